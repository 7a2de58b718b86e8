"""Column functions and helpers over tables."""
