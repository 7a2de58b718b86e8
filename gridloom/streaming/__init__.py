"""Structured Streaming forms of the reductions, for frames that arrive in time steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduce_steps(stream: DataFrame, fields: Sequence[str], time: str, step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sum, minimum and maximum of each field by id and time step; rows later than the watermark go."""
    aggs = [f(c).alias(f"{f.__name__}_{c}") for c in fields for f in (F.sum, F.min, F.max)]
    return stream.withWatermark(time, late).groupBy(F.window(time, step).alias("step"), "gnum").agg(*aggs, F.count("*").alias("n"))


def first_of_each(stream: DataFrame, keys: Sequence[str], time: str, late: str = "2 hours") -> DataFrame:
    """One row of each key within the watermark: cleanup of a stream."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
