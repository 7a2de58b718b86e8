"""Grouped reductions whose result goes back to every member of the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATIONS = {"min": F.min, "max": F.max, "sum": F.sum}


def reduce_fields(df: DataFrame, fields: Sequence[str], operation: str) -> DataFrame:
    """Each member gets the min, max or sum over its gnum. Partial sums precede the shuffle; a hot id is one row after."""
    f = OPERATIONS[operation]
    total = df.groupBy("gnum").agg(*[f(x).alias(f"{operation}_{x}") for x in fields])
    return df.join(total, "gnum")


def mean_fields(df: DataFrame, fields: Sequence[str], weight: str | None = None, least: float = 1e-15) -> DataFrame:
    """Weighted mean over each gnum; an absolute weight under `least` is an error."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = df.groupBy("gnum").agg(F.sum(w).alias("_w"), *[F.sum(w * F.col(x)).alias(f"_{x}") for x in fields])
    ok = F.when(F.abs("_w") < least, F.raise_error(F.lit("weights of an id sum to zero")).cast("double")).otherwise(F.col("_w"))
    means = sums.select("gnum", *[(F.col(f"_{x}") / ok).alias(f"mean_{x}") for x in fields])
    return df.join(means, "gnum")


def global_weights(df: DataFrame, weight: str) -> DataFrame:
    return reduce_fields(df, [weight], "sum").withColumnRenamed(f"sum_{weight}", "global_weight")
