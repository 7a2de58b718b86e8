"""Global ids and distributions. Ids are 1-based; distributions are half-open and 0-based."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import sfc
from gridloom.functions.tables import materialise, numbered


def from_keys(df: DataFrame, keys: Sequence[str], out: str = "gnum") -> DataFrame:
    """Dense id of each row's key in the order of distinct keys."""
    held = [F.col(k).alias(f"_k_{k}") for k in keys]
    ids = numbered(df.select(*held).distinct(), [f"_k_{k}" for k in keys], out)
    cond = None
    for k in keys:
        same = df[k].eqNullSafe(ids[f"_k_{k}"])
        cond = same if cond is None else cond & same
    return df.join(ids, cond).drop(*[f"_k_{k}" for k in keys])


def from_tuples(df: DataFrame, keys: Sequence[str], out: str = "gnum") -> DataFrame:
    """Dense id of n-tuples, ordered by one plus the sum of their absolute values and then by the tuples."""
    total = F.lit(1).cast("long")
    for k in keys:
        total = total + F.abs(F.col(k).cast("long"))
    return from_keys(df.withColumn("_sum", total), ["_sum", *keys], out).drop("_sum")


def from_coordinates(df: DataFrame, axes: Sequence[str] = ("x", "y", "z"), merge: bool = False, level: int = 20, order: Sequence[str] = (), out: str = "gnum") -> DataFrame:
    """Dense id in Morton order, ties by coordinates; merge gives coincident points one id."""
    box = df.agg(*[f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)]).first()
    low, high = [box[f"min_{a}"] for a in axes], [box[f"max_{a}"] for a in axes]
    if low[0] is None:
        return df.withColumn(out, F.lit(None).cast("long"))
    key = sfc.morton([sfc.grid(F.col(a), lo, hi, level) for a, lo, hi in zip(axes, low, high, strict=True)], level)
    keyed = df.withColumn("_key", key)
    if merge:
        return from_keys(keyed, ["_key", *axes], out).drop("_key")
    return numbered(keyed, ["_key", *axes, *order], out).drop("_key")


def from_shared(df: DataFrame, graph: DataFrame, out: str = "gnum") -> DataFrame:
    """Dense ids of entities (rank, part, lnum) of which some are shared, as a symmetric graph of all copies says (rank,
    part, lnum, o_rank, o_part, o_lnum). The lowest copy owns an entity; ids go by the owner's rank and part, there first
    those that nobody shares and then the shared ones, each by lnum. All copies get their owner's id."""
    me = ["rank", "part", "lnum"]
    low = graph.groupBy(*me).agg(F.min(F.struct(*[F.col(f"o_{c}").alias(c) for c in me])).alias("_other"))
    owned = df.join(low, me, "left").withColumn("_shared", F.col("_other").isNotNull().cast("int"))
    owned = owned.withColumn("_own", F.least(F.struct(*me), F.coalesce("_other", F.struct(*me))))
    keys = {"_r": F.col("_own.rank"), "_p": F.col("_own.part"), "_s": F.col("_shared"), "_l": F.col("_own.lnum")}
    keyed = materialise(owned.select(*df.columns, *[c.alias(k) for k, c in keys.items()]))  # the graph is read once
    return from_keys(keyed, list(keys), out).drop(*keys)


def invert(perm: DataFrame) -> DataFrame:
    """(gnum, image) of a permutation of 1 .. n as the same of its inverse."""
    return perm.select(F.col("image").alias("gnum"), F.col("gnum").alias("image"))


def permute(df: DataFrame, perm: DataFrame) -> DataFrame:
    """Rows of df under their new ids: the row of gnum goes to image."""
    return df.join(perm, "gnum").drop("gnum").withColumnRenamed("image", "gnum").select(*df.columns)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts of equal intervals [low, high), closed at the end; bin 0 is below, bins + 1 above."""
    b = F.when(F.col(column) == high, bins).otherwise(F.width_bucket(F.col(column), F.lit(float(low)), F.lit(float(high)), F.lit(bins)))
    return df.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def unique_in_order(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row a key, the first in order."""
    every = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    return df.groupBy(key).agg(F.min(every).alias("_first")).select(*[F.col("_first")[c].alias(c) for c in df.columns])


def uniform_distribution(spark, n: int, ranks: int, start: int = 0) -> DataFrame:
    """(rank, lo, hi): n ids over ranks, the first n % ranks of them one larger."""
    r = F.col("id")
    small, more = n // ranks, n % ranks
    lo = r * small + F.least(r, F.lit(more)) + start
    return spark.range(ranks).select(r.cast("int").alias("rank"), lo.alias("lo"), (lo + small + F.when(r < more, 1).otherwise(0)).cast("long").alias("hi"))


def counted_distribution(counts: DataFrame, start: int = 0) -> DataFrame:
    """(rank, lo, hi) from (rank, n): running sums."""
    w = Window.partitionBy(F.lit(0)).orderBy("rank")
    hi = F.sum("n").over(w) + start
    return counts.select("rank", (hi - F.col("n")).alias("lo"), hi.alias("hi"))


def weighted_split(df: DataFrame, weight: str, ranks: int, order: Sequence[str], out: str = "rank") -> DataFrame:
    """Contiguous blocks in the given order with nearly equal weight: a row goes by the middle of its own weight.

    The running weight comes from range-sorted partitions and the sums of those before, never from one window.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(weight).alias("_w"))
    before = sums.select("_part", F.coalesce(F.sum("_w").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_w").over(Window.partitionBy(F.lit(0))).alias("_all"))
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    mid = F.col("_before") + F.col("_inside") - F.col(weight) / 2
    rank = F.least(F.floor(mid * ranks / F.col("_all")), F.lit(ranks - 1)).cast("int")
    return parts.withColumn("_inside", inside).join(before, "_part").withColumn(out, rank).drop("_part", "_before", "_all", "_inside")
