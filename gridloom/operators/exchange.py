"""Exchanges between partitioned frames (rank, part, lnum, gnum, values) and block frames (gnum, values)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.tables import numbered, spread_join

TRIPLET = ("rank", "part", "lnum")


def to_block(df: DataFrame, values: Sequence[str], mode: str = "cleanup", order: Sequence[str] = TRIPLET) -> DataFrame:
    """Partition to block, by gnum.

    nothing: all rows, by gnum and arrival. cleanup: the first row of each gnum. merge: all rows with their place `pos`
    (from 0) among those of their gnum, in arrival order; a gnum of many rows is spread over tasks. arrays: merge, as one
    row of arrays a gnum, for ids of few rows. count: rows of each gnum. Arrival is `order`, which takes the place of an
    unspecified one.
    """
    if mode == "nothing":
        return df.select("gnum", *order, *values).repartitionByRange("gnum").sortWithinPartitions("gnum", *order)
    if mode == "count":
        return df.groupBy("gnum").agg(F.count("*").alias("n"))
    row = F.struct(*order, *[F.col(v).alias(f"v_{v}") for v in values])
    if mode == "cleanup":
        return df.groupBy("gnum").agg(F.min(row).alias("r")).select("gnum", *[F.col("r")[f"v_{v}"].alias(v) for v in values])
    if mode == "merge":
        rows = numbered(df.select("gnum", *order, *values), [*order, *[v for v in values if v not in order]], "pos", ["gnum"])
        return rows.select("gnum", (F.col("pos") - 1).alias("pos"), *values)
    if mode == "arrays":
        rows = df.groupBy("gnum").agg(F.array_sort(F.collect_list(row)).alias("r"))
        return rows.select("gnum", *[F.col("r")[f"v_{v}"].alias(v) for v in values])
    raise ValueError(mode)


def to_parts(df: DataFrame, block: DataFrame, how: str = "inner") -> DataFrame:
    """Block to partition: each row fetches the block row of abs(gnum). how="left": a sparse block, nulls where absent."""
    return df.withColumn("_g", F.abs("gnum")).join(block.withColumnRenamed("gnum", "_bg"), F.col("_g") == F.col("_bg"), how).drop("_g", "_bg")


def reverse(df: DataFrame, values: Sequence[str], order: Sequence[str] = TRIPLET) -> DataFrame:
    """Each contributor gets the merged values of its gnum, as arrays."""
    merged = to_block(df, values, "arrays", order)
    return df.select(*order, "gnum").join(merged, "gnum")


def to_other_block(block: DataFrame, distribution: DataFrame) -> DataFrame:
    """Block re-layout: rank and position under another distribution (rank, lo, hi), one small row a rank."""
    d = distribution.select("rank", "lo", "hi")
    return block.join(F.broadcast(d), (F.col("gnum") - 1 >= F.col("lo")) & (F.col("gnum") - 1 < F.col("hi"))).withColumn("pos", F.col("gnum") - 1 - F.col("lo")).drop("lo", "hi")


def multi_block(blocks: Sequence[DataFrame], sizes: Sequence[int]) -> DataFrame:
    """Several blocks as one, ids shifted by the sizes before."""
    out, shift = None, 0
    for b, n in zip(blocks, sizes, strict=True):
        moved = b.withColumn("gnum", F.col("gnum") + shift)
        out = moved if out is None else out.unionByName(moved)
        shift += n
    return out


def across(bridge: DataFrame, values: DataFrame) -> DataFrame:
    """Part 1 to part 2 over (gnum1, gnum2): part 2 rows get the values of the gnum1 that name them."""
    return bridge.join(values.withColumnRenamed("gnum", "gnum1"), "gnum1")


def back(bridge: DataFrame, values: DataFrame) -> DataFrame:
    """Part 2 to part 1 over (gnum1, gnum2): each gnum1 gets the values of the gnum2 that it names."""
    return bridge.join(values.withColumnRenamed("gnum", "gnum2"), "gnum2")


def across_triplets(bridge: DataFrame, values: DataFrame) -> DataFrame:
    """Part 1 to part 2 where the bridge names part 2 by place: (gnum1, o_rank, o_part, o_lnum). Part 2's places get the
    values of the gnum1 that name them, in the order of gnum1 (pos)."""
    met = bridge.join(values.withColumnRenamed("gnum", "gnum1"), "gnum1")
    place = ["o_rank", "o_part", "o_lnum"]
    return numbered(met, ["gnum1"], "pos", place).select(*[F.col(c).alias(c[2:]) for c in place], "pos", "gnum1", *[c for c in values.columns if c != "gnum"])


def referenced(bridge: DataFrame, part2: DataFrame) -> DataFrame:
    return part2.join(bridge.select(F.col("gnum2").alias("gnum")), "gnum", "left_semi")


def unreferenced(bridge: DataFrame, part2: DataFrame) -> DataFrame:
    return part2.join(bridge.select(F.col("gnum2").alias("gnum")), "gnum", "left_anti")


def come_from(bridge: DataFrame) -> DataFrame:
    """(gnum2, pos, gnum1): for each referenced id the distinct ids that name it, sorted."""
    return numbered(bridge.select("gnum1", "gnum2").distinct(), ["gnum1"], "pos", ["gnum2"])


def neighbours(values: DataFrame, graph: DataFrame) -> DataFrame:
    """Along (rank, part, lnum, pos, o_rank, o_part, o_lnum), each entity gets the values of its neighbours."""
    other = values.select(*[F.col(c).alias(f"o_{c}") if c in TRIPLET else F.col(c) for c in values.columns])
    return graph.join(other, ["o_rank", "o_part", "o_lnum"])


def location(df: DataFrame) -> DataFrame:
    """(gnum, pos, rank, part, lnum): where each global id lives."""
    return numbered(df.select("gnum", *TRIPLET), list(TRIPLET), "pos", ["gnum"])


def shared_graph(df: DataFrame) -> DataFrame:
    """Communication graph: pairs of copies of one gnum on different parts."""
    a = df.select("gnum", *TRIPLET)
    b = df.select("gnum", *[F.col(c).alias(f"o_{c}") for c in TRIPLET])
    return spread_join(a, b, ["gnum"]).where("rank <> o_rank OR part <> o_part")


def owners(df: DataFrame) -> DataFrame:
    """df with the owner of each gnum: the lowest (rank, part, lnum)."""
    own = df.groupBy("gnum").agg(F.min(F.struct(*TRIPLET)).alias("_o"), F.count("*").alias("copies"))
    return df.join(own, "gnum").select(*df.columns, F.col("_o.rank").alias("own_rank"), F.col("_o.part").alias("own_part"), F.col("_o.lnum").alias("own_lnum"), "copies")
