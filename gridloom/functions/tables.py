"""Lineage cuts and partition-wise running counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, MutableMapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_path(spark: SparkSession) -> str:
    """A path of no one's yet in the folder that spark.checkpoint.dir names."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def kept_while_used(spark: SparkSession, path: str) -> str:
    """The path, whose folder (made where it isn't there) goes when the session ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the folder that spark.checkpoint.dir names and read it back. The table goes when the session ends."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return shuffled(spark.read.schema(df.schema).parquet(kept_while_used(spark, path)))


def shuffled(df: DataFrame) -> DataFrame:
    """df, which joins don't send through the driver. Spark takes a table for as large as its packed files, a range for as
    large as its ids, and an array for one element: what explodes to millions of rows would still count as small. Sides that
    are small whatever the input are named by F.broadcast, which goes before."""
    return df.hint("merge")


def absent(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df with keys that `seen` hasn't. As an anti join Spark may move it ahead of the grouping that made df, and
    would sort what the grouping gets instead of what it gives."""
    held = seen.select(*keys, F.lit(True).alias("_seen"))
    return df.join(held, keys, "left").where(F.col("_seen").isNull()).select(*df.columns)


class Frames(MutableMapping):
    """Frames by name, each made when it is first asked for, from those before it: nobody pays for what nobody reads."""

    def __init__(self, makers: dict[str, Callable[[Frames], DataFrame]]) -> None:
        self.makers, self.made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name](self)
        return self.made[name]

    def __setitem__(self, name: str, frame: DataFrame) -> None:
        self.makers[name], self.made[name] = lambda _: frame, frame

    def __delitem__(self, name: str) -> None:
        del self.makers[name]
        self.made.pop(name, None)

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def numbered(df: DataFrame, by: list[str], out: str = "gnum", within: list[str] | None = None) -> DataFrame:
    """df with a dense number from 1 in the order of by, and within each group of `within` if given.

    A range sort spreads the rows, which are written with their places in their partitions; each partition counts its own
    rows, and the counts of the partitions before give its offset. Without groups the rows move no further. A group goes
    on into a partition only as its first one and from a partition only as its last one, so a row for each partition
    tells the offsets, which are broadcast.
    """
    group = [*(within or [])]
    keys = [*group, *by]
    place = F.monotonically_increasing_id()  # the partition, and below 33 bits the row
    parts = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", place))
    part = F.shiftright("_place", 33).alias("_part")
    every = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if not group:
        counts = parts.groupBy(part).agg(F.count("*").alias("_n"))
        before = counts.select("_part", F.coalesce(F.sum("_n").over(every), F.lit(0)).alias("_before"))
        rows = parts.withColumn("_part", part).join(F.broadcast(before), "_part")
        inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        return rows.withColumn(out, (inside + F.col("_before")).cast("long")).select(*df.columns, out)
    one = F.struct(*group)
    ends = materialise(parts.groupBy(part).agg(F.min(one).alias("_first"), F.max(one).alias("_last")))
    last = parts.withColumn("_part", part).join(F.broadcast(ends), "_part").where(one.eqNullSafe(F.col("_last"))).groupBy("_part").agg(F.count("*").alias("_n"))
    tails = ends.join(F.broadcast(last), "_part").select(F.col("_part").alias("_q"), F.col("_last").alias("_g"), "_n")
    ahead = ends.join(F.broadcast(tails), (F.col("_q") < F.col("_part")) & F.col("_first").eqNullSafe(F.col("_g"))).groupBy("_part", F.col("_first").alias("_g")).agg(F.sum("_n").alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", *group).orderBy("_place"))
    rows = parts.withColumn("_part", part).withColumn("_inside", inside).withColumn("_own", one)
    met = rows.join(F.broadcast(ahead.withColumnRenamed("_part", "_p")), (F.col("_part") == F.col("_p")) & F.col("_own").eqNullSafe(F.col("_g")), "left")
    return met.withColumn(out, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("long")).select(*df.columns, out)


HOT = 4096


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], most: int = HOT) -> DataFrame:
    """The inner join on keys, where a key may hold a large share of either side: the right rows of a key with more than
    `most` of them are dealt over as many chunks, and the left rows of that key go to each chunk, so no task has more than
    about `most` right rows of one key. The hot keys are at most the right rows over `most`."""
    many = right.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_chunks"))
    many = materialise(many)
    if not many.limit(1).count():
        return left.join(right, keys)
    own = [c for c in right.columns if c not in keys]
    dealt = right.join(many, keys, "left").withColumn("_chunk", F.when(F.col("_chunks").isNotNull(), F.pmod(F.xxhash64(*own), F.col("_chunks"))).otherwise(0).cast("int")).drop("_chunks")
    each = left.join(many, keys, "left").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1))).drop("_chunks")
    return each.join(dealt, [*keys, "_chunk"]).drop("_chunk")
