"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes in an Arrow batch: with the default of 64 MB, a batch of long texts and its copies take hundreds of MB of a
#: Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark.conf.get(name).rstrip("bB"))
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset, on one machine."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        held = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def materialise(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing. The
    table goes when the session ends. file_rows: most rows of a file, for wide rows, as readers take up to 4,096 of a file at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


MARK_BITS = 24


def marked(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """df with __mark: false only where the key in `column` is surely not among keys (key).

    A bitmap of 2 ** MARK_BITS hashed keys, at most 2 ** (MARK_BITS - 6) rows whatever the input, is broadcast; rows that
    it marks by a collision cost a little work in the exact join that has to follow."""
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MARK_BITS))
    bit = keys.select(h(F.col("key")).alias("h"))
    words = bit.groupBy(F.shiftright("h", 6).alias("__chunk")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("__word"))
    out = df.withColumn("__h", h(F.col(column))).withColumn("__chunk", F.shiftright("__h", 6))
    out = out.join(F.broadcast(words), "__chunk", "left")
    mark = F.expr("coalesce(shiftright(__word, cast(__h & 63 AS int)) & 1L, 0L) = 1L")
    return out.withColumn("__mark", mark).drop("__h", "__chunk", "__word")
