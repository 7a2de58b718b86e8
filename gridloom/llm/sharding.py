"""Sharding by rendezvous hashing (operator 8).

A record's key and each shard's number give a hash u in (0, 1); the shard of the smallest -ln(u) / weight takes the
record. The hash depends on nothing else, so another shard takes records only into itself, and a changed weight moves
only its share. Slots within a shard come from a range sort of the light rows (no texts) and the counts of the sorted
partitions before: no shard is ever one task.

Defined results: a null key hashes as the word `null`; a null text has size 1 and the CRC of the empty text; rows with
equal keys share a shard, and equal rows take neighbouring slots; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, text_or_empty


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0 .. len(weights) - 1 of a key."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def cost(j: int, w: float) -> Column:
        digits = F.substring(F.md5(F.concat(text, F.lit(f":{j}")).cast("binary")), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / F.lit(float(w))).alias("cost"), F.lit(j).alias("shard"))

    return F.array_min(F.array(*[cost(j, w) for j, w in enumerate(weights)]))["shard"]


def shard(df: DataFrame, weights: Sequence[float] = (1.0,) * 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = text_or_empty(text_col)
    light = df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(id_col), weights).alias("shard"), rendezvous(F.col(id_col), [*weights, 1.0]).alias("grown_shard"),
    )
    keys = ["shard", "doc_id", "text_crc32", "size"]
    parts = materialise(light).repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = materialise(parts.withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("shard", "part").agg(F.count("*").alias("n"))
    by_shard = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "part", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", "shard").orderBy("doc_id", "text_crc32", "size"))
    out = parts.withColumn("inside", inside).join(before, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"), "grown_shard")


def oracle_sql(shards: int = 16) -> str:
    """The result of equal weights as DuckDB SQL; CRC-32 goes bit by bit over a text's bytes, its table made by its rule."""
    steps = "CAST(i AS BIGINT)"
    for _ in range(8):
        steps = f"(SELECT CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM (SELECT {steps} AS c))"
    return f"""
WITH crc AS (SELECT list({steps} ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT doc_id, key, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2), lambda k: CAST('0x' || h[2 * k + 1 : 2 * k + 2] AS BIGINT)),
      lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295::BIGINT) AS BIGINT) AS text_crc32
  FROM d, crc),
c AS (
  SELECT *, list_transform(range({shards + 1}), lambda j: -ln((CAST('0x' || substr(md5(key || ':' || j), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)) AS cost FROM s),
p AS (
  SELECT doc_id, size, text_crc32, CAST(list_position(cost, list_min(cost[1 : {shards}])) - 1 AS INTEGER) AS shard,
    CAST(list_position(cost, list_min(cost)) - 1 AS INTEGER) AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM p
"""
