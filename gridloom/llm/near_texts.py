"""One document of each group of near-duplicate texts, by SimHash and an exact check.

Candidates come from the trie self-join of simhash.py over fingerprints of a text's distinct words: a text that differs
from another in a few words keeps almost all of its words, so its fingerprint differs in few bits (at most `max_bits`).
Each text has `PRINTS` fingerprints, of independent hashes of its words; a pair is a candidate if one of them is within
the bits. A candidate link counts if the five-word shingles of the two texts have a Jaccard similarity of `similarity`
or more. Equal texts (by 128-bit digests) are one class from the start.

Every text that has a candidate is found by the trie join, which gives its smallest and its nearest partner in each
bucket; the rest is over these texts alone. Each has a map of 1,024 bits of its shingles, which bounds what it can share
with another text from above: a pair that the maps rule out can't reach the similarity and isn't looked at further. The
pairs that are left are checked by their shingles: first those of the trie join, then, for `ROUNDS` rounds (one, as given), each text's
nearest partner in each bucket that isn't in its group yet, as groups grow together by few links; at last every pair that
is still apart, in chunks of at most half as many pairs as there are texts (`PAIRS` at least); what a chunk links leaves
the next ones. So each candidate pair is checked, ruled out by its maps, or lies in one group by links that passed.

Classes are numbered in the order of their smallest doc_ids, so the smallest number of a group names the row that stays,
and no group is ever gathered. Texts move only where they must: a bitmap (`marked`) tells texts that may be in a candidate
pair, or in a group of more than one row, from those that surely aren't; the latter are never shuffled.

Of every group the row with the smallest doc_id stays (of equal doc_ids one, null last). Null and empty texts have no
shingles: they are equal to each other and to nothing else. Empty tables give empty ones; other columns are kept,
whatever their names. Fingerprints are a filter, not a proof: on random texts and on the 0.1 tables 0.96 or more of the
pairs with a similarity of 0.8 to 0.85 are candidates, and 0.97 or more of the more similar ones (README).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import marked, materialise, text_or_empty
from gridloom.llm.simhash import MAP_WORDS, components, crossing_pairs, fingerprint_links, majority, may_be_similar, shingle_hashes, shingle_map


#: PAIRS: least number of candidate pairs that are checked at once.
PRINTS, ROUNDS, PAIRS = 2, 1, 1_000_000


def sketches(df: DataFrame, width: int) -> DataFrame:
    """(node, n, map, shingles): the distinct 64-bit hashes of each text's shingles, sorted, their number and map."""

    def run(batches):
        for batch in batches:
            out = [np.unique(shingle_hashes(t or b"", width, 42, True)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            cols = [
                pa.array(list(map(len, out)), pa.int64()), pa.array([shingle_map(h) for h in out], pa.list_(pa.int64())),
                pa.array([h.view(np.int64) for h in out], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["node", "n", "map", "shingles"])

    return df.select("node", "text").mapInArrow(run, "node bigint, n bigint, map array<bigint>, shingles array<bigint>")


def both_sides(pairs: DataFrame, held: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """pairs with the columns of held for a (a_..) and b (b_..)."""
    for side in "ab":
        pairs = pairs.join(held.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def hopeful(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs that their maps don't rule out."""

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column(k).to_numpy() for k in ("a_n", "b_n")])
            maps = np.concatenate([batch.column(k).flatten().to_numpy() for k in ("a_map", "b_map")]).reshape(-1, MAP_WORDS)
            can = may_be_similar(n, maps, np.arange(m), np.arange(m, 2 * m), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(can, pa.bool_()))

    return both_sides(pairs, held, ("n", "map")).select("a", "b", "a_n", "b_n", "a_map", "b_map").mapInArrow(run, "a bigint, b bigint")


def similar(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets, in held, reach the similarity."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("a_shingles"), batch.column("b_shingles")
            keep = []
            for i in range(batch.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                n = len(p) + len(q)
                both = n - len(np.unique(np.concatenate([p, q]))) if min(len(p), len(q)) >= similarity * max(len(p), len(q)) else 0
                keep.append(bool(both) and both >= similarity * (n - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both_sides(pairs, held, ("shingles",)).select("a", "b", "a_shingles", "b_shingles").mapInArrow(run, "a bigint, b bigint")


def other_hashes(h: np.ndarray, turn: int) -> np.ndarray:
    """An independent hash of the same words: a bijection that mixes all bits."""
    z = h + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_prints(text: bytes) -> list[int]:
    h = shingle_hashes(text, 1, 42, True)
    return [majority(h if k == 0 else other_hashes(h, k)) for k in range(PRINTS)]


def keep_one(df: DataFrame, max_bits: int = 6, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns."""
    plain = {c: f"__{k}" for k, c in enumerate(df.columns)}
    text, row_id = text_or_empty(plain[text_col]), plain[id_col]
    named = df.select(*[F.col(f"`{c}`").alias(x) for c, x in plain.items()]).withColumn("key", F.md5(text.cast("binary")))

    def run(batches):
        for batch in batches:
            out = [word_prints(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["key", "id", "fps"])

    kind = df.schema[id_col].dataType.simpleString()
    prints = materialise(named.select("key", F.col(row_id).alias("id"), text.alias("text")).mapInArrow(run, f"key string, id {kind}, fps array<bigint>"))
    classes = prints.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("low"), F.count("*").alias("n"), F.first("fps").alias("fps"))
    order = [F.col("low.none"), F.col("low.id"), F.col("key")]
    classes = classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id())  # in order
    classes = materialise(classes.select("key", "node", F.col("low.id").alias("low"), "n", "fps"))
    each = classes.select("node", F.posexplode("fps").alias("turn", "fp"))
    reps = materialise(each.groupBy("turn", "fp").agg(F.min("node").alias("rep")))
    star = each.join(reps, ["turn", "fp"]).where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(reps.select("fp", "turn"), max_bits, emit="leaders")
    a, b = reps.select(F.col("fp").alias("fa"), F.col("rep").alias("ra")), reps.select(F.col("fp").alias("fb"), F.col("rep").alias("rb"))
    across = links.join(a, links["a"] == a["fa"]).join(b, links["b"] == b["fb"]).where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    pairs = materialise(star.unionByName(across).distinct())
    # the texts that have a candidate, and their shingles
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialise(wanted.join(classes.select("node", "key", "fps"), "node"))
    texts = marked(named.select("key", text.alias("text")), wanted, "key").where("__mark").join(wanted, "key").dropDuplicates(["node"])
    held = materialise(sketches(texts, width), 1000)
    nodes = wanted.select("node")
    rows = materialise(wanted.select("node", F.posexplode("fps").alias("turn", "fp")).join(held.select("node", "n", "map"), "node"))
    real = materialise(similar(hopeful(pairs, held, similarity), held, similarity))
    roots = materialise(components(nodes, real))

    def apart(best):
        return materialise(crossing_pairs(rows.join(roots.withColumnRenamed("root", "comp"), "node"), max_bits, similarity, best))

    def linked(more):
        nonlocal real, roots
        if not more.limit(1).count():
            return False
        real = materialise(real.unionByName(more))
        roots = materialise(components(nodes, real))
        return True

    for _ in range(ROUNDS):
        if not linked(materialise(similar(apart(True), held, similarity))):
            break
    left = apart(False)
    most, turn = max(PAIRS, classes.count() // 2), 0
    while n := left.count():
        turn, chunks = turn + 1, -(-n // most)
        dealt = F.pmod(F.xxhash64(F.lit(turn), "a", "b"), F.lit(chunks))
        linked(materialise(similar(left if chunks == 1 else left.where(dealt == 0), held, similarity)))
        if chunks == 1:
            break
        left = left.where(dealt != 0)
        left = left.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = materialise(left.where("ra <> rb").select("a", "b"))
    # texts without a candidate are their own groups
    roots = classes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    # the class that names its group keeps one row; other classes of the group keep none
    several = materialise(classes.join(roots, "node").where("n > 1 OR node <> root").select("key", "low", (F.col("node") == F.col("root")).alias("names")))
    told = marked(named, several, "key").withColumn("__id", plain_id(F.col(row_id)))
    columns = [F.col(x).alias(c) for c, x in plain.items()]
    alone = told.where("NOT __mark").select(*columns)
    maybe = told.where("__mark")
    other = maybe.join(several.select("key"), "key", "left_anti").select(*columns)  # they only share a marked bit with a group
    own = several.where("names").select("key", plain_id(F.col("low")).alias("__id"))
    kept = maybe.join(own, ["key", "__id"]).dropDuplicates(["key", "__id"]).select(*columns)
    return alone.unionByName(other).unionByName(kept)


def plain_id(column):
    return F.coalesce(column.cast("string"), F.lit("null"))
