"""Ranked lexical search by block-max pruning (operator 11).

Documents, in the order in which Spark reads them, form blocks: ranges of at most `BLOCK_DOCS` documents or
`BLOCK_POSTINGS` postings. A block's row holds its forward index (of each document, the query terms in it with their
counts) and its distinct terms; once the corpus counts are known, a second table holds impacts in place of counts, and
each term's greatest impact in the block. A term's part of a score is its weight in the query times its impact, so the
weighted sum of a block's maxima bounds the score of every document in it.

1. Seeds: from the maxima alone, the `SEEDS` blocks of the highest bounds of each query, over all blocks; their documents
   are scored, and a query's k-th best score among them is its first threshold.
2. Search: each task goes through its blocks; of each batch it sorts a query's blocks by bound and scores them until the
   bound drops below the threshold, which rises with the documents found. What beats the thresholds, at most k documents
   for each task and query, is ranked at the end.

Bounds only skip blocks without a document of the result, so results are exact, ties included. Nothing that grows with
the documents is broadcast or read by the driver: those are the queries' terms, weights and thresholds. Queries beyond
`MOST_TOKENS` terms are taken in several groups, one after another, each over all documents.

Defined results: null texts and texts without terms match nothing and don't count in N; items without terms, or without a
matching document, have no rows; equal rows of items are one item; items of one id and different texts are ranked on their
own; repeated documents each take a rank; equal scores go by doc_id, a null doc_id last (as is 2 ** 63 - 1, which stands
for it); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise
from gridloom.llm.decontaminate import words_of

BLOCK_DOCS, BLOCK_POSTINGS, SEEDS, MOST_TOKENS, PIECE = 64, 1 << 16, 4, 1 << 20, 1 << 20
NO_ID = (1 << 63) - 1
FORWARD = "block long, docs array<long>, lengths array<long>, ptr array<int>, terms array<int>, counts array<int>, own array<int>, df array<int>, n_docs long, n_words long"
INDEX = "block long, docs array<long>, ptr array<int>, terms array<int>, impacts array<int>, own array<int>, maxima array<int>"


def pieces(text: bytes):
    """A text in pieces of about PIECE bytes, cut where no term is."""
    a = 0
    while len(text) - a > PIECE:
        cut = max(text.rfind(b" ", a, a + PIECE), text.rfind(b"\n", a, a + PIECE))
        if cut <= a:  # a piece without white space
            after = [x for x in (text.find(b" ", a + PIECE), text.find(b"\n", a + PIECE)) if x >= 0]
            cut = min(after, default=len(text))
        yield text[a:cut]
        a = cut
    yield text[a:]


def counted(text: bytes | None, vocabulary: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """The number of a text's terms, and how often each term of the vocabulary occurs."""
    n, found = 0, Counter()
    for piece in pieces(text or b""):
        words = words_of(piece)
        n += len(words)
        found.update(map(vocabulary.get, words))
    found.pop(None, None)
    return n, found


def lists(rows: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def forward(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """FORWARD rows, one a block, of (doc_id, text); documents without a term of the vocabulary only count."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)  # MOST_TOKENS terms at most

    def run(batches):
        held = shared.value
        serial = TaskContext.get().partitionId() << 32
        docs, lengths, parts, total, n_docs, n_words = [], [], [], 0, 0, 0

        def row():
            sizes = np.array([len(t) for t, _ in parts], np.int64)
            terms = np.concatenate([t for t, _ in parts]) if parts else np.empty(0, np.int32)
            counts = np.concatenate([c for _, c in parts]) if parts else np.empty(0, np.int32)
            own, df = np.unique(terms, return_counts=True)
            arrays = [lists([x], k) for x, k in ((docs, pa.int64()), (lengths, pa.int64()), (np.append(0, sizes.cumsum()).astype(np.int32), pa.int32()), (terms, pa.int32()), (counts, pa.int32()), (own, pa.int32()), (df.astype(np.int32), pa.int32()))]
            names = [c.split()[0] for c in FORWARD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([serial]), *arrays, pa.array([n_docs]), pa.array([n_words])], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = counted(text.as_py(), held)
                n_docs, n_words = n_docs + (n > 0), n_words + n
                if found:
                    terms = np.fromiter(found, np.int32, len(found))
                    order = np.argsort(terms)
                    docs.append(NO_ID if doc is None else doc)
                    lengths.append(n)
                    parts.append((terms[order], np.fromiter(found.values(), np.int32, len(found))[order]))
                    total += len(terms)
                if len(docs) >= BLOCK_DOCS or total >= BLOCK_POSTINGS:
                    yield row()
                    serial += 1
                    docs, lengths, parts, total, n_docs, n_words = [], [], [], 0, 0, 0
        if n_docs:
            yield row()

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, FORWARD)


def with_impacts(blocks: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """INDEX rows of FORWARD rows."""

    def run(batches):
        for batch in batches:
            impacts, maxima = [], []
            for lengths, ptr, terms, counts, own in zip(*[batch.column(k) for k in (2, 3, 4, 5, 6)], strict=True):
                terms, tf = terms.values.to_numpy(), counts.values.to_numpy().astype(np.int64)
                m = np.array([25 + 75 * n * n_docs // n_words for n in lengths.as_py()], np.int64)
                each = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ptr.values.to_numpy())))
                most = np.zeros(len(own.values), np.int64)
                np.maximum.at(most, np.searchsorted(own.values.to_numpy(), terms), each)
                impacts.append(each.astype(np.int32))
                maxima.append(most.astype(np.int32))
            arrays = [batch.column(k) for k in (0, 1, 3, 4)] + [lists(impacts, pa.int32()), batch.column(6), lists(maxima, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in INDEX.split(", ")])

    return blocks.mapInArrow(run, INDEX)


class Queries:
    """Queries over term numbers: their terms side by side, each with its weight times its repeats."""

    def __init__(self, items: list[Counter], weights: np.ndarray):
        self.start = np.append(0, np.cumsum([len(q) for q in items])).astype(np.int64)
        self.terms = np.array([t for q in items for t in q], np.int64)
        self.weight = np.array([n for q in items for n in q.values()], np.int64) * weights[self.terms]
        self.size = len(weights)

    def bounds(self, own: np.ndarray, maxima: np.ndarray) -> np.ndarray:
        """Of each query, the most that a document of a block can score."""
        most = np.zeros(self.size, np.int64)
        most[own] = maxima
        return np.add.reduceat(self.weight * most[self.terms], self.start[:-1])

    def dense(self, q: int) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        out[self.terms[self.start[q] : self.start[q + 1]]] = self.weight[self.start[q] : self.start[q + 1]]
        return out


def scores(weight: np.ndarray, ptr: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Of each document of a block; weight: a query's, by term."""
    run = np.append(0, np.cumsum(weight[terms] * impacts))
    return run[ptr[1:]] - run[ptr[:-1]]


def best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k first of (-score, doc)."""
    found.sort()
    return found[:k]


def search_blocks(index: DataFrame, shared, floors, k: int, chosen: bool = False) -> DataFrame:
    """(item, doc, score): what each task finds that may be among the k best, given a floor of each query's k-th best
    score. chosen: a last column, items, says which queries a block is meant for."""

    def run(batches):
        queries, floor = shared.value, floors.value.copy()
        found: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            rows = [[batch.column(c)[i].values.to_numpy() for c in range(1, 7)] for i in range(batch.num_rows)]
            if not rows:
                continue
            bound = np.array([queries.bounds(own, maxima) for *_, own, maxima in rows])
            if chosen:
                meant = np.zeros(bound.shape, bool)
                for i, items in enumerate(batch.column(7).to_pylist()):
                    meant[i, items] = True
                bound[~meant] = 0
            for q in np.flatnonzero((bound >= np.maximum(floor, 1)).any(axis=0)):
                weight, top = queries.dense(q), found.get(q, [])
                for b in np.argsort(-bound[:, q], kind="stable"):
                    if bound[b, q] < max(floor[q], 1):
                        break
                    docs, ptr, terms, impacts, _, _ = rows[b]
                    s = scores(weight, ptr, terms, impacts)
                    at = np.flatnonzero(s >= max(floor[q], 1))
                    if len(at):
                        top = best(top + list(zip((-s[at]).tolist(), docs[at].tolist(), strict=True)), k)
                        if len(top) == k:
                            floor[q] = max(floor[q], -top[-1][0])
                found[q] = top
        flat = [(q, d, -s) for q, top in found.items() for s, d in top]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in range(3)], names=["item", "doc", "score"])

    return index.mapInArrow(run, "item long, doc long, score long")


def seed_blocks(index: DataFrame, shared, seeds: int) -> DataFrame:
    """(block, items): the blocks of each query's highest bounds and the queries that chose them, from the maxima alone."""

    def run(batches):
        queries, top = shared.value, None
        blocks = np.empty((0, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bound = np.array([queries.bounds(o.values.to_numpy(), m.values.to_numpy()) for o, m in zip(batch.column(1), batch.column(2), strict=True)])
            name = np.broadcast_to(batch.column(0).to_numpy()[:, None], bound.shape)
            top, blocks = (bound, name) if top is None else (np.concatenate([top, bound]), np.concatenate([blocks, name]))
            order = np.lexsort((blocks, -top), axis=0)[:seeds]
            top, blocks = np.take_along_axis(top, order, 0), np.take_along_axis(blocks, order, 0)
        if top is not None:
            at, q = np.nonzero(top)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(top[at, q]), pa.array(blocks[at, q])], names=["item", "bound", "block"])

    own = index.select("block", "own", "maxima").mapInArrow(run, "item long, bound long, block long")
    first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))
    return own.withColumn("r", first).where(F.col("r") <= seeds).groupBy("block").agg(F.collect_list("item").alias("items"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", order.cast("int")).where(F.col("rank") <= k)


def search_group(documents: DataFrame, names: list, items: list[list[bytes]], k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of one group of queries; names: their ids, items: their terms, not empty."""
    spark = documents.sparkSession
    vocabulary: dict[bytes, int] = {}
    numbered = [Counter(vocabulary.setdefault(w, len(vocabulary)) for w in words) for words in items]
    blocks = materialise(forward(documents, vocabulary))
    stats = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("l")).first()
    n_docs, n_words = stats["n"] or 0, stats["l"] or 0
    held = blocks.select(F.explode(F.arrays_zip("own", "df")).alias("x")).groupBy("x.own").agg(F.sum("x.df").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for r in held.collect():  # a row for each term of the queries at most
        df[r["own"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    shared = spark.sparkContext.broadcast(Queries(numbered, weights))
    index = materialise(with_impacts(blocks.where(F.size("docs") > 0), n_docs, max(n_words, 1)))
    floors = np.zeros(len(items), np.int64)
    seeds = materialise(seed_blocks(index, shared, SEEDS))  # SEEDS rows a query at most
    known = search_blocks(index.join(seeds, "block").select(*index.columns, "items"), shared, spark.sparkContext.broadcast(floors), k, chosen=True)
    for r in ranked(known, k).where(F.col("rank") == k).collect():  # a row a query
        floors[r["item"]] = r["score"]
    found = ranked(search_blocks(index, shared, spark.sparkContext.broadcast(floors), k), k)
    at = spark.createDataFrame(list(enumerate(names)), "item long, item_id long")
    doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return found.join(F.broadcast(at), "item").select("item_id", "rank", doc.alias("doc_id"), "score")


def groups_of(items: DataFrame) -> list[DataFrame]:
    """The items in groups of about MOST_TOKENS words; an item is never cut."""
    rows = items.where("text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 2 / MOST_TOKENS))  # a term takes two bytes with what parts it from the next, at least
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g) for g in range(n)]


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of each item (item_id, text) with the highest scores
    above 0."""
    out = None
    for group in groups_of(items):
        rows = [(r["item_id"], words_of(bytes(r["text"]))) for r in group.orderBy("item_id", "text").toLocalIterator()]
        rows = [(name, words) for name, words in rows if words]
        if rows:
            found = search_group(documents, *map(list, zip(*rows, strict=True)), k)
            out = found if out is None else out.unionByName(found)
    return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


ORACLE_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT row_number() OVER () AS k, doc_id, w, len(w) AS n FROM low WHERE len(w) > 0),
c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
q AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS (SELECT item, item_id, t, count(*) AS r FROM (SELECT item, item_id, unnest(w) AS t FROM q) GROUP BY ALL),
p AS (SELECT k, doc_id, n, t, count(*) AS tf FROM (SELECT k, doc_id, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
i AS (SELECT k, doc_id, t, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))) AS v FROM p JOIN f USING (t), c),
s AS (SELECT item, item_id, k, doc_id, CAST(sum(r * v) AS BIGINT) AS score FROM qt JOIN i USING (t) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
