"""Benchmark decontamination by a generalised suffix automaton (operator 2).

The normalised items form a generalised suffix automaton over word numbers. Each document's words stream through it; the
automaton's state gives, at each word, the longest suffix that some item contains. Where that length reaches `window`
words, or the state or one of its suffixes is a whole item of fewer words, the words of the match are hit.

Items go to the workers in blocks of at most `block_bytes` (a larger item is a block of its own). The driver reads and
broadcasts one block at a time and the documents stream through it, so what the driver and a worker hold is bounded
however large the benchmark is. An ordinary benchmark is one block, and then nothing is written. With several, each pass
writes the digests, hits and items of the texts that it hit, and a last one brings them together by digest; texts stay
where they are. Blocks split between items, and hits add up over blocks.

Defined results: null and empty texts have no words and no hits; items without words are ignored, as are null items'
texts; repeated items count once per item_id; repeated documents give repeated rows; an empty benchmark hits nothing; an
empty table gives an empty one; other columns are ignored by the report and kept by removal, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import marked, materialise

WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of 0-9, a-z and non-ASCII bytes, which is UTF-8's image of the word pattern."""
    return text.translate(WORD_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with windows of `window` words and shorter whole items marked."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = []
        for name, words in items:
            if words:
                numbered.append((name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
        for _, seq in numbered:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: of a state: the items that have the window (or are the short item) that ends there
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for name, seq in numbered:
            s = 0
            for i, c in enumerate(seq):
                s = self.next[s][c]
                if i + 1 >= window:
                    while self.link[s] >= 0 and self.length[self.link[s]] >= window:
                        s = self.link[s]
                    self.windows.setdefault(s, set()).add(name)
            if len(seq) < window:
                self.short.setdefault(s, (len(seq), set()))[1].add(name)
        #: of a state: the short items among its suffixes
        self.inner: list[list[tuple[int, set[str]]]] = [[] for _ in self.link]
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            own = [self.short[s]] if s in self.short else []
            self.inner[s] = self.inner[self.link[s]] + own
        self.root = self.next[0]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The word ranges [a, b) of occurring windows, merged, and the items that they are from."""
        get, nxt, link, length, inner, window = self.vocab.get, self.next, self.link, self.length, self.inner, self.window
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        met: set[int] = set()
        s = n = 0
        for i, c in enumerate(map(get, words)):
            if c is None:
                s = n = 0
                continue
            t = nxt[s].get(c)
            if t is None:
                while s >= 0 and c not in nxt[s]:
                    s = link[s]
                if s < 0:
                    s = n = 0
                    continue
                n = length[s] + 1
                t = nxt[s][c]
            else:
                n += 1
            s = t
            reach = 0
            if n >= window:
                reach = window
                w = s
                while link[w] >= 0 and length[link[w]] >= window:
                    w = link[w]
                if w not in met:
                    met.add(w)
                    items |= self.windows[w]
            if inner[s]:
                for m, names in inner[s]:
                    if m <= n:
                        reach = max(reach, m)
                        if -s - 1 not in met:
                            items |= names
                if inner[s][-1][0] <= n:
                    met.add(-s - 1)  # all short items of the state are in
            if reach:
                a, b = i + 1 - reach, i + 1
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, b))
        return spans, items


def item_blocks(items: DataFrame, block_bytes: int):
    """The items in blocks of at most block_bytes, one at a time; at least one block, which may be empty."""
    rows = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        text = bytes(r["t"])
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], text))
        size += len(text)
    yield block


def contamination(df: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 8_000_000, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), cut: bool = False) -> DataFrame:
    """keep, n_words, hit ranges as flat array<int> of word bounds, and item ids, for each row.

    cut: the __text in keep comes back without the words of its ranges.
    """
    picked = df.select(*[c for c in keep if c != "__text"], F.col(text_col).alias("__text"))
    blocks = item_blocks(items, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return searched(picked, block, window, keep, cut)
    digest = F.md5(F.coalesce("__text", F.lit("")).cast("binary")).alias("key")
    texts, found = picked.select(digest, "__text"), []
    while block is not None:
        hit = searched(texts, block, window, ("key",)).where("size(ranges) > 0")
        found.append(materialise(hit.groupBy("key").agg(F.first("ranges").alias("ranges"), F.first("items").alias("items"))))
        block, after = after, next(blocks, None)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))  # a row a block
    every = materialise(every)
    told = marked(picked.select("*", digest), every, "key")
    none = [F.lit(None).cast("array<int>").alias("ranges"), F.lit(None).cast("array<string>").alias("items")]
    met = told.where("__mark").join(every, "key", "left").select(*picked.columns, "ranges", "items")
    return searched(told.where("NOT __mark").select(*picked.columns, *none).unionByName(met), None, window, keep, cut)


def searched(df: DataFrame, items: list[tuple[str, bytes]] | None, window: int, keep: tuple[str, ...], cut: bool = False) -> DataFrame:
    """keep, n_words, ranges and items of df's __text with one block of items; without one, of the hits that df has."""
    shared = df.sparkSession.sparkContext.broadcast(items) if items is not None else None  # at most block_bytes, or one item

    def run(batches):
        automaton = SuffixAutomaton([(i, words_of(t)) for i, t in shared.value], window) if shared else None
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            docs = [words_of(t or b"") for t in texts]
            if automaton:
                found = [automaton.hits(words) for words in docs]
            else:
                held = zip(batch.column("ranges").to_pylist(), batch.column("items").to_pylist(), strict=True)
                found = [(list(zip(r[::2], r[1::2], strict=True)), set(n)) if r else ([], set()) for r, n in held]
            ranges = [[x for r in merged(f[0]) for x in r] for f in found]
            kept = {c: batch.column(c) for c in keep}
            if cut and any(ranges):
                kept["__text"] = pa.array([without(t, r) if r else t for t, r in zip(texts, ranges, strict=True)], pa.binary()).cast(pa.string())
            cols = [
                pa.array([len(d) for d in docs], pa.int64()),
                pa.array(ranges, pa.list_(pa.int32())),
                pa.array([sorted(f[1]) for f in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*kept.values(), *cols], names=[*keep, "n_words", "ranges", "items"])

    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.mapInArrow(run, head + "n_words bigint, ranges array<int>, items array<string>")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def report(df: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The digest: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.expr("aggregate(sequence(0, size(ranges) div 2), 0L, (s, k) -> s + coalesce(get(ranges, 2 * k + 1) - get(ranges, 2 * k), 0))")
    out = contamination(df, items, window)
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"),
    )


def remove_spans(df: DataFrame, items: DataFrame, window: int = 10, drop_coverage: float = 0.5, text_col: str = "text") -> DataFrame:
    """df with the hit words cut out of its texts; rows with at least drop_coverage of their words hit are removed.

    Rows without hits keep their text byte for byte. A cut takes the bytes from the first word of a range to the end of
    its last word and leaves one space where it joins two words.
    """
    names = df.columns
    plain = {c: f"__{k}" if c != text_col else "__text" for k, c in enumerate(names)}
    numbered = df.select(*[F.col(f"`{c}`").alias(x) for c, x in plain.items()])
    spans = contamination(numbered, items, window, text_col="__text", keep=tuple(plain.values()), cut=True)
    hit = F.expr("aggregate(sequence(0, size(ranges) div 2), 0L, (s, k) -> s + coalesce(get(ranges, 2 * k + 1) - get(ranges, 2 * k), 0))")
    kept = spans.where((F.size("ranges") == 0) | (hit < drop_coverage * F.col("n_words")))
    return kept.select(*[F.col(x).alias(c) for c, x in plain.items()])


def without(raw: bytes, ranges: list[int]) -> bytes:
    at = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", raw.translate(WORD_TABLE))]
    out, last = [], 0
    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    out.append(raw[last:])
    return b" ".join(x.strip(b" ") for x in out if x.strip(b" "))


def items_digest(names) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (
    SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM g),
p AS (
  SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), m AS (SELECT p.r, p.k, p.n, g.item FROM p JOIN g USING (n, gram)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM m) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""
