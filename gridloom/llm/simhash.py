"""SimHash near-duplicate detection by a binary-trie self-join (operator 9).

Each document gets a 64-bit fingerprint: a bit is 1 if it is set in over half of the 64-bit hashes of its shingles.
Fingerprints that differ in at most `max_bits` bits are linked, without loss:

* equal fingerprints collapse first, so copies never meet in the join, however many there are;
* the 64 bits are cut into `max_bits + k` blocks; two fingerprints within the budget agree on at least k whole blocks, so
  each fingerprint goes once to every choice of k blocks, keyed by their contents; k is the one that makes the fewest rows
  (`fewest_rows`): 1 for few fingerprints, 2 or 3 for so many that the buckets of fewer bits would have to be cut often;
* in a bucket, the sorted fingerprints are an implicit binary trie. Pairs of its nodes are traversed together, the bits
  in which they differ are added up, and a pair is dropped once its budget is exceeded. Many buckets are traversed at
  once, level by level, in chunks of bounded size;
* a bucket of more than `bucket_rows` fingerprints is cut into salted parts that meet pair by pair, so no task needs a
  whole hot bucket;
* a bucket emits a spanning forest of its links, never all pairs; components follow by iterated minimum labels over
  tables in the shared folder. Nothing of this passes through the driver but convergence counts.

Defined results: null text counts as empty; an empty text has fingerprint zero and links like any other; repeated rows
give repeated rows with equal results; a component's id is the smallest doc_id in it (null doc_ids are ignored, and a
component of only null doc_ids has a null id); other columns of the input are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise

SALTS = 32
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, width: int, seed: int, distinct: bool) -> np.ndarray:
    """XXH64 of each word shingle (fewer words: the whole sequence; none: no hashes)."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if width == 1:
        grams = words
    elif len(words) <= width:
        grams = [b" ".join(words)]
    else:
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - width].tolist()]
        grams = [flat[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    if distinct:
        grams = set(grams)
    return np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64, len(grams))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit integer. Long documents are added up in blocks."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[i : i + 65536])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)) if len(hashes) else np.zeros(64, bool)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, width: int = 4, seed: int = 42, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for each row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            out = [majority(shingle_hashes(t or b"", width, seed, distinct)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def trie_pairs(group: np.ndarray, fp: np.ndarray, side: np.ndarray | None, max_bits: int, chunk: int = 1 << 14, comp: np.ndarray | None = None):
    """Index pairs (i, j) with equal group and at most max_bits differing bits. group and fp are sorted together.

    A node is a run of rows that share a group and a bit prefix. side: if given, only pairs of different sides count
    where a bucket was cut in two. comp: if given, only pairs of different comp count, and two runs of one and the same
    comp are left at once. Yields arrays; the frontier is kept in chunks, depth first.
    """
    n = len(fp)
    if n < 2:
        return
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[cuts[1:], n]
    many = ends - cuts > 1
    lo, hi = cuts[many], ends[many]
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    turns = None if comp is None else np.r_[0, np.cumsum(comp[1:] != comp[:-1])]

    def split(bit, lo, hi):
        """First row of each run whose bit is 1: rows of a run are sorted, so it is a binary search."""
        a, b = lo.copy(), hi.copy()
        mask = np.uint64(1) << np.uint64(bit)
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            one = (fp[np.minimum(mid, n - 1)] & mask) != 0
            b = np.where(open_ & one, mid, b)
            a = np.where(open_ & ~one, mid + 1, a)
        return a

    while stack:
        bit, alo, ahi, blo, bhi, errs = stack.pop()
        if len(alo) > chunk:
            half = len(alo) // 2
            stack.append((bit, alo[half:], ahi[half:], blo[half:], bhi[half:], errs[half:]))
            alo, ahi, blo, bhi, errs = alo[:half], ahi[:half], blo[:half], bhi[:half], errs[:half]
            stack.append((bit, alo, ahi, blo, bhi, errs))
            continue
        if comp is not None:
            one = (turns[alo] == turns[ahi - 1]) & (turns[blo] == turns[bhi - 1]) & (comp[alo] == comp[blo])
            alo, ahi, blo, bhi, errs = (x[~one] for x in (alo, ahi, blo, bhi, errs))
        small = (ahi - alo) * (bhi - blo) <= 64
        if bit < 0 and not small.all():
            for a0, a1, b0, b1 in zip(*(x[~small].tolist() for x in (alo, ahi, blo, bhi)), strict=True):
                step = max(1, (1 << 18) // (b1 - b0))
                for a in range(a0, a1, step):
                    e = min(a1, a + step)
                    for node in ((a, e, a, e), (a, e, e, b1)) if a0 == b0 else ((a, e, b0, b1),):
                        for i, j in leaves(*(np.array([x]) for x in node), fp, side, max_bits):
                            yield (i, j) if comp is None else (i[comp[i] != comp[j]], j[comp[i] != comp[j]])
            alo, ahi, blo, bhi, errs = (x[small] for x in (alo, ahi, blo, bhi, errs))
            small = small[small]
        if small.any():
            for i in range(0, int(small.sum()), 1 << 12):
                for x, y in leaves(*(x[small][i : i + (1 << 12)] for x in (alo, ahi, blo, bhi)), fp, side, max_bits):
                    yield (x, y) if comp is None else (x[comp[x] != comp[y]], y[comp[x] != comp[y]])
        keep = ~small
        if not keep.any():
            continue
        alo, ahi, blo, bhi, errs = (x[keep] for x in (alo, ahi, blo, bhi, errs))
        am, bm = split(bit, alo, ahi), split(bit, blo, bhi)
        same = alo == blo
        out = [
            (alo, am, blo, bm, errs, None),
            (am, ahi, bm, bhi, errs, None),
            (alo, am, bm, bhi, errs + 1, None),
            (am, ahi, blo, bm, errs + 1, ~same),
        ]
        parts = []
        for a0, a1, b0, b1, e, also in out:
            ok = (a0 < a1) & (b0 < b1) & (e <= max_bits) & ~((a0 == b0) & (a1 - a0 < 2))
            if also is not None:
                ok &= also
            parts.append(tuple(x[ok] for x in (a0, a1, b0, b1, e)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def leaves(alo, ahi, blo, bhi, fp, side, max_bits):
    """Compare the rows of small node pairs directly."""
    na, nb = ahi - alo, bhi - blo
    size = na * nb
    which = np.repeat(np.arange(len(size)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    i = alo[which] + at // nb[which]
    j = blo[which] + at % nb[which]
    ok = (i < j) | (alo[which] != blo[which])
    if side is not None:
        ok &= (side[i] != side[j]) | (side[i] < 0)
    ok &= np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
    yield i[ok], j[ok]


def spanning(n: int, pairs) -> list[tuple[int, int]]:
    """A spanning forest of the links, by union-find."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


def block_masks(max_bits: int, agree: int = 2) -> list[int]:
    """For each choice of `agree` of the max_bits + agree blocks, the mask of their bits: two fingerprints within the budget
    agree on at least so many whole blocks."""
    signed = [sum(c) for c in combinations(block_bits(max_bits, agree), agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in signed]


def block_bits(max_bits: int, agree: int) -> list[int]:
    n = max_bits + agree
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def fewest_rows(n: int, max_bits: int, bucket_rows: int) -> int:
    """How many blocks should agree, so that n fingerprints make the fewest rows: a row for each choice of blocks and for
    each part that an average bucket is cut into."""
    return min((1, 2, 3), key=lambda k: comb(max_bits + k, k) * -(-n // (bucket_rows << (64 * k // (max_bits + k)))))


def fingerprint_links(fps: DataFrame, max_bits: int = 4, bucket_rows: int = 4096, emit: str = "forest") -> DataFrame:
    """Links (a, b) between the distinct fingerprints in fps (fp long); with a column turn, between those of one turn.

    emit "forest": a spanning forest of each bucket's links. "leaders": for each fingerprint its smallest and its
    nearest linked fingerprint in the bucket, for links that a later exact check may turn down.
    """
    agree = fewest_rows(fps.count(), max_bits, bucket_rows)
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(max_bits, agree)])
    turn = [F.col("turn")] if "turn" in fps.columns else []
    rows = fps.select("fp", *turn, F.posexplode(masks).alias("slot", "mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    rows = rows.select("fp", F.xxhash64("slot", "part", *turn).alias("bucket"))
    hot = rows.groupBy("bucket").count().where(F.col("count") > bucket_rows)
    hot = materialise(hot.select("bucket", F.ceil(F.col("count") / bucket_rows).cast("int").alias("cuts")))
    plain = rows.withColumn("side", F.lit(-1)).withColumn("key", F.col("bucket"))
    if hot.limit(1).count():
        plain = plain.join(hot, "bucket", "left_anti")
        cut = rows.join(hot, "bucket").withColumn("own", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("cuts")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        first, second = F.least("own", "other"), F.greatest("own", "other")
        cut = cut.select("fp", "bucket", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), F.xxhash64("bucket", first, second).alias("key"))
        plain = plain.unionByName(cut)
    keyed = plain.select("key", "fp", "side").repartition("key").sortWithinPartitions("key")

    def links(keys, fp, side):
        unsigned = fp.view(np.uint64)
        order = np.lexsort((unsigned, keys))
        keys, unsigned, side = keys[order], unsigned[order], side[order]
        sides = None if (side < 0).all() else side
        found = trie_pairs(keys, unsigned, sides, max_bits)
        signed = unsigned.view(np.int64)
        if emit == "forest":
            edges = spanning(len(keys), found)
            a = signed[np.array([e[0] for e in edges], np.int64)]
            b = signed[np.array([e[1] for e in edges], np.int64)]
        else:
            low = np.arange(len(keys))
            near, dist = np.full(len(keys), -1), np.full(len(keys), 65)
            for i, j in found:
                np.minimum.at(low, j, i)
                np.minimum.at(low, i, j)
                for x, y in ((i, j), (j, i)):
                    d = np.bitwise_count(unsigned[x] ^ unsigned[y]).astype(np.int64)
                    by = np.lexsort((d, x))
                    first = by[np.r_[True, x[by][1:] != x[by][:-1]]] if len(by) else by
                    better = d[first] < dist[x[first]]
                    near[x[first[better]]], dist[x[first[better]]] = y[first[better]], d[first[better]]
            at = np.arange(len(keys))
            i = np.r_[at[low != at], at[near >= 0]]
            j = np.r_[low[low != at], near[near >= 0]]
            a, b = signed[i], signed[j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        """Whole buckets at a time; the last, unfinished bucket of a batch waits for the next one."""
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        for batch in batches:
            held = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(held)]
            keys = held[0]
            end = len(keys) - int((keys == keys[-1]).sum()) if len(keys) else 0
            if end >= 50_000:
                yield links(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if len(held[0]):
            yield links(*held)

    return keyed.mapInArrow(run, "a bigint, b bigint").distinct()


MAP_WORDS = 16


def shingle_map(hashes: np.ndarray) -> np.ndarray:
    """The residues of a set of hashes as bits of MAP_WORDS 64-bit words."""
    bits = np.zeros(64 * MAP_WORDS, bool)
    bits[hashes % np.uint64(64 * MAP_WORDS)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def may_be_similar(n: np.ndarray, maps: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets i and j can have the Jaccard similarity: each bit of one map that the other lacks is a hash that the
    other set lacks, so a set shares no more than its size less these. Never wrong about a pair that has it."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        p, q = maps[x].view(np.uint64), maps[y].view(np.uint64)
        both = np.minimum(n[x] - np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64), n[y] - np.bitwise_count(q & ~p).sum(axis=1, dtype=np.int64))
        out[k : k + (1 << 16)] = both >= similarity * (n[x] + n[y] - both)
    return out


def crossing_pairs(nodes: DataFrame, max_bits: int, similarity: float, best: bool = False, bucket_rows: int = 4096) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints differ in at most max_bits bits, whose comp differs and whose shingle sets
    can have the similarity by their maps. best: of each row in a bucket only the nearest such partner; else every pair,
    once a turn, given by the first blocks in which it agrees, so that its other buckets of the turn stay silent.

    nodes: (node, turn, fp, comp, n, map array<long>); a node may have several rows, of which those of one turn meet.
    Pairs leave a task in batches of bounded size.
    """
    agree = fewest_rows(nodes.select("node").distinct().count(), max_bits, bucket_rows)
    masks = block_masks(max_bits, agree)
    blocks = [np.uint64(m) for m in block_bits(max_bits, agree)]
    slots = np.full(1 << len(blocks), -1, np.int32)
    for k, c in enumerate(combinations(range(len(blocks)), agree)):
        slots[sum(1 << x for x in c)] = k
    # light rows tell which buckets have several comps, as one has nothing to give; only what is left gets its maps
    rows = nodes.select("node", "turn", "comp", "fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("slot", "mask"))
    rows = rows.select("node", "turn", "comp", "slot", F.xxhash64("turn", "slot", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    held = rows.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    held = materialise(held.where("least < most").select("bucket", F.ceil(F.col("rows") / bucket_rows).cast("int").alias("cuts")))
    kept = rows.join(held, "bucket").select("node", "turn", "slot", "bucket", "cuts").join(nodes, ["node", "turn"])
    cut = kept.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("cuts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    key = F.xxhash64("bucket", first, second).alias("key")
    keyed = cut.select(key, "fp", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "slot", "comp", "node", "n", "map")
    keyed = keyed.repartition("key").sortWithinPartitions("key")

    def batches_of(keys, fp, side, slot, comp, node, n, maps):
        unsigned = fp.view(np.uint64)
        order = np.lexsort((comp, unsigned, keys))
        keys, unsigned, side, slot, comp, node, n, maps = (x[order] for x in (keys, unsigned, side, slot, comp, node, n, maps))
        near, dist = np.full(len(keys), -1), np.full(len(keys), 65)
        for i, j in trie_pairs(keys, unsigned, None if (side < 0).all() else side, max_bits, comp=comp):
            can = may_be_similar(n, maps, i, j, similarity)
            i, j = i[can], j[can]
            differ = unsigned[i] ^ unsigned[j]
            if best:
                d = np.bitwise_count(differ).astype(np.int64)
                for x, y in ((i, j), (j, i)):
                    by = np.lexsort((d, x))
                    first_of = by[np.r_[True, x[by][1:] != x[by][:-1]]] if len(by) else by
                    better = first_of[d[first_of] < dist[x[first_of]]]
                    near[x[better]], dist[x[better]] = y[better], d[better]
                continue
            equal = np.stack([differ & b == 0 for b in blocks])
            first_ones = equal & (equal.cumsum(axis=0) <= agree)
            own = (slots[(first_ones << np.arange(len(blocks))[:, None]).sum(axis=0)] == slot[i]) & (slot[i] == slot[j])
            if own.any():
                yield node[i[own]], node[j[own]]
        at = np.flatnonzero(near >= 0)
        if len(at):
            yield node[at], node[near[at]]

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(7)] + [batch.column(7).flatten().to_numpy().reshape(-1, MAP_WORDS)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            keys = held[0]
            end = len(keys) - int((keys == keys[-1]).sum()) if len(keys) else 0
            if end >= 50_000:
                yield from map(pair_batch, batches_of(*(x[:end] for x in held)))
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield from map(pair_batch, batches_of(*held))

    return keyed.mapInArrow(run, "a bigint, b bigint").distinct()


def pair_batch(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    a, b = pair
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def components(nodes: DataFrame, links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b). Nodes without links are their own roots.

    Alternates large-star and small-star steps, each a grouped minimum; every step ends in a written table.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = materialise(links.where("a <> b").distinct())
    last = None
    for _ in range(most):
        near = both(edges).groupBy("u").agg(F.min("v").alias("m"))
        near = near.select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u goes to the smallest in u's neighbourhood
        large = both(edges).join(near, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        step = large.join(small, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
        step = step.unionByName(small.select(F.col("m").alias("x"), F.col("b").alias("y"))).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        edges = materialise(step)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("b").agg(F.min("a").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["b"], "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(df: DataFrame, max_bits: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; see the module's text."""
    prints = materialise(fingerprints(df, width, seed, id_col=id_col, text_col=text_col))
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("copies")))
    linked = components(nodes.select(F.col("fp").alias("node")), fingerprint_links(nodes.select("fp"), max_bits))
    roots = materialise(linked)
    lows = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "low")
    # a large component is spread: its rows are salted, and its one result goes to each salt
    by_root = lows.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    by_root = by_root.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    named = salted.join(by_root, ["root", "salt"], "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    # the fingerprints of a thousandth of the rows and more, a thousand of them at most, are spread in the same way
    rows = nodes.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(nodes.where(F.col("copies") > rows / 1000).select("fp", F.lit(True).alias("hot")))
    salt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    dealt = prints.join(hot, "fp", "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0))
    every = F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))
    named = named.join(hot, "fp", "left").withColumn("salt", F.explode(every)).drop("hot")
    return dealt.join(named, ["fp", "salt"]).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
