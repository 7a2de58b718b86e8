"""Near-dedup checks every candidate pair, not only leaders."""

import random

import numpy as np
import pytest

from gridloom.llm import near_texts, simhash
from tests.llm.test_pipeline import shingles


def expected(rows, max_bits=6):
    """doc_ids that stay when all pairs within max_bits are checked."""
    fps = [near_texts.word_prints(t.encode()) for _, t in rows]
    sets, par = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if any(((p ^ q) & (1 << 64) - 1).bit_count() <= max_bits for p, q in zip(fps[i], fps[j], strict=True)) and both >= 0.8 * len(sets[i] | sets[j]):
                par[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[i][0] for i in range(len(rows)) if root(i) == i}


def test_texts_of_one_fingerprint(spark):
    rng, rows = random.Random(5), []
    for k in range(6):
        words = [f"w{i}" for i in range(120)]
        rng.shuffle(words)
        rows.append((2 * k, " ".join(words)))
        words[60], words[61] = words[61], words[60]
        rows.append((2 * k + 1, " ".join(words)))
    want = expected(rows)
    got = {r.doc_id for r in near_texts.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert want == set(range(0, 12, 2)) and got == want


def test_noisy_copies(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "PAIRS", 3000)
    rng, rows = random.Random(7), []
    base = [f"word{rng.randrange(4000)}" for _ in range(400)]
    for k in range(120):
        words = list(base)
        for at in rng.sample(range(400), 7 + k % 5):
            words[at] = f"word{rng.randrange(4000)}"
        rows.append((k, " ".join(words)))
    rows.append((500, " ".join(base)))
    want = expected(rows)
    got = {r.doc_id for r in near_texts.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and len(want) < 60


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_pairs_of_each_block_choice(spark, monkeypatch, agree):
    """Every pair within the bits that the maps allow, once a turn, in cut buckets too."""
    monkeypatch.setattr(simhash, "fewest_rows", lambda *_: agree)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(x) for x in rng.choice(62, rng.integers(0, 5), replace=False)) for b in base for _ in range(15)]
    full = [-1] * simhash.MAP_WORDS
    rows = [(k, t, fps[k] if t == 0 else fps[-1 - k], k % 50, 10, full) for k in range(len(fps)) for t in (0, 1)]
    df = spark.createDataFrame(rows, "node long, turn int, fp long, comp long, n long, map array<long>")
    want = {(i, j) for t in (0, 1) for i in range(len(fps)) for j in range(i + 1, len(fps)) if i % 50 != j % 50 and ((fps[i] ^ fps[j]) if t == 0 else (fps[-1 - i] ^ fps[-1 - j])).bit_count() <= 6}
    for size in (4096, 8):
        assert {(r.a, r.b) for r in simhash.crossing_pairs(df, 6, 0.8, bucket_rows=size).collect()} == want
    best = {(r.a, r.b) for r in simhash.crossing_pairs(df, 6, 0.8, best=True).collect()}
    assert best <= want and {x for p in best for x in p} == {x for p in want for x in p}


def test_maps_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    for size in (5, 100, 900, 5000):
        base = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        sets = [np.unique(np.r_[rng.choice(base, size, replace=False)[: int(size * rng.uniform(0.8, 1))], base[: size // 2]]) for _ in range(30)]
        n, maps = np.array(list(map(len, sets))), np.array([simhash.shingle_map(x) for x in sets])
        i, j = np.triu_indices(30, 1)
        real = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
        for limit in (0.5, 0.7, 0.8):
            assert simhash.may_be_similar(n, maps, i, j, limit)[real >= limit].all()
