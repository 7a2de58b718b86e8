"""The parts of the personal-data operator against brute force."""

import math
import random
import time

from pyspark.sql import functions as F

from gridloom.llm import pii


def test_running_values(spark):
    rng = random.Random(2)
    rows = [(n, [rng.randrange(100) for _ in range(n)]) for n in (1, 2, 3, 10, 50, 333)]
    df = spark.createDataFrame(rows, "n int, x array<int>")
    got = df.select("n", pii.running(F.col("x"), 0, lambda a, b: a + b).alias("s"), pii.running(F.col("x"), 0, lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r, (_, x) in zip(sorted(got), rows, strict=True):
        assert r.s == [sum(x[: i + 1]) for i in range(len(x))] and r.m == [max(x[: i + 1]) for i in range(len(x))]


def test_apart(spark):
    rng = random.Random(4)
    make = lambda kinds: sorted((a := rng.randrange(300), rng.choice(kinds), a + rng.randrange(1, 9)) for _ in range(rng.randrange(12)))
    rows = [(i, make(range(4)), make(range(4, 9))) for i in range(200)]
    span = "array<struct<at: int, k: int, end: int>>"
    df = spark.createDataFrame(rows, f"i int, base {span}, wider {span}")
    got = {r.i: [tuple(s) for s in r.a] for r in df.select("i", pii.apart(F.col("base"), F.col("wider")).alias("a")).collect()}
    for i, base, wider in rows:
        assert got[i] == [w for w in wider if not any(b[0] < w[2] and w[0] < b[2] for b in base)]


def synthetic(n=40_000, seed=6):
    """Votes of labelers of known accuracies that abstain at times."""
    rng, truth = random.Random(seed), {"form": (0.9, 0.7), "gazetteer": (0.75, 0.95), "context": (0.8, 0.85)}
    kind = pii.KINDS.index("local")
    counts: dict[tuple, int] = {}
    for _ in range(n):
        real = rng.random() < 0.35
        votes = []
        for no, yes in truth.values():
            right = rng.random() < (yes if real else no)
            votes.append(0 if rng.random() < 0.3 else 1 if right == real else 2)
        counts[kind, *votes] = counts.get((kind, *votes), 0) + 1
    return [(*k, n) for k, n in sorted(counts.items())]


def brute_em(rows, rounds=200):
    """The same estimates, row by row in plain Python: posteriors by pattern of votes."""
    sure, share = [[0.8, 0.8] for _ in range(3)], 0.5
    for _ in range(rounds):
        post = []
        for _, *v, _n in rows:
            odds = math.log(share / (1 - share))
            for x, (no, yes) in zip(v, sure, strict=True):
                odds += math.log(yes / (1 - no)) if x == 1 else math.log((1 - yes) / no) if x == 2 else 0
            post.append(1 / (1 + math.exp(-odds)))
        for i in range(3):
            for c in (0, 1):
                w = [(r[-1] * (p if c else 1 - p), r[1 + i]) for r, p in zip(rows, post, strict=True)]
                sure[i][c] = (sum(x for x, v in w if v == 2 - c) + 8) / (sum(x for x, v in w if v) + 10)
        share = (sum(r[-1] * p for r, p in zip(rows, post, strict=True)) + 1) / (sum(r[-1] for r in rows) + 2)
    return post, sure, share


def test_reliabilities(spark):
    rows = synthetic()
    want, sure, share = brute_em(rows)
    df = spark.createDataFrame(rows, "k int, form int, gazetteer int, context int, n long")
    got = {r[:4]: r.p for r in df.select("k", "form", "gazetteer", "context", pii.reliabilities(df, rounds=200, settled=1e-6).alias("p")).collect()}
    assert all(abs(got[r[:4]] - p) < 1e-3 for r, p in zip(rows, want, strict=True))
    assert abs(share - 0.35) < 0.05 and all(abs(a - b) < 0.08 for x, y in zip(sure, ((0.9, 0.7), (0.75, 0.95), (0.8, 0.85)), strict=True) for a, b in zip(x, y, strict=True))


def test_classifier_weights(spark):
    kind = pii.KINDS.index("local")
    rows = [(kind, 1, 3, 0, 0, 5, 30, 0.9), (kind, 1, 3, 3, 3, 5, 10, 0.2), (kind, 2, 3, 0, 0, 7, 8, 0.6)]
    names = list(pii.FEATURES)
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names) + ", n int, p double")
    odds, weights = pii.classifier(df, F.col("p"))
    yes, no = sum(r[-2] * r[-1] for r in rows), sum(r[-2] * (1 - r[-1]) for r in rows)
    assert abs(odds - math.log((yes + 1) / (no + 1))) < 1e-9
    for i, (name, size) in enumerate(pii.FEATURES.items()):
        for v in {r[i] for r in rows}:
            a, b = (sum(r[-2] * (r[-1] if c else 1 - r[-1]) for r in rows if r[i] == v) + 1 for c in (1, 0))
            assert abs(weights[name][v] - math.log(a / (yes + 1 + size) / (b / (no + 1 + size)))) < 1e-9


def test_names_and_orders(spark):
    rows = [(i, f"Dear Maria Keller{'abcdefghij'[i % 10]}, please call 4{i % 10}2 664 10{i % 90 + 10} in London.") for i in range(80)]
    rows += [(100 + i, f"order 112-664-10{i % 90 + 10} of part 9{i % 10}1-00-1234 shipped") for i in range(80)]
    got = {r.doc_id: r.spans for r in pii.find_personal(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i].startswith("name:5:18,local:32:") for i in range(80)) and not any(got[100 + i] for i in range(80))


def test_many_spans_in_one_text(spark):
    df = spark.createDataFrame([(1, "1.2.3.4 (312) 664-2222 " * 6000)], "doc_id bigint, text string")
    pii.find_personal(df.limit(0)).collect()
    began = time.time()
    r = pii.find_personal(df).first()
    assert r.n_ip == 6000 and time.time() - began < 20


def test_no_python_in_the_plan(spark):
    df = spark.range(3).selectExpr("id as doc_id", "'a@b.co' as text")
    plan = pii.find_personal(df)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("InArrow", "InPandas", "PythonUDF", "BatchEval"))
