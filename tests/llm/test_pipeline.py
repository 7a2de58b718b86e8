"""The pipeline's stages against brute force on small tables."""

import re
import tempfile

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import near_texts

SF = "/root/testdata/sf0.01"


def shingles(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    sets = [shingles(t) for _, t in rows]
    par = list(range(len(rows)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) >= 0.8 * max(a, b) and (n := len(sets[i] & sets[j])) >= 0.8 * (a + b - n):
                par[max(root(i), root(j))] = min(root(i), root(j))
                links += 1
    want = {rows[i][0] for i in range(len(rows)) if root(i) == i}
    got = {r.doc_id for r in near_texts.keep_one(docs).select("doc_id").collect()}
    assert links > 20 and want <= got
    assert len(got - want) <= 0.02 * (len(rows) - len(want))


def test_near_dedup_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(100))
    rows = [(5, "same text"), (3, "same text"), (3, "same text"), (None, "same text"), (7, None), (8, ""), (9, long), (10, long + " end"), (11, long.replace("word50", "other")), (12, long[: len(long) // 2]), (None, "alone"), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as key", "2 as low", "3 as root")
    got = sorted(near_texts.keep_one(df).collect(), key=str)
    assert sorted((r.doc_id, r.text is None) for r in got if r.doc_id is not None) == [(3, False), (7, True), (9, False), (12, False)]
    assert sum(r.doc_id is None for r in got) == 1 and got[0].asDict().keys() == {"doc_id", "text", "key", "low", "root"}
    assert near_texts.keep_one(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        folder = tempfile.mkdtemp(prefix="spark-") + "/t"
        stage(spark, docs, SF).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append((name, docs))
    return out


def test_stages(spark, stages):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(set(d.columns) == set(first.columns) for _, d in stages[:-1])
    counts = [first.count(), *[d.count() for _, d in stages]]
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][1].collect()}
    assert np.mean([d in kept for d, q in quality.items() if q]) > 0.9
    assert np.mean([d in kept for d, q in quality.items() if not q]) < 0.3
    bench = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())] for i in range(max(1, len(w) - 9))}
    for r in stages[2][1].collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())
        assert not any(tuple(w[i : i + 10]) in bench for i in range(len(w)))
    assert not any(re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r.text) for r in stages[3][1].collect())
    assert all(r.n_chars == len(r.text) for _, d in stages[:-1] for r in d.collect())
    packed = stages[4][1].groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in stages[3][1].collect()}


def test_run_gives_the_last_stage(spark, stages):
    a = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}
    assert a == {(r.doc_id, r.start, r.length, r.ids_crc32) for r in stages[-1][1].collect()}


def test_odd_rows_through_all_stages(spark):
    """Null, empty, long and repeated rows, a column of another name and empty tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    long = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
    odd = spark.createDataFrame([(-1, None, "en", None, None), (-2, "", None, "s", 0), (-3, long, "en", "s", len(long)), (-3, long, "en", "s", len(long)), (None, "short", None, None, 5)], docs.select(*corpus_pipeline.COLUMNS).schema)
    every = docs.select(*corpus_pipeline.COLUMNS).unionByName(odd).selectExpr("*", "1 as key", "2 as __key", "3 as pattern", "4 as ranges")
    for rows in (every, every.limit(0)):
        now, counts = rows, []
        for _, stage in corpus_pipeline.STAGES:
            folder = tempfile.mkdtemp(prefix="spark-") + "/t"
            stage(spark, now, SF).write.parquet(folder)
            now = spark.read.schema(spark.read.parquet(folder).schema).parquet(folder)
            counts.append(now.count())
        ids = {r.doc_id for r in now.collect()}
        assert not ids & {-1, -2, None} and (rows is every) == bool(counts[-1])
