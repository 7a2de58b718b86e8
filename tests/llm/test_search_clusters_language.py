"""Ranked search, centroid clustering and language identification against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import centroids, language, queries, search

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rank(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for d, c, n in held:
            m = 25 + 75 * n * n_docs // n_words
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in Counter(terms(text)).items() if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        found.sort()
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:k])]
    return Counter(out)


ODD_DOCS = [
    (1, None), (2, ""), (3, " \n.,"), (4, "alpha"), (4, "alpha"), (5, "ALPHA beta Élan élan"), (None, "alpha beta"), (6, "x" * 3000), (7, "beta " * 5000 + "gamma"), (8, "\x00alpha\x7fbeta"),
    (9, "beta\ngamma 1a"), (10, ",".join(f"w{i % 9}" for i in range(2000))),
]
ODD_ITEMS = [(0, None), (1, ""), (2, "..."), (3, "alpha alpha beta"), (3, "alpha alpha beta"), (3, "gamma"), (4, "Élan"), (5, "nowhere"), (6, "w1 w2 1A w1"), (None, "beta")]


@pytest.mark.parametrize("sizes", [(64, 1 << 16, 1 << 20, 1 << 20), (2, 8, 10, 50)])
def test_search_of_odd_rows(spark, monkeypatch, sizes):
    """Small blocks, groups of queries and pieces of texts give what large ones give."""
    for name, size in zip(("BLOCK_DOCS", "BLOCK_POSTINGS", "MOST_TOKENS", "PIECE"), sizes, strict=True):
        monkeypatch.setattr(search, name, size)
    docs = spark.createDataFrame([(*r, "x", 1) for r in ODD_DOCS], "doc_id long, text string, block string, score int").repartition(3)
    items = spark.createDataFrame([(*r, 1) for r in ODD_ITEMS], "item_id long, text string, rank int")
    got = search.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == rank(ODD_DOCS, [(i, t) for i, t in ODD_ITEMS if terms(t)])


def test_search_breaks_ties_and_prunes(spark):
    """Hundreds of equal documents: the lowest ids stay, whatever block they lie in."""
    rows = [(i, "one two") for i in range(500, 0, -1)] + [(1000 + i, f"one three w{i}") for i in range(500)] + [(5000, "three three three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = [(1, "two"), (2, "three one"), (3, "w499 two")]
    assert Counter(map(tuple, search.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect())) == rank(rows, items)


def test_search_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{n} long, text string") for n in ("doc_id", "item_id"))
    assert search.search(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items).count() == 0


def test_bounds_hold(spark):
    """No document scores beyond its block's bound, and the bound of a block of one document is its score."""
    rng = np.random.default_rng(3)
    q = search.Queries([Counter({1: 2, 4: 1}), Counter({0: 1})], np.array([5, 7, 11, 13, 17]))
    for _ in range(50):
        own = np.sort(rng.choice(5, 3, replace=False))
        impacts = rng.integers(1, 100, (2, 3))
        ptr, terms_, flat = np.array([0, 3, 6]), np.tile(own, 2), impacts.ravel()
        for k, weight in enumerate((q.dense(0), q.dense(1))):
            bound = q.bounds(own, impacts.max(axis=0))[k]
            assert (search.scores(weight, ptr, terms_, flat) <= bound).all()
            assert q.bounds(own, impacts[0])[k] == search.scores(weight, ptr[:2], terms_[:3], flat[:3])[0]


def lloyd(rows, clusters=8, rounds=10, size=64, salt=3):
    held = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:clusters]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    assign = lambda: [min((far(v, w), j) for j, w in enumerate(c)) for _, v in held]
    for _ in range(rounds):
        near = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, k) in zip(held, near, strict=True) if k == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()
    per = Counter()
    for d, j in near:
        per[j] += d
    fit = lambda d: d if d < 1 << 63 else None
    total = [None] if any(d >= 1 << 63 for d, _ in near) else [fit(sum(per.values()))]
    lost = {j for d, j in near if d >= 1 << 63}
    return Counter((i, j, fit(d), None if j in lost else fit(per[j]), total[0], hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(held, near, strict=True))


def clustered(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], f"vec_id long, embedding array<{kind}>, h string, cluster int").repartition(3)
    got = centroids.cluster(df, **more)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return Counter(map(tuple, got.collect()))


def test_clusters_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert Counter(map(tuple, queries.op12_centroids(spark, SF).collect())) == lloyd(rows)


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    f = lambda *v: [float(np.float32(x)) if x is not None else None for x in v]
    rows = [(i, f(*rng.normal(0, 1, 3))) for i in range(40)]
    rows += [(100, None), (101, []), (102, f(1, 2)), (103, f(1, None, 2)), (104, f(1, math.nan, 2)), (105, f(1, math.inf, 2)), (None, f(1, 2, 3)), (106, f(0, 0, 0)), (106, f(0, 0, 0)), (107, f(-0.0, -1e-9, 1e-9))]
    assert clustered(spark, rows, size=3, clusters=4) == lloyd(rows, 4, 10, 3)
    huge = [*rows, *[(200 + i, f(*(rng.normal(0, 1, 3) * 10.0 ** (5 + 4 * i)))) for i in range(8)]]
    assert clustered(spark, huge, size=3, clusters=4, rounds=4) == lloyd(huge, 4, 4, 3)
    assert clustered(spark, rows[:2], size=3) == lloyd(rows[:2], 8, 10, 3)
    assert clustered(spark, [], size=3) == Counter()
    same = [(i, f(1, 1, 1)) for i in range(30)] + [(99, f(5, 5, 5))]
    assert clustered(spark, same, size=3, clusters=3) == lloyd(same, 3, 10, 3)


@pytest.mark.parametrize("scale", [1, 300, 1 << 20, 1 << 28, 1e20, 1e35])
def test_screening_is_exact(scale):
    """Grids of many equal and nearly equal distances at every magnitude; the intervals hold the true values."""
    rng = np.random.default_rng(7)
    x, c = (np.rint(rng.integers(-3, 4, (n, 6)) * float(scale) + rng.integers(-1, 2, (n, 6))) for n in (300, 9))
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
    whole = np.array([[int(b) for b in q] for q in c], object)
    assert centroids.nearest(x, whole).tolist() == [min(range(9), key=lambda j: (row[j], j)) for row in far]
    low, high = centroids.intervals(x, c)
    for i in range(300):
        for j in range(9):
            true = sum(int(b) ** 2 - 2 * int(a) * int(b) for a, b in zip(x[i], c[j], strict=True))
            assert low[i, j] <= true <= high[i, j]
    if scale == 300:
        assert ((low <= high.min(axis=1)[:, None]).sum(axis=1) == 1).mean() > 0.5  # most need no exact distance


def test_limbs():
    for total in (0, 5, -5, 1 << 100, -(1 << 100) - 7):
        assert sum(p << (centroids.LIMB * k) for k, p in enumerate(centroids.limbs_of(total, 4))) == total


def test_language_held_out(spark):
    """Nearly all held-out texts of some length get their language, whole and by brute force of the network."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs, net = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, langs, net).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    long = [r for r in held if r.text and len(r.text) > 100]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in long) >= 0.98 * len(long)
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, *language.fit(docs.repartition(5))).collect()}
    assert again == {k: (r.lang_pred, r.score) for k, r in got.items()}


def plain_log_probabilities(net, window):
    """The network's definition, byte by byte."""
    n = language.FILTERS * len(language.WIDTHS)
    top = np.full(n, -np.inf)
    for i in range(language.STEP):
        top = np.maximum(top, sum(net.embed[window[i + k]] @ net.filters[k] for k in range(language.LONGEST)))
    z = np.maximum(top + net.bias, 0) @ net.dense + net.shift
    return z - np.log(np.exp(z).sum())


def test_network_against_plain_sums():
    net = language.Network(3, seed=1)
    text = ("Ärger und Ünde, the quick brown fox. " * 30).encode()
    rows = language.windows_of(text)
    want = np.array([plain_log_probabilities(net, w) for w in rows])
    assert np.allclose(net.log_probabilities(net.pooled(rows, net.pair_tables())), want, atol=1e-4)
    assert b"".join(bytes(w[: language.STEP]) for w in rows).rstrip(b"\0").startswith(text[:-language.LONGEST])
    grams = {bytes(w[i : i + 4]) for w in rows for i in range(language.STEP)}
    assert all(text[i : i + 4] in grams for i in range(len(text) - 3))


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    net = language.Network(3, seed=4)
    for p in net.parameters():
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    net.embed[0], net.filters = 0, net.filters * net.used
    net.embed, net.filters, net.bias, net.dense, net.shift = (p.astype(np.float64) for p in net.parameters())
    rows, labels = rng.integers(1, 256, (5, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, slopes = net.gradients(rows, labels)
    for p, g in zip(net.parameters(), slopes, strict=True):
        for at in np.argsort(-np.abs(g).ravel())[:4]:
            at = np.unravel_index(at, p.shape)
            was, e = p[at], 1e-6
            p[at] = was + e
            up = net.gradients(rows, labels)[0]
            p[at] = was - e
            down = net.gradients(rows, labels)[0]
            p[at] = was
            assert abs((up - down) / (2 * e) - g[at]) <= 1e-4 + 0.02 * abs(g[at])


def test_language_of_odd_rows(spark):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(40)] + [(100 + i, "der hund und die katze " * 3, "de") for i in range(40)]
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 !? \n", "en"), (903, "x", None), (None, "der hund", "de"), (904, "die katze und " * 30_000, None), (0, rows[0][1], "en")]
    docs = spark.createDataFrame([(*r, 1.0, True) for r in rows + odd], "doc_id long, text string, lang string, score double, held_out boolean").repartition(3)
    got = language.language(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    out = got.collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (900, 901, 902))
    assert by[904].lang_pred == "de" and by[None].lang_pred == "de" and not by[None].held_out
    assert all(0 <= r.score <= 1 and r.lang_pred in ("de", "en", "und") for r in out)
    none = language.language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    one = language.language(docs.where("lang = 'de'")).where("lang_pred <> 'und'").collect()
    assert one and all((r.lang_pred, r.score) == ("de", 1.0) for r in one)
    assert language.language(docs.limit(0)).count() == 0
