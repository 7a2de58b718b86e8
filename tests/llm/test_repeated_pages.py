"""Copies of a page count once in their host's template, wherever they lie; alignment against brute force."""

import random
import time
from functools import cache

import pytest

from gridloom.llm import html


def test_one_page_over_partitions(spark):
    page = "<body><article><h1>Head</h1><p>One text</p>rest</article></body>"
    df = spark.createDataFrame([(i, "http://a.example/1", page) for i in range(12)], "page_id bigint, url string, html string").repartition(6)
    got = html.extract(df).collect()
    assert len(got) == 12 and {r.text for r in got} == {"Head One text rest"}


@pytest.mark.parametrize("parts", [1, 3, 12])
def test_partitions_do_not_matter(spark, parts):
    page = "<body><div>Menu {n}</div><div>CONST LINE</div><div><h1>Head {n}</h1><p>Text {n} of the page and more of it</p></div></body>"
    rows = [(6 * n + k, "http://two.example/", page.format(n=n)) for n in range(2) for k in range(6)]
    rows += [(100 + 3 * n + k, "http://many.example/", page.format(n=n)) for n in range(9) for k in range(3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    for i, _, _ in rows:
        n = i // 6 if i < 100 else (i - 100) // 3
        assert got[i] == (f"Menu {n} CONST LINE Head {n} Text {n} of the page and more of it" if i < 100 else f"Head {n} Text {n} of the page and more of it")


def test_long_menu_and_neutral_names(spark):
    menu = "".join(f"<li><a href=/{{n}}/{k}>Item {k} {{n}}</a>" for k in range(300))
    page = "<body><ul class=x>" + menu + "</ul><div class=y><h1>Head {n}</h1><p>Own words {n} again and again</p><p>Line on all pages</p>" + "<p>More of page {n}, long enough to be most of its text</p>" * 60 + "</div><div class=z>Foot {n}</div></body>"
    rows = [(n, "http://menu.example/", page.format(n=n)) for n in range(20)]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()
    for r in got:
        n = r.page_id
        assert r.text == " ".join([f"Head {n}", f"Own words {n} again and again"] + [f"More of page {n}, long enough to be most of its text"] * 60)


def test_shifting_notice(spark):
    """Equal labels: the line of all pages is found although half of the pages have a varying block before it."""
    rows = [(n, "http://shift.example/", "<body><div><div>Notice {n} {n}</div>".replace("{n}", str(n)) * (n % 2) + "<div>The same line</div><h1>Head {0}</h1><p>Text {0}</p></div></body>".format(n)) for n in range(10)]
    rows = [(i, u, h if h.startswith("<body>") else "<body><div>" + h) for i, u, h in rows]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("The same line" not in t and f"Head {n} Text {n}" in t for n, t in got.items())


def test_template_never_empties_a_page():
    page = "<body><article><h1>Head</h1><p>One text</p></article></body>"
    shapes = html.Shapes()
    ref = shapes.name(html.parse(page))
    counts = html.np.full((3, shapes.size[ref.shape]), html.LEAST)
    assert html.main_text(page, frozenset(html.constants(ref, counts, html.LEAST))) == "Head One text"


def test_time_in_proportion():
    began = time.time()
    html.main_text("<a " * 100_000 + '"')
    html.main_text("<div class=menu>" * 20_000 + "text")
    html.main_text("<b>" * 20_000 + "<p>x</p>" * 20_000 + "</i>" * 20_000)
    html.main_text("<article>" * 20_000 + "<article>x</article>" * 20_000)
    assert time.time() - began < 8


def random_tree(rng, depth):
    return "<" + (tag := rng.choice(["div", "span", "ul"])) + ">" + "".join(random_tree(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0)) + f"</{tag}>"


def test_matching_against_brute_force():
    """Simple tree matching by its plain recursion, with and without the memory bound."""
    rng, shapes = random.Random(3), html.Shapes()
    for _ in range(60):
        a, b = (shapes.name(html.parse(random_tree(rng, 4))) for _ in range(2))

        @cache
        def stm(x, y):
            if x.label != y.label:
                return 0
            p, q = html.elements(x), html.elements(y)
            m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
            for i, u in enumerate(p):
                for j, v in enumerate(q):
                    m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + stm(u, v))
            return 1 + m[-1][-1]

        assert shapes.matching(a.shape, b.shape) == stm(a, b)
        counts = html.np.zeros((3, shapes.size[a.shape]), html.np.int64)
        html.count(a, b, shapes, counts)
        assert counts[0].sum() == stm(a, b)


def test_halves_match_as_much(monkeypatch):
    rng = html.np.random.default_rng(5)
    for n, m in ((9, 30), (40, 40), (3, 200)):
        rows = [rng.integers(0, 4, m) for _ in range(n)]
        monkeypatch.setattr(html, "CELLS", 1 << 22)
        whole = html.best_pairs(rows)
        monkeypatch.setattr(html, "CELLS", 50)
        parts = html.best_pairs(rows)
        weigh = lambda pairs: sum(int(rows[i][j]) for i, j in pairs)
        assert weigh(whole) == weigh(parts) == html.best_score(rows)
        assert all(a < c and b < d for (a, b), (c, d) in zip(parts, parts[1:], strict=False))


def test_odd_pages(spark):
    long = "<p>word word</p>" * 200_000
    df = spark.createDataFrame([(1, "u", long), (2, None, "<<>&lt;</p></p>"), (None, "u", "x")], "page_id bigint, url string, html string").selectExpr("*", "1 as refs", "2 as key", "3 as n", "4 as pages", "5 as host")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].n_chars == 200_000 * 10 - 1 and got[None].text == "x" and len(got) == 3
    assert html.extract(df.limit(0)).count() == 0
