"""Pages with numbered classes, with names that only look like menus, and with several articles."""

from gridloom.llm import html


def texts(spark, pages):
    df = spark.createDataFrame([(i, f"https://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(html.extract(df).collect(), key=lambda r: r.page_id)]


def test_numbered_classes(spark):
    """Neutral tags whose classes hold the post's number: the wrapper alone tells the slot."""
    pages = [
        f"<body><div class='m-{n}'>Home About Contact</div><div class='post-{n} z{n}'><p>Story {n} begins here w{n * 7}.</p><p>It goes on for the {n}th time and ends w{n * 13}.</p></div><div class='x{n}'>Foot of the page</div></body>"
        for n in range(100, 112)
    ]
    for n, text in zip(range(100, 112), texts(spark, pages), strict=True):
        assert text == f"Story {n} begins here w{n * 7}. It goes on for the {n}th time and ends w{n * 13}."


def test_names_that_hold_content(spark):
    page = (
        "<body><article><h1>Title</h1><p>First.</p><div class='related-work'><p>Earlier work.</p></div><section class='search-results-discussion'><p>What was found.</p></section>"
        "<p><label>A label</label> in a sentence.</p><div class='related-posts'><p>See also this.</p></div><div class='ad-slot'>Buy now</div><div class='comments'>First!</div></article></body>"
    )
    assert texts(spark, [page]) == ["Title First. Earlier work. What was found. A label in a sentence."]


def test_one_article(spark):
    page = "<body><article class='teaser'><p>Read this too.</p></article><article><h1>The piece</h1><p>A long and winding piece of text.</p></article><article class='teaser'><p>And that.</p></article></body>"
    assert texts(spark, [page]) == ["The piece A long and winding piece of text."]
    assert texts(spark, ["<body><form><label>Name</label><input></form><p>Text.</p></body>"]) == ["Text."]
