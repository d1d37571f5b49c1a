"""Main content of pages written out by hand, and the best of several extractions."""

import pytest
from pyspark.sql import functions as F

from strataloom.operators import content as C

LONG = "This paragraph has enough words to count as the content of a page that somebody wrote. " * 3
PAGES = [
    ("<html><body><nav>Navigation</nav><article><h1>Title</h1><p>Content here</p></article><footer>Footer</footer></body></html>", "Title Content here", None),
    (f"<body><header>Header</header><main><h1>Main</h1><p>{LONG}</p></main></body>", f"Main {LONG.strip()}", "main"),
    (f"<article><script>alert('bad')</script><style>.bad {{}}</style><p>Good {LONG}</p><svg><text>x</text></svg></article>", f"Good {LONG.strip()}", "article"),
    (f"<div id=content><p>{LONG}</p></div><div class=content><p>{LONG} more</p><h2>Head</h2></div>", f"{LONG.strip()} more Head", ".content"),
    (f"<div id='content-container'><p>{LONG}</p><div class='x cookie-banner'>Accept cookies</div><div aria-label='Our COOKIE note'>no</div></div>", LONG.strip(), "#content-container"),
    (f"<main><p>{LONG}</p><div><span>Loading...</span></div><p>Data <b>loading</b> guide</p><p>Loading</p></main>", f"{LONG.strip()} Data guide", "main"),
    ("<main>" + "<div>Loading...</div>" * 40 + f"</main><article><p>{LONG}</p></article>", LONG.strip(), "article"),
    (f"<div id='S:1'><p>{LONG}</p></div>", LONG.strip(), 'div[id^="S:"]'),
    (f"<article><p>{LONG}<p>unclosed <b>bold<p>more</article>tail", f"{LONG.strip()} unclosed bold more", "article"),
    (f"<article class='menu'><p>{LONG}</p></article><body><p>b</p></body>", "", "article"),
    ("<p>no body</p>", "", None),
    ("", "", None),
    (None, "", None),
    (f"<article><p>{LONG}</p><!-- note --><template><p>hid</p></template><nav><div>a</div></nav>after</article>", f"{LONG.strip()} hid after", "article"),
]


def test_main_content(spark):
    frame = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(PAGES)], "page_id int, html string")
    for r in C.main_content(frame).collect():
        html, text, selector = PAGES[r.page_id]
        assert (r.content_text, r.content_selector) == (text, selector), html
        assert "alert" not in r.content_html and "cookie" not in r.content_html.lower()


def test_scores_follow_the_rules(spark):
    html = f"<article><h2>H</h2><p>{LONG}</p></article><div class=documentation>{LONG}</div>"
    got = C.main_content(spark.createDataFrame([(html,)], "html string")).first()
    assert got.content_score == len(f"H {LONG.strip()}") + (30 - 2) + 20 + 80
    wait = f"<main><p>{LONG} loading and loading</p></main>"
    got = C.main_content(spark.createDataFrame([(wait,)], "html string")).first()
    assert got.content_score == len(f"{LONG}loading and loading") + (30 - 3) + 20 - 40


def test_selectors():
    for selector in [*C.CONTENT, *C.REMOVED]:
        assert C._SELECTOR.match(selector)
    with pytest.raises(ValueError, match="a > b"):
        C.matches(F.lit(1), "a > b")


def test_best_extraction(spark):
    rows = [("short fallback", "# Article\n\n" + "Useful reference content. " * 120, "dense"), ("# Docs\n\nInstall and configure the client.", " ", "generic"), ("", "", None), ("same words", "same words", "dense"), ("good " * 40, "subscribe to our newsletter " * 20, "generic")]
    found = C.best_extraction({"generic": F.col("a"), "dense": F.col("b")})
    for r in spark.createDataFrame(rows, "a string, b string, want string").withColumn("x", found).collect():
        assert (r.x.name if r.x else None) == r.want


def test_best_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = C.extract_best(pages).collect()
    assert len(got) == pages.count() and all(r.extraction and r.extraction.candidates == 2 for r in got)
    two = f"<body><nav>Home</nav><div><p>{LONG}</p></div><article><p>{'Short text of another kind. ' * 5}</p></article></body>"
    best = C.extract_best(spark.createDataFrame([("u", two)], "url string, html string")).first().extraction
    assert best.name == "dense" and "somebody wrote" in best.markdown and "another kind" in best.markdown and "Home" not in best.markdown
