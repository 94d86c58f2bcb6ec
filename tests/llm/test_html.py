import time

import pytest

from tessera.llm import html_text
from tessera.llm.html_text import extract, main_text, smoothed, threshold

LONG = "This is a sentence of the article that has enough words to look like text. " * 4


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<p>only", "only"),
        ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>x</a></nav><div class=\"ad\">Buy</div><article><h1>A &amp; B</h1><p><b>One<br>two<p>Three</article><footer>f</footer>", "A & B\nOne two\nThree"),
        (f"<body><div id=menu><ul><li><a href=a>Home</a><li><a>About</a></ul></div><div id=main><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div></body>", f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><form>name <input></form><section class=\"comments\"><p>{LONG}</p></section><div class='cookie-notice'>ok</div></article>", LONG.strip()),
        (f"<main><p>a&nbsp;b \n\t c&lt;d&#233;</p><aside>{LONG}</aside></main>", "a b c<dé"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        # one paragraph of over 90 % among ordinary ones, in a div, bare, and in a list
        (f"<body><div><h1>Title</h1><p>Some words first.</p><p>{LONG * 30}</p><p>And some last.</p><p>Really.</p></div></body>", f"Title\nSome words first.\n{(LONG * 30).strip()}\nAnd some last.\nReally."),
        (f"<div>{LONG * 9}</div><div>The end.</div>", f"{(LONG * 9).strip()}\nThe end."),
        (f"<body><ul><li><div>{LONG}</div><li>One<li>Two</ul><p>Three</p></body>", f"{LONG.strip()}\nOne\nTwo\nThree"),
        # an article in two parts
        (f"<body><div id=page><div class=body><p>{LONG * 9}</p><p>{LONG * 10}</p></div><div class=more><p>{LONG}</p></div></div></body>", f"{(LONG * 9).strip()}\n{(LONG * 10).strip()}\n{LONG.strip()}"),
        # linked headings and references
        (f"<body><div><h2><a href=a>A linked heading</a></h2><p>{LONG}</p><p>{LONG}</p><ul><li><a href=b>First reference</a><li><a href=c>Second</a></ul></div><div class=nav><a>x</a></div></body>", f"A linked heading\n{LONG.strip()}\n{LONG.strip()}\nFirst reference\nSecond"),
        # sibling articles
        (f"<body><main><article><p>{LONG * 2}</p></article><article><p>{LONG}</p></article></main></body>", f"{(LONG * 2).strip()}\n{LONG.strip()}"),
        # a layout of cells
        (f"<body><table><tr><td><a>Home</a><td><p>{LONG}</p><p>Short.</p><p>{LONG}</p></table></body>", f"{LONG.strip()}\nShort.\n{LONG.strip()}"),
    ],
)
def test_main_text_is_whole(html, text):
    assert main_text(html) == text


def test_pages_keep_every_paragraph(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        body = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_smoothing_and_threshold():
    assert smoothed([5.0]) == [5.0] and smoothed([1, 1, 1]) == pytest.approx([1, 1, 1])
    assert 3 < threshold([1, 2, 1, 30, 29]) < 29


SHORT = "".join(f"<div><a href=x{i}>Link {i}</a> of <a>that</a></div>" for i in range(8))


@pytest.mark.parametrize(
    "html, text",
    [
        # unmarked boilerplate around the text: only the ratios tell
        (f"<body><div>{SHORT}</div><div><p>{LONG}</p><p>{LONG}</p></div><div>{SHORT}</div></body>", f"{LONG.strip()}\n{LONG.strip()}"),
        # an article that is a teaser beside the text
        (f"<body><article><a>More</a> <b>news</b></article>{SHORT}<div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div></body>", f"Title\n{LONG.strip()}\n{LONG.strip()}"),
    ],
)
def test_ratios_choose_the_region(html, text, monkeypatch):
    assert main_text(html) == text
    monkeypatch.setattr(html_text, "smoothed", lambda values: [0.0] * len(values))
    assert main_text(html) != text


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div class=content-sidebar-wrap><div class='has-sidebar'><article><p>{LONG}</p></article></div></div><div class=main-nav>x</div>", LONG.strip()),
        (f"<header>Site</header><article><header class=article-header><h1>Title</h1></header><p>{LONG}</p><footer>f</footer></article>", f"Title\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><p><a href=a>Only a link</a></p><p>{LONG}</p></article>", f"{LONG.strip()}\nOnly a link\n{LONG.strip()}"),
        (f"<div><ul><li><a>Home</a><li><a>News</a></ul><h2>T</h2><p>{LONG}</p><p>{LONG}</p></div>", f"T\n{LONG.strip()}\n{LONG.strip()}"),
        (f"<article><p>One <a href=x>two</p><p>{LONG}<b>x</div></b> y</p></article>", f"One two\n{LONG.strip()} x\ny"),
    ],
)
def test_markup(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("page", ["<div>x" * 20_000, "<div><b>" * 10_000 + "</b>" * 10_000 + "t", "<b>" * 10_000 + "<div>" * 10_000 + "</b>" * 10_000 + "t", "<p>" * 20_000 + "</i>" * 20_000, "<article><ul><li>a" * 7000])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    assert main_text(page) or page.startswith("<p>")
    assert time.process_time() - began < 2


def test_dirty_rows(spark):
    rows = [(1, None, None, 1), (None, "u", "<p>x</p>", 2), (9007199254740993, "u", "<" * 50_000, 3), (9007199254740993, "u", "<b>" * 3000 + "t" * 200_000, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").withColumnRenamed("text", "n_chars").coalesce(1)
    got = [(r.page_id, r.url, r.n_chars) for r in extract(pages).collect()]
    assert got == [(1, None, 0), (None, "u", 1), (9007199254740993, "u", 50_000), (9007199254740993, "u", 200_000)]
    assert extract(pages.limit(0)).count() == 0
