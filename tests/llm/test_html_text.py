import pytest

from siftworks.llm.html_text import extract_main_text, main_text

LONG = "This is a sentence that is long enough for the window to surge over its mark, no doubt."

CASES = {
    "article": (f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer></body></html>", f"Title & more\n\n{LONG}\n\nShort."),
    "unclosed": (f"<body><div class=ad>{LONG}</div><article><h1>T</h1><p><b>{LONG}<br><p>One\n  two&nbsp;three</article><footer>f", f"T\n\n{LONG}\n\nOne two three"),
    "no article": (f"<div class='header'><a href=x>Home</a></div><div id='cookie-notice'>{LONG}</div><div class='content'><h2>Head</h2><div>{LONG}</div><div>End.</div></div><div class='comments'><p>{LONG}</p></div><form>Name {LONG}</form>", f"Head\n\n{LONG}\n\nEnd."),
    "furniture in article": (f"<main><article><p>{LONG}</p><aside>{LONG}</aside><p>After.</p><div class='share-buttons'>Share</div><section id='comments'><p>{LONG}</p></section></article></main>", f"{LONG}\n\nAfter."),
    "references": (f"<article><p>&lt;b&gt; &#233;&#x41; &quot;q&quot; &amp;amp; {LONG}</p></article>", f'<b> éA "q" &amp; {LONG}'),
    "comments and raw text": (f"<article><!-- <p>no</p> --><p>{LONG}<!-- x --></p><script>if (a<b) {{ '<p>no</p>' }}</script><noscript><p>no</p></noscript><p>yes</p></article>", f"{LONG}\n\nyes"),
    "hidden": (f"<article><p>{LONG}</p><p hidden>no</p><div style='display: none'>no</div><p>yes</p></article>", f"{LONG}\n\nyes"),
    "layout words": (f"<body class='x'><div class='wrap has-sidebar'><div id='post-1'><p>{LONG}</p></div><div class='sidebar'>{LONG}</div></div></body>", LONG),
    "null": (None, ""),
    "empty": ("", ""),
    "no text": ("<html><body><nav>x</nav></body></html>", ""),
    "plain": ("just words", "just words"),
    "broken": ("<p <a href='x", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    page, want = CASES[name]
    assert main_text(page) == want


def test_very_long_page_is_whole():
    page = "<article>" + "".join(f"<p>Paragraph {i} {LONG}</p>" for i in range(20_000)) + "</article>"
    assert main_text(page).count("\n\n") == 19_999


def test_rows(spark):
    rows = [(1, "u", CASES["article"][0], "x"), (1, "u", CASES["article"][0], "x"), (None, None, None, None), (2, "v", "é", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in extract_main_text(df).collect()]
    want = CASES["article"][1]
    assert got == [(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (2, "v", "é", 1)]
    assert extract_main_text(df.limit(0)).collect() == []


BARE = {
    "links in mid-article": (f"<div><p>{LONG}</p><ul>" + "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(4)) + f"</ul><p>{LONG} 2</p></div>", f"{LONG}\n\nLink 0\n\nLink 1\n\nLink 2\n\nLink 3\n\n{LONG} 2"),
    "short lead": (f"<div><p>A lead.</p><p>Two.</p><p>Three.</p><p>Four.</p><p>{LONG}</p></div>", f"A lead.\n\nTwo.\n\nThree.\n\nFour.\n\n{LONG}"),
    "short lines after links": (f"<div><p>{LONG}</p><ul>" + "<li><a href=x>Link</a></li>" * 3 + "</ul><p>The end.</p></div>", f"{LONG}\n\nLink\n\nLink\n\nLink\n\nThe end."),
    "enumeration": (f"<div><p>{LONG}</p><p>(a) one</p><p>(b) two</p><p>(c) three</p><p>Copyright law is old.</p><p>{LONG}</p></div>", f"{LONG}\n\n(a) one\n\n(b) two\n\n(c) three\n\nCopyright law is old.\n\n{LONG}"),
    "enumeration at the end": (f"<div><p>{LONG}</p><p>(a) one</p><p>(b) two</p><p>(c) three</p></div>", f"{LONG}\n\n(a) one\n\n(b) two\n\n(c) three"),
    "copyright at the end": (f"<div><p>{LONG}</p></div><p>(c) 2024 Someone</p><p>\u00a9 Someone</p>", LONG),
    "links beside": (f"<div><a href=x>Home</a></div><div><p>{LONG}</p></div><div><a href=x>More</a></div>", LONG),
}


@pytest.mark.parametrize("name", BARE)
def test_pages_without_article(name):
    page, want = BARE[name]
    assert main_text(page) == want


KEPT = {
    "copyright paragraph": (f"<article><p>{LONG}</p><p>Copyright law is changing.</p><p>{LONG}</p></article>", f"{LONG}\n\nCopyright law is changing.\n\n{LONG}"),
    "names that articles use": (f"<article><p>{LONG}</p><div class='search-results'><p>Found it.</p></div><p id='legal'>It is legal.</p><p>End.</p></article>", f"{LONG}\n\nFound it.\n\nIt is legal.\n\nEnd."),
    "stray quotes": (f"<article><p title=5\">First {LONG}</p><p>It is 5\" long.</p></article>", f'First {LONG}\n\nIt is 5" long.'),
    "quoted mark": (f"<article><p title='a > b'>{LONG}</p><p data-x=\"</p>\">Two.</p></article>", f"{LONG}\n\nTwo."),
    "dense related": (f"<article><p>{LONG}</p><div class='related'><p>{LONG}</p></div><p>End.</p></article>", f"{LONG}\n\n{LONG}\n\nEnd."),
    "thin related": (f"<article><p>{LONG}</p><div class='related-posts'><a href=x>One more article to read</a></div><p>End.</p></article>", f"{LONG}\n\nEnd."),
    "links at the end of the article": (f"<article><h1><a href=x>T</a></h1><p>{LONG}</p><p>End.</p><ul>" + "<li><a href=x>Tag</a></li>" * 5 + "</ul></article>", f"T\n\n{LONG}\n\nEnd."),
    "two links at the end": (f"<article><p>{LONG}</p><p><a href=x>Source one</a></p><p><a href=x>Source two</a></p></article>", f"{LONG}\n\nSource one\n\nSource two"),
    "comments": (f"<article><p>{LONG}</p></article><div class='reader-comments'><p>{LONG}</p></div><section id=commentList><p>{LONG}</p></section>", LONG),
    "marked paragraph that is not closed": (f"<article><p>{LONG}<p class=ad>Buy.<p>{LONG}</article>", f"{LONG}\n\n{LONG}"),
    "containers of one paragraph": (f"<div id=a><div><p>Lead.</p></div><div><p>{LONG}</p></div><div><p>{LONG}</p></div><div><p>End.</p></div></div><div>Other.</div>", f"Lead.\n\n{LONG}\n\n{LONG}\n\nEnd."),
    "article and long text beside it": (f"<article><p>{LONG}</p><p>{LONG}</p></article><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
}


@pytest.mark.parametrize("name", KEPT)
def test_what_stays_and_goes(name):
    page, want = KEPT[name]
    assert main_text(page) == want


def test_densities_alone_find_the_text(spark, sf_dir):
    """Without names and element rules, line blocks give the same text on most pages, and it is the article's."""
    import html
    import re

    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    same = right = 0
    for page in pages:
        blocks = re.split(r"<(?:/?(?:p|h1|article)|b><br)\b[^>]*>|</article>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        want = [x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()))]
        right += " ".join(main_text(page).split()) == " ".join(want)
        same += main_text(page, marks=False, home=1) == main_text(page)
    assert right == len(pages) and same > 0.8 * len(pages)


def test_pages_that_close_nothing_are_linear():
    import time

    for bit in ("<p class=ad>word ", "<li class=ad>word ", "<span class=ad>word", "<div class=ad>word ", "<script/>", "<a href='", '<p title="x>', "</ul>", "<div><ul>"):
        start = time.monotonic()
        main_text("<article>" + bit * (4_000_000 // len(bit)))
        assert time.monotonic() - start < 30, bit
