"""Main texts: against regular expressions on the given pages, and hand-made pages."""

import html
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlpit.llm import html_text, queries

PROSE = "The first sentence of this article is long enough, has commas, and says what it is about."
MORE = "A second paragraph follows, as it does in most articles, and it is about as long as the first."
SIDE = "Read this other story, which is long, full of commas, and has nothing to do with the article at all."


def plain(page):
    """The article of a given page, which has paragraphs and a heading only."""
    own = re.search(r"<article>(.*?)</article>", page, re.DOTALL)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", own[1])]
    return "\n".join(b for b in parts if b)


def test_main_text_of_pages(spark, small):
    pages = {r.page_id: r for r in queries.table(spark, small, "pages").collect()}
    rows = queries.op13_main_text(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just text, no markup", "just text, no markup"),
        ("<p>a &amp; b &lt;p&gt; &eacute;&#233;&#x1F600; c&nbsp;d</p>", "a & b <p> éé😀 c d"),
        ("<body><nav><a href=x>A</a></nav><footer>f</footer></body>", ""),
        (f"<article><h1>Title</h1><p>{PROSE}<p>Short.<ul><li>one<li>two</ul></article>", f"Title\n{PROSE}\nShort.\none\ntwo"),
        (f"<div id=wrap><h1>Title</h1><div class=content><p>{PROSE}</p><p>{MORE}</p></div><div class=sidebar><p>{SIDE}</p></div></div>", f"Title\n{PROSE}\n{MORE}"),
        (f"<main><section><p>{PROSE}</p></section><section><h2>Part</h2><p>{MORE}</p></section></main><section id=comments><article class=comment><p>{SIDE} {SIDE}</p></article></section>", f"{PROSE}\nPart\n{MORE}"),
        (f"<div><div><p>{PROSE}</p></div><div><p>{MORE}</p></div><div><a href=a>Some, link, text</a> <a href=b>and, more, links</a></div></div>", f"{PROSE}\n{MORE}"),
        (f"<div class='cookie-notice'>We use cookies, as all do, and hope, dearly, that you agree.</div><div>{PROSE}<br>{MORE}</div>", f"{PROSE} {MORE}"),
        (f"<body class='has-sidebar'><div class='page menu-open'><article><p>{PROSE}</p><form><p>{SIDE}</p></form><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></article></div></body>", PROSE),
        (f"<article><script>if (a<b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>{PROSE}<b>bold <i>both</b> odd</i></p></article>", f"{PROSE}bold both odd"),
        (f"<table><tr><td>{PROSE}<td>{MORE}</table>", f"{PROSE}\n{MORE}"),
        (f"<article><p>{PROSE}</p><p hidden>{SIDE}</p><p style='display: none'>{SIDE}</p></article>", PROSE),
        (f"<article><p>{PROSE}</p><!-- open <p>{SIDE}</p></article>", PROSE),
        (f"<article><p>{PROSE}</p></article><script>var a = 1; // open", PROSE),
        (f"<article>\n<p>\n  {PROSE}\t\n<div>x <span>y</span>z</div>w</p></article>", f"{PROSE}\nx yz\nw"),
        (f"<div class=post><p>{PROSE}</p></div><div role=complementary><p>{SIDE}</p></div><div id=respond><p>{SIDE}</p></div>", PROSE),
    ],
)
def test_main_text_of_hand_made_pages(page, text):
    assert html_text.main_text(page) == text


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "text, ", "&amp", "<", "<!--", "-->", "<a href='x", "'>", "<td>", "<table>", "</table>", "<script>", "</script>", "<article>", "\n", "é"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_page_has_a_text(parts):
    text = html_text.main_text("".join(parts))
    assert all(line == " ".join(line.split()) != "" for line in text.split("\n")) or text == ""


def test_long_and_deep_pages_take_time_in_proportion():
    for part in ("<div>", "<b>", "<p>a, b", "<ul><li>x", "</div>", "<a href='", "<!--", "<td>x", "&amp;", "<script>", "<"):
        began = time.perf_counter()
        html_text.main_text(part * 40_000)
        assert time.perf_counter() - began < 20, part


def test_main_text_of_odd_rows(spark):
    page = f"<article><p>{PROSE}</p></article>"
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    rows = [(1, page, "clash", 1), (1, page, "clash", 1), (2, None, None, None), (3, "", "x", 0), (None, long, "x", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, text string, n_chars int")
    found = html_text.extract(df)
    assert found.columns == df.columns
    assert sorted(((r.page_id or -1, len(r.text)) for r in found.collect())) == [(-1, 20_000 * (len(PROSE) + 1) - 1), (1, len(PROSE)), (1, len(PROSE)), (2, 0), (3, 0)]
    assert html_text.extract(df.limit(0)).collect() == []
