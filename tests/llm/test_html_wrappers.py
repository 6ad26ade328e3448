"""Wrapper inference and main text of pages."""

import html
import random
import re

import pytest

from veracity.llm import html_wrappers as hw
from veracity.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"
SF = "/root/testdata/sf0.01"


def sentence(rng, n=12):
    return " ".join(rng.choice("alpha beta gamma delta ünder straße omega river stone light".split()) for _ in range(n)) + "."


def wrapper(pages):
    state = hw._state(pages[0])
    for p in pages[1:]:
        state = hw._join(state, hw._state(p))
    return hw._write(state)


def texts(pages):
    w = wrapper(pages)
    return [hw.extract(p, w) for p in pages]


def article(rng, i):
    return [f"Headline {i} {sentence(rng, 4)}"] + [f"{k} {sentence(rng, rng.randint(8, 30))}" for k in range(rng.randint(2, 6))]


def semantic(rng, blocks, i):
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p class='x'>{b}</p>" for b in blocks[1:])
    return (f"<!doctype html><html><head><title>{blocks[0]}</title><style>p{{}}</style></head><body class='has-sidebar'>"
            f"<header><h1>My site</h1><p>Motto {i}</p></header><nav><ul><li><a href=/>Home</a><li><a>Topic {i}</a></ul></nav>"
            f"<div id='cookie-notice'>We use cookies {i}</div><main><article>{body}<aside>Related: {i}</aside>"
            f"<form><label>Mail</label><input><button>Send</button></form><script>var a = '<p>no</p>';</script>"
            f"<section class='comments'><h2>Comments</h2><article class='comment'><p>Nice {i}</p></article></section>"
            f"<footer>Filed under {i}</footer></article></main><aside>Side {i}</aside><footer>&copy; {i}</footer></body></html>")


def classes(rng, blocks, i):
    body = f"<h2 class=title>{blocks[0]}</h2>" + "<br><br>".join(f"<div>{b}</div>" for b in blocks[1:])
    return (f"<BODY><DIV CLASS='site-header'>Site {i}</DIV><div class='main-menu'><a href=x>A</a> <a>B {i}</a></div>"
            f"<div class=wrap><div class='post-content'>{body}<div class='ad-slot'>Buy {i}!</div></div>"
            f"<div id=sidebar>Popular {i}</div></div><div class='reader-comments'><p>First {i}</p></div>"
            f"<div class='newsletter'>Join {i}</div><div id='page-footer'>Imprint {i}</div></BODY>")


def bare(rng, blocks, i):
    menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in ["home", "news", f"topic{i}"])
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    return (f"<html><body><div><ul>{menu}</ul></div><div>{body}<p>Thank you for reading this page.</p></div>"
            f"<div>All about stones and rivers since 1990</div></body></html>")


@pytest.mark.parametrize("layout", [semantic, classes, bare])
def test_layouts(layout):
    rng = random.Random(1)
    blocks = [article(rng, i) for i in range(12)]
    got = texts([layout(rng, b, i) for i, b in enumerate(blocks)])
    if layout is bare:  # the closing line stands among the paragraphs, in a slot
        blocks = [[*b, "Thank you for reading this page."] for b in blocks]
    assert got == ["\n".join(b) for b in blocks]


@pytest.mark.parametrize("layout", [semantic, classes])
def test_single_pages(layout):
    rng = random.Random(2)
    blocks = article(rng, 0)
    assert hw.extract(layout(rng, blocks, 0)) == "\n".join(blocks)


def test_optional_repeated_and_slots():
    pages = ["<body><div><b>Books of</b> <h2>A</h2><ul><li>one</li><li>two</li></ul></div></body>",
             "<body><div><b>Books of</b> <h2>B</h2><img src=x><p>note</p><ul><li>three</li></ul></div></body>"]
    state = hw._join(hw._state(pages[0]), hw._state(pages[1]))
    assert hw.expression(state["w"]) == ("<html><div>'fixed'<h2>TEXT</h2><p>'fixed'</p>?<ul><li>TEXT</li>+</ul></div></html>")
    state = hw._state("<h2>a</h2><p>1</p><p>2</p><h2>b</h2><p>3</p><div>end</div>")
    assert hw.expression(state["w"]) == "<html>(<h2>TEXT</h2>? <p>TEXT</p>?)+<div>'fixed'</div></html>"


def test_fixed_texts_outside_the_article_need_three_pages():
    page = "<div>{m}</div><div><p>{a}</p><p>{b}</p></div><div>Always the same closing words here</div>"
    make = [page.format(m=f"m{i}", a=f"first text number {i} " * 9, b=f"other text {i} " * 9) for i in range(3)]
    assert all("closing" not in t for t in texts(make))


def test_copies_of_one_article_stay():
    body = [f"{k} long text of the one article" for k in range(9)]
    for tag in ("p", "h2", "div"):
        inner = "".join(f"<{tag}>{b}</{tag}>" for b in body)
        pages = [f"<div><a>menu {i}</a></div><div>{inner}</div>" for i in range(5)] * 2
        assert set(texts(pages)) == {"\n".join(body)}
    pages = [f"<div><a>menu {i}</a></div><div><p>One paragraph in all copies of this page</p></div>" for i in range(5)]
    assert set(texts(pages)) == {"One paragraph in all copies of this page"}


def test_references_and_white_space():
    page = ("<article><p>a&amp;b &lt;c&gt; &eacute;&#233;&#xe9;&nbsp;x &copy 1 &am &</p><p>\n one\t<b>t</b>wo<br>three  </p>"
            "<p> </p>loose <i>text</i><ul><li>1<li>2</ul><table><tr><td>x<td>y</table>a < b<pre>  k\n  l</pre></article>")
    assert hw.extract(page).split("\n") == ["a&b <c> ééé x © 1 &am &", "one two three", "loose text", "1", "2", "x", "y",
                                            "a < b", "k l"]


def test_inline_parts_do_not_split_a_block():
    assert hw.extract("<article><p>one <span class='ad'>buy <span>x</span></span>two</p><p>three</p></article>") == "one two\nthree"


@pytest.mark.parametrize("page", [
    "", "plain text", "<", "<p", "<p class='x", "</p></div>", "<!-- open", "<script>var x", "<div>" * 3000 + "deep" + "</div>" * 3000,
    "<b>" * 20000 + "x", "<p a='" * 500, "<table><tr><td><div></table></div>t", "&#xD800;&#0;&bogus;", "<ul>" + "<li>x" * 5000,
    "<x-1 .=\"'>" * 300, "".join(f"<div class=c{chr(97 + i % 26) * (i % 40 + 1)}>t{i}</div>" for i in range(2000))])
def test_broken_pages(page):
    assert isinstance(hw.extract(page), str)
    texts([page or " ", "<article><p>other</p></article>", page or " "])


def test_deep_and_long_texts_stay_whole():
    assert hw.extract("<div>" * 3000 + "deep") == "deep"
    long = "wörd " * 400_000
    assert hw.extract(f"<nav>x</nav><article><p>{long}</p></article>") == long.strip()


def expected(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_query_on_whole_pages(spark):
    rows = QUERIES["op12_html_extraction"](spark, SF).collect()
    source = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        assert r["text"] == expected(source[r["page_id"]]["html"])
        assert r["url"] == source[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])


def test_merged_in_rounds(spark, monkeypatch):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(120):
        layout = (semantic, classes, bare)[i % 3]
        blocks = article(rng, i)
        want[i] = "\n".join(blocks + ["Thank you for reading this page."] * (layout is bare))
        rows.append((i, f"https://{layout.__name__}.example.org:80/p/{i}?q#f", layout(rng, blocks, i)))
    monkeypatch.setattr(hw, "FAN_IN", 2)
    df = spark.createDataFrame(rows, PAGES).repartition(17)
    pages = df.selectExpr("regexp_extract(url, '//([^/:]+)', 1) as host", "html")
    assert hw.infer_wrappers(pages).groupBy("host").count().where("count > 1").count() == 0
    assert {r["page_id"]: r["text"] for r in hw.extract_main_text(df).collect()} == want


def test_nulls_repeats_and_clashing_columns(spark):
    page = "<nav>n</nav><article><p>main</p></article>"
    rows = [(1, "http://a.org/x", page), (1, "http://a.org/x", page), (2, None, page), (None, "http://a.org", page),
            (3, "http://a.org", None), (4, "", ""), (5, "no url", page), (6, "//USER@A.org/y", page)]
    df = spark.createDataFrame([(*r, "h", "w", "t", 0) for r in rows],
                               PAGES + ", host string, wrapper string, text string, n_chars int")
    got = sorted((tuple(r) for r in hw.extract_main_text(df).collect()), key=str)
    assert got == sorted([(i, u, "main" if h else "", 4 if h else 0) for i, u, h in rows], key=str)
    assert hw.extract_main_text(spark.createDataFrame([], PAGES)).collect() == []
