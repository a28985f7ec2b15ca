import html
import re
from collections import Counter

import pytest

from quarry.llm import html_extract
from quarry.llm.catalogue import QUERIES

SF = "/root/testdata/sf0.01"


def plain(page):
    """The tables' layout, read by a few patterns: blocks of the only article."""
    page = re.sub(r"<(script|style)>.*?</\1>", "", page, flags=re.S)
    body = page.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
    blocks = re.split(r"</?(?:p|h1|li|ul|div|table|tr|td)[^>]*>", body)
    texts = (
        re.sub(
            r"\s+", " ", html.unescape(re.sub(r"<br>", " ", b) and re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))
        ).strip() for b in blocks
    )
    return "\n".join(t for t in texts if t)


def test_query_equals_plain_reading(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op9_html_extract"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text)


CASES = [
    ("<p>a<p>b", "a\nb"),
    ("<div>x &amp; y&nbsp; z<br>w</div>tail", "x & y z w\ntail"),
    (
        "<article><header><h1>T</h1></header><p>one <b>two</b>three</p><aside>no</aside><div class='ad-slot'>no</div></article><p>out</p>",
        "T\none twothree",
    ),
    ("<main><nav>m</nav><p>in</p></main><p>out</p>", "in"),
    ("<header>h</header><p>t</p><div class='comments'><p>c</p></div><form><p>f</p></form><footer>f</footer>", "t"),
    ("<script>var a='</p><p>no</p>';</script><style>p{}</style><p>1 < 2 & 3 &lt; 4", "1 < 2 & 3 < 4"),
    ("<div class='content has-sidebar'><p>kept</p></div>", "kept"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb\nc"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<!-- <p>no</p> --><p title='>'>yes</p><p>cut <a href=\"x", "yes\ncut"),
    ("&#x41;&#66;<![CDATA[c<d]]>", "ABc<d"),
    ("", ""),
    ("<article>", ""),
    ("<article><p>kept</p><div class=\"cookie-notice\">no</div>", "kept"),
    ("<article><p>before</p><datalist><option value=a>x<option value=b>y</datalist><p>after</p></article>", "before\nafter"),
    ("<article><p>a</p><select><option>no</option></select><textarea>no</textarea><iframe>no</iframe><p>b</p></article>", "a\nb"),
    ("<title>t<article><p>a</p><iframe src=x><p>b</p><textarea>c</article>", "a\nb\nc"),
    ("<article><h2 id='discussion'>Discussion</h2><section class='discussion'><p>s</p></section><p id=legal>l</p></article>", "Discussion\ns\nl"),
    ("<article><section id='related-work'><h2>R</h2><p class=search>w</p></section><section class=comments>no</section><p class=ad>no</p></article>", "R\nw"),
    ("<main><article><p>one card</p></article><p>main body that is longer</p></main>", "one card\nmain body that is longer"),
    ("<main><article><p>the article that is longer</p></article><p>a word</p></main>", "the article that is longer"),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "so x=1 holds"),
    ("<div class='w-1/2'><p>half</p></div>", "half"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_markup(page, text):
    assert html_extract.main_text(page, 0, lambda *_: False) == text


@pytest.mark.parametrize("sent", [0, 1000])
def test_constant_text_of_a_host_goes(spark, sent):
    rows = [
        (
            i, f"http://a.example/{i}", f"<div><p>We use cookies here.</p><p>Story number {i} tells of {i * 7}.</p></div>"
        ) for i in range(12)
    ]
    rows += [(100 + i, f"http://b.example/{i}", f"<div><p>We use cookies here.</p><p>Tale {i}.</p></div>") for i in range(2)]
    got = {
        r.page_id: r.text for r in html_extract.extract(
            spark.createDataFrame(rows, "page_id long, url string, html string"), max_sent=sent
        ).collect()
    }
    assert got[3] == "Story number 3 tells of 21." and got[101] == "We use cookies here.\nTale 1."


def test_copies_of_an_article_stay(spark):
    rows = [(i, f"http://c.example/{i}", f"<div><p>Copied story.</p><p>It goes on and on.</p></div><p>Page {i % 2}</p>") for i in range(3)]
    rows += [(10 + i, f"http://d.example/{i}", "<div><p>All rights kept.</p>" + (f"<p>Copied story {'on ' * 9}</p>" if i < 4 else f"<p>Own {'x' * 30} {i}</p>") + "</div>") for i in range(10)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Copied story.\nIt goes on and on.\nPage 1"
    assert got[10] == "Copied story on on on on on on on on on" and got[15] == f"Own {'x' * 30} 5"


def test_slashes_in_names_part_no_path():
    blocks, tags = html_extract.blocks_of("<div class='w-1/2'><p>half</p></div>")
    assert len(tags) == 2 and blocks[0][0].count("/") == 2


def test_classes_group_tokens_of_equal_vectors(spark):
    pages = [
        (
            i,
            "http://h/x",
            "<div class='a'><p>fixed</p></div><span>t</span>" + (
                "<div class='b'><p>often</p></div>" if i % 2 else ""
            ) + f"<p>own {i}</p>",
        ) for i in range(10)
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = html_extract.templates(df).collect()
    vectors = Counter()
    for token in {r.token for r in found}:
        classes = {r["class"] for r in found if r.token == token}
        assert len(classes) == 1
    by_pages = {r["class"]: r.pages for r in found}
    assert sorted(by_pages.values()) == [5, 10] and not vectors
    assert len(html_extract.templates(df.limit(2)).collect()) == 0


def test_unnamed_menus_of_a_host_go(spark):
    links = "<div><p><a href='/a'>{0} one</a> <a href='/b'>{0} two</a></p></div>"
    rows = [
        (
            i, "http://m.example/x", links.format(i) + f"<section><p>Body {i} with <a href='/c'>one</a> link.</p></section>"
        ) for i in range(8)
    ]
    got = {
        r.page_id: r.text for r in html_extract.extract(
            spark.createDataFrame(rows, "page_id long, url string, html string")
        ).collect()
    }
    assert got[5] == "Body 5 with one link."
    found = html_extract.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.token: r for r in found}
    outer, inner = by[html_extract._hash("/div")], by[html_extract._hash("/div/p")]
    assert outer.parent is None and inner.parent == outer["class"] and inner.menu and not by[html_extract._hash("/section/p")].menu


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, host string, token long, text string"
    rows = [
        (1, None, "<p>x</p>", None, 1, "q"),
        (1, None, "<p>x</p>", None, 1, "q"),
        (None, "u", None, "h", 2, "q"),
        (2, "no host", "", "h", 2, None),
        (3, "http://e.org", "<p>" + "long " * 50_000, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, len(r.text)) for r in got.collect()) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 5 * 50_000 - 1)]
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, 1000])
def test_template_decides_in_articles_and_main_parts_too(spark, sent):
    page = "<article id='{2}'><h1>Title</h1><p>{0}</p><p>We use cookies here.</p><div><p><a href='/a'>Back</a> <a href='/b'>Next</a></p></div><ul><li><a href='/{1}'>Source {1}</a></li></ul></article>"
    rows = [(i, "http://e.example/x", page.format(f"Story number {i} tells of {i * 7} days and nights.", i, "post")) for i in range(6)]
    rows += [(10 + i, "http://f.example/x", f"<main><p>We use cookies here.</p><p>Teaser {i}</p><article><p>The tale of day number {i}.</p></article></main>") for i in range(6)]
    rows += [(20 + i, "http://g.example/x", f"<main><p>We use cookies here.</p><p>Body {i} {'y' * 30}.</p></main>") for i in range(6)]
    # an article that stands on three pages, beside longer ones, stays whole
    rows += [(30 + i, "http://h.example/x", "<nav>All the parts of this site</nav>" + page.format("Copied tale.", 1, "copy")) for i in range(3)]
    rows += [(40 + i, "http://h.example/x", f"<nav>All the parts of this site</nav><article id='own{i}'><p>{'long ' * 50}{i}</p></article>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df, max_sent=sent).collect()}
    assert got[3] == "Title\nStory number 3 tells of 21 days and nights.\nSource 3"
    assert got[12] == "The tale of day number 2." and got[22] == f"Body 2 {'y' * 30}."
    assert got[31] == "Title\nCopied tale.\nWe use cookies here.\nBack Next\nSource 1" and got[41] == "long " * 50 + "1"
