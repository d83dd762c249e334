"""Main texts of pages: the reader of HTML, the rules of one page, and what recurs on a host."""

import html
import re
import time

import pytest

from quillon.llm import pages, queries
from quillon.llm.htmltree import Page


def text(h):
    return Page(h).main_text()


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b<div>c</div>d", "a b c d"),
        ("<p><b>Title<br><p>next</p>", "Title next"),
        ("<p>fo<b>o</b>b<i>ar</i> x</p>", "foobar x"),
        ("<p>a\n\t b&nbsp;c</p>", "a b c"),
        ("<p>&lt;b&gt; &amp;lt; &copy &#233; &#x4E00; &zzname; &am</p>", "<b> &lt; © é 一 &zzname; &am"),
        ("<script>var t='</p>';</script><style>p{}</style><p>x</p>", "x"),
        ("<script>unclosed <p>x</p>", ""),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ('<p title="a > b">x</p><p title=\'it"s\'>y</p>', "x y"),
        ("<p>a<!-- no > <p>never</p> -->b</p><!-- open", "ab"),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "one two in three"),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", "a b c d"),
        ("<div><table><tr><td>a</div>b</td></tr></table>c</div>", "ab c"),
        ("<html><head><title>T</title><meta charset=utf-8><body><p>x", "x"),
        ("<P CLASS=x>Upper</P><BR/>case", "Upper case"),
        ("<p>cut off <a hre", "cut off"),
        ("<title>only</title>", ""),
        ("<b><div>x</b>y</div>z", "xy z"),
    ],
)
def test_reading(page, want):
    assert text(page) == want


SITE = '<header><a href="/">Site</a><h2>Slogan</h2></header><nav><ul><li><a>Home</a></ul></nav><aside>Side</aside>'


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body class='has-sidebar'>{SITE}<article><h1>T</h1><p>x</p></article><footer>f</footer></body>", "T x"),
        (f"{SITE}<main><h1>T</h1><p>x</p><div class='share-buttons'>tweet</div><section id='comments'><article class='comment'>me too</article></section></main>", "T x"),
        ("<article><header><h1>T</h1></header><p>x</p><form><input>y</form><div class='ad-slot'>buy</div><footer>by me</footer></article>", "T x"),
        ("<div class='cookie-notice'>We use cookies</div><div id='content'><p>long text of the page</p></div><div class='widget'>w</div>", "long text of the page"),
        ("<form id='aspnet'><article><p>x</p></article></form>", "x"),
        ("<div class='with-ads comments-closed'><article><p>x</p></article></div>", "x"),
        ("<article><p>x</p></article><section class='comments'><article><p>first!</p></article></section>", "x"),
        ("<article><p>x</p><div style='display: none'>h</div><p hidden>h</p><p aria-hidden='true'>h</p><noscript>n</noscript><template>t</template></article>", "x"),
        ("<div><ul><li><a>A</a><li><a>B</a><li><a>C</a></ul><p>Text of a page with <a>a link</a>.</p></div>", "Text of a page with a link."),
        ("<article><p title='hidden gems' data-hidden alt=\"a class='ad'\" CLASS = text>x</p><p class=ad>y</p><p aria-hidden=false id='a' id='ad'>z</p></article>", "x z"),
        ("<article><p class='notice'>Read this</p><p class='text-center'>x</p><p class='addition'>y</p></article>", "x y"),
    ],
)
def test_rules_of_one_page(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page", ["<div>" * 200_000, "<b>" * 200_000, "<p><b>" * 100_000, "<p a=\"" * 100_000, "<!-- " * 100_000, "<script>" * 50_000, "<" * 500_000, "<a " * 100_000, "<article>x</article>" * 50_000, "</div>" * 300_000, "&" * 500_000, "<a href='" * 100_000, "<p " + "a " * 200_000 + ">", "<p " + "class " * 100_000 + ">x", "<p " + "a=" * 200_000 + ">"])
def test_long_pages_take_time_in_proportion(page):
    began = time.time()
    p = Page(page)
    p.subtrees("h")
    p.main_text("h", frozenset([1]))
    assert time.time() - began < 20


def plain(h):
    """The articles of the given pages, which are all of one make."""
    inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", inner))).split())


def test_op13_over_the_whole_table(spark, sf_dir):
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op13_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(rows) > 0
    for r in got:
        assert (r.url, r.text) == (rows[r.page_id].url, plain(rows[r.page_id].html)) and r.n_chars == len(r.text)


def unmarked(i, k):
    """A page of plain divisions: nothing but recurrence tells the site's from its own."""
    return f"<div><div>Fine Goods of Town since 1950</div><div>Story {i} of the day<p>{' '.join(f'word{i}x{j}' for j in range(30 + k))}</p></div><div>Call us any time, <b>we are open</b></div></div>"


SCHEMA = "page_id long, url string, html string, host string, subtree long, page long, page_key string, text string, n_chars long"


@pytest.fixture(scope="module")
def site(spark):
    rows = [(i, f"https://Shop.example.org:80/{i}", unmarked(i, 0)) for i in range(6)]
    rows += [(10 + i, f"http://copies.example.org/{i}", unmarked(77, 0) + f"<p>visit {i}</p>") for i in range(8)]
    rows += [(20 + i, f"http://quotes.example.org/{i}", f"<article><h1>T{i}</h1><p>A passage that they all quote.</p><section class='x'>Follow the site</section><p>own {i}</p></article>") for i in range(5)]
    rows += [(30, "http://small.example.org/1", unmarked(30, 0)), (31, "http://small.example.org/2", unmarked(31, 0)), (32, None, unmarked(32, 0)), (33, None, unmarked(33, 0)), (34, None, unmarked(34, 0)), (35, "not a url", unmarked(35, 0)), (36, "http://e.org/", None), (37, "http://e.org/", ""), (None, "http://e.org/", "<p>x</p>")]
    rows += [rows[0]]
    return spark.createDataFrame([(*r, "h", 1, 2, "k", "t", 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("most", [pages.BROADCAST_SUBTREES, 0])
def test_what_recurs_on_a_host_goes(site, most):
    got = [tuple(r) for r in pages.main_texts(site, broadcast_subtrees=most).collect()]
    own = {r[0]: r[2] for r in got}
    assert len(got) == 29 and all(len(t) == n for _, _, t, n in got)
    for i in range(6):
        assert own[i] == f"Story {i} of the day " + " ".join(f"word{i}x{j}" for j in range(30))
    for i in range(8):  # one story eight times is no template
        assert f"Story 77 of the day {' '.join(f'word77x{j}' for j in range(30))}" in own[10 + i]
    for i in range(5):  # a shared passage of marked articles stays, a box of the site goes
        assert own[20 + i] == f"T{i} A passage that they all quote. own {i}"
    for i in (30, 31, 32, 33, 34, 35):
        assert own[i].startswith("Fine Goods") and own[i].endswith("we are open")
    assert own[36] == own[37] == "" and own[None] == "x"


def test_templates_are_counted_by_host(site):
    got = pages.site_templates(site).groupBy("host").count().collect()
    assert {r.host for r in got} == {"shop.example.org", "quotes.example.org"}
    assert pages.site_templates(site, min_pages=7).count() == 0


def test_no_pages(spark):
    assert pages.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
