"""Main text of pages: named branches, the site style tree on unnamed ones, broken markup, hard inputs."""

import math
from collections import defaultdict

import pytest
from conftest import text

from frostline.llm import site_pages
from frostline.llm.site_pages import Page

SCHEMA = "page_id long, url string, html string, text string, node long, unit string"


def extract(html):
    page = Page(html)
    return page.text(dict.fromkeys(page.open, True))


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", -1, "clash") for i, u, h in rows], SCHEMA)


def site(k, words):
    """A page without any telling names: menu, advert, article, comment box and foot are plain divisions."""
    menu = "".join(f"<div><a href='/{w}'>{w.title()}</a></div>" for w in ("home", "news", "sport", "about"))
    article = "".join(f"<p>{p}</p>" for p in words)
    return f"<html><body><div class=x1>{menu}</div><div class=x2><h2>{words[0][:20]} {k}</h2>{article}</div><div class=x3>Sign up for our letter. It is free.</div><div class=x4>All rights kept.<br>Page made by hand.</div></body></html>"


@pytest.fixture(scope="module")
def unnamed():
    return [(k, f"https://plain.example/{k}", site(k, [text(10 * k + j, 12) for j in range(1 + k % 5)])) for k in range(40)]


def test_tree_on_unnamed_branches(spark, unnamed):
    """What all pages of a host repeat goes, what each says alone stays; a host's only page keeps all."""
    lonely = (99, "https://other.example/", unnamed[0][2])
    no_host = (98, None, unnamed[0][2])
    got = {r.page_id: r for r in site_pages.main_text(frame(spark, [*unnamed, lonely, no_host])).collect()}
    for k, _, _ in unnamed:
        paragraphs = [text(10 * k + j, 12) for j in range(1 + k % 5)]
        assert got[k].text == "\n".join([f"{paragraphs[0][:20]} {k}".replace("  ", " "), *paragraphs]) and got[k].n_chars == len(got[k].text)
    for k in (98, 99):
        assert got[k].text.startswith("Home\nNews") and got[k].text.endswith("All rights kept. Page made by hand.")


def test_units_of_any_size_agree(spark, unnamed):
    a, b = (sorted(map(tuple, site_pages.main_text(frame(spark, unnamed).repartition(n), chars=c).collect())) for n, c in ((1, 4_000_000), (5, 3_000)))
    assert a == b


def test_importance_by_brute_force(spark, unnamed):
    styles, said = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for _, u, h in unnamed:
        page = Page(h)
        page.tree(site_pages.host_of(u))
        for i, s in enumerate(page.states):
            if s == 0:
                styles[page.ids[i]][page.styles[i]] += 1
        for i, fs in page.features().items():
            for f in fs:
                said[page.ids[i]][f] += 1
    rows = [(n, True, v, c) for n, vs in styles.items() for v, c in vs.items()] + [(n, False, v, c) for n, vs in said.items() for v, c in vs.items()]
    got = {r.node: r for r in site_pages.style_tree(spark.createDataFrame(rows, "node long, look boolean, value long, n long")).collect()}
    assert set(got) == {n for n, vs in styles.items() if sum(vs.values()) > 1}
    for n, r in got.items():
        m = sum(styles[n].values())
        look = -sum(c / m * math.log(c / m, m) for c in styles[n].values())
        assert r.styles == len(styles[n]) and abs(r.look - look) < 1e-8
        if said[n]:
            assert abs(r.content - (1 - sum(math.log(c, m) for c in said[n].values()) / len(said[n]))) < 1e-8


def test_named_branches():
    page = """<!DOCTYPE html><html class=no-js><head><title>T &amp; t</title><script>if (a < b) { "</p>" }</script><style>p{}</style></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-banner">We use cookies</div><!-- <p>no</p> -->
    <form id=aspnet><div id="content"><article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>two</b><i>three</i>&nbsp;four
    five<br>six<p>Seven<ul><li>a<li>b</ul><div class="ad">buy</div><aside>side</aside><form><input><button>Go</button></form><footer>tags</footer>
    <pre> x   y </pre><table><tr><td>1<td>2<tr><td>3</table></article></div><ol class="comment-list"><li><article class="comment">nice</article></ol></form>
    <div id=sidebar>links</div><div>Lost</div><footer>&copy; me</footer></body></html>"""
    assert extract(page) == "Title & more\nOne twothree four five six\nSeven\na\nb\nx y\n1\n2\n3"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""), ("plain &lt;text&gt; &am &amp", "plain <text> &am &"), ("<p>a<p>b</p>c", "a\nb\nc"), ("<b><p>a</b> b</p>", "a b"), ("a < b <3 </ x> c", "a < b <3 c"), ("<p title='x>y' class=\"z>\">t</p>", "t"),
        ("<p title=it's>t</p> it's", "t\nit's"), ("<p title=\"never>t</p>", "t"), ("<!-->a<!---->b<!--c", "ab"), ("x<script>1", "x"), ("x<p", "x"), ("<div><span>a</div>b", "a\nb"), ("<P>A&#x41;&#65;</P>", "AAA"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"), ("a<br>b<hr>c", "a b\nc"), ("<p>&nbsp;　</p>", ""), ("<textarea>a</textarea><title>b</title>c", "c"), ("<div hidden>a</div><div style='display: none'>b</div>c", "c"),
        ("<article>" * 3 + "a" + "</article>" * 3 + "b", "a"), ("</p></div></b>a", "a"), ("<html><html><body><body>a</body></html>b", "ab"),
    ],
)
def test_markup(html, want):
    assert extract(html) == want


def test_hard_rows(spark):
    """Null and empty pages, repeated rows, bad addresses, very long and very deep pages."""
    long = "<article><p>" + "word &amp; " * 100_000 + "</p></article>"
    deep = "<div>" * 5_000 + "deep" + "</div>" * 5_000
    rows = [(1, "http://h/", None), (2, None, ""), (None, "http://[bad", "<p>x"), (3, "http://h/", long), (4, "http://h2/", deep), (4, "http://h2/", deep), (5, "http://h3/", "<")]
    got = sorted(map(tuple, site_pages.main_text(frame(spark, rows)).collect()), key=str)
    said = " ".join(["word &"] * 100_000)
    want = [(1, "http://h/", "", 0), (2, None, "", 0), (None, "http://[bad", "x", 1), (3, "http://h/", said, len(said)), (4, "http://h2/", "deep", 4), (4, "http://h2/", "deep", 4), (5, "http://h3/", "<", 1)]
    assert got == sorted(want, key=str)
    assert site_pages.main_text(frame(spark, rows[:0])).count() == 0


def named_site(k, words):
    """A page whose markup names its menu, article and footer; all articles of the site end alike."""
    article = "".join(f"<p>{p}</p>" for p in words)
    return f"<html><head><title>{k}</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><div class=ad>Buy it now</div><article><h1>{words[0][:20]} {k}</h1>{article}<p>Written in the capital.</p></article><footer>All rights kept.</footer><script>1</script></body></html>"


def test_tree_has_named_branches():
    """All elements but those that are never text have a place in the tree, and what they say counts."""
    page = Page(named_site(1, [text(1, 12)]))
    page.tree("h")
    assert {t for t, i in zip(page.tags, page.ids) if not i} == {"head"}
    assert {page.tags[i] for i, s in enumerate(page.states) if s} == {"head", "nav", "ul", "li", "div", "article", "h1", "p", "footer"}
    assert {page.tags[i] for i in page.features()} == {"li", "div", "h1", "p", "footer"}


@pytest.mark.parametrize(("n", "chars"), [(1, 4_000_000), (5, 3_000)])
def test_names_check_what_the_tree_says(spark, tmp_path, n, chars):
    """The tree judges named branches as well, by all pages of the host; names come after it."""
    said = {k: [text(10 * k + j, 12) for j in range(1 + k % 5)] for k in range(40)}
    rows = [(k, f"https://named.example/{k}", named_site(k, w)) for k, w in said.items()]
    styles, features, pages = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int)), {}
    for k, u, h in rows:
        page = pages[k] = Page(h)
        page.tree(site_pages.host_of(u))
        for i in range(len(page.tags)):
            if page.seen[i]:
                styles[page.ids[i]][page.styles[i]] += 1
        for i, fs in page.features().items():
            for f in fs:
                features[page.ids[i]][f] += 1
    known = {}
    for i, vs in styles.items():
        if (m := sum(vs.values())) > 1:
            content = 1 - sum(math.log(c, m) for c in features[i].values()) / len(features[i]) if features[i] else 0.0
            known[i] = (-sum(c / m * math.log(c / m, m) for c in vs.values()), content, len(vs))
    frame(spark, rows).repartition(n).write.parquet(str(tmp_path / "pages"))
    got = {r.page_id: r for r in site_pages.main_text(spark.read.parquet(str(tmp_path / "pages")), chars=chars, stored=True, tree_chars=True).collect()}
    for k, w in said.items():
        whole = "\n".join([f"{w[0][:20]} {k}".replace("  ", " "), *w])
        assert pages[k].text(site_pages.judge(pages[k], known, 0.3, 0.9), checked=False) == whole
        assert got[k].tree_chars == len(whole) and got[k].text == f"{whole}\nWritten in the capital."


def test_importance_reaches_pages_however_files_are_cut(spark, unnamed, tmp_path):
    """Units go by rows' places in files: the second reading may be cut otherwise than the first."""
    frame(spark, unnamed * 20).coalesce(1).write.option("parquet.block.size", 20_000).option("compression", "none").parquet(str(tmp_path / "pages"))
    want = sorted(map(tuple, site_pages.main_text(frame(spark, unnamed * 20), chars=3_000).collect()))
    pages, before = spark.read.parquet(str(tmp_path / "pages")), spark.conf.get("spark.sql.files.maxPartitionBytes")
    parts = pages.rdd.getNumPartitions()
    out = site_pages.main_text(pages, chars=3_000, stored=True)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        assert out.rdd.getNumPartitions() > parts
        assert sorted(map(tuple, out.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
