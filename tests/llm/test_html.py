import html
import re

import pytest

from tagflow.llm import html_extract as x


def brute(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, brute(r.html)) for r in pages.collect()}
    got = {r.page_id: (r.url, r.text) for r in x.main_text(pages).collect()}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in x.main_text(pages).collect())


CASES = [
    ("", ""), (None, ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b<br>c</p>d", "a\nb c\nd"), ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<nav>menu</nav><article><h1>T</h1><p>one <b>two</b></article><footer>f</footer>", "T\none two"),
    ("<main><div class='sidebar'>s</div><p>x</p><div id=comments><p>nice</div></main>", "x"),
    ("<article><p>a</p><section class=\"user-comments\"><p>c</p></section><aside>z</aside><form>f</form></article>", "a"),
    ("<body><header>site</header><div role=navigation>n</div><div class='cookie-notice'>k</div><p>text</p><div class=\"adBanner\">buy</div>", "text"),
    ("<article><header><h1>Title</h1><time>now</time></header><p>x</article>", "Title\nx"),
    ("<article><p>a &amp;amp; b &copy; &#233; &eacute &nbsp; c</p></article>", "a &amp; b © é é c"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ("<script>var t='</p><article>no</article>';</script><style>p{}</style><article><p>x</p></article>", "x"),
    ("<article><p>x</p><script>if (a < b) { c('</article>') }</script><p>y</p></article>", "x\ny"),
    ("<article><p>a<!-- b --> c</p><p hidden>h</p><p style='display: none'>i</p></article>", "a c"),
    ("<article><p>a</div></span>b</p></article>", "ab"), ("<article><p>unclosed <b>bold<p>next", "unclosed bold\nnext"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<article>loose text<p>para</p>tail</article>", "loose text\npara\ntail"),
    ("<div class='article-body'><p>a</p></div><div class='related'>r</div>", "a"), ("<article><p>w<wbr>x<img alt='no'>y</p></article>", "wx y"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert x.extract(page, set()) == want


def test_deep_and_long_pages():
    assert x.extract("<div>" * 20000 + "deep", set()) == "deep"
    assert len(x.extract("<p>word " * 20000, set()).split("\n")) == 20000


def page(i, host="h.example"):
    return (f"http://{host}/{i}", f"<div class=top>All pages say this</div><div class=text><p>Page {i} says {i * 7} things</p><p>and {i * 13} more</p></div><div class=end>Same end</div>")


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, *page(i)) for i in range(30)] + [(100, *page(3, "lonely.example"))]
    got = {r.page_id: r.text for r in x.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Page 7 says 49 things\nand 91 more"
    assert got[100].startswith("All pages say this\nPage 3")  # a host with one page has no say


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://c.example/", "<nav>n</nav><article><h1>Copy</h1><p>the same text</p></article>") for i in range(40)]
    assert {r.text for r in x.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Copy\nthe same text"}


PAGES = "page_id long, url string, html string"


def test_style_tree_removes_what_a_site_repeats_inside_articles(spark):
    box = "<div class=bio>Ann writes about ships and the sea.</div><p class=more><a href=/>Read more</a></p>"
    rows = [(i, "http://b.example/", f"<nav>n</nav><article><h1>Title {i}</h1><p>Page {i} says<br>{i * 7} things</p>{box}</article>") for i in range(30)]
    rows += [(100 + i, "http://c.example/", f"<main><p>the same text</p>{box}</main>") for i in range(30)]  # copies: one text, no say
    got = {r.page_id: r.text for r in x.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"Title {i}\nPage {i} says {i * 7} things" for i in range(30))
    assert {got[100 + i] for i in range(30)} == {"the same text\nAnn writes about ships and the sea.\nRead more"}


def test_a_small_section_of_a_large_host_is_cleaned(spark):
    rows = [(i, "http://big.example/", f"<div class=text><p>Page {i}</p></div>") for i in range(1000)]
    rows += [(i, "http://big.example/s", f"<div class=list>Section menu</div><div class=text><p>Page {i}</p></div>") for i in range(1000, 1008)]
    got = {r.page_id: r.text for r in x.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"Page {i}" for i in range(1008))


def test_nodes_below_long_paths_are_told_apart(spark):
    long = " ".join(f"utility-class-{k}" for k in range(60))
    rows = [(i, "http://l.example/", f"<div class='{long}'><div class=text><p>Page {i} says {i * 7} things</p></div><div class=end>Same end</div></div>") for i in range(30)]
    got = {r.page_id: r.text for r in x.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"Page {i} says {i * 7} things" for i in range(30))


def test_importance_equals_a_plain_count(spark):
    import math
    rows = [("h", "<div>" + "".join(f"<p>{w}</p>" for w in ws) + "</div>") for ws in (["a", "b"], ["a"], ["a", "c"], ["d", "e", "f"])]
    got = {r.path: r for r in x.importance(spark.createDataFrame(rows, "host string, html string")).collect()}
    p = got[x.path_hash(">div>p")]
    assert p.pages == 4 and p.content == pytest.approx(1 - (math.log(3) / 6) / math.log(4) * 1) or p.content == pytest.approx(1 - math.log(3) / math.log(4) / 6)
    d = got[x.path_hash(">div")]
    assert d.presentation == pytest.approx(-(2 / 4 * math.log(2 / 4) + 2 * 1 / 4 * math.log(1 / 4)) / math.log(4))


def test_edges(spark):
    rows = [(1, None, None, "x"), (None, "notaurl", "<p>a", "x"), (1, None, None, "x"), (2, "http://Q.r:80/x", "", None), (3, "http://u@q.r/", "<p>" + "long " * 200000, "y")]
    got = x.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 5
    assert {(r.page_id, r.n_chars) for r in got.collect()} == {(1, 0), (None, 1), (2, 0), (3, 999999)}
    assert x.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_near_copies_of_an_article_keep_their_text(spark):
    common = "".join(f"<p>Paragraph {k} of the release notes that all eight share.</p>" for k in range(30))
    rows = [(i, "http://n.example/", f"<nav>n</nav><article><h1>Release {i}</h1>{common}<p>Only number {i} has this.</p></article>") for i in range(8)]
    rows += [(100 + i, "http://m.example/", f"<article><h1>Release {i}</h1>{common}<p>Only number {i} has this.</p></article>") for i in range(300)]
    for r in x.main_text(spark.createDataFrame(rows, PAGES)).collect():
        i = r.page_id % 100 if r.page_id < 100 else r.page_id - 100
        assert r.text.split("\n") == [f"Release {i}", *[f"Paragraph {k} of the release notes that all eight share." for k in range(30)], f"Only number {i} has this."]


@pytest.mark.parametrize("name", ["social-history", "related-work", "side-effects", "price-side", "header-image-credits", "commented", "navigator", "adrift", "notice-of-appeal"])
def test_a_name_among_others_is_no_verdict(name):
    assert x.extract(f"<article><p>a</p><div class='{name}'><p>b</p></div><p class='{name}'>c</p><p>d <span id='{name}'>e</span></p></article>", set()) == "a\nb\nc\nd e"


@pytest.mark.parametrize("name", ["sidebar", "site-header", "main-nav", "share-buttons", "adBanner", "ad-slot-3", "cookie_notice", "commentList", "relatedPosts", "ads x"])
def test_names_of_parts_that_are_no_content(name):
    assert x.extract(f"<main><p>a</p><div class='{name}'><p>b</p></div></main>", set()) == "a"


def test_a_hint_is_confirmed_by_the_site(spark):
    rows = [(i, "http://s.example/", f"<article><p>Text number {i}.</p><p>More of it, {i * 3}.</p><div class='related-reading'><p>{'See also our guide' if i % 3 else f'On topic {i}'}</p></div></article>") for i in range(60)]
    got = {r.page_id: r.text for r in x.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1] == "Text number 1.\nMore of it, 3." and got[3] == "Text number 3.\nMore of it, 9.\nOn topic 3"


@pytest.mark.parametrize("markup", ["<a " * 340_000, "<a " * 340_000 + ">", "<div></span>" * 87_000, "<span><article>" + "<div>" * 40_000 + "</span>" * 110_000, "<a x='\"b>" * 110_000,
                                    "<" * 1_000_000, "<!--" * 250_000, "<title>" * 140_000, "&" * 1_000_000])
def test_broken_markup_of_a_megabyte_is_read_in_seconds(markup):
    import time
    began = time.process_time()
    x.extract(markup, set())
    assert time.process_time() - began < 5


def site(draw, pages):
    """Well-formed pages of one host without article tags: a menu, own and shared paragraphs, a box on some pages, now and then a copy."""
    out = []
    for i in range(pages):
        own = "".join(f"<p>Own text {i} {k} {draw.random():.6f}</p>" for k in range(draw.randint(1, 3)))
        often = "".join(f"<p>Often said {k}</p>" for k in range(4) if draw.random() < [0.9, 0.5, 0.1, 0.02][k])
        box = "<div class='box'><h2>About us</h2><p>We sell ships.</p></div>" if draw.random() < 0.6 else ""
        out.append(f"<html><body><div class='top'><p>Home</p><p>Shop</p></div><div class='text'>{own}{often}</div>{box}<div class='end'>The end</div></body></html>")
        if draw.random() < 0.2:
            out.append(out[-1])
    return out


def test_style_tree_against_a_plain_one(spark):
    """Counts, importance and verdicts of every block by plain Python over ElementTree."""
    import math
    import random
    from collections import Counter, defaultdict
    from xml.etree import ElementTree

    def walk(node, path, out, kids):
        path += (node.tag + ("." + node.attrib["class"] if "class" in node.attrib else ""),)
        if len(node):
            kids.append((path, tuple(c.tag for c in node)))
        if (node.text or "").strip():
            out.append((path, node.text.strip()))
        for c in node:
            walk(c, path, out, kids)

    for seed in (1, 2, 3):
        pages = site(random.Random(seed), 50)
        texts, styles = [], []
        for p in pages:
            out, kids = [], []
            walk(ElementTree.fromstring(p), (), out, kids)
            texts.append(tuple(out)), styles.append(tuple(kids))
        units = {tuple(b for _, b in t): (set(t), set(s)) for t, s in zip(texts, styles)}
        c, n, m, at = Counter(), Counter(), Counter(), defaultdict(list)
        for blocks, kids in units.values():
            c.update(blocks), n.update(kids)
            m.update({p for p, _ in blocks} | {p for p, _ in kids})
        for (p, t), k in c.items():
            at[p].append(k)
        seqs = defaultdict(list)
        for (p, s), k in n.items():
            seqs[p].append(k)

        def low(p, t):
            if c[p, t] < x.MIN_PAGES:
                return False
            own = 1 - math.log(c[p, t]) / math.log(m[p])
            content = 1 - sum(map(math.log, at[p])) / len(at[p]) / math.log(m[p])
            if seqs[p]:
                total = sum(seqs[p])
                content = (content - sum(k / total * math.log(k / total) for k in seqs[p]) / math.log(m[p])) / 2
            return x.OWN * own + (1 - x.OWN) * content < x.LEAST_IMPORTANCE

        rows = [(i, "http://one.example/", p) for i, p in enumerate(pages)]
        got = {r.page_id: r.text for r in x.main_text(spark.createDataFrame(rows, PAGES)).collect()}
        removed = 0
        for i, t in enumerate(texts):
            left = [b for p, b in t if not low(p, b)]
            removed += len(t) - len(left)
            assert got[i] == "\n".join(left or [b for _, b in t])
        assert removed > 100
