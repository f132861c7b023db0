"""Main text of web pages with a site style tree.

The element trees of a host's pages are merged by path (tags with classes and ids from the root).  Each text block is a leaf of the merged tree: m
distinct texts of the host have its path, c of them this very block there; its own importance is 1 - log c / log m (a block that all
share has 0, one that stands once has 1).  A path's importance is the mean of its blocks' importance (content) and of the entropy
of its child-tag sequences to base m (presentation), where it has both.  A block goes where ``OWN`` times its own importance and 1 - ``OWN``
times its path's stay below ``LEAST_IMPORTANCE``, so a verdict is about a block and never takes what stands once.

What markup itself declares to be no content goes first (menus, headers, footers, asides, forms, adverts, notices, comments): by tag, role, and
class or id tokens that are such a name, or are put together of nothing but such names and words for places and shapes.  A class that
merely holds such a name among others ("social-history") is a weak vote: a block below it needs ``SUSPECT_IMPORTANCE``.  A page's article or
main element bounds what is extracted.

Copies and near copies must not make an article look like a template.  Equal texts count once, and a block inside an article or main element
goes only where its companions differ: each text has ``HASHES`` min-hash values over its blocks, and the texts that hold the block must have
values of at least ``MIN_PAGES`` kinds, and of one for each ``COPIES`` texts.  If nothing would be left of a page, all stays.

Defined cases: null or empty html gives an empty text; pages without a host in their url share the empty host; fewer than
``MIN_PAGES`` distinct texts with a path have no say on it; unclosed and stray tags are taken as browsers do roughly; a tag that is
never closed by > is text; repeated rows are pages each; null ids are kept; an empty table gives no rows; other columns are ignored.
Parsing takes time in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tagflow.llm.common import dropped, prepared, written

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold no article text, and what classes, ids and roles call such parts (fixed values).
NO_CONTENT = frozenset("head title script style noscript template iframe object svg canvas nav footer aside form button select textarea input "
                       "label dialog menu audio video".split())
NO_CONTENT_NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
                             "breadcrumb breadcrumbs pagination pager sidebar side aside footer header masthead cookie cookies consent gdpr notice notices alert popup modal "
                             "overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar skip "
                             "comment comments commentlist reply replies respond discussion disqus".split())
#: Words for places and shapes that a name of such a part is put together with (fixed values).
PLACES = frozenset("site page main global top bottom left right list box bar container wrapper wrap inner outer area slot unit block section panel "
                   "button buttons link links item items post posts article articles story stories user users reader readers icon icons primary secondary "
                   "sub mobile desktop sticky fixed js".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
#: An open element that a new one of the given kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article main section aside nav body html div td th".split())
P_CLOSERS = BLOCKS - {"html", "body", "caption", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "summary"}
#: A stray end tag of another kind doesn't reach out of these.
WALLS = ("article", "main", "body", "table")
WALL_ENDS = frozenset(WALLS) | {"html"}
_NOT_P, _SCOPES = BLOCKS - {"p"}, {tag: SCOPE - closed for tag, closed in CLOSES.items()}

MIN_PAGES, LEAST_IMPORTANCE, SUSPECT_IMPORTANCE, OWN, COPIES, HASHES = 5, 0.3, 0.6, 0.7, 4, 4
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# --------------------------------------------------------------------------- tokens of a page
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)?+")
_WANTED = frozenset(("class", "id", "role", "style", "hidden", "aria-hidden"))


def tokens(page: str):
    """("data", text), ("open", tag, attributes) and ("close", tag), in one pass from left to right; every character is looked at a bounded number of times."""
    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        lt = page.find("<", at)
        if lt < 0 or lt >= last:  # no tag can end any more
            yield "data", page[at:]
            return
        if lt > at:
            yield "data", page[at:lt]
        tag = _TAG.match(page, lt)
        if tag is None:
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
            elif page[lt + 1:lt + 2] in ("!", "?", "/"):
                at = page.index(">", lt) + 1
            else:
                yield "data", "<"
                at = lt + 1
            continue
        name = tag.group(2).lower()
        if tag.group(1):
            yield "close", name
            at = page.index(">", tag.end()) + 1
            continue
        given, here = {}, tag.end()
        while here < end and page[here] != ">":
            a = _ATTRIBUTE.match(page, here)
            if a.end() == here:
                break
            here = a.end()
            if a.group(1) and (key := a.group(1).lower()) in _WANTED:
                given.setdefault(key, entities.unescape(a.group(2) or a.group(3) or a.group(4) or ""))
        if here >= end:  # never closed
            yield "data", page[lt:]
            return
        at = here + 1
        yield "open", name, given
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I | re.A).search(page, at)
            if name in ("textarea", "title"):
                yield "data", page[at:stop.start() if stop else end]
            at = stop.start() if stop else end
            if stop and page.find(">", at) < 0:
                at = end


# --------------------------------------------------------------------------- tree
class Node:
    __slots__ = ("tag", "noise", "suspect", "path", "parts")

    def __init__(self, tag: str, noise: bool, suspect: bool, path: int):
        self.tag, self.noise, self.suspect, self.path, self.parts = tag, noise, suspect, path, []


def named(tokens_: str) -> tuple[bool, bool]:
    """(whether a class or id says that this is no content, whether it hints at it)."""
    hint = False
    for token in tokens_.split():
        parts = {p.lower() for p in _PART.findall(token)}
        if parts & NO_CONTENT_NAMES:
            if parts <= NO_CONTENT_NAMES | PLACES or all(p.isdigit() for p in parts - NO_CONTENT_NAMES - PLACES):
                return True, True
            hint = True
    return False, hint


def no_content(tag: str, given: dict[str, str]) -> tuple[bool, bool]:
    """(whether markup declares the element to be no content, whether its name hints at it)."""
    if tag in ("html", "body"):
        return False, False
    if tag in NO_CONTENT or "hidden" in given or given.get("role", "").lower() in NO_CONTENT_ROLES or given.get("aria-hidden") == "true":
        return True, True
    if re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", given.get("style", "")):
        return True, True
    noise, hint = named(f"{given.get('class', '')} {given.get('id', '')}")
    if noise and tag in ("article", "main"):
        parts = {p.lower() for p in _PART.findall(f"{given.get('class', '')} {given.get('id', '')}")}
        noise = bool(parts & {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "related"})
        hint = False
    return noise, hint


class Tree:
    """The element tree of one page; never fails on bad markup.  ``_at`` holds the places of each open tag, so closing one needs no search."""

    def __init__(self, page: str | None):
        self.root = Node("#root", False, False, 0)
        self.open, self._at = [self.root], {}
        for token in tokens(page or ""):
            if token[0] == "data":
                if token[1]:
                    self.open[-1].parts.append(entities.unescape(token[1]))
            elif token[0] == "open":
                self._start(token[1], token[2])
            else:
                self._end(token[1])

    def _last(self, tags) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=0)

    def _cut(self, place: int) -> None:
        for node in self.open[place:]:
            self._at[node.tag].pop()
        del self.open[place:]

    def _start(self, tag: str, given: dict[str, str]) -> None:
        if tag in P_CLOSERS and (p := self._last(("p",))) and p > self._last(_NOT_P):
            self._cut(p)
        if tag in CLOSES and (p := self._last(CLOSES[tag])) and p > self._last(_SCOPES[tag]):
            self._cut(p)
        style = tag + "".join(sorted("." + c for c in given.get("class", "").split())) + (f"#{given['id']}" if given.get("id") else "")
        parent = self.open[-1]
        node = Node(tag, *no_content(tag, given), chained(parent.path, style))
        parent.parts.append(node)
        if tag not in VOID:
            self._at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def _end(self, tag: str) -> None:
        place = self._last((tag,))
        if place and (tag in WALL_ENDS or place >= self._last(WALLS)):
            self._cut(place)


def tree_of(page: str | None) -> Node:
    return Tree(page).root


def chained(parent: int, style: str) -> int:
    """The path of a node: a hash of its parent's path and its own style, of the same size at any depth."""
    return xxh64_intdigest(parent.to_bytes(8, "little") + style.encode("utf-8", "surrogatepass")) >> 1


def path_hash(path: str) -> int:
    """The path of styles written as ``>style>style``."""
    h = 0
    for style in path.split(">")[1:]:
        h = chained(h, style)
    return h


def digest(text: str) -> int:
    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def regions(root: Node) -> list[Node]:
    """The outermost article or main elements; the whole page if there is none."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            found.append(node)
            continue
        stack += [p for p in reversed(node.parts) if not isinstance(p, str) and not p.noise]
    return found or [root]


def leaves(root: Node) -> tuple[list[tuple[str, int, bool]], list[tuple[int, int]]]:
    """(text blocks below ``root`` in page order as (text, path of the block element it stands in, whether a name hints at no content), and the
    (path, child-tag sequence) of each element on the way); what markup declares to be no content is left out."""
    out, run, styles = [], [], []
    top = root.tag in ("article", "main")
    # a frame: parts still to come, the block element's path, hinted, whether we are in an article's own header, where only headings count
    stack = [(iter([root]), root.path, False, False, False)]

    def flush(path, hint):
        if text := " ".join("".join(run).split()):
            out.append((text, path, hint))
        run.clear()

    while stack:
        parts, path, hint, header, block = stack[-1]
        p = next(parts, None)
        if p is None:
            if block:
                flush(path, hint)
            stack.pop()
        elif isinstance(p, str):
            if not header:
                run.append(p)
        elif p is root or not (p.noise or p.tag == "header" and not top):
            if p.tag in VOID:
                if p.tag == "hr":
                    flush(path, hint)
                elif p.tag != "wbr":
                    run.append(" ")
                continue
            if kids := [k.tag for k in p.parts if not isinstance(k, str)]:
                styles.append((p.path, digest(" ".join(kids))))
            block = p.tag in BLOCKS
            if block:
                flush(path, hint)
            own = hint or (p.suspect and p is not root)
            stack.append((iter(p.parts), p.path if block else path, own, (header or p.tag == "header") and p.tag not in HEADINGS, block))
    flush(root.path, False)
    return out, styles


def page_leaves(page: str | None) -> tuple[list[tuple[str, int, bool]], list[tuple[int, int]], bool]:
    """(blocks, styles, whether an article or main element bounds them) of a page."""
    root = tree_of(page)
    blocks, styles = [], []
    found = regions(root)
    for r in found:
        b, s = leaves(r)
        blocks += b
        styles += s
    return blocks, styles, found[0] is not root


def extract(page: str | None, low: set[tuple[int, int]] = frozenset()) -> str:
    """Main text of one page; ``low`` are the (path, hash) of blocks that are of low importance on its host."""
    blocks = page_leaves(page)[0]
    left = [b for b, path, _ in blocks if (path, digest(b)) not in low] if low else None
    return "\n".join(left or [b for b, _, _ in blocks])


# --------------------------------------------------------------------------- site style tree
LEAVES = "array<struct<path:long,h:long,hint:boolean>>"
STYLES = "array<struct<path:long,h:long>>"


def sketch(hashes) -> list[int]:
    """Min-hash values of a set of block hashes."""
    return [min((((h ^ (k + 1) * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93) & (1 << 63) - 1 for h in hashes), default=0) for k in range(HASHES)]


def page_table(pages: DataFrame) -> DataFrame:
    """One row per page: host, page (hash of its html), unit (hash of its whole text), bounded, leaves, styles and the min-hash values of its blocks."""
    def parsed(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                leaf, style, unit, bounded, sketches = [], [], [], [], []
                for page in part.column(2).to_pylist():
                    blocks, styles, inside = page_leaves(page)
                    hashes = [digest(t) for t, _, _ in blocks]
                    leaf.append([{"path": p, "h": h, "hint": s} for (_, p, s), h in zip(blocks, hashes)])
                    style.append([{"path": p, "h": h} for p, h in sorted(set(styles))])
                    unit.append(digest("\n".join(t for t, _, _ in blocks)))
                    bounded.append(inside)
                    sketches.append(sketch(set(hashes)))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(unit, pa.int64()), pa.array(bounded, pa.bool_()),
                    pa.array(leaf, pa.list_(pa.struct([("path", pa.int64()), ("h", pa.int64()), ("hint", pa.bool_())]))),
                    pa.array(style, pa.list_(pa.struct([("path", pa.int64()), ("h", pa.int64())]))), *[pa.array([s[k] for s in sketches], pa.int64()) for k in range(HASHES)]],
                    names=["host", "page", "unit", "bounded", "leaves", "styles", *[f"k{k}" for k in range(HASHES)]])

    prepared(pages.sparkSession)
    schema = f"host string, page long, unit long, bounded boolean, leaves {LEAVES}, styles {STYLES}, " + ", ".join(f"k{k} long" for k in range(HASHES))
    return pages.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(parsed, schema)


def style_trees(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Site style trees from one row per distinct text of a host (host, unit, bounded, leaves, styles, k0 ..):
    (host, path, pages, content, presentation) of the paths, and (host, path, h, c, kinds, hint, bounded) of the blocks that stand more than once."""
    keys = [f"k{k}" for k in range(HASHES)]
    leaf = units.select("host", "unit", "bounded", *keys, F.explode(F.array_distinct("leaves")).alias("x")).select("host", "unit", "bounded", *keys, "x.*")
    style = units.select("host", "unit", F.explode("styles").alias("x")).select("host", "unit", "x.*")
    blocks = leaf.groupBy("host", "path", "h").agg(F.count_distinct("unit").cast("double").alias("c"), F.greatest(*[F.approx_count_distinct(k) for k in keys]).alias("kinds"),
                                                   F.bool_or("hint").alias("hint"), F.bool_or("bounded").alias("bounded"))
    paths = leaf.select("host", "path", "unit").unionByName(style.select("host", "path", "unit")).distinct().groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("pages"))
    shared = blocks.groupBy("host", "path").agg(F.avg(F.log("c")).alias("shared"))
    styles = style.groupBy("host", "path", "h").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("host", "path").agg(
        F.sum("n").alias("styled"), F.sum(F.col("n") * F.log("n")).alias("styles"))
    many = F.col("pages") > 1
    tree = paths.join(shared, ["host", "path"], "left").join(styles, ["host", "path"], "left").select(
        "host", "path", "pages", F.when(many, 1 - F.col("shared") / F.log("pages")).when(F.col("shared").isNotNull(), 1.0).alias("content"),
        F.when(many, (F.log("styled") - F.col("styles") / F.col("styled")) / F.log("pages")).when(F.col("styles").isNotNull(), 1.0).alias("presentation"))
    return tree, blocks.where("c > 1")


def distinct_texts(table: DataFrame) -> DataFrame:
    """The rows of ``page_table`` with equal texts of a host as one."""
    cols = ["bounded", "leaves", "styles", *[f"k{k}" for k in range(HASHES)]]
    return table.groupBy("host", "unit").agg(F.min(F.struct(*cols)).alias("x")).select("host", "unit", "x.*")


def importance(pages: DataFrame) -> DataFrame:
    """The paths of site style trees (host, path, pages, content, presentation); ``pages`` has host and html."""
    return style_trees(distinct_texts(page_table(pages)))[0]


def low_blocks(units: DataFrame) -> DataFrame:
    """(host, path, h) of the blocks that go."""
    tree, blocks = style_trees(units)
    own = F.when(F.col("pages") > 1, 1 - F.log("c") / F.log("pages")).otherwise(F.lit(1.0))
    path = F.when(F.col("presentation").isNull(), F.col("content")).otherwise((F.col("content") + F.col("presentation")) / 2)
    weight = OWN * own + (1 - OWN) * path
    apart = (F.col("kinds") >= MIN_PAGES) & (F.col("kinds") * COPIES >= F.col("c"))
    often = (F.col("c") >= MIN_PAGES) & (~F.col("bounded") | apart)
    low = weight < F.when(F.col("hint"), SUSPECT_IMPORTANCE).otherwise(LEAST_IMPORTANCE)
    return blocks.join(tree, ["host", "path"]).where(often & low).select("host", "path", "h")


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A page is parsed for the site's trees, of which only hashes are kept, and again for its text, so no text is written or moved in between.
    """
    prepared(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    table = written(page_table(own), "site-pages")
    low = low_blocks(distinct_texts(table))
    # each page's own blocks meet the host's low ones row by row, so that a page's list is as long as the page and no host has one
    found = table.select("host", "page", F.explode("leaves").alias("x")).select("host", "page", "x.path", "x.h").distinct().join(low, ["host", "path", "h"])
    gone = written(found.groupBy("host", "page").agg(F.collect_list(F.struct("path", "h")).alias("gone")), "site-low")
    dropped(table)

    @F.pandas_udf("string")
    def text_of(html: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([extract(h, frozenset() if x is None else {(r["path"], r["h"]) for r in x}) for h, x in zip(html, lists)], dtype=object)

    # the lists are joined as Spark finds fit: small ones are broadcast by measured size, else a much-copied page is split
    return (own.withColumn("page", F.xxhash64("html")).join(gone, ["host", "page"], "left").select("page_id", "url", text_of("html", "gone").alias("text"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))
