"""Main text of web pages by site template removal.

A page is parsed into elements; the subtree of each block element has a hash of its tags and
text, and a slot: the path of tags, classes and places that leads to it. Spark counts, for each host, on how many
different pages a subtree stands, where pages with the same body count once, so that copies of a page are no template.
A subtree is template, and goes with all it holds, if it stands on a few different pages at least and either

* on a share of its host's pages, or
* in a slot where such a share of the host's pages has something that recurs (a menu with a text for each rubric, say).

What recurrence leaves goes by its tag if the tag names a part that is no article (nav, footer, form, ...), and by a
class or id that does (a host with few pages has no recurrence to go by, and some adverts never recur).

An article (article or main) and what holds one is never template. Inside an article, recurrence alone
removes only containers, never headings, paragraphs, lists, figures, quotes, code and tables: passages that
several articles of a host share are their text. If nothing is left of a page's articles, the rest of the page counts.

Defined cases: null and empty html, and pages without text, give an empty text; a url without a host, or
a null one, counts under the empty host; repeated rows each get a row; unclosed, crossed or stray
tags are closed by their block; a tag with a stray or unclosed quote ends at its first >, so that no more than the tag is
lost; a comment that never ends stops at the next < or >, a title at its own mark; very long pages are parsed whole, in time linear in their length, one page of
a task at a time; an empty table gives an empty result; a null page_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import chunks, map_arrow, materialize, out_batch, table

#: Different pages of a host on which a subtree must stand, at least, to be template.
PAGES_AT_LEAST = 4
#: The share of its host's different pages on which it, or what recurs in its slot, must stand besides.
SHARE_AT_LEAST = 0.5
#: Template keys (8 bytes each) that may be broadcast; beyond, pages meet their own keys by a join.
BROADCAST_KEYS = 2_000_000

# HTML element names by their part in extraction.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "input", "option", "fieldset", "svg", "canvas", "object", "embed", "audio", "video", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "tbody", "thead", "table", "caption", "figcaption"}
BOX = {"html", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "dl", "figure", "form", "menu", "dialog", "fieldset", "address", "center", "details", "summary", "hgroup", "tfoot", "search"}
BLOCKS = PROSE | BOX | {"hr", "br"} | RAW
HEAD = {"title", "script", "style", "noscript", "template", "noframes", "base", "link", "meta"}
CLOSED_BY = {"p": BLOCKS - {"br"} - RAW, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": (BLOCKS | DROPPED) - HEAD}
# Words in class, id or role that mark a container as no part of the article.
COMMENTS = {"comment", "comments", "commentlist", "respond", "disqus", "disqus_thread"}
MARKS = COMMENTS | {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "banners", "sidebar", "sidebars", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "masthead", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "popup", "modal", "widget", "widgets", "toolbar", "skip", "complementary", "contentinfo", "search"}
#: Words that say where or in what shape a part stands; a name of such words and a mark, site-nav or share-buttons, marks as well.
SHAPES = {"site", "main", "page", "global", "primary", "secondary", "top", "bottom", "left", "right", "bar", "box", "area", "wrap", "wrapper", "container", "inner", "outer", "block", "list", "links", "link", "buttons", "button", "posts", "articles", "form", "section", "header", "footer", "media"}
ARTICLE = {"article", "main"}
#: Elements nested deeper than this are taken as siblings, as browsers do; their text stays.
DEEPEST = 512
#: What recurrence leaves inside an article.
TEXT = PROSE | {"ul", "ol", "dl", "figure"}

# A quoted value ends at a quote that a space, / or > follows; a value that has none is read as bare names, up to the first >.
_VALUE = r"""(?:"[^"]*+"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z)|[^\s>"'][^\s>]*+)"""
_NAMED = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+"
TAG = re.compile(rf"(<!--)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAMED})*+)(?:>|\Z)", re.S)
COMMENT_END = re.compile(r"-?>|.*?--!?>", re.S)
UNCLOSED = re.compile(r"[^<>]*+>?")
ATTRIBUTE = re.compile(rf"[\s/]*+(?:(class|id|role)\s*+=\s*+({_VALUE})|{_NAMED})", re.I)
PART = re.compile(r"[^\W_]+")
#: Parts of the text itself: an id here is a link target made from a title.
TITLED = PROSE | {"section", "article", "main", "hgroup"}
_MIX_SLOT, _MIX_TREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hash_of(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text) - (1 << 63)


class Node:
    __slots__ = ("tag", "marked", "items", "parent", "inside", "slot", "places", "depth")

    def __init__(self, tag: str, marked: str, parent: Node | None, slot: int):
        self.tag, self.marked, self.parent, self.slot = tag, marked, parent, slot
        self.depth = parent.depth + 1 if parent else 0
        self.inside = tag in ARTICLE or (parent is not None and parent.inside)
        self.items: list[Node | str] = []
        self.places: dict[str, int] = {}

    def place(self, name: str) -> int:
        """The slot of the next child of this tag and class."""
        n = self.places[name] = self.places.get(name, 0) + 1
        return hash_of(f"{self.slot}/{name}:{n}") | 1


def attributes_of(text: str) -> dict[str, str]:
    """Class, id and role, lower-cased; the first of each counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        if m[1]:
            found.setdefault(m[1].lower(), m[2].strip("\"'").lower())
    return found


def says(token: str) -> bool:
    """Whether a name marks: as a whole, or by parts that are all marks or shapes."""
    if token in MARKS:
        return True
    parts = PART.findall(token)
    return len(parts) > 1 and not MARKS.isdisjoint(parts) and all(p in MARKS or p in SHAPES for p in parts)


def marks(tag: str, given: dict[str, str], inside: bool) -> str:
    """What class, id or role say: "comments", "part" (no part of the article), or nothing.

    Headings, paragraphs and the like are never marked; inside an article an id marks only a box of comments, and
    a section is never marked by its id.
    """
    if tag in PROSE:
        return ""
    named = [t for kind, text in given.items() if kind != "id" for t in text.split()]
    own = given.get("id", "").split() if tag not in TITLED else []
    if not COMMENTS.isdisjoint(named) or not (COMMENTS - {"comment", "disqus"}).isdisjoint(own):
        return "comments"
    return "part" if any(map(says, named if inside else named + own)) else ""


def parse(source: str) -> Node:
    """Block elements as a tree; inline elements leave only their text. Linear in the length."""
    root = node = Node("#root", "", None, 1)
    at, n = 0, len(source)
    endless: set[str] = set()  # what has no end mark from here on, so that it is searched for once
    while m := TAG.search(source, at):
        if m.start() > at:
            if node.tag == "head" and not source[at : m.start()].isspace():  # text or an inline tag ends an open head
                node = node.parent
            node.items.append(source[at : m.start()])
        at = m.end()
        if m[1]:
            end = None if "-->" in endless else COMMENT_END.match(source, at)
            if not end:
                endless.add("-->")
            at = (end or UNCLOSED.match(source, at)).end()
            continue
        name = m[3] and m[3].lower()
        if not name:
            continue
        if node.tag == "head" and not m[2] and name not in BLOCKS | DROPPED | HEAD:
            node = node.parent
        if m[2]:
            if name in BLOCKS or name in DROPPED:
                up = node
                while up.parent is not None and up.tag != name:
                    if up.tag in BOX and name in PROSE:  # a stray end tag does not leave its box
                        up = root
                        break
                    up = up.parent
                if up.parent is not None:
                    node = up.parent
            continue
        if name == "br":
            node = node.parent if node.tag == "head" else node
            node.items.append(" ")
            continue
        if name not in BLOCKS and name not in DROPPED:
            continue
        while node.parent is not None and name in CLOSED_BY.get(node.tag, ()):
            node = node.parent
        given = attributes_of(m[4]) if m[4] else {}
        marked = "tag" if name in DROPPED else marks(name, given, node.inside or name in ARTICLE) if given and name not in ("html", "body") else ""
        if name in ARTICLE and not marked:  # a box that holds an article is not itself the sidebar; comments may be articles, too
            up, line = node, []
            while up is not None and up.marked not in ("tag", "comments"):
                line.append(up)
                up = up.parent
            for x in line if up is None else ():
                x.marked = ""
        child = Node(name, marked, node, node.place(f"{name}.{given['class']}" if "class" in given else name))
        node.items.append(child)
        if name in RAW:
            end = None if name in endless else re.compile(f"</{name}\\b[^>]*+>", re.I).search(source, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
                at = n if name in ("script", "style") else at
        elif name not in VOID and not m[4].endswith("/") and node.depth < DEEPEST:
            node = child
    if at < n:
        node = node.parent if node.tag == "head" and not source[at:].isspace() else node
        node.items.append(source[at:])
    return root


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def hashes(root: Node) -> dict[int, int]:
    """Hash of every block element's subtree, by the node's identity; children before parents."""
    order, out = [root], {}
    for node in order:
        order.extend(x for x in node.items if isinstance(x, Node))
    for node in reversed(order):
        inner = "\x00".join(x if isinstance(x, str) else f"\x01{out[id(x)]:x}" for x in node.items)
        out[id(node)] = hash_of(f"{node.tag}\x02{inner}")
    return out


def holding(root: Node) -> set[int]:
    """Identities of the articles, other than comments and those in dropped parts, and of all that holds one."""
    out, stack = set(), [root]
    while stack:
        node = stack.pop()
        stack.extend(x for x in node.items if isinstance(x, Node) and not x.marked)
        if node.tag in ARTICLE:
            up = node
            while up is not None and id(up) not in out:
                out.add(id(up))
                up = up.parent
    return out


def candidates(root: Node, held: set[int]) -> list[Node]:
    """The subtrees that may be template, marked or not.

    Not those that hold an article, not the text of an article, and not a wrapper of a single element, which that element stands for.
    """
    out, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or (node.tag in ARTICLE and id(node) in held)
        parts = [x for x in node.items if not isinstance(x, str) or not x.isspace()]
        if node.parent is not None and id(node) not in held and not (inside and node.tag in TEXT) and parts and not (len(parts) == 1 and isinstance(parts[0], Node)):
            out.append(node)
        if node.tag != "head":
            stack.extend((x, inside) for x in node.items if isinstance(x, Node) and x.tag not in RAW)
    return out


def keys_of(site: int, nodes: list[Node], found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of subtrees on a host, by themselves and in their slots."""
    trees = np.array([found[id(x)] for x in nodes], np.int64).view(np.uint64)
    slots = np.array([x.slot for x in nodes], np.int64).view(np.uint64)
    alone = trees * _MIX_TREE ^ np.int64(site).view(np.uint64)
    return alone.view(np.int64), (alone + slots * _MIX_SLOT).view(np.int64)


def page_keys(source: str, site: int) -> tuple[int, list[tuple[int, int]]]:
    """The hash of the body without marked elements, and (slot, key) of each candidate: slot 0, and its own."""
    root = parse(source)
    stack, kept = [root], []
    while stack:
        node = stack.pop()
        for x in reversed(node.items):
            if isinstance(x, str):
                kept.append(x)
            elif not x.marked:
                stack.append(x)
    nodes = candidates(root, holding(root))
    alone, slotted = keys_of(site, nodes, hashes(root))
    own = {(0, k) for k in alone.tolist()} | {(x.slot, k) for x, k in zip(nodes, slotted.tolist())}
    return hash_of("\x00".join(kept)), sorted(own)


def main_text(source: str, site: int = 0, template: np.ndarray | None = None) -> tuple[str, int]:
    """Blocks of the article, in page order, without template and marked subtrees; and how many template subtrees went.

    ``template`` holds the sorted keys of the corpus, or of this page.
    """
    root = parse(source)
    held, gone = holding(root), set()
    if template is not None and len(template):
        nodes = candidates(root, held)
        if nodes:
            hit = np.zeros(len(nodes), bool)
            for keys in keys_of(site, nodes, hashes(root)):
                hit |= template[np.minimum(np.searchsorted(template, keys), len(template) - 1)] == keys
            gone = {id(x) for x, h in zip(nodes, hit.tolist()) if h}
    return "\n\n".join((held and blocks_of(root, held, gone, True)) or blocks_of(root, held, gone, False)), len(gone)


def blocks_of(root: Node, held: set[int], gone: set[int], only_articles: bool) -> list[str]:
    """The blocks that are left, of the whole page or of its articles only."""
    blocks, now = [], []

    def flush() -> None:
        if text := clean("".join(now)):
            blocks.append(text)
        now.clear()

    work: list[tuple[Node | str | None, bool]] = [(root, False)]
    while work:
        item, inside = work.pop()
        if item is None:
            flush()
            continue
        if isinstance(item, str):
            if inside or not only_articles:
                now.append(item)
            continue
        inside = inside or (item.tag in ARTICLE and id(item) in held)
        flush()
        if id(item) in gone or item.marked or (item.tag == "header" and not inside and id(item) not in held):
            continue
        work.append((None, inside))
        work.extend((x, inside) for x in reversed(item.items))
    flush()
    return blocks


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def counted(pages: DataFrame, at_least: int = PAGES_AT_LEAST) -> DataFrame:
    """site, slot, key and pages: on how many different pages of its host a subtree stands, alone (slot 0) and in a slot.

    Only those on ``at_least`` pages. Pages with the same body are one row before they are counted; a hot host spreads over its keys.
    A page also counts under its host itself (key = site), which gives the host's different pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sources in chunks(batch, "html"):
                rows = []
                for host, source in zip(part.column("host").to_pylist(), sources):
                    site = hash_of(host)
                    body, own = page_keys(source, site)
                    rows += [(site, slot, key, body) for slot, key in [(0, site), *own]]
                yield out_batch(dict(zip(("site", "slot", "key", "body"), np.array(rows, np.int64).reshape(-1, 4).T)), {})

    seen = map_arrow(pages.select("host", "html"), run, "site bigint, slot bigint, key bigint, body bigint")
    return seen.distinct().groupBy("site", "slot", "key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= at_least)


def templates(pages: DataFrame, at_least: int = PAGES_AT_LEAST, share: float = SHARE_AT_LEAST) -> DataFrame:
    """key of what is template on its host: by itself, or with what else recurs in its slot.

    A page has at most one subtree in a slot, so the pages of a slot's subtrees add up.
    """
    counts = materialize(counted(pages, at_least), "counts")
    sites = counts.where("key = site and slot = 0").select("site", (F.lit(share) * F.col("pages")).alias("enough"))
    alone = counts.where("key <> site and slot = 0").join(sites, "site").where("pages >= enough").select("key")
    slots = counts.where("slot <> 0").groupBy("site", "slot").agg(F.sum("pages").alias("n")).join(sites, "site").where("n >= enough").select("site", "slot")
    return alone.unionByName(counts.join(materialize(slots, "slots"), ["site", "slot"], "left_semi").select("key"))


def extract(pages: DataFrame, at_least: int = PAGES_AT_LEAST, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """page_id, url, text, n_chars and n_template (template subtrees removed) of every page."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    keys = materialize(templates(pages, at_least).distinct(), "templates")
    small = keys.count() <= broadcast_keys
    shared = spark.sparkContext.broadcast(np.sort(np.array([r["key"] for r in keys.toLocalIterator()], np.int64))) if small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sources in chunks(batch, "html"):
                own = part.column("own").to_pylist() if shared is None else [None] * len(sources)
                got = [main_text(s, hash_of(h), np.sort(np.array(mine or [], np.int64)) if shared is None else shared.value) for h, s, mine in zip(part.column("host").to_pylist(), sources, own)]
                texts = [t for t, _ in got]
                yield out_batch({"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": [len(t) for t in texts], "n_template": [n for _, n in got]}, {"text": pa.string(), "n_chars": pa.int64(), "n_template": pa.int64()})

    return map_arrow(pages if small else _with_own(pages, keys), run, "page_id bigint, url string, text string, n_chars bigint, n_template bigint")


def _with_own(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds own, each page's template keys, by a join; for key tables too large to broadcast."""
    pages = materialize(pages.withColumn("row", F.monotonically_increasing_id()), "pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sources in chunks(batch, "html"):
                rows = []
                for row, host, source in zip(part.column("row").to_pylist(), part.column("host").to_pylist(), sources):
                    rows += [(row, key) for _, key in page_keys(source, hash_of(host))[1]]
                yield out_batch(dict(zip(("row", "key"), np.array(rows, np.int64).reshape(-1, 2).T)), {})

    met = map_arrow(pages.select("row", "host", "html"), run, "row bigint, key bigint").join(keys, "key")
    return pages.join(met.groupBy("row").agg(F.collect_set("key").alias("own")), "row", "left").drop("row")


def op8_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
