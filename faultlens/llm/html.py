"""Main text of HTML pages by site template removal.

Element subtrees are hashed (tag, class, id, role and text), counted per host in Spark, and deleted where they recur
on many different pages of that host, inside and outside a page's article: on ``MIN_PAGES`` pages, or on half of the
host's pages (two at least) where it has fewer than twice as many. Inside an <article> or
<main>, paragraphs, headings, lists and tables are content and are never taken for template: a passage that many
articles quote stays. Text outside the article stays where it does not recur. A host with one page shows nothing to
compare: there the text of an <article> (else <main>, else the body) alone remains.
Elements that say what they are (nav, header, footer, aside, form, script, style, and classes, ids or roles for menus,
adverts, notices, comments) go everywhere. A class or id counts as a whole name, an id of a heading or a paragraph names
its text; an element that a class or id names is kept where it holds an article or main of its own, one that its
tag or role names where the page has no other.
Pages whose texts are the same count as one, so copies of a page do not turn it into a template.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
by one space.

Defined results: null or empty html has the empty text; unclosed and stray tags are tolerated as browsers do; a page
without a host counts with all such pages; rows that repeat are extracted once each; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import small_side, stored

MIN_PAGES = 10

# fixed values of HTML
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "button"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CONTENT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "blockquote", "table", "tr", "td",
           "th", "tbody", "thead", "figure", "figcaption"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
DROP_TAGS = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "fieldset"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu"}
DROP_NAMES = {"nav", "navbar", "navigation", "menu", "header", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts",
              "advertisement", "adsense", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice",
              "popup", "modal", "comment", "comments", "respond", "disqus", "share", "social", "related", "newsletter",
              "subscribe", "breadcrumb", "breadcrumbs", "masthead", "pagination", "widget"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HEADINGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_MAIN = ("article", "main")
_ALONE = 0      # stands on every page, and among the templates of a host that has no other page to compare

_BY_NAME, _BY_TAG = 1, 2        # why an element goes: its class or id; its tag or role


class Node:
    __slots__ = ("tag", "attrs", "drop", "kids")

    def __init__(self, tag, attrs="", drop=0):
        self.tag, self.attrs, self.drop, self.kids = tag, attrs, drop, []


def parse(text: str) -> Node:
    """Element tree; children are nodes and strings. Raw elements are left out, and so is what they hold."""
    root = Node("#root")
    stack, at, size = [root], 0, len(text)
    wrapped, free = [], False       # named elements around an article or main; is there one outside of them?
    while at < size:
        m = _TAG.search(text, at)
        if not m:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P or tag in CLOSES:
            closes = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE and stack[k].tag not in closes:
                    break
        attrs, drop, named = "", tag in DROP_TAGS, False
        if m.group(3) and "=" in m.group(3):
            found = [(a.lower(), x or y or z) for a, x, y, z in _ATTR.findall(m.group(3))]
            attrs = " ".join(f"{a}={v}" for a, v in sorted(found))
            for a, v in found:
                if a == "role":
                    drop |= v.lower() in DROP_ROLES
                elif tag not in ("html", "body", "main") and not (a == "id" and tag in _HEADINGS):
                    named |= any(x in DROP_NAMES for x in v.lower().split())
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else (size if tag in ("script", "style", "textarea", "title") else at)
            continue
        node = Node(tag, attrs, _BY_TAG if drop else _BY_NAME if named else 0)
        if tag in _MAIN and not node.drop and not any(x.tag in _MAIN and not x.drop for x in stack):
            around = [x for x in stack if x.drop == _BY_TAG]
            wrapped += around
            free |= not around
            for x in stack:
                if x.drop == _BY_NAME:
                    x.drop = 0
        stack[-1].kids.append(node)
        if tag not in VOID and not m.group(0).endswith("/>"):
            stack.append(node)
    if not free:
        for x in wrapped:
            x.drop = 0
    return root


def _find(node: Node, tag: str) -> list[Node]:
    """Outermost elements ``tag`` that are not inside something dropped."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not x.drop:
            if x.tag == tag:
                out.append(x)
            else:
                todo.extend(reversed(x.kids))
    return out


def _hashes(root: Node) -> dict[int, tuple[int, bool]]:
    """id(node) -> (hash with text, does it hold text?), bottom up."""
    out: dict[int, tuple[int, bool]] = {}
    todo = [(root, False)]
    while todo:
        x, ready = todo.pop()
        if not ready:
            todo.append((x, True))
            todo.extend((k, False) for k in x.kids if isinstance(k, Node))
            continue
        full, text = [x.tag, x.attrs], False
        for k in x.kids:
            if isinstance(k, Node):
                f, t = out[id(k)]
                full.append(str(f))
                text |= t
            elif k.strip():
                full.append(" ".join(k.split()))
                text = True
        out[id(x)] = (xxhash.xxh3_64_intdigest("\x00".join(full).encode()) - (1 << 63), text)
    return out


def analyse(text: str) -> tuple[list[list], list[int], int]:
    """Blocks ``[text, hashes of the subtrees that would take it away, inside the main part?]`` of the page in order, the
    subtree hashes to count, and an id of the page's text (of its main part, where it has one)."""
    root = parse(text)
    main = {id(x) for x in _find(root, "article") or _find(root, "main")}
    hashes = _hashes(root)
    blocks: list[list] = []
    count: list[int] = []
    words: list[str] = []
    held: list[str] = []
    own: list[int] = []

    def flush(inside):
        line = " ".join(_html.unescape("".join(words)).split())
        words.clear()
        if line:
            blocks.append([line, list(own), inside])
            if inside:
                held.append(line)

    # (node, inside the main part, leaving a counted subtree?)
    todo: list = [(root, not main, False)]
    while todo:
        x, inside, counted = todo.pop()
        if isinstance(x, str):
            words.append(x)
            continue
        if x is None:                   # leaving a block
            flush(inside)
            if counted:
                own.pop()
            continue
        block = x.tag not in INLINE
        if block or x.drop:
            flush(inside)
        if x.drop:
            continue
        inside = inside or id(x) in main
        protected = bool(main) and inside and x.tag in CONTENT
        counted = block and hashes[id(x)][1] and x.tag not in ("#root", "html", "body", "article", "main") and not protected
        if counted:
            count.append(hashes[id(x)][0])
            own.append(hashes[id(x)][0])
        if block:
            todo.append((None, inside, counted))
        todo.extend((k, inside, False) for k in reversed(x.kids))
    flush(not main)
    page = xxhash.xxh3_64_intdigest("\x00".join(held or [b[0] for b in blocks]).encode()) - (1 << 63)
    return blocks, sorted(set(count)), page


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, packed, hashes, page, key`` of every page: its blocks, its subtrees, an id of its text."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), _host(F.col("url")).alias("host"),
                       F.col("html").alias("html"))

    def run(batches):
        for b in batches:
            rows = [analyse(t or "") for t in b.column("html").to_pylist()]
            packed = [zlib.compress(json.dumps(r[0], ensure_ascii=False).encode(), 1) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), b.column("host"), pa.array(packed, pa.binary()),
                 pa.array([[_ALONE, *r[1]] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int64())],
                ["page_id", "url", "host", "packed", "hashes", "page"])

    return src.mapInArrow(run, "page_id long, url string, host string, packed binary, hashes array<long>, page long").withColumn(
        "key", F.monotonically_increasing_id())


def templates(rows: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, hash`` of subtrees that recur on ``min_pages`` different pages of their host, or on half of them, two at
    least; and ``_ALONE`` for a host with one page. ``rows``: ``host, hashes, page``."""
    sizes = rows.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    sizes = stored(sizes, "hosts")
    seen = rows.select("host", F.explode("hashes").alias("hash"), "page").where(F.col("hash") != _ALONE)
    seen = seen.groupBy("host", "hash", "page").agg(F.count(F.lit(1)).alias("c"))
    seen = seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 2")
    needed = F.least(F.lit(min_pages), F.greatest(F.lit(2), F.ceil(F.col("size") / 2)))
    return seen.join(small_side(sizes, sizes.count(), 64), "host").where(F.col("pages") >= needed).select("host", "hash").union(
        sizes.where("size = 1").select("host", F.lit(_ALONE).cast("long").alias("hash")))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page. Pages are parsed once; their blocks are a stored table."""
    rows = stored(parsed(pages), "pages")
    known = stored(templates(rows, min_pages), "templates")
    # the page's subtrees that are template
    gone = (rows.select("key", "host", F.explode("hashes").alias("hash"))
            .join(small_side(known, known.count(), 64), ["host", "hash"])
            .groupBy("key").agg(F.collect_set("hash").alias("gone")))
    joined = rows.select("key", "page_id", "url", "packed").join(gone, "key", "left")

    def text(batches):
        for b in batches:
            out = []
            for raw, gone in zip(b.column("packed").to_pylist(), b.column("gone").to_pylist()):
                drop = set(gone or ())
                out.append(" ".join(line for line, own, inside in json.loads(zlib.decompress(raw))
                                    if (inside or _ALONE not in drop) and not drop.intersection(own)))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "packed", "gone").mapInArrow(text, "page_id long, url string, text string, n_chars long")
