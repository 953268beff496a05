"""Main text of web pages, by removal of site templates.

Every element's subtree is hashed, from its tag, class, id, text and children. Spark counts on how
many pages of a host each hash stands; subtrees that recur are the site's template and are
deleted. Menus, forms, adverts and the like are known by tag, role and class as well, for a site
of few pages shows no recurrence. Text of a page that marks its article is taken from there, and in
it only what stands on most pages of a host is template, since articles quote each other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.base import checkpointed, numbered, query, table

OUTSIDE_PAGES = 3  # a subtree outside the article is template on so many pages of a host
INSIDE_PAGES, INSIDE_SHARE = 20, 0.5  # within it: on so many, and on this share of the host's pages

# HTML's element classes, and names that sites give to what isn't the article.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {
    "head", "script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video",
    "nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "title",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "widget", "cookie", "cookies", "consent", "gdpr",
    "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related",
    "comment", "comments", "disqus", "replies", "respond", "masthead", "pagination", "pager", "toolbar", "skip",
}
WHOLE_NAMES = {"site-header", "page-header", "site_header", "page_header", "header", "topbar", "top-bar"}
# End of the fixed values.

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)")


class Node:
    __slots__ = ("tag", "names", "role", "children")

    def __init__(self, tag: str, names: str = "", role: str = "") -> None:
        self.tag, self.names, self.role = tag, names, role
        self.children: list = []  # nodes and texts


def parse(page: str) -> Node:
    """A tree of elements and texts; end tags that close nothing are passed over."""
    root = Node("#page")
    stack, at = [root], 0
    while match := _TAG.search(page, at):
        if match.start() > at:
            stack[-1].children.append(html.unescape(page[at : match.start()]))
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table") and tag in ("p", "b", "i", "a", "span"):
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, "p", {"td", "th", "table", "button", "div", "section", "article"})
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            _close(stack, tag, {"ul", "ol", "dl", "table", "select"} | ({"tr"} if tag in ("td", "th") else set()))
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(match[3])} if match[3] else {}
        names = " ".join(x for x in (attributes.get("class"), attributes.get("id")) if x)
        node = Node(tag, html.unescape(names), attributes.get("role", ""))
        stack[-1].children.append(node)
        if tag in VOID or match[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            node.children.append(html.unescape(body) if tag in ("title", "textarea") else body)
            at = end.end() if end else len(page)
            continue
        stack.append(node)
    if at < len(page):
        stack[-1].children.append(html.unescape(page[at:]))
    return root


def _close(stack: list[Node], tag: str, limits: set[str]) -> None:
    """Ends an open ``tag`` that isn't beyond one of ``limits``."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in limits:
            return


def known_as_other(node: Node, inside: bool) -> bool:
    """Whether tag, role or class say that this isn't article text."""
    if node.tag in DROPPED or node.role in ROLES or node.tag == "header" and not inside:
        return True
    if not node.names:
        return False
    names = node.names.lower()
    return bool(NAMES.intersection(re.split(r"[\s_-]+", names)) or WHOLE_NAMES.intersection(names.split()))


def article_of(root: Node) -> list[Node]:
    """The elements whose text is wanted: articles, else the main element, else the page."""
    for wanted in ("article", "main"):
        found: list[Node] = []
        stack = [root]
        while stack:
            node = stack.pop()
            if node.tag == wanted and not known_as_other(node, True):
                found.append(node)
            elif not known_as_other(node, False):
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return [root]


def hashes_of(root: Node) -> dict[int, int]:
    """Hash of each element's subtree, by the identity of its node. Depth is not limited by the call stack."""
    out: dict[int, int] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Node)]
            continue
        parts = [node.tag, node.names]
        parts += [f"{out[id(c)]:x}" if isinstance(c, Node) else " ".join(c.split()) for c in node.children]
        value = xxhash.xxh64_intdigest("\x00".join(p for p in parts if p))
        out[id(node)] = value - (1 << 64) if value >> 63 else value
    return out


def zones(root: Node) -> tuple[list[Node], set[int]]:
    """The wanted elements, and the nodes that lie in them."""
    wanted = article_of(root)
    inside: set[int] = set()
    stack = list(wanted)
    while stack:
        node = stack.pop()
        inside.add(id(node))
        stack += [c for c in node.children if isinstance(c, Node)]
    return wanted, inside


def marked(page: str) -> tuple[set[int], set[int]]:
    """Hashes of the subtrees outside the article and inside."""
    root = parse(page)
    _, inside = zones(root)
    found = hashes_of(root)
    return {h for n, h in found.items() if n not in inside}, {h for n, h in found.items() if n in inside}


def main_text(page: str | None, outside: set[int] = frozenset(), within: set[int] = frozenset()) -> str:
    """Text of the wanted blocks without template subtrees, a block to a line."""
    if not page:
        return ""
    root = parse(page)
    wanted, inside = zones(root)
    found = hashes_of(root) if outside or within else {}
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    for top in wanted:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                line.append(x)
                continue
            if x is None:
                end()
                continue
            if x is not root and known_as_other(x, True):
                continue
            if x is not top and found and found[id(x)] in (within if id(x) in inside else outside):
                continue
            if x.tag == "br":
                line.append(" ")
                continue
            if x.tag in BLOCKS:
                end()
                stack.append(None)
            stack += reversed(x.children)
        end()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    match = _HOST.match(url or "")
    return match[1].lower() if match else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages`` (``page_id``, ``url``, ``html``).

    A null or empty page has the empty text. Pages without an address share one host. Repeated rows are
    pages of their own, and so count as recurrence. Other columns are not read. ``pages`` must be
    a scan or a checkpointed frame.
    """
    rows = numbered(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), "row")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, host, zone, digest = [], [], [], []
            for r, url, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = host_of(url)
                for inside, hashes in enumerate(marked(page) if page else ((), ())):
                    for h in hashes:
                        row.append(r)
                        host.append(own)
                        zone.append(bool(inside))
                        digest.append(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(host, pa.string()), pa.array(zone, pa.bool_()), pa.array(digest, pa.int64())],
                names=["row", "host", "inside", "hash"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([None if t is None else shrink(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, batch.column(3)], names=batch.schema.names)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expand = zstandard.ZstdDecompressor().decompress
            texts = []
            for data, outside, within in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                page = None if data is None else expand(data).decode()
                texts.append(main_text(page, set(outside or ()), set(within or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    subtrees = rows.select("row", "url", "html").mapInArrow(mark, "row bigint, host string, inside boolean, hash bigint")
    # the page itself is a subtree that no zone holds twice, so its host's rows of any one hash count pages
    counts = subtrees.groupBy("host", "inside", "hash").agg(F.count(F.lit(1)).alias("n"))
    per_host = pages.select(F.col("url").cast("string").alias("url")).select(_host_column().alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    template = checkpointed(
        counts.where(F.col("n") >= F.when(F.col("inside"), INSIDE_PAGES).otherwise(OUTSIDE_PAGES))
        .join(per_host, "host")
        .where(~F.col("inside") | (F.col("n") >= INSIDE_SHARE * F.col("pages")))
        .select("host", "inside", "hash")
    )
    found = (
        subtrees.join(template, ["host", "inside", "hash"])
        .groupBy("row")
        .agg(
            F.collect_set(F.when(~F.col("inside"), F.col("hash"))).alias("outside"),
            F.collect_set(F.when(F.col("inside"), F.col("hash"))).alias("within"),
        )
    )
    kind = pages.schema["page_id"].dataType.simpleString()
    packed = rows.mapInArrow(pack, f"page_id {kind}, url string, html binary, row bigint")
    return (
        packed.join(found, "row", "left")
        .select("page_id", "url", "html", "outside", "within")
        .mapInArrow(render, f"page_id {kind}, url string, text string, n_chars bigint")
    )


def _host_column():
    """The same as ``host_of``, as a Column."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


@query()
def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
