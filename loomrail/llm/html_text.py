"""Main text of web pages by composite text density over the DOM.

Every node has a density: characters for each tag below it, adjusted by the share of links. The
densities of a node's paragraphs are summed, and the node with the largest sum is the article, with
what goes on around it. Lists of names tell what is no text at all (scripts, hidden parts) and what is
none of an article (menus, footers, forms, adverts); no name makes a node the article.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrail.llm.common import table

# Fixed lists of HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
# Never text of the page, wherever they stand.
UNSEEN = frozenset("script style textarea title noscript iframe noembed noframes xmp head button select option input template svg canvas object audio video map dialog".split())
# Elements that a slash in their tag doesn't end.
CONTAINERS = frozenset("body article main section div td center blockquote nav header footer aside form fieldset menu".split())
# Within the chosen subtree these go, unless they hold most of it.
PARTS = frozenset("nav header footer aside form fieldset menu label".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
WHOLE = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Whole tokens of class, id and role of parts within an article that are none of it.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar complementary menu nav navbar navigation breadcrumb breadcrumbs footer contentinfo cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription share sharing social related recommended comment comments disqus login signin signup search toolbar widget pagination".split())

# Leaves that are text by their name, and elements that may go on a text beside the chosen subtree.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre li dd dt td th blockquote figcaption address caption summary".split())
FLOW = PROSE | frozenset("ul ol dl table tbody tr figure hgroup details section article main hr".split())

#: So many other leaves in one block count as its paragraphs.
SEVERAL = 3

# a tag whose quote is never closed ends at its first >
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|$)|<[!?/][^>]*(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


@dataclass
class Node:
    name: str
    parent: Node | None
    drop: bool = False
    #: by its class, id, role or name no article, if another part is
    marked: bool = False
    parts: list = field(default_factory=list)
    #: characters and tags below, and those within links
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    link: bool = False
    density: float = 0.0
    sum: float = 0.0
    leaf: bool = False
    #: article and main elements with text below, whether one is above, and whether a marked part holds the node
    whole: int = 0
    around: bool = False
    out: bool = False


def values(attributes: str) -> dict[str, str]:
    """Values by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *value in ATTRIBUTE.findall(attributes):
        out.setdefault(name.lower(), "".join(value))
    return out


def parse(page: str) -> Node:
    """A tree of the page; what is never seen stands in it without its text. Unclosed elements end with their parents."""
    root = here = Node("body", None)
    at = 0

    def text(raw: str) -> None:
        if raw and not here.drop:
            here.parts.append(html.unescape(raw))

    def close(names, until=()) -> None:
        nonlocal here
        node = here
        while node.parent is not None and node.name not in until:
            if node.name in names:
                here = node.parent
                return
            node = node.parent

    while (m := TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        slash, name, attributes, end = m.group(1, 2, 3, 4) if m[2] is not None else m.group(5, 6, 7, 8)
        if name is None or end != ">":
            continue
        name = name.lower()
        if slash:
            close((name,), () if name in ("body", "html") else ("table",) if name in ("p", "li") else ())
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P:
            close(("p",), ("table", "div", "article", "section", "main", "td", "blockquote"))
        if name in CLOSED_BY_SAME:
            close(CLOSED_BY_SAME[name], ("ul", "ol", "dl", "table", "select"))
        drop, marked = here.drop or name in UNSEEN, name in PARTS
        if not drop and attributes.strip(" /"):
            of = values(attributes)
            drop = "hidden" in of or of.get("aria-hidden", "").strip().lower() == "true" or bool(NO_DISPLAY.search(of.get("style", "")))
            marked = marked or not MARKS.isdisjoint(f"{of.get('class', '')} {of.get('id', '')} {of.get('role', '')}".lower().split())
        node = Node(name, here, drop, marked)
        here.parts.append(node)
        if name in VOID or attributes.endswith("/") and name not in RAW and name not in CONTAINERS:
            continue
        if name in RAW:
            close_tag = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            at = close_tag.end() if close_tag else len(page)
            continue
        here = node
    text(page[at:])
    return root


def letters(text: str) -> int:
    """Characters that are no white space."""
    return len("".join(text.split()))


def composite(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Characters for each tag, times a logarithm that falls with the share of links; share is that of the whole page."""
    t, lt, outside, lc = max(t, 1), max(lt, 1), max(c - lc, 1), max(lc, 1)
    return c / t * math.log(c / lc * t / lt) / math.log(math.log(c / outside * lc + share * c + math.e)) if c else 0.0


def children(node: Node) -> list[Node]:
    """Elements right below that are seen and hold text."""
    return [c for c in node.parts if isinstance(c, Node) and not c.drop and c.chars]


def own_text(node: Node) -> tuple[int, int]:
    """Characters right in the node, inline elements counted with it, and those of them in links."""
    runs = sum(letters(c) for c in node.parts if isinstance(c, str))
    inline = [c for c in children(node) if c.name in INLINE]
    return runs + sum(c.chars for c in inline), (runs if node.link else 0) + sum(c.link_chars for c in inline)


def measure(root: Node) -> list[Node]:
    """Counts, composite densities and density sums of all nodes that are seen, parents first.

    A leaf is a block without blocks in it. A node that holds blocks sums the densities of its leaves
    and of its own text; blocks that hold others stand for themselves. Leaves that are paragraphs,
    headings or cells by name count always, others (a div may be a paragraph, or a notice) only where
    there are several. A leaf's own sum is zero.
    """
    order, todo = [], [(root, False)]
    while todo:
        node, link = todo.pop()
        node.link = link or node.name == "a"
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        order.append(node)
        todo.extend((c, node.link) for c in reversed(node.parts) if isinstance(c, Node) and not c.drop)
    for node in reversed(order):
        own = sum(letters(c) for c in node.parts if isinstance(c, str))
        node.chars += own
        node.link_chars += own if node.link else 0
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.name == "a")
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.leaf = all(c.name in INLINE for c in children(node))
    for node in order:
        node.sum = 0.0
        if not node.leaf:
            leaves = [c for c in children(node) if c.leaf and c.name not in INLINE]
            others = [c for c in leaves if c.name not in PROSE]
            counted = leaves if len(others) >= SEVERAL else [c for c in leaves if c.name in PROSE]
            chars, link_chars = own_text(node)
            node.sum = sum(c.density for c in counted) + composite(chars, 0, link_chars, 0, share)
    return order


def take_out(order: list[Node]) -> None:
    """Drop marked parts but wrappers, if there is text without them.

    A wrapper holds most of the page's text outside links, and no article or main element lies outside of it.
    """
    plain, body = lambda n: n.chars - n.link_chars, order[0]
    for node in reversed(order):
        node.whole += node.name in WHOLE and plain(node) > 0
        if node.parent is not None:
            node.parent.whole += node.whole
    out, gone = [], 0
    for node in order:
        up = node.parent
        if up is not None:
            node.around, node.out = up.around or up.name in WHOLE, up.out
        # headings of an article may be marked; they are looked at when it is chosen
        if node.marked and not node.out and not (node.name == "header" and node.around):
            node.out = 2 * plain(node) <= plain(body) or (body.whole > node.whole and not node.around)
            if node.out:
                out.append(node)
                gone += node.chars
    if gone < body.chars:
        for node in out:
            node.drop = True


def heavy(node: Node) -> bool:
    """Whether most of its text is links."""
    return 2 * node.link_chars > node.chars


def main_nodes(root: Node) -> list[Node]:
    """The subtree whose density sum is largest, and what goes on around it, in page order.

    The threshold is the least density on the path from that node to the body. On each level of the path
    its siblings belong to the text if they are paragraphs, headings, tables and the like that aren't
    mostly links, or hold blocks, have the same name and reach the threshold; a parent with text of its
    own belongs to it as a whole. If the body itself has the largest sum, divisions of it below the
    threshold go. Marked parts are out before anything is measured. Ties go to the earlier node, nothing
    is returned for a page without text; nothing is dropped for being short.
    """
    take_out(measure(root))
    order = measure(root)
    if not root.chars:
        return []
    best = max((n for n in order if n.name not in INLINE), key=lambda n: n.sum)
    if best.sum <= 0:
        best = root
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    top, beside = best, []
    for node, up in zip(path, path[1:]):
        if up.parent is not None and own_text(up)[0] > 0:
            top, beside = up, []
            continue
        for c in children(up):
            prose = c.name in FLOW and not heavy(c)
            alike = c.name == node.name and not c.leaf and not heavy(c) and c.density >= threshold
            if c is not node and (prose or alike):
                beside.append(c)
    if top is root:
        several = sum(c.leaf and c.name not in FLOW and c.name not in INLINE for c in children(root)) >= SEVERAL
        for c in children(root):
            if c.name not in FLOW and c.name not in INLINE and (heavy(c) or (c.density < threshold and not several)):
                c.drop = True
    chosen = {id(n) for n in (top, *beside)}
    return [n for n in order if id(n) in chosen]


def without_parts(top: Node) -> None:
    """Drop marked parts within a chosen subtree, but not one that holds most of its text outside links."""
    todo = [c for c in top.parts if isinstance(c, Node)]
    while todo:
        node = todo.pop()
        if node.drop:
            continue
        if node.marked and 2 * (node.chars - node.link_chars) <= top.chars - top.link_chars and not (node.name == "header" and _within(node, top)):
            node.drop = True
        else:
            todo.extend(c for c in node.parts if isinstance(c, Node))


def _within(node: Node, top: Node) -> bool:
    """Whether a header belongs to an article rather than to the page."""
    while node is not None:
        if node.name in WHOLE:
            return True
        node = None if node is top else node.parent
    return False


def blocks(node: Node) -> str:
    """Text of a subtree: inline tags vanish, other tags part blocks; white space within a block and between blocks is one space."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.drop:
            out.append("" if n.name in INLINE else " ")
        else:
            edge = [] if n.name in INLINE else [" "]
            todo.extend(edge + n.parts[::-1] + edge)
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The article's text; empty for a null, empty or textless page."""
    tops = main_nodes(parse(page)) if page else []
    for top in tops:
        without_parts(top)
    return " ".join(t for t in map(blocks, tops) if t)


def extracted(pages: DataFrame, keys: tuple = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(keys..., text, n_chars) of every row of pages, whole pages read.

    Null and empty pages have an empty text. Repeated rows stay repeated, an empty table gives no
    rows, and other columns of pages are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(p) for p in b["_html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keys), pa.array(got, pa.string()), pa.array([len(g) for g in got], pa.int64())], [*keys, "text", "n_chars"])

    rows = pages.select(*keys, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
