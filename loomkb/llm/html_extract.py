"""Main text of web pages by composite text density.

Every node of the page's tree gets a density: its characters per tag, adjusted
for links (characters of controls count as links). A node's sum adds up the
densities of its children. The subtree with the largest sum holds the article;
the least density on the path from the body to it is the threshold.

Densities decide what else belongs to the article: beside the path to it, what
is above the threshold and at least half as dense as the article; inside it,
lists of links below the threshold and, where they are less than a third as
dense as its parts are on average, repeated containers such as comments go.

Names and classes only break ties: the page's first article or main element is
taken where its sum is at least half of the largest, or where the subtree with
the largest holds it and little else that no hint covers; a hinted neighbour must be
as dense as the article, and a hinted part of it stays where it holds a sentence
and is a third as dense.

The parser is a tolerant tokenizer that builds the tree in one pass, with the
implied end tags of HTML: a paragraph ends where a block begins. It keeps the
places of open elements, so its time is in proportion to the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.session import table

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: An attribute; a quote that is never closed takes the rest of the page.
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)("|\Z)|'([^']*)('|\Z)|([^\s>]*)))?""")
TAG_END = re.compile(r"[\s/]*>")
SPACE = re.compile(r"[\s ]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no running text, and those whose text is some only inside of a sentence.
NO_TEXT = frozenset("script style noscript template textarea title iframe head select option input svg canvas object embed audio video xmp noembed noframes".split())
CONTROLS = frozenset("button label".split())
#: Elements and words in class, id or role that hint at page furniture.
HINT_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
HINT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments disqus respond reply replies "
    "discussion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead topbar toolbar cookie cookies "
    "consent gdpr notice notices notification popup modal overlay alert newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations widget widgets pagination pager search form skip complementary contentinfo search-form copyright "
    "legal disclaimer".split()
)
#: Share of the largest sum with which the first article element is taken; shares of the article's density for neighbours, hinted ones, and parts.
TIE, BESIDE, HINTED_BESIDE, INSIDE = 0.5, 0.5, 1.0, 1 / 3
#: Characters of a sentence; links that make a list.
SENTENCE, LIST = 40, 3
#: Single pieces of running text: beside the article, the threshold is enough for them.
PIECES = frozenset("p h2 h3 h4 h5 h6 blockquote pre".split())
ENDS_PARAGRAPH = BLOCK - {"html", "body"}
#: An open element of the key ends where one of these begins, up to a list or table around it.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table html body article section div td th".split())


class Node:
    __slots__ = ("tag", "hint", "gone", "children", "chars", "tags", "link_chars", "link_tags", "noise", "anchors", "density", "total")

    def __init__(self, tag: str, hint: bool = False, gone: bool = False):
        #: Whether its name or class hints at furniture, whether it is never text, and whether its characters count as links.
        self.tag, self.hint, self.gone, self.noise = tag, hint, gone, tag in CONTROLS
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.anchors = 0
        self.density = self.total = 0.0

    @property
    def list_of_links(self) -> bool:
        """Links make up most of its text."""
        return self.anchors >= LIST and 5 * self.link_chars >= 4 * self.chars

    @property
    def typical(self) -> float:
        """The mean density of what it is made of."""
        return self.total / max(1, sum(c.chars > 0 for c in self.nodes()))

    @property
    def repeated(self) -> bool:
        """Made of containers of one kind, each with blocks of its own."""
        inner = [c for c in self.nodes() if any(g.tag in BLOCK for g in c.nodes())]
        return len(inner) > 1 and 2 * sum(c.chars for c in inner) >= self.chars and len({c.tag for c in inner}) == 1 and inner[0].tag in BLOCK

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and not c.gone]


def attributes_of(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, first of each name, and where the tag ends; -1 if it never does."""
    out: dict[str, str] = {}
    while True:
        end = TAG_END.match(page, at)
        if end:
            return out, end.end()
        m = ATTRIBUTE.match(page, at)
        if not m:
            return out, -1
        out.setdefault(m[1].lower(), m[2] or m[4] or m[6] or "")
        at = m.end()


def hint_of(tag: str, attributes: dict[str, str]) -> bool:
    if tag in HINT_TAGS:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in ("class", "id", "role"):
        for word in attributes.get(name, "").lower().split():
            if word.startswith(("no-", "has-", "with-")):
                continue
            if word in HINT_WORDS or not HINT_WORDS.isdisjoint(re.split(r"[-_]+", word)):
                return True
    return False


def hidden(attributes: dict[str, str]) -> bool:
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or "display:none" in re.sub(r"\s+", "", attributes.get("style", "").lower())
    )


class Open:
    """The open elements, with the places of each tag, and of the nearest block, paragraph end and scope."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {root.tag: [0]}
        self.block, self.ender, self.scope = [0], [0], [0]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        self.block.append(at if node.tag in BLOCK else self.block[-1])
        self.ender.append(at if node.tag in ENDS_PARAGRAPH else self.ender[-1])
        self.scope.append(at if node.tag in SCOPES else self.scope[-1])

    def cut(self, at: int) -> None:
        """Close the element at place ``at`` and all inside it."""
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        for places in (self.stack, self.block, self.ender, self.scope):
            del places[at:]

    def place(self, tag: str) -> int:
        """Where ``tag`` was opened last; 0 if it is not open below the root."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def begin(self, tag: str) -> None:
        """End what cannot hold ``tag``."""
        if tag in ENDS_PARAGRAPH and self.place("p") and self.ender[-1] == self.place("p"):
            self.cut(self.place("p"))
        if tag in SIBLINGS:
            sibling = max(self.place(t) for t in SIBLINGS[tag])
            if sibling and sibling >= self.scope[-1]:
                self.cut(sibling)
                if tag == "tr" and self.place("tr") > self.scope[-1]:  # the cell's row ends with it
                    self.cut(self.place("tr"))

    def end(self, tag: str) -> None:
        """Formatting left open inside a block ends with it; a stray end tag is dropped."""
        at = self.place(tag)
        if at and (tag in BLOCK or self.block[-1] < at):
            self.cut(at)


def parse(page: str) -> Node:
    """The page's tree; strings are decoded text."""
    root = Node("html")
    opened, at = Open(root), 0

    def text(part: str) -> None:
        if part:
            opened.stack[-1].children.append(entities.unescape(part) if "&" in part else part)

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        closing = page.startswith("</", lt)
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            text("<")
            at = lt + 1
            continue
        tag = name[0].lower()
        attributes, at = attributes_of(page, name.end())
        if at < 0:  # cut off inside a tag
            break
        if closing:
            opened.end(tag)
            continue
        if tag in ("html", "body") and (len(opened.stack) > 1 and tag == "html" or opened.place(tag)):
            continue
        opened.begin(tag)
        node = Node(tag, hint_of(tag, attributes), tag in NO_TEXT or hidden(attributes))
        opened.stack[-1].children.append(node)
        if tag in VOID:  # a slash at the end of other tags means nothing
            continue
        if tag in RAW:  # up to its end tag, nothing in it is markup
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        opened.push(node)
    return root


def top_down(root: Node) -> list[Node]:
    """Parents before children, without recursion: pages can nest very deep."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.nodes()))
    return order


def composite(c: int, t: int, lc: int, lt: int, body_chars: int, body_links: int) -> float:
    """Composite text density of a node with ``c`` characters and ``t`` tags, ``lc`` and ``lt`` of them in links."""
    if not c:
        return 0.0
    t, lt = max(t, 1), max(lt, 1)
    base = math.log(c * lc / max(c - lc, 1) + body_links * c / max(body_chars, 1) + math.e)
    return c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0 + 1e-9)) / math.log(base + 1.0)


def densities(root: Node) -> list[Node]:
    """Fill in counts, densities and sums of all nodes; returns them, parents first."""
    order = top_down(root)
    for node in reversed(order):
        node.chars = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        for c in node.nodes():
            node.anchors += c.anchors + (c.tag == "a")
            node.chars += c.chars
            node.tags += c.tags + 1
            node.link_chars += c.link_chars
            node.link_tags += c.link_tags + (c.tag == "a" or c.noise)
        if node.tag == "a" or node.noise:
            node.link_chars = node.chars
    for node in order:
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, root.chars, root.link_chars)
    for node in order:
        node.total = sum(c.density for c in node.nodes()) or node.density
    return order


def narrows(best: Node, named: Node) -> bool:
    """Whether ``best`` holds ``named`` and, outside of it and of what is hinted, no more plain text."""
    outside, held, todo = 0, False, [best]
    while todo:
        node = todo.pop()
        if node is named:
            held = True
        elif not node.hint and node.tag != "a" and not node.noise:
            outside += sum(len(c.strip()) for c in node.children if isinstance(c, str))
            todo.extend(node.nodes())
    return held and outside <= named.chars - named.link_chars


def main_node(order: list[Node]) -> tuple[Node, list[Node], float]:
    """The subtree with the largest density sum, its ancestors, and the least density on the path to the root.

    Of equal sums the first in page order counts. The first article or main
    element stands for the subtree where it holds it, or comes near its sum.
    """
    parents = {id(c): node for node in order for c in node.nodes()}

    def path_of(node: Node) -> list[Node]:
        path = [node]
        while id(path[-1]) in parents:
            path.append(parents[id(path[-1])])
        return path

    best = max(order, key=lambda n: n.total if n.chars > n.link_chars else 0.0)
    path = path_of(best)
    threshold = min((n.density for n in path if n.chars), default=0.0)
    named = next((n for n in order if n.tag in ("article", "main") and not n.hint and n.chars > n.link_chars), None)
    if named is not None and (any(n is named for n in path) or named.total >= TIE * best.total or narrows(best, named)):
        path = path_of(named)
        threshold = min(n.density for n in path if n.chars)
    return path[0], path[1:], threshold


def belongs(node: Node, article: Node, parent: Node, above: list[Node], threshold: float) -> bool:
    """Whether a node beside the path to the article is part of it; a named article is whole."""
    if node.tag == "h1":
        return not node.hint and node.chars > node.link_chars
    if article.tag in ("article", "main") or node.density < threshold:
        return False
    if node.tag in PIECES and not node.hint and parent is above[0]:
        return True
    return node.density >= (HINTED_BESIDE if node.hint else BESIDE) * article.density


def furniture(node: Node, article: Node, threshold: float) -> bool:
    """Whether a node inside the article is none of it."""
    thin = node.density < INSIDE * article.typical
    if node.hint and not (node.tag == "header" and article.tag in ("article", "main")):
        return thin or node.chars - node.link_chars < SENTENCE
    if node.density < threshold and node.list_of_links:
        return True
    return thin and node.tag in BLOCK and 2 * node.chars < article.chars and node.repeated and node.tag not in ("ul", "ol", "dl", "table", "tbody")


def blocks_of(root: Node, article: Node, above: list[Node], threshold: float) -> list[str]:
    """Blocks in page order: the article without its furniture, and what belongs to it beside it."""
    out: list[str] = []
    current: list[tuple[str, bool]] = []
    path = {id(n) for n in above}

    def flush() -> None:
        # the text of controls counts inside of a sentence only
        spoken = any(not control and part.strip() for part, control in current)
        text = SPACE.sub(" ", "".join(part for part, control in current if spoken or not control)).strip()
        current.clear()
        if text:
            out.append(text)

    # (node or text, the node around it, whether it is inside what is kept, whether it is in a control, whether it ends here)
    todo: list[tuple[Node | str, Node, bool, bool, bool]] = [(root, root, False, False, False)]
    while todo:
        item, parent, inside, control, ends = todo.pop()
        if isinstance(item, str):
            if inside:
                current.append((item, control))
            continue
        if ends:
            flush()
            continue
        if item.tag == "br":
            current.append(("\n", control))
        if item.tag in BLOCK:
            flush()
        if item.gone:
            continue
        if item is article:
            inside = True
        elif inside:
            if furniture(item, article, threshold):
                continue
        elif id(item) not in path:
            beside = id(parent) in path
            inside = (beside or item.tag == "h1" and not parent.hint) and belongs(item, article, parent, above, threshold)
            if not inside and not (beside and not item.hint):
                continue
        if item.tag in BLOCK:
            todo.append((item, parent, inside, control, True))
        todo.extend((c, item, inside, control or item.tag in CONTROLS, False) for c in reversed(item.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: blocks joined by an empty line, empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    order = densities(root)
    if root.chars <= root.link_chars:
        return ""  # links only
    return "\n\n".join(blocks_of(root, *main_node(order)))


def extract_text(pages: DataFrame, html_col: str = "html", carry: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The ``carry`` columns with text and n_chars (code points) for every page.

    Null and empty html give an empty text, and so do pages of links only.
    Pages without markup are one block. Unclosed and stray tags are repaired, a
    cut-off page gives what it has; very long and very deep pages are parsed
    whole, in time in proportion to their length. Repeated rows are extracted
    each by itself; an empty table stays empty.
    """

    @F.pandas_udf("string")
    def main_text_of(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in column], dtype=object)

    done = pages.select(*[F.col(c) for c in carry], main_text_of(F.col(html_col)).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
