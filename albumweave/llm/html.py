"""Main text of web pages by composite text density.

A page becomes a tree of its elements, menus, adverts and footers included. Every element's density is its characters for
each tag, adjusted for the share of links; its density sum is the sum of its children's densities (of those that are no
mere inline markup, or one bold line would outweigh its article). The element of the largest sum is the article's body,
and the least density on its path up to the body element is the threshold:
- An element beside that path joins the text if its density reaches the threshold and its own sum a share (`PART`) of the
  largest; so do headings and paragraphs beside the chosen element, unless they stand in the body element itself; in an
  `article` or `main` these need not be dense, and nothing joins from outside of it.
- Inside the chosen element, blocks below the threshold that are links for the greater part go.
HTML fixes the meaning of some tags: menus, footers, asides, forms and the like never hold the text, and of elements with
equal sums an `article` or `main` is chosen before others, and then the outermost. Where no part of a page outweighs the
whole, the body element has the largest sum and tells nothing; then the page's only `article` or `main` is chosen.
Text inside is taken in page order, one line for each block.

Null and empty pages, and pages without such text, give an empty text. Whole pages are read, in one pass however long or
broken they are; a tag that the page's end cuts off is dropped with what follows it. Repeated rows give repeated results;
other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from albumweave.llm.common import table

#: Fixed values of HTML: elements without content, with raw text, that end an open paragraph, and inline ones.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"table", "ul", "ol", "dl", "select", "div", "article", "section", "body", "html", "main"}
#: Elements that hold no article, by tag and by role.
NO_TAG = RAW | set("head nav footer aside form button select menu svg canvas object audio video dialog header".split())
NO_ROLE = set("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
#: Share of the largest density sum that other parts must reach.
PART = 0.3
HEADS = set("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
BREAK = object()


class Node:
    """An element. `off` are those that HTML itself or the page hides or sets apart, with all below them; `gone` those
    whose text is no text at all."""

    __slots__ = ("block", "chars", "children", "density", "gone", "item", "link_chars", "link_tags", "off", "parent", "parts", "sum", "tag", "tags", "within")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.children: list[Node] = []
        self.parts: list = []  # text and child elements in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.block = self if tag in BLOCK or parent is None else parent.block  # the nearest block, item or scope
        self.item = self if tag in CLOSES or tag in SCOPE or parent is None else parent.item
        self.within = tag in ("article", "main") or (parent is not None and parent.within)
        self.off = parent is not None and parent.off
        self.gone = tag in RAW or tag == "head" or (parent is not None and parent.gone)

    def mark(self, attributes: str) -> None:
        if self.tag in NO_TAG and not (self.tag == "header" and self.within):
            self.off = True
        if "=" not in attributes:
            self.off |= "hidden" in attributes.lower().split()
            return
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if (name == "role" and value in NO_ROLE) or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                self.off = True


def parse(page: str) -> Node:
    """The tree of a page, in one pass: what an open quote or tag swallows is found once."""
    root = now = Node("body", None)
    counts: dict[str, int] = {}
    lower = None  # the page in lower case, for the ends of raw elements
    quotes = True
    at, text_from, size = 0, 0, len(page)

    def text(to: int) -> None:
        if text_from < to and not now.gone:
            piece = page[text_from:to]
            now.parts.append(html.unescape(piece) if "&" in piece else piece)

    def leave(node: Node) -> Node:
        """Close all down to `node` and that; the element around it."""
        x = now
        while x is not node:
            counts[x.tag] -= 1
            x = x.parent
        counts[node.tag] -= 1
        return node.parent

    while True:
        start = page.find("<", at)
        if start < 0:
            text(size)
            return root
        at = start + 1
        if page.startswith("!--", at):
            text(start)
            end = page.find("-->", at + 3)
            at = text_from = end + 3 if end >= 0 else size
            continue
        if at < size and page[at] in "!?":
            text(start)
            end = page.find(">", at)
            at = text_from = end + 1 if end >= 0 else size
            continue
        closing = page.startswith("/", at)
        name = NAME.match(page, at + closing)
        if name is None:
            continue  # a mere sign
        text(start)
        rest = REST.match(page, name.end()) if quotes else None
        if rest is None:
            quotes = False  # some quote is never closed: from here on tags end at their first sign
            end = page.find(">", name.end())
            if end < 0:
                return root
            attributes, at = page[name.end() : end], end + 1
        else:
            attributes, at = page[name.end() : rest.end() - 1], rest.end()
        text_from, tag = at, name[0].lower()
        if closing:
            if counts.get(tag):
                node = now
                while node.tag != tag:
                    node = node.parent
                now = leave(node)
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK and now.block.tag == "p":
            now = leave(now.block)
        if tag in CLOSES:
            node = now.item
            while node is not root and node.tag not in SCOPE and node.tag not in CLOSES[tag]:
                node = node.parent.item
            if node.tag in CLOSES[tag]:
                now = leave(node)
                if tag == "tr" and now.tag == "tr":
                    now = leave(now)
        if tag in VOID:
            now.tags += 1
            if tag in ("br", "hr"):
                now.parts.append(BREAK)
            continue
        child = Node(tag, now)
        child.mark(attributes)
        now.children.append(child)
        now.parts.append(child)
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != size:  # some letters grow in lower case
                lower = page
            end = lower.find(f"</{tag}", at)
            end = page.find(">", end) if end >= 0 else -1
            at = text_from = end + 1 if end >= 0 else size
        elif not attributes.endswith("/"):
            now = child
            counts[tag] = counts.get(tag, 0) + 1


def in_order(root: Node) -> list[Node]:
    """The elements, each before its children."""
    out, left = [], [root]
    while left:
        node = left.pop()
        out.append(node)
        left.extend(reversed(node.children))
    return out


def measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.chars += sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density = max(c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.0) + 1.0), 0.0)
    for node in nodes:
        node.sum = sum(x.density for x in node.children if x.tag not in INLINE)


def largest(nodes: list[Node]) -> dict[int, Node]:
    """The element of the largest sum in each element; of equal ones an `article` or `main`, else the outermost. Those set
    apart are passed over."""
    named = lambda x: x.tag in ("article", "main")
    best: dict[int, Node] = {}
    for node in reversed(nodes):
        top = node
        for child in node.children:
            other = best[id(child)]
            if not child.off and (other.sum > top.sum or (other.sum == top.sum and named(other) and not named(top))):
                top = other
        best[id(node)] = top
    return best


def content(nodes: list[Node]) -> tuple[set[int], Node, float]:
    """The ids of the elements whose text is the page's main text; the chosen one and the threshold."""
    best = largest(nodes)
    body = nodes[0]
    chosen = best[id(body)]
    most, least, node = chosen.sum, chosen.density, chosen
    if chosen is body:
        tops = [x for x in nodes if x.tag in ("article", "main") and not x.off and x.chars and not x.parent.within]
        chosen = node = tops[0] if len(tops) == 1 else body
    while node is not None:
        least = min(least, node.density)
        node = node.parent
    taken, child = {id(chosen)}, chosen
    while child.tag not in ("article", "main") and child.parent is not None:
        near = child.parent
        for x in near.children:
            if x is child or x.off or not x.chars:
                continue
            part = x.density >= least and best[id(x)].sum >= PART * most
            beside = x.tag in HEADS and near is not body and near is chosen.parent and 2 * x.link_chars <= x.chars
            if part or (beside and (near.within or x.density >= least)):
                taken.add(id(best[id(x)]) if part else id(x))
        child = near
    return taken, chosen, least


def main_text(page: str | None) -> str:
    root = parse(page or "")
    nodes = in_order(root)
    measure(nodes)
    if not root.chars:
        return ""
    chosen, top, least = content(nodes)
    lines: list[list[str]] = [[]]
    stack: list = [(root, False)]
    while stack:
        item, taken = stack.pop()
        if item is BREAK:
            lines.append([])
        elif isinstance(item, str):
            if taken:
                lines[-1].append(item)
        elif not item.off:
            block = item.tag in BLOCK
            if taken and block and item is not top:
                if item.density < least and 2 * item.link_chars > item.chars:
                    lines.append([])
                    continue
            taken = taken or id(item) in chosen
            if block:
                lines.append([])
                stack.append((BREAK, taken))
            stack.extend((x, taken) for x in reversed(item.parts))
    out = (" ".join("".join(x).split()) for x in lines)
    return "\n".join(x for x in out if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
