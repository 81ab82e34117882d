"""Block trees of web pages: block elements with the text that stands directly in them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from html.parser import HTMLParser

#: Fixed values of HTML: elements without content, without readable content, within lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "head title script style template noscript iframe object svg math canvas audio video "
    "button select option optgroup datalist textarea".split()
)
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An open paragraph ends where one of these begins.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd".split()
)
#: Elements whose start ends an open one, and what that one must lie within.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup"}, {"select", "datalist"}),
}
#: Elements that can stand in a head; any other one ends an open head.
IN_HEAD = frozenset(
    "base basefont bgsound link meta title script style template noscript noframes head html".split()
)
_SPACES = re.compile(r"\s+")
_OPENS = re.compile(r"<[A-Za-z/!?]")


class Node:
    """A block element. `pieces` has its own texts and, as numbers, its child blocks."""

    __slots__ = ("tag", "hints", "parent", "children", "pieces", "chars", "link_chars")

    def __init__(self, tag: str, hints: str, parent: int) -> None:
        self.tag, self.hints, self.parent = tag, hints, parent
        self.children: list[int] = []
        self.pieces: list[str | int] = []
        self.chars = self.link_chars = 0


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", "", -1)]
        self.open: list[tuple[str, int]] = []  # (tag, node or -1 for inline and hidden ones)
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag in `open`
        self.blocks: list[int] = []  # places of those with a node
        self.at = 0
        self.links = self.hidden = 0
        self.marked: set[int] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self.handle_endtag("head")
        elif tag not in IN_HEAD:
            self._end_head()
        if tag == "br" or tag == "hr":
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._end_open({"p"}, {"table", "td", "th", "article", "section", "div"})
        if tag == "optgroup":
            self._end_open(*SIBLINGS["option"])
        if tag in SIBLINGS:
            self._end_open(*SIBLINGS[tag])
        node = -1
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in INLINE:
            self.links += tag == "a"
        elif tag not in ("html", "body") and not self.hidden:
            values = dict(attrs)
            hints = " ".join(values.get(k) or "" for k in ("class", "id", "role")).lower()
            node = len(self.nodes)
            self.nodes.append(Node(tag, hints, self.at))
            self.nodes[self.at].children.append(node)
            self.nodes[self.at].pieces.append(node)
            if "data-main" in values:
                self.marked.add(node)
            self.at = node
            self.blocks.append(len(self.open))
        self.places[tag].append(len(self.open))
        self.open.append((tag, node))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in FOREIGN:
            self.handle_starttag(tag, attrs)  # HTML knows no empty form of other elements

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # which is what HTML takes `<![` for, up to the next `>`

    def handle_endtag(self, tag: str) -> None:
        i = self._nearest((tag,))
        # A line-level end tag closes no block.
        if i >= 0 and not (tag in INLINE and self.blocks and self.blocks[-1] > i):
            self._close(i)

    def handle_data(self, data: str) -> None:
        if self.hidden and not data.isspace():
            self._end_head()
        if self.hidden:
            return
        node = self.nodes[self.at]
        node.pieces.append(data)
        n = len(_SPACES.sub("", data))
        node.chars += n
        node.link_chars += n if self.links else 0

    def _end_head(self) -> None:
        """Close an open head, unless what begins lies in another element of it."""
        while self.open and self.open[-1][0] == "head":
            self._close(len(self.open) - 1)

    def _end_open(self, ended: set[str], within: set[str]) -> None:
        """Close the nearest open element of `ended` that lies within the nearest `within`."""
        i = self._nearest(ended)
        if i > self._nearest(within):
            self._close(i)

    def _nearest(self, tags: Iterable[str]) -> int:
        """The place of the last open element of these, -1 without one."""
        return max(self.places[t][-1] if self.places[t] else -1 for t in tags)

    def _close(self, i: int) -> None:
        for tag, node in reversed(self.open[i:]):
            self.places[tag].pop()
            if node >= 0:
                self.blocks.pop()
                self.at = self.nodes[node].parent
            elif tag in HIDDEN:
                self.hidden -= 1
            else:
                self.links -= tag == "a"
        del self.open[i:]


def block_tree(html: str) -> tuple[list[Node], set[int]]:
    """The blocks of a page, parents first (the first stands for the page), and those with
    a `data-main` attribute, by which labelled pages mark their main text."""
    builder = _Builder()
    # A tag or comment that nothing closes ends with the page and is no text. Left in, the
    # parser would look for its end again from each `<`.
    last = html.rfind(">") + 1
    unclosed = _OPENS.search(html, last)
    builder.feed(html[: unclosed.start()] if unclosed else html)
    builder.close()
    return builder.nodes, builder.marked


def own_blocks(node: Node) -> list[str]:
    """The texts directly in a node, in order, cut at child blocks; white space is one
    blank. A number marks the place of a child."""
    out: list = []
    line: list[str] = []
    for piece in [*node.pieces, -1]:
        if isinstance(piece, str):
            line.append(piece)
            continue
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        if piece >= 0:
            out.append(piece)
        line = []
    return out
