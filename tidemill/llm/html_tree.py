"""Pages to trees: a tolerant scan of HTML into elements and the text runs between them."""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from html import unescape

#: Fixed values of the HTML standard: element kinds that the scan treats in a way of their own.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template textarea title iframe desc annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: What ends an open svg or math element.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var html article aside section nav main header footer form noscript".split()
)
#: An opening tag of the first kind ends an open element of the second, up to the nearest of the third.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}

def _tag(quoted: str) -> re.Pattern[str]:
    """A tag or comment. ``quoted``: what, besides the quotes, an attribute's value may not hold."""
    return re.compile(
        r"<(?:!--(?P<note>.*?)(?:-->|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)"
        rf"(?P<rest>(?:[^>\"'{quoted}]++|\"[^\"{quoted}]*+\"|'[^'{quoted}]*+')*+)>|[!?/][^>]*>)",
        re.DOTALL,
    )


_TAG, _STRICT_TAG = _tag(""), _tag("<")
_LAST_RESORT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)", re.DOTALL)
_LABEL = re.compile(r"""(?<![-\w])(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_UNSEEN = r"(?:display\s*:\s*none|visibility\s*:\s*hidden)"
_HIDDEN = re.compile(
    rf"""(?<![-\w])(?:hidden(?![-\w])|style\s*+=\s*+(?:"[^"]*?{_UNSEEN}|'[^']*?{_UNSEEN}|[^\s"'>]{{0,200}}?{_UNSEEN}))""", re.IGNORECASE
)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}


class Node:
    """An element, or (name ``#text``) a run of text between the borders of elements that are nodes."""

    __slots__ = ("name", "labels", "parent", "text", "linked", "tight")

    def __init__(self, name: str, labels: tuple[str, ...], parent: int) -> None:
        self.name, self.labels, self.parent = name, labels, parent
        self.text, self.linked, self.tight = "", 0, False


def label_words(rest: str) -> tuple[str, ...]:
    """Lower-case words of class, id and role values."""
    found: list[str] = []
    for m in _LABEL.finditer(rest):
        found += [w.lower() for w in _WORD.findall(m.group(1) or m.group(2) or m.group(3) or "")]
    if _HIDDEN.search(rest):
        found.append("hidden")
    return tuple(dict.fromkeys(found))


class _Open:
    """Elements that are open, with their depths by name, so that none is searched for."""

    def __init__(self, nodes: list[Node]) -> None:
        self.nodes, self.path = nodes, [0]
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]  # depths of those that are not inline

    def push(self, i: int, inline: bool = False) -> None:
        self.depths[self.nodes[i].name].append(len(self.path))
        if not inline:
            self.blocks.append(len(self.path))
        self.path.append(i)

    def close(self, depth: int) -> None:
        """Close all from this depth on."""
        while len(self.path) > depth:
            self.depths[self.nodes[self.path.pop()].name].pop()
            if self.blocks[-1] == len(self.path):
                self.blocks.pop()

    def depth(self, names: Iterable[str]) -> int:
        """Of the last opened of these, or 0."""
        return max((self.depths[name][-1] for name in names if self.depths[name]), default=0)


def parse(html: str) -> list[Node]:
    """Nodes in document order, parents first; node 0 is the page.

    Nodes are block elements, inline elements with a class, id, role or a mark that hides them, and runs
    of text. Comments, markup, scripts, styles and other raw elements leave nothing and end character references; math and svg are
    inline content. A run's text has its character references decoded and its white space turned into
    single spaces; ``tight`` runs follow the run before without white space or a block's border. Runs
    without any text are dropped. Unclosed and misnested elements close with the nearest open ancestor.
    A page whose quotes don't match is read on with values that hold no ``<``. The time is linear in the page's length.
    """
    nodes = [Node("#page", (), -1)]
    held = _Open(nodes)
    run: list[str] = []
    linked, links, gap, foreign = 0, 0, True, 0
    inline: dict[str, list[bool]] = defaultdict(list)  # open inline elements by name: whether they are nodes
    endless: set[str] = set()  # raw elements that don't end any more
    tag, last = _TAG, html.rfind(">")

    def flush(border: bool) -> None:
        nonlocal run, linked, gap
        if run:
            raw = "".join(map(unescape, run))
            text = " ".join(raw.split())
            if text:
                node = Node("#text", (), held.path[-1])
                node.text, node.linked, node.tight = text, min(linked, len(text)), not (gap or raw[0].isspace())
                nodes.append(node)
                gap = raw[-1].isspace()
            else:
                gap = gap or raw != ""
            run, linked = [], 0
        gap = gap or border

    def add(piece: str) -> None:
        nonlocal linked
        run.append(piece)
        if links:
            linked += len(piece)

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        m = tag.match(html, lt) if lt < last or html.startswith("<!--", lt) else None
        if m:
            at, name, closing, rest = m.end(), m.group("name"), m.group("end"), m.group("rest") or ""
        else:
            m = _LAST_RESORT.match(html, lt)
            if not m:
                add("<")
                at = lt + 1
                continue
            at, closing, name, rest, tag = m.end(), m.group(1), m.group(2), "", _STRICT_TAG
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not (foreign and rest.endswith("/")) and name not in endless:
                end = _RAW_END[name].search(html, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    at = n
                else:
                    endless.add(name)
            continue
        if name in ("svg", "math"):
            if closing:
                foreign = max(0, foreign - 1)
            elif not rest.endswith("/"):
                foreign += 1
            continue
        if foreign:
            if name not in BREAKOUT:
                if name == "text":
                    add(" ")
                continue
            foreign = 0
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            if closing:
                if inline[name] and inline[name].pop() and held.depth([name]) > held.blocks[-1]:
                    flush(False)
                    held.close(held.depth([name]))
            elif name not in VOID:
                labels = label_words(rest) if rest else ()
                inline[name].append(bool(labels))
                if labels:
                    flush(False)
                    nodes.append(Node(name, labels, held.path[-1]))
                    held.push(len(nodes) - 1, inline=True)
            continue
        if name == "br":
            add(" ")
            continue
        flush(True)
        links = 0
        if name in VOID:
            continue
        if closing:
            if held.depths[name]:
                held.close(held.depth([name]))
            continue
        if held.depth(["p"]) == held.blocks[-1] > 0:  # any block ends an open paragraph
            held.close(held.blocks[-1])
        if name in ENDS:
            ended, bound = ENDS[name]
            depth = held.depth(ended)
            if depth > held.depth(bound):
                held.close(depth)
        if name in ("html", "body", "head"):
            held.close(1)  # whatever the head left open
            nodes.append(Node(name, label_words(rest), 0))
        else:
            nodes.append(Node(name, label_words(rest) if rest else (), held.path[-1]))
        held.push(len(nodes) - 1)
    flush(True)
    return nodes
