"""A page's tree of block elements and text blocks, as far as extraction needs it."""

from __future__ import annotations

import re
from html import unescape

#: Elements that don't interrupt a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is raw and never shown as such: all up to the closing tag.
RAW = frozenset("script style iframe noembed noframes title textarea".split())
#: Elements with a tree of their own that isn't shown as text.
SKIPPED = frozenset("template svg object math canvas audio video".split())
#: Of these, those that '/>' closes.
FOREIGN = frozenset({"svg", "math"})
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s+|/|=|\"[^\"]*\"|'[^']*'|[^\s\"'>/=]+)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<(?=/?[a-zA-Z])[^>]*\Z", re.DOTALL
)
_NAMES = re.compile(r"(?:^|[\s/\"'])(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """A block element, or a text block if `text` isn't None."""

    __slots__ = ("tag", "names", "parent", "text", "link_chars", "index", "hidden")

    def __init__(self, tag: str, names: tuple, parent: int, text: str | None = None, link_chars: int = 0, hidden: bool = False):
        self.tag, self.names, self.parent, self.text, self.link_chars, self.hidden = tag, names, parent, text, link_chars, hidden


def names_of(attributes: str) -> tuple:
    """Words of the attributes that name an element's purpose."""
    if not attributes or "=" not in attributes:
        return ()
    out = []
    for _, a, b, c in _NAMES.findall(attributes):
        out += [w.lower() for w in _WORD.findall(a or b or c)]
    return tuple(dict.fromkeys(out))


def _ends(page: str, at: int, tag: str) -> dict[int, int]:
    """Where the page goes on after each element of SKIPPED from `at` on, by where its tag ends, in one
    pass. An element without a closing tag of its own isn't listed: it is taken as empty."""
    out, opened = {}, []
    while (m := _TOKEN.search(page, at)) is not None:
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if m[1] or m[4]:
            if name == tag and opened:
                out[opened.pop()] = at
        elif name in RAW and tag not in FOREIGN:
            at = _after_raw(page, at, name)
        elif name == tag and not (tag in FOREIGN and (m[3] or m[6] or "").endswith("/")):
            opened.append(at)
    return out


def _after_raw(page: str, at: int, tag: str) -> int:
    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
    return close.end() if close else len(page)


class _Open:
    """The open elements: tag and node of the block that holds what follows; and where each tag is open."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("#root", 0)]
        self.where: dict[str, list[int]] = {}
        self.blocks = [0]  # places of open blocks, the root among them

    def push(self, tag: str, node: int) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.where[tag].pop()
        if tag not in INLINE:
            self.blocks.pop()
        return tag

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)


def parse(html: str | None) -> list[Node]:
    """Nodes in page order, parents before children; the first is the root. Takes time in proportion
    to the page, however deep its elements lie and whichever tags are missing."""
    nodes = [Node("#root", (), -1)]
    opened = _Open()  # inline elements have their block's node
    stack = opened.stack
    skips: dict[str, dict[int, int]] = {}
    pieces: list[str] = []
    links, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                nodes.append(Node("#text", (), stack[-1][1], text, links))
            pieces.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            links += len(text.strip())

    def close_to(depth: int) -> None:
        nonlocal in_link
        if opened.blocks[-1] >= depth:
            flush()  # a text ends at the first block that closes
        while len(stack) > depth:
            if opened.pop() == "a":
                in_link = max(0, in_link - 1)

    page = html or ""
    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        begin, at = m.start(), m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in SKIPPED and not closing:
            if not (tag in FOREIGN and attributes.endswith("/")):
                if tag not in skips:
                    skips[tag] = _ends(page, begin, tag)
                at = skips[tag].get(at, at)
            continue
        if closing:
            depth = opened.last((tag,))
            if tag in INLINE:
                if depth > opened.blocks[-1]:
                    close_to(depth)
            elif depth:
                close_to(depth)
            else:
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            at = _after_raw(page, at, tag)
            continue
        if tag in INLINE:
            in_link += tag == "a"
            opened.push(tag, stack[-1][1])
            continue
        if tag in _P_ENDS and stack[opened.blocks[-1]][0] == "p":
            close_to(opened.blocks[-1])
        if tag in _CLOSES:
            own, scope = _CLOSES[tag]
            lowest = opened.last(own)
            if lowest > opened.last(scope):
                while stack[lowest - 1][0] in own:
                    lowest -= 1
                close_to(lowest)
        flush()
        nodes.append(Node(tag, names_of(attributes), stack[-1][1], hidden=bool(attributes) and _HIDDEN.search(attributes) is not None))
        opened.push(tag, len(nodes) - 1)
    close_to(1)
    flush()
    return nodes
