"""A forgiving HTML parser for extraction: elements and texts of a page in document order."""

from __future__ import annotations

import re
from html import unescape

#: Comments (``<!-->`` is a whole one), other declarations, end tags, and the names of start tags.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)",
    re.S,
)
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements whose content is never shown as text of the page, or is that of a form's field.
UNSEEN = RAW - {"xmp"} | frozenset("head template svg audio video canvas select datalist button".split())
#: Elements that may stand in a head; any other, and any text, ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start of one of these ends a paragraph that is open.
_ENDS_P = BLOCK - frozenset("body br caption html legend optgroup option tbody td tfoot th thead tr".split())
#: A start of the key ends an open element of the first set, unless one of the second is open within it.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_BOUNDARY = frozenset("html body table td th caption".split())
_P_STOP = _BOUNDARY | {"button", "object"}


def name_tokens(attributes: str) -> list[str]:
    """Parts of the values of class, id, role and of microdata, in lower case, and names of flags that hide."""
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role", "itemprop", "itemtype", "aria-label", "data-role"):
            out += [p.lower() for p in _NAME_PART.findall((m[2] or "").strip("\"'").rpartition("/")[2])]
        elif name == "hidden" or (name == "style" and "display:none" in (m[2] or "").replace(" ", "").lower()):
            out.append("hidden")
    return out


class Node:
    __slots__ = ("attributes", "block", "depth", "parent", "seen", "tag", "text")

    def __init__(self, tag: str, attributes: str, parent: int, depth: int, seen: bool, text: str = "", block: bool = False):
        self.tag, self.attributes, self.parent, self.depth, self.seen, self.text, self.block = tag, attributes, parent, depth, seen, text, block


class _Open:
    """Open elements: their nodes, and where in that list each tag, block and boundary is, so that a search costs no walk."""

    def __init__(self):
        self.nodes = [0]
        self.tags: list[str] = ["#root"]
        self.at: dict[object, list[int]] = {BLOCK: [], _BOUNDARY: [], _P_STOP: []}

    def push(self, node: int, tag: str) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.at.setdefault(tag, []).append(place)
        for group in (BLOCK, _BOUNDARY, _P_STOP):
            if tag in group:
                self.at[group].append(place)

    def cut(self, place: int) -> None:
        """Closes the element at the place and all within it."""
        for tag in self.tags[place:]:
            self.at[tag].pop()
            for group in (BLOCK, _BOUNDARY, _P_STOP):
                if tag in group:
                    self.at[group].pop()
        del self.nodes[place:], self.tags[place:]

    def last(self, *keys) -> int:
        """The innermost place of any of the tags or groups; 0 without one."""
        return max((x[-1] for k in keys if (x := self.at.get(k))), default=0)

    def find(self, tags, stop) -> int:
        """The innermost place of any of ``tags`` if none of ``stop`` is open within it, else 0."""
        place = self.last(*tags)
        return place if place and self.last(*stop) < place else 0


def _tag_end(html: str, at: int, lost: set[int]) -> tuple[int, int]:
    """(end of the attributes, end of the tag) of a start tag whose name ends at ``at``.

    Quoted text may hold any sign. Where a quote never closes, the tag ends at its first
    ``>``. ``lost`` keeps the quotes from which none closes, so that no stretch is
    searched for every tag in it.
    """
    seen, i = [], at
    while (m := _STOP.search(html, i)) is not None:
        j = m.start()
        if html[j] == ">":
            return j, j + 1
        k = -1 if j in lost else html.find(html[j], j + 1)
        seen.append(j)
        if k < 0:
            lost.update(seen)
            end = html.find(">", at)
            return (end, end + 1) if end >= 0 else (len(html), len(html))
        i = k + 1
    return len(html), len(html)


def parse(html: str) -> list[Node]:
    """Nodes in document order, the root first; texts are nodes of tag "#". A br is an element.

    Tags that end nothing open are ignored, open elements end with the page, and a tag
    that the end of the page cuts off counts as a tag. Character references of texts
    are decoded. The time grows with the length of the page, however deep it is nested.
    """
    nodes = [Node("#root", "", -1, 0, True)]
    open_, lost = _Open(), set()
    at, n = 0, len(html)

    def end_head() -> None:
        if (k := open_.last("head")) and open_.tags[k + 1 :] in ([], ["noscript"]):
            open_.cut(k)

    def text(raw: str, plain: bool = False) -> None:
        if raw:
            if open_.at.get("head") and not raw.isspace():
                end_head()
            parent = open_.nodes[-1]
            top = nodes[parent]
            nodes.append(Node("#", "", parent, top.depth + 1, top.seen, raw if plain or "&" not in raw else unescape(raw)))

    while at < n:
        i = html.find("<", at)
        if i < 0:
            text(html[at:])
            break
        m = _TOKEN.match(html, i)
        if m is None:  # a plain < sign
            j = html.find("<", i + 1)
            j = n if j < 0 else j
            text(html[at:j])
            at = j
            continue
        text(html[at:i])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in _BOUNDARY:
                k = open_.find((tag,), _BOUNDARY - {tag})
            else:
                k = open_.find((tag,), (_BOUNDARY if tag in BLOCK else BLOCK,))
            if not k and tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "table"):
                k = open_.last(tag)
            if k:
                open_.cut(k)
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        end, at = _tag_end(html, at, lost)
        attributes = html[m.end() : end]
        if tag not in _IN_HEAD and open_.at.get("head"):
            end_head()
        if tag in _ENDS_P and (k := open_.find(("p",), (_P_STOP,))):
            open_.cut(k)
        if tag in _ENDS and (k := open_.find(*_ENDS[tag])):
            open_.cut(k)
        parent = open_.nodes[-1]
        top = nodes[parent]
        nodes.append(Node(tag, attributes, parent, top.depth + 1, top.seen and tag not in UNSEEN, "", tag in BLOCK))
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW and tag != "a":
            continue
        open_.push(len(nodes) - 1, tag)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            if tag not in UNSEEN:
                text(html[at : stop.start() if stop else n], plain=True)
            if stop is None:
                break
            at = stop.start()
    return nodes
