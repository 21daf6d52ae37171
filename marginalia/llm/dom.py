"""A small, forgiving HTML parser and simple tree matching of its trees.

The parser makes a tree of elements from any string: it never fails, closes what is left open, and treats raw-text elements, comments and
attribute quotes as browsers do closely enough for text extraction. Its cost is linear in the page.
"""

from __future__ import annotations

import html as entities
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that close an open element of the named kinds, up to the nearest container.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
}
#: Start tags that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body article aside section main nav header footer div form table td th blockquote figure ul ol dl".split())

_MARK = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|/?[a-zA-Z][^>]*+>)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    __slots__ = ("tag", "names", "role", "children", "up", "shape", "size")

    def __init__(self, tag: str, names: tuple[str, ...] = (), role: str = ""):
        self.tag, self.names, self.role = tag, names, role
        self.children: list = []  # nodes and decoded strings
        self.up: Node | None = None
        self.shape, self.size = -1, 0

    def label(self) -> str:
        return self.tag + "." + self.names[0] if self.names else self.tag


def _element(tag: str, attrs: str) -> Node:
    names, role = [], ""
    if attrs:
        for key, *values in _ATTR.findall(attrs):
            value = next(filter(None, values), "").lower()
            if key.lower() == "role":
                role = value
            else:
                names += value.split()
    return Node(tag, tuple(names), role)


def parse(page: str) -> Node:
    root = Node("#root")
    open_: list[Node] = [root]
    at, end = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            open_[-1].children.append(entities.unescape(piece) if "&" in piece else piece)

    while at < end:
        m = _MARK.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth].tag == tag:
                    del open_[depth:]
                    break
                if tag in INLINE and open_[depth].tag in CONTAINERS:
                    break
            continue
        if tag in CLOSES or tag in BLOCKS:
            closing = CLOSES.get(tag, ()) + (("p",) if tag in BLOCKS else ())
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth].tag in closing:
                    del open_[depth:]
                    break
                if open_[depth].tag in CONTAINERS:
                    break
        node = _element(tag, m[3])
        node.up = open_[-1]
        open_[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            # An unclosed raw-text element swallows the rest of the page.
            at = end if stop is None else stop.start()
        if tag not in VOID and not m[3].endswith("/"):
            open_.append(node)
    return root


class Shapes:
    """Numbers for tree shapes (labels and element children), and the sizes of best matches between shapes."""

    def __init__(self, most: int = 200_000):
        self.ids: dict = {}
        self.parts: list = []
        self.sizes: list[int] = []
        self.scores: dict = {}
        self.most = most

    def of(self, root: Node) -> int:
        """Sets shape and size throughout a tree, without recursion."""
        order, stack = [], [root]
        while stack:
            n = stack.pop()
            order.append(n)
            stack += [c for c in n.children if type(c) is Node]
        for n in reversed(order):
            key = (n.label(), tuple(c.shape for c in n.children if type(c) is Node))
            n.shape = self.add(key)
        return root.shape

    def add(self, key: tuple) -> int:
        i = self.ids.get(key)
        if i is None:
            i = self.ids[key] = len(self.parts)
            self.parts.append(key)
            self.sizes.append(1 + sum(self.sizes[c] for c in key[1]))
        return i

    def score(self, a: int, b: int, depth: int = 0) -> int:
        """Simple tree matching: the most nodes that an order- and ancestor-preserving match of the shapes pairs."""
        if a == b:
            return self.sizes[a]
        la, ca = self.parts[a]
        lb, cb = self.parts[b]
        if la != lb or depth > 60:
            return 0
        key = (a, b)
        got = self.scores.get(key)
        if got is None:
            got = 1 + self.table(ca, cb, depth + 1)[-1][-1]
            if len(self.scores) < self.most:
                self.scores[key] = got
        return got

    def table(self, ca, cb, depth: int) -> list[list[int]]:
        rows = [[0] * (len(cb) + 1)]
        for x in ca:
            last, row, best = rows[-1], [0], 0
            for j, y in enumerate(cb):
                best = max(best, last[j + 1], last[j] + self.score(x, y, depth))
                row.append(best)
            rows.append(row)
        return rows

    def pairs(self, ca: tuple, cb: tuple) -> list[tuple[int, int]]:
        """Places of matched children: equal shapes at both ends first, then the best match of what is between."""
        m, n = len(ca), len(cb)
        lead = 0
        while lead < min(m, n) and ca[lead] == cb[lead]:
            lead += 1
        tail = 0
        while tail < min(m, n) - lead and ca[m - 1 - tail] == cb[n - 1 - tail]:
            tail += 1
        out = [(k, k) for k in range(lead)] + [(m - 1 - k, n - 1 - k) for k in range(tail)]
        a, b = ca[lead : m - tail], cb[lead : n - tail]
        if a and b:
            rows, i, j = self.table(a, b, 0), len(a), len(b)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i + lead, j + lead))
        return out
