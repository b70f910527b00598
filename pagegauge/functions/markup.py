"""HTML parsing helpers for markup that patterns cannot read (unclosed or nested tags)."""

from __future__ import annotations

import operator
import re
import sys
from html.parser import HTMLParser

from pagegauge.functions import kernels

VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
CELL_TAGS = ("td", "th")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def _below(self):
        """Everything inside, in order; a stack instead of recursion, since markup can be nested to any depth."""
        stack = self.children[::-1]
        while stack:
            child = stack.pop()
            yield child
            if isinstance(child, Node):
                stack += child.children[::-1]

    def walk(self):
        return (c for c in self._below() if isinstance(c, Node))

    def texts(self):
        return (c for c in self._below() if not isinstance(c, Node))

    def text(self) -> str:
        return " ".join(t for t in (part.strip() for part in self.texts()) if t)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.open = self.root

    def handle_starttag(self, tag, attrs):
        # An unclosed row or cell ends where the next one starts.
        if tag in CELL_TAGS or tag == "tr":
            enders = CELL_TAGS if tag in CELL_TAGS else CELL_TAGS + ("tr",)
            at = self.open
            while at.parent is not None and at.tag != "table":
                if at.tag in enders:
                    self.open = at.parent
                at = at.parent
        node = Node(tag, dict(attrs), self.open)
        self.open.children.append(node)
        if tag not in VOID_TAGS:
            self.open = node

    def parse_marked_section(self, i, report=1):
        # "<![" with any other word than CDATA is a comment in HTML; the base class raises.
        return self.parse_bogus_comment(i)

    def handle_startendtag(self, tag, attrs):
        self.open.children.append(Node(tag, dict(attrs), self.open))

    def handle_endtag(self, tag):
        at = self.open
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.open = at.parent

    def handle_data(self, data):
        self.open.children.append(data)


#: Markup of bare tags and text: no attribute, entity, comment or declaration.
_BARE = re.compile(r"(?:[^<&]++|</?[A-Za-z][A-Za-z0-9]*+>)*+")
_TOKEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*+)>|[^<]++")
#: Elements whose content is no markup.
_RAW = re.compile(r"(?i)<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)>")


def parse(html: str) -> Node:
    """The tree of a page; bare tags are cut by patterns, which takes an eighth of the parser's time."""
    builder, html = _Builder(), html or ""
    if _BARE.fullmatch(html) and not _RAW.search(html):
        for token in _TOKEN.finditer(html):
            end, tag = token.groups()
            if tag is None:
                builder.handle_data(token[0])
            elif end:
                builder.handle_endtag(tag.lower())
            else:
                builder.handle_starttag(tag.lower(), [])
        return builder.root
    builder.feed(html)
    builder.close()
    return builder.root


def tables(html: str) -> list[list[list[str]]]:
    """Raw cell text of every table: rows in order, spans ignored, empty rows dropped."""
    out = []
    for table in (n for n in parse(html).walk() if n.tag == "table"):
        rows = [
            [" ".join(" ".join(cell.texts()).split()) for cell in row.walk() if cell.tag in CELL_TAGS]
            for row in table.walk() if row.tag == "tr"
        ]
        rows = [row for row in rows if row]
        if rows:
            out.append(rows)
    return out


def first_table(html: str) -> Node | None:
    return next((n for n in parse(html).walk() if n.tag == "table"), None)


class Rows(tuple):
    """A plain table: a tuple of cells, each a string of tag and text, for every row."""


def tree_size(node: Node | Rows | tuple | None) -> int:
    if isinstance(node, Rows):
        return 1 + len(node) + sum(map(len, node))
    if isinstance(node, tuple):
        return node[1]
    return 0 if node is None else 1 + sum(1 for _ in node.walk())


def _label(node: Node) -> tuple:
    spans = tuple(
        (name, node.attrs[name]) for name in ("rowspan", "colspan")
        if node.attrs.get(name) and node.attrs[name] != "1"
    )
    return node.tag, node.text() if node.tag in CELL_TAGS else "", spans


def _too_deep(node: Node) -> bool:
    """Whether reading a tree would pass Python's limit: ``freeze`` takes at least two calls a level."""
    level, most = [node], sys.getrecursionlimit() // 2
    while level and most:
        level, most = [child for parent in level for child in parent.elements()], most - 1
    return bool(level)


def freeze(node: Node) -> tuple:
    """(label, size, children, labels of the children if all are leaves) with everything the distance needs read once."""
    return _frozen(_label(node), tuple(freeze(c) for c in node.elements()))


def _frozen(label: tuple, children: tuple) -> tuple:
    leaves = all(not c[2] for c in children)
    return label, 1 + sum(c[1] for c in children), children, frozenset(c[0] for c in children) if leaves else None


#: Markup of one table without attributes, entities or markup in its cells, on one line and without blanks to strip.
_PLAIN_TABLE = re.compile(
    r"[^<&]*+<table>(?:<tr>(?:<td>[^<&\r\n]*+</td>|<th>[^<&\r\n]*+</th>)*+</tr>)*+</table>[^<&]*+")
_CELL = re.compile(r"<(t[dh]>[^<]*+)")
_BLANK_END = re.compile(r">\s|\s<")


def read_table(html: str) -> Node | Rows | None:
    """The first table of a page; plain markup is cut by patterns into rows of cells (tag and text) instead of parsed."""
    if not html or not _PLAIN_TABLE.fullmatch(html):
        return first_table(html)
    table = html[html.index("<table>"):html.rindex(">") + 1]
    if _BLANK_END.search(table):
        return first_table(html)
    return Rows(tuple(_CELL.findall(row)) for row in table.split("</tr>")[:-1])


def _leaf(cell: str) -> tuple:
    tag, _, text = cell.partition(">")
    return _frozen((tag, text, ()), ())


def _frozen_table(table: Node | Rows | tuple) -> tuple:
    if isinstance(table, Rows):
        return _frozen(("table", "", ()), tuple(_frozen(("tr", "", ()), tuple(map(_leaf, row))) for row in table))
    return table if isinstance(table, tuple) else freeze(table)


def _row_distance(a: tuple, b: tuple) -> int:
    """Distance of two rows of plain cells: a cell comes, goes or changes for 1."""
    if set(a).isdisjoint(b):
        return max(len(a), len(b))
    other = sum(map(operator.ne, a, b)) if len(a) == len(b) else 2
    return other if other < 2 else kernels.distance(a, b)


def tree_distance(a: Node | Rows | tuple | None, b: Node | Rows | tuple | None) -> int:
    """Top-down distance: relabel the roots, align child sequences, whole subtrees come and go."""
    if a is None or b is None:
        return tree_size(a) + tree_size(b)
    if any(isinstance(t, Node) and _too_deep(t) for t in (a, b)):
        raise RecursionError("maximum recursion depth exceeded")
    if isinstance(a, Rows) and isinstance(b, Rows):
        return _sequence_distance(*_trimmed(a, b), lambda row: 1 + len(row), _row_distance)
    return _frozen_distance(_frozen_table(a), _frozen_table(b))


def _frozen_distance(a: tuple, b: tuple) -> int:
    if a[2] == b[2]:
        return int(a[0] != b[0])
    if not a[2] or not b[2]:
        return (a[0] != b[0]) + a[1] + b[1] - 2
    if a[3] is not None and b[3] is not None and a[3].isdisjoint(b[3]):
        # Leaves without a common label: each place costs 1.
        return (a[0] != b[0]) + max(len(a[2]), len(b[2]))
    return (a[0] != b[0]) + _sequence_distance(*_trimmed(a[2], b[2]), lambda child: child[1], _frozen_distance)


def _sequence_distance(left, right, size, change) -> int:
    """Cheapest alignment of two lists of subtrees, given the size of one and the cost of changing one into another.

    Diagonals near the difference in length are tried first: an alignment that leaves them takes out and puts in one more
    subtree at least for each diagonal beyond, so a result below that price is the cheapest of all.
    """
    if len(left) < len(right):
        left, right = right, left
    gone, come = [size(child) for child in left], [size(child) for child in right]
    if not come:
        return sum(gone)
    extra, least, reach = len(left) - len(right), min(*gone, *come), 0
    while True:
        found = _band_distance(left, right, gone, come, change, extra + reach, reach)
        if found <= (extra + 2 * (reach + 1)) * least or reach >= len(right):
            return found
        reach = 2 * reach + 1


def _band_distance(left, right, gone: list[int], come: list[int], change, below: int, above: int) -> int:
    """Cheapest alignment that never passes so many more of the left side than of the right, or so many fewer."""
    far, line, first = 1 << 60, [0], 0  # costs from the ``first`` number of right subtrees on
    for size in come[:above]:
        line.append(line[-1] + size)
    for i, child in enumerate(left, 1):
        lo, hi, out = max(0, i - below), min(len(right), i + above), gone[i - 1]
        fresh, last = [], far
        if lo == 0:
            last = line[0] + out
            fresh.append(last)
        for j in range(max(lo, 1), hi + 1):
            at, into = j - first, come[j - 1]
            last = min(last + into, line[at] + out if at < len(line) else far)
            # Sizes bound what changing one into the other costs from below.
            if line[at - 1] + abs(out - into) < last:
                last = min(last, line[at - 1] + change(child, right[j - 1]))
            fresh.append(last)
        line, first = fresh, lo
    return line[-1]


def _trimmed(left, right) -> tuple:
    """Children without the equal ones at either end: the distance is a metric, so matching those is never worse."""
    n = min(len(left), len(right))
    start = 0
    while start < n and left[start] == right[start]:
        start += 1
    end = 0
    while end < n - start and left[-1 - end] == right[-1 - end]:
        end += 1
    return left[start:len(left) - end], right[start:len(right) - end]
