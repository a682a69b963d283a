"""Text of web pages as a reader sees it: a tree, visibility, then blocks laid out as lines."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import annotate

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|[^<]+|<",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_BLANK = re.compile(r"[ \t\n\r\f]+")

#: Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style template noscript title meta link base iframe object audio video canvas "
    "svg math datalist noembed noframes select textarea".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr form fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside nav header footer main address li dt dd figcaption "
    "details summary center legend caption tr td th thead tbody tfoot".split()
)
CELLS = frozenset({"td", "th"})
GROUPS = frozenset({"thead", "tbody", "tfoot"})
_CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
#: A start tag ends open elements of these names, looking no further than the given ones.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": (CELLS | {"tr", "caption"}, {"table"}),
    "td": (CELLS, {"tr", "table"}),
    "th": (CELLS, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
    **dict.fromkeys(GROUPS, (CELLS | GROUPS | {"tr", "caption"}, {"table"})),
    **dict.fromkeys(_CLOSES_P, ({"p"}, {"table", "td", "th", "li", "div", "body", "button"})),
}


class Node:
    __slots__ = ("name", "attributes", "children", "preserved")

    def __init__(self, name: str, attributes: dict[str, str], preserved: bool = False):
        self.name, self.attributes, self.preserved = name, attributes, preserved
        self.children: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    if not text.strip("/ \t\n\r\f"):
        return {}
    return {
        name.lower(): unescape(value.strip("\"'")) for name, value in reversed(_ATTRIBUTE.findall(text))
    }


def parse(page: str) -> list[Node]:
    """Elements in document order, the root first; missing end and start tags are implied."""
    root = Node("#root", {})
    nodes, open_ = [root], [root]

    def start(name: str, attributes: dict[str, str]) -> Node:
        node = Node(name, attributes, name == "pre" or open_[-1].preserved)
        open_[-1].children.append(node)
        nodes.append(node)
        open_.append(node)
        return node

    def end_to(position: int) -> None:
        del open_[position:]

    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        name = token[2]
        if name is None:
            text = token[0]
            if text[0] != "<" or text == "<":
                open_[-1].children.append(unescape(text))
            continue
        name = name.lower()
        if token[1]:
            if name == "p" and not any(node.name == "p" for node in open_):
                start("p", {})
            for position in range(len(open_) - 1, 0, -1):
                if open_[position].name == name:
                    end_to(position)
                    break
                if open_[position].name == "table" and name not in ("table", "body", "html"):
                    break
                if open_[position].name in CELLS and name not in CELLS | GROUPS | {"tr", "table", "body", "html"}:
                    break
            continue
        ends, limit = IMPLIED_ENDS.get(name, ((), ()))
        for position in range(len(open_) - 1, 0, -1):
            if open_[position].name in ends:
                end_to(position)
            elif open_[position].name in limit:
                break
        if name in CELLS and open_[-1].name in GROUPS | {"table"}:
            start("tr", {})
        node = start(name, _attributes(token[3]))
        if name in VOID:
            open_.pop()
        elif name in RAW:
            found = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, at)
            stop = found.start() if found else len(page)
            node.children.append(page[at:stop])
            close = page.find(">", stop)
            at = close + 1 if found and close >= 0 else len(page)
            open_.pop()
    return nodes


def hidden(node: Node) -> bool:
    if node.name in UNSEEN or "hidden" in node.attributes:
        return True
    style = node.attributes.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style


class Box:
    """A laid-out block: its lines, whether blank lines surround it, and what it is part of."""

    __slots__ = ("lines", "spaced", "kind", "cells", "span")

    def __init__(self, lines, spaced=False, kind="block", cells=(), span=1):
        self.lines, self.spaced, self.kind, self.cells, self.span = lines, spaced, kind, cells, span


_BREAK = object()


def _flow(items: list, preserved: bool) -> list[str]:
    """Lines of inline text and boxes, one below the other; margins do not add up."""
    lines: list[str] = []
    row: list[str] = []
    gap = False

    def put(new: list[str], spaced: bool) -> None:
        nonlocal gap
        if new:
            if lines and (gap or spaced):
                lines.append("")
            lines.extend(new)
            gap = spaced

    def end_row(keep_empty: bool = False) -> None:
        text = "".join(row)
        row.clear()
        if preserved:
            if text:
                put(text.removeprefix("\n").removesuffix("\n").split("\n"), False)
            return
        text = _BLANK.sub(" ", text).strip(" ")
        if text or (keep_empty and lines):
            put([text], False)

    for item in items:
        if isinstance(item, str):
            row.append(item)
        elif item is _BREAK:
            if preserved:
                row.append("\n")
            else:
                end_row(keep_empty=True)
        else:
            end_row()
            put(item.lines, item.spaced)
    end_row()
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _marked(marker: str, lines: list[str]) -> list[str]:
    blank = " " * len(marker)
    return [(blank if k else marker) + line if line else line for k, line in enumerate(lines or [""])]


def _list(node: Node, items: list) -> list:
    number = node.attributes.get("start", "1")
    number = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
    out = []
    for item in items:
        if isinstance(item, Box) and item.kind == "item":
            marker = f"{number}. " if node.name == "ol" else "- "
            out.append(Box(_marked(marker, item.lines)))
            number += 1
        else:
            out.append(item)
    return out


def _span(node: Node) -> int:
    given = node.attributes.get("colspan", "1")
    return min(100, max(1, int(given))) if re.fullmatch(r"\d{1,4}", given) else 1


def _grid(rows: list[Box]) -> list[str]:
    """Rows of cells as lines; cells of a column start at the same place."""
    widths: list[int] = []
    for row in rows:
        at = 0
        for cell in row.cells:
            widths.extend([0] * (at + cell.span - len(widths)))
            if cell.span == 1:
                widths[at] = max(widths[at], max(map(len, cell.lines), default=0))
            at += cell.span
    lines = []
    for row in rows:
        for k in range(max((len(cell.lines) for cell in row.cells), default=0)):
            at, parts = 0, []
            for cell in row.cells:
                room = sum(widths[at : at + cell.span]) + 3 * (cell.span - 1)
                parts.append((cell.lines[k] if k < len(cell.lines) else "").ljust(room))
                at += cell.span
            lines.append(" | ".join(parts).rstrip())
    return lines


def _table(items: list) -> Box:
    above, rows, loose = [], [], []
    for item in items:
        if isinstance(item, Box) and item.kind == "row":
            rows.append(item)
        elif isinstance(item, Box) and item.kind == "caption":
            above += item.lines
        elif not isinstance(item, str) or item.strip():
            loose.append(item)
    return Box([*above, *_flow(loose, False), *_grid(rows)], spaced=True)


def render(page: str | None) -> str:
    """The visible text of a page; empty for null and empty pages.

    Children come after their parents in the list of elements, so going backwards lays
    out the innermost first, however deep a page is nested.
    """
    nodes = parse(page or "")
    made: dict[int, list] = {}
    for node in reversed(nodes):
        if hidden(node):
            made[id(node)] = []
            continue
        items: list = []
        for child in node.children:
            if isinstance(child, str):
                items.append(child)
            else:
                items.extend(made.pop(id(child)))
        name = node.name
        if name == "br":
            result: list = [_BREAK]
        elif name == "hr":
            result = [Box(["---"], spaced=True)]
        elif name in GROUPS:
            result = items
        elif name in CELLS:
            result = [Box(_flow(items, node.preserved), kind="cell", span=_span(node))]
        elif name == "tr":
            cells = [item for item in items if isinstance(item, Box) and item.kind == "cell"]
            loose = [i for i in items if not (isinstance(i, Box) and i.kind == "cell")]
            cells += [Box(lines, kind="cell") for lines in [_flow(loose, False)] if lines]
            result = [Box(_grid([Box([], cells=cells)]), kind="row", cells=cells)]
        elif name == "table":
            result = [_table(items)]
        elif name == "caption":
            result = [Box(_flow(items, False), kind="caption")]
        elif name in ("ul", "ol"):
            result = [Box(_flow(_list(node, items), False), spaced=True)]
        elif name == "li":
            lines = _flow(items, node.preserved)
            result = [Box(lines, kind="item")] if lines else []
        elif name in ("blockquote", "dd"):
            result = [Box(_marked("  ", _flow(items, node.preserved)), name in SPACED)]
        elif name in BLOCKS:
            result = [Box(_flow(items, node.preserved), name in SPACED)]
        else:
            result = items
        made[id(node)] = result
    return "\n".join(_flow(made[id(nodes[0])], False))


def page_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """pages with the visible text of each; a column of that name is replaced.

    Pages are laid out alone, so nothing is shuffled, and copies, ties and repeated rows
    need no care. A page with no visible text gives an empty one.
    """

    def run(batch):
        return [pa.array([render(page) for page in batch.column(html_col).to_pylist()], pa.string())]

    rows = pages.withColumn(html_col, F.col(html_col).cast("string"))
    return annotate(rows, {text_col: "string"}, run, keep)
