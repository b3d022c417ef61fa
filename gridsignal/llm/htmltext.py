"""Visible text of HTML pages, laid out as a reader would see it.

A tree is built with the tags that HTML lets authors leave out; what style, attributes or the kind of element hide is
skipped; the rest is written as blocks, list items and tables with aligned columns. Parsing and layout keep their own
stacks, so the depth of a page is not limited.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.llm.blobs import bounded_records

DEEPEST_INDENT = 20  # deeper lists and quotes are not indented further

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)"""
    # a quote opens a value only after "="; where such values leave no end of the tag, it ends at the first ">"
    r"""((?:[\s/]++|(?>=?[^\s=/>]++|=)(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+(?=>)|[^>]*+)>""", re.S
)
ATTRIBUTE = re.compile(r"""((?>=?[^\s=/>]++|=))(?:\s*+=\s*+(?>"([^"]*)"|'([^']*)'|([^\s>]+)))?+""")
CLOSED = re.compile(r"""(?:^|[\s"'])/\Z""")
SPACE = re.compile(r"[ \t\n\r\f]+")

names = lambda text: frozenset(text.split())

VOID = names("area base br col embed hr img input link meta param source track wbr")
RAW = names("script style textarea title xmp iframe noembed noframes")
UNSEEN = names(
    "head script style template title iframe noembed noframes object video audio canvas datalist rp meta link base area embed"
)
HEAD_PARTS = names("base link meta noscript script style template title basefont bgsound")
SPACED = names("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl pre blockquote table figure listing hr xmp")
BLOCKS = SPACED | names(
    "address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend "
    "li main nav search section summary tr td th thead tbody tfoot caption option optgroup"
)
TABLE_PARTS = names("table thead tbody tfoot tr")
TABLE_TAGS = names("caption colgroup col thead tbody tfoot tr td th script style template")
WALL = names("html table td th caption template button object marquee applet")
HEADINGS = names("h1 h2 h3 h4 h5 h6")
CLOSES_P = BLOCKS - names("body html td th tr thead tbody tfoot caption option optgroup legend")
# of a drawing, only the text elements and the pages inside it show text
UNDRAWN = names("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter")
LEAVES_SVG = names(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var"
)
HOLDS_PAGE = names("foreignobject desc title")
TABLE, SVG, LISTS = names("table"), names("svg"), names("ul ol menu dir")
BLOCKS_OR_WALL, PAGE_AGAIN = BLOCKS | WALL, HOLDS_PAGE | LEAVES_SVG
OUTSIDE, DRAWING, DRAWN_TEXT = range(3)
RELEVANT = re.compile(r"hidden|display|visibility|style|colspan|rowspan|start|value|open|reversed", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes(text: str) -> dict[str, str]:
    if not RELEVANT.search(text):
        return {}
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


class Path:
    """Open elements from the root to the one that takes what comes next, with the places of each tag and of all walls."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.groups = [(tags, []) for tags in (WALL, BLOCKS_OR_WALL, PAGE_AGAIN)]

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        for tags, held in self.groups:
            if node.tag in tags:
                held.append(at)

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.nodes) > at:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            for tags, held in self.groups:
                if node.tag in tags:
                    held.pop()

    def last(self, tags: frozenset[str]) -> int:
        """The place of the innermost open element called one of ``tags``, 0 for none but the root."""
        for known, held in self.groups:
            if known is tags:
                return held[-1] if held else 0
        return max((held[-1] for t in tags if (held := self.places.get(t))), default=0)


class Builder:
    """Tree of a page. Every tag finds its partner by the places of open elements, so the work is linear in the page."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.path = Path(self.root)
        self.opened = self.path.nodes

    def text(self, text: str) -> None:
        here = self.opened[-1]
        if here.tag == "head" and text.strip():
            self.path.cut(len(self.opened) - 1)
            here = self.opened[-1]
        if here.tag in TABLE_PARTS and text.strip():
            self.before_table(text)
        elif text:
            here.children.append(text)

    def before_table(self, child: Node | str) -> None:
        """What a table cannot hold stands before it."""
        at = self.path.last(TABLE)
        parent = self.opened[at - 1] if at else self.opened[0]
        parent.children.insert(len(parent.children) - 1 if at else len(parent.children), child)

    def close(self, tags: frozenset[str], *walls: frozenset[str]) -> bool:
        """Close the innermost open element called one of ``tags``, unless one of ``walls`` stands before it."""
        at = self.path.last(tags)
        if not at or any(self.path.last(wall) > at for wall in walls):
            return False
        self.path.cut(at)
        return True

    def close_to(self, tags: frozenset[str]) -> None:
        self.path.cut(max(1, self.path.last(tags) + 1))

    def drawing(self) -> int:
        """The place of the open drawing that takes what comes next, or 0."""
        at = self.path.last(SVG)
        return at if at and self.path.last(PAGE_AGAIN) < at else 0

    def start(self, tag: str, text: str) -> None:
        inside = self.drawing()
        if inside and tag in LEAVES_SVG:
            self.path.cut(inside)
            inside = 0
        if tag in ("html", "body"):
            self.close(names("head"), names("body"))
            if tag == "html" or any(n.tag == "body" for n in self.opened[:3]):
                return
        if self.opened[-1].tag == "head" and tag not in HEAD_PARTS:
            self.path.cut(len(self.opened) - 1)
        if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup", "col"):
            if not self.path.last(TABLE):
                return
            self.table_part(tag)
        elif tag == "li":
            self.close(names("li"), WALL, LISTS)
        elif tag in ("dt", "dd"):
            self.close(names("dt dd"), WALL, names("dl"))
        elif tag in ("option", "optgroup"):
            self.close(names("option"), WALL, names("select optgroup"))
            if tag == "optgroup":
                self.close(names("optgroup"), WALL, names("select"))
        if tag in CLOSES_P:
            self.close(names("p"), WALL)
            if tag in HEADINGS and self.opened[-1].tag in HEADINGS:
                self.path.cut(len(self.opened) - 1)
        node = Node(tag, attributes(text))
        if self.opened[-1].tag in TABLE_PARTS and tag not in TABLE_TAGS:
            self.before_table(node)
        else:
            self.opened[-1].children.append(node)
        if tag not in VOID and not ((inside or tag == "svg") and CLOSED.search(text)):
            self.path.push(node)

    def table_part(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.close_to(TABLE_PARTS)
            if self.opened[-1].tag != "tr":
                row = Node("tr", {})
                self.opened[-1].children.append(row)
                self.path.push(row)
        elif tag == "tr":
            self.close_to(names("table thead tbody tfoot"))
        else:
            self.close_to(names("table"))

    def end(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID and tag != "br":
            return
        if tag == "br":
            self.start("br", "")
        elif tag in TABLE_TAGS or tag == "table":
            self.close(frozenset((tag,)), TABLE if tag != "table" else frozenset())
        elif tag in BLOCKS or tag in WALL:
            if tag in HEADINGS:
                self.close(HEADINGS, WALL)
            elif not self.close(frozenset((tag,)), WALL, LISTS if tag == "li" else frozenset()) and tag == "p":
                self.start("p", "")
                self.path.cut(len(self.opened) - 1)
        else:
            self.close(frozenset((tag,)), BLOCKS_OR_WALL)


def build(page: str) -> Node:
    """The tree of a page; broken markup is read as browsers do in the common cases."""
    tree = Builder()
    at, size, last = 0, len(page), page.rfind(">")
    lower = None
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            tree.text(html.unescape(page[at:]))
            break
        if begin > at:
            tree.text(html.unescape(page[at:begin]))
        token = TOKEN.match(page, begin) if begin < last or page[begin + 1 : begin + 2] in ("!", "?") else None
        if token is None:
            tree.text("<")
            at = begin + 1
            continue
        at = token.end()
        tag = token[2]
        if not tag:
            continue
        tag = tag.lower()
        if token[1]:
            tree.end(tag)
            continue
        tree.start(tag, token[3])
        if tag in RAW and tree.opened[-1].tag == tag:
            lower = page.lower() if lower is None else lower
            if len(lower) != size:  # a letter whose lower case is longer
                lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            end = lower.find(f"</{tag}", at)
            end = size if end < 0 else end
            inner = page[at:end]
            tree.opened[-1].children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            tree.path.cut(len(tree.opened) - 1)
            close = page.find(">", end)
            at = size if close < 0 else close + 1
    return tree.root


class Flow:
    """Lines of one block. ``gap`` is what stands between the last line and the next text: 1 a new line, 2 a blank one."""

    __slots__ = ("lines", "line", "gap")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0

    def flush(self) -> None:
        if self.line:
            text = "".join(self.line).rstrip(" ")
            if text:
                self.open(text)
            self.line = []

    def open(self, text: str) -> None:
        if self.gap == 2 and self.lines:
            self.lines.append("")
        self.lines.append(text)
        self.gap = 1

    def rest(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def inline(self, text: str) -> None:
        text = SPACE.sub(" ", text)
        if text[0] == " " and (not self.line or self.line[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.line.append(text)

    def block(self, lines: list[str], first: str = "", other: str = "", gap: int = 1) -> None:
        self.rest(gap)
        for i, text in enumerate(lines):
            if i == 0:
                self.open((first + text).rstrip(" "))
            else:
                self.lines.append((other + text).rstrip(" "))
        self.rest(gap)

    def done(self) -> list[str]:
        self.flush()
        return self.lines


def whole(text: str | None, default: int, least: int, most: int) -> int:
    found = re.match(r"\s*([+-]?\d+)", text or "", re.A)
    return min(max(int(found[1][:12]), least), most) if found else default


def shown(node: Node, parent_visible: bool, parent: Node | None, drawing: int = OUTSIDE) -> tuple[bool, bool]:
    """Whether an element takes part in the layout, and whether its own text is visible."""
    given = node.attributes
    if drawing and (node.tag in UNDRAWN or given.get("display") == "none"):
        return False, False
    if drawing and "visibility" in given:
        parent_visible = given["visibility"] == "visible"
    if node.tag in UNSEEN or "hidden" in given and given["hidden"] != "until-found":
        return False, False
    if node.tag == "dialog" and "open" not in given:
        return False, False
    if parent is not None and parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary":
        return False, False
    style = given.get("style")
    if style:
        rules = dict(r.split(":", 1) for r in re.sub(r"\s+", "", style.lower()).replace("!important", "").split(";") if ":" in r)
        if rules.get("display") == "none":
            return False, False
        if rules.get("visibility") in ("hidden", "collapse"):
            return True, False
        if rules.get("visibility") == "visible":
            return True, True
    return True, parent_visible


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns, rows) as text with columns aligned to the left."""
    grid: list[list[tuple[int, list[str], int]]] = []
    taken: dict[int, int] = {}
    for row in rows:
        placed, column = [], 0
        following = {c: n - 1 for c, n in taken.items() if n > 1}
        for lines, columns, height in row:
            while taken.get(column, 0) > 0:
                column += 1
            placed.append((column, lines, columns))
            if height > 1:
                following.update(dict.fromkeys(range(column, column + columns), height - 1))
            column += columns
        grid.append(placed)
        taken = following
    width: dict[int, int] = {}
    for placed in grid:
        for column, lines, columns in placed:
            if columns == 1:
                width[column] = max(width.get(column, 0), *map(len, lines), 0)
    starts, position = {}, 0
    for column in sorted({c for placed in grid for c, _, _ in placed} | set(width)):
        starts[column] = position
        position += width.get(column, 0) + (2 if width.get(column, 0) else 0)
    out = []
    for placed in grid:
        for i in range(max((len(lines) for _, lines, _ in placed), default=0)):
            text, at = [], 0
            for column, lines, _ in placed:
                if i < len(lines) and lines[i]:
                    space = max(starts[column] - at, 2 if at else 0)
                    text.append(" " * space + lines[i])
                    at += space + len(lines[i])
            out.append("".join(text))
    return out


class Layout:
    """Walks a tree and writes its text."""

    def __init__(self) -> None:
        self.flows = [Flow()]
        self.counters: list[list[int] | None] = []
        self.tables: list[list[list[tuple[list[str], int, int]]]] = []
        self.depth = 0

    def run(self, root: Node) -> str:
        stack = [(root, iter(root.children), True, False, OUTSIDE)]
        self.enter(root)
        while stack:
            node, children, visible, pre, drawing = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
                self.leave(node)
                if node.tag == "text" and drawing:
                    self.flows[-1].rest(1)
            elif isinstance(child, str):
                if visible and drawing != DRAWING and not (node.tag == "details" and "open" not in node.attributes) and node.tag not in TABLE_PARTS:
                    self.preformatted(child) if pre else self.flows[-1].inline(child)
            else:
                part, seen = shown(child, visible, node, drawing)
                if part:
                    self.enter(child)
                    if child.tag == "svg":
                        within = DRAWING
                    elif drawing and child.tag == "foreignobject":
                        within = OUTSIDE
                    else:
                        within = DRAWN_TEXT if drawing and child.tag == "text" else drawing
                    if within and child.tag == "text":
                        self.flows[-1].rest(1)
                    stack.append((child, iter(child.children), seen, pre or child.tag in ("pre", "listing", "xmp", "textarea"), within))
        return "\n".join(self.flows[0].done())

    def preformatted(self, text: str) -> None:
        flow = self.flows[-1]
        first, *others = text.replace("\r\n", "\n").expandtabs(8).split("\n")
        flow.line.append(first)
        for line in others:
            flow.open("".join(flow.line).rstrip(" ")) if flow.line and "".join(flow.line).strip() else flow.lines.append("")
            flow.line = [line]

    def enter(self, node: Node) -> None:
        tag, flow = node.tag, self.flows[-1]
        if tag == "br":
            if flow.line:
                flow.flush()
            elif flow.lines and flow.gap < 2:
                flow.lines.append("")
            return
        if tag == "wbr":
            return
        if tag in ("li", "dd", "blockquote", "td", "th", "caption"):
            if tag in ("li", "dd", "blockquote"):
                self.depth += 1
            self.flows.append(Flow())
        elif tag == "table":
            flow.rest(2)
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in BLOCKS:
            flow.rest(2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and self.depth) else 1)
        if tag in ("ul", "menu", "dir"):
            self.counters.append(None)
        elif tag == "ol":
            count = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
            down = "reversed" in node.attributes
            self.counters.append([whole(node.attributes.get("start"), count if down else 1, -(10**9), 10**9), -1 if down else 1])

    def leave(self, node: Node) -> None:
        tag = node.tag
        if tag in ("td", "th", "caption"):
            lines = self.flows.pop().done()
            if tag == "caption" or not self.tables or not self.tables[-1]:
                self.flows[-1].block(lines)
            else:
                across, down = node.attributes.get("colspan"), node.attributes.get("rowspan")
                self.tables[-1][-1].append((lines, whole(across, 1, 1, 1000), whole(down, 1, 1, 65534)))
        elif tag == "table":
            self.flows[-1].block(table_lines(self.tables.pop()), gap=2)
        elif tag in ("li", "dd", "blockquote"):
            lines = self.flows.pop().done()
            self.depth -= 1
            mark = "  "
            if tag == "li":
                mark = "- "
                if self.counters and self.counters[-1] is not None:
                    counter = self.counters[-1]
                    counter[0] = whole(node.attributes.get("value"), counter[0], -(10**9), 10**9)
                    mark = f"{counter[0]}. "
                    counter[0] += counter[1]
            if self.depth >= DEEPEST_INDENT:
                mark = mark if tag == "li" else ""
                self.flows[-1].block(lines, mark, "")
            else:
                self.flows[-1].block(lines, mark, " " * len(mark), 2 if tag == "blockquote" else 1)
        elif tag in BLOCKS:
            if tag in ("ul", "menu", "dir", "ol") and self.counters:
                self.counters.pop()
            if tag != "tr":
                self.flows[-1].rest(2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and self.depth) else 1)


def visible_text(page: str | None) -> str:
    """The text of one page; null and empty pages have none."""
    return Layout().run(build(page)).replace("\xa0", " ").strip("\n") if page else ""


def extract(pages: DataFrame, id: str = "page_id", page: str = "html") -> DataFrame:
    """``page_id`` and ``text`` of every page. Null ids are kept, null pages have empty texts, repeated rows are repeated,
    no pages give no rows. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = pa.array([visible_text(p) for p in rows.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), texts], names=["page_id", "text"])

    given = bounded_records(pages).select(F.col(id).cast("long").alias("page_id"), F.col(page).alias("page"))
    return given.mapInArrow(run, "page_id long, text string")
