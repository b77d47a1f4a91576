"""Layout-aware text of web pages.

Each page is tokenised, built into a tree with implied tags, and rendered: all
visible text in reading order, with the spacing of blocks, list markers and
aligned table cells.  Pages are independent rows, so this is one pass over Arrow
batches without a shuffle; the rest of the row stays in Spark.

Tree: ``p`` is closed by the next block, ``li``, ``dt``/``dd``, ``option``, table
rows and cells by the next of their kind within the same list or table; end tags
without an open element are ignored; an end tag closes what is open inside it, but
not beyond a table cell; elements left open are closed at the end.

Visibility: nothing of head, script, style, template, noscript, iframe, object,
select, textarea, media, svg and the like is shown, nor elements with ``hidden``,
``aria-hidden="true"``, ``display:none`` or ``visibility:hidden`` (a descendant may
be visible again), nor comments, nor what a closed ``details`` holds beside its
summary.

Rendering: white space collapses except in ``pre``; paragraphs, headings, lists,
tables, quotes and ``pre`` are set off by an empty line, other blocks by a line
break; list items get ``- `` or their number, inner lists are indented; the cells
of a table's column are padded to equal width, and ``colspan`` takes the room of
its columns.

Time grows with the page's length whatever its markup: see ``Tags`` and ``Opened``.
Indents count up to ``INDENTS`` levels, columns are padded up to ``WIDE`` characters, and
tables in more than ``TABLES`` tables are rows of the innermost of these.

Defined results: a null page has an empty text; broken markup never fails; nesting
of any depth is handled without recursion; repeated rows get equal rows; the rows'
further columns are kept by ``rendered``.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, table

#: A whole start or end tag, or the name of one whose end has to be looked for.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
NAME = re.compile(r"</?[a-zA-Z]")
SIGNS = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY_STYLE = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset(
    "head title script style template noscript iframe object embed select option optgroup datalist textarea "
    "audio video canvas svg math noembed noframes meta link base param source track map area dialog".split()
)
SET_OFF = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
BLOCKS = SET_OFF | frozenset(
    "html body div section article header footer nav main aside address form fieldset li dt dd hr figcaption "
    "details summary center menu dir tr td th caption thead tbody tfoot legend hgroup search".split()
)
CLOSES_P = BLOCKS - frozenset("html body td th tr thead tbody tfoot caption legend summary figcaption".split())
CELLS = frozenset(("td", "th"))
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
LISTS = frozenset(("ul", "ol", "menu", "dir"))
#: Start tag: what it closes first, and where the search for it ends.
IMPLIED = {
    "li": (frozenset(("li",)), LISTS | frozenset(("table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (CELLS | {"caption"}, frozenset(("table",))),
    "th": (CELLS | {"caption"}, frozenset(("table",))),
    "tr": (CELLS | {"tr", "caption"}, frozenset(("table",))),
    "thead": (CELLS | SECTIONS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    "tbody": (CELLS | SECTIONS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    "tfoot": (CELLS | SECTIONS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset()),
}
#: End tags that close elements around the cell they are in.
BEYOND_CELLS = frozenset("table tr tbody thead tfoot html body".split())
#: Tables in tables beyond this are lines of the table around them; indents and columns are not padded beyond these.
TABLES, INDENTS, WIDE = 8, 32, 200
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


class Tags:
    """Tags of a page from left to right, in time that grows with its length.

    A tag ends at the first ``>`` outside quotes.  A ``<`` that no such end follows is text.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.signs: list[int] | None = None

    def ended(self, at: int) -> bool:
        """Whether a tag that is open at ``at`` ends; looked up in a table made once, from the back."""
        if self.signs is None:
            self.signs = [m.start() for m in SIGNS.finditer(self.page)]
            self.ends = [False] * (len(self.signs) + 1)
            later: dict[str, int] = {}
            for i in range(len(self.signs) - 1, -1, -1):
                sign = self.page[self.signs[i]]
                self.ends[i] = sign == ">" or (sign in later and self.ends[later[sign] + 1])
                later[sign] = i
        return self.ends[bisect_left(self.signs, at)]

    def next(self, at: int) -> tuple[int, int, re.Match | None]:
        """Start and end of the next tag or comment at or after ``at``, and its parts if it is a tag."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return len(page), len(page), None
            after = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), None
            if start < self.last:
                name = NAME.match(page, start)
                # Once a tag without end has been met, all others are looked up before they are read.
                if name and (self.signs is None or self.ended(name.end())):
                    match = TAG.match(page, start)
                    if match:
                        return start, match.end(), match
                    self.ended(start)
                if after in ("!", "?", "/"):
                    return start, page.find(">", start) + 1, None
            at = start + 1


class Opened:
    """The open elements, and where in the stack those of each name are."""

    def __init__(self, root: Node):
        self.stack: list[Node] = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of some names, or 0."""
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=0)

    def close_first(self, names: frozenset[str], stop: frozenset[str]) -> None:
        """Close the outermost open element of ``names`` inside the innermost of ``stop``."""
        above = self.last(stop)
        found = [places[bisect_right(places, above)] for name in names if (places := self.places.get(name)) and places[-1] > above]
        if found:
            self.close(min(found))


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root", {})
    opened, tags = Opened(root), Tags(page)
    stack = opened.stack
    at, size = 0, len(page)
    while at < size:
        start, end, match = tags.next(at)
        if start > at:
            text = html.unescape(page[at:start])
            if stack[-1].tag == "head" and text.strip():
                opened.close(len(stack) - 1)
            stack[-1].children.append(text)
        at = end
        if match is None:
            continue
        tag = match[2].lower()
        if match[1]:
            place, cell = opened.last((tag,)), opened.last(CELLS)
            if place and (place >= cell or tag in BEYOND_CELLS):
                opened.close(place)
            elif tag == "br" and not cell:
                stack[-1].children.append(Node("br", {}))
            continue
        if tag == "html" and len(stack) > 1:
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            opened.close(len(stack) - 1)
        if tag in IMPLIED:
            opened.close_first(*IMPLIED[tag])
        if tag in CLOSES_P:
            opened.close_first(frozenset(("p",)), frozenset(("table", "td", "th", "button", "caption")))
        if tag == "td" or tag == "th":
            if stack[-1].tag in ("table", *SECTIONS):
                row = Node("tr", {})
                stack[-1].children.append(row)
                opened.push(row)
        node = Node(tag, attributes_of(match[3]) if match[3].strip(" /\n\t") else {})
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            node.children.append(page[at : stop.start() if stop else size])
            at = page.find(">", stop.start()) + 1 or size if stop else size
        elif tag not in VOID and not (match[3].endswith("/") and tag in ("path", "circle", "rect", "use")):
            opened.push(node)
    return root


def is_hidden(node: Node) -> bool:
    a = node.attributes
    if node.tag in INVISIBLE:
        return not (node.tag == "dialog" and "open" in a)
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or (node.tag == "input" and a.get("type") == "hidden"):
        return True
    return "style" in a and HIDDEN_STYLE.search(a["style"]) is not None


class Page:
    """Collects lines; ``gap`` is the number of line breaks due before the next text."""

    __slots__ = ("lines", "line", "gap", "space", "indents", "marker")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space = 0, False
        self.indents: list[str] = []
        self.marker: str | None = None

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def start(self) -> None:
        if not self.line:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            indent = "".join(self.indents[-INDENTS:])
            if self.marker is not None:
                indent = indent[: max(0, len(indent) - len(self.marker))] + self.marker
                self.marker = None
            self.line.append(indent)
            self.space = False

    def inline(self, text: str) -> None:
        words = SPACE.sub(" ", text)
        if words == " ":
            self.space = bool(self.line)
            return
        if words[0] == " ":
            words = words[1:]
            self.space = bool(self.line)
        after = words[-1] == " "
        if not self.line:
            self.start()
        elif self.space:
            self.line.append(" ")
        self.line.append(words[:-1] if after else words)
        self.space = after

    def verbatim(self, text: str) -> None:
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                if not self.line:
                    self.start()
                self.lines.append("".join(self.line).rstrip())
                self.line = []
            if part:
                self.start()
                self.line.append(part)

    def preset(self, lines: list[str]) -> None:
        """Whole lines, as of a table."""
        for text in lines:
            self.start()
            self.line.append(text)
            self.end_line()

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def number_of(attributes: dict[str, str], name: str, default: int, low: int, high: int) -> int:
    try:
        return min(max(int(attributes.get(name, default)), low), high)
    except ValueError:
        return default


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of a table: cells are lists of lines with a number of columns."""
    widths: list[int] = []
    for row in rows:
        column = 0
        for lines, span in row:
            widths += [0] * (column + span - len(widths))
            if span == 1:
                widths[column] = max([widths[column], *map(len, lines)])
            column += span
    for row in rows:
        column = 0
        for lines, span in row:
            if span > 1:
                room = sum(widths[column : column + span]) + 2 * (span - 1)
                widths[column + span - 1] += max([0, *(len(x) - room for x in lines)])
            column += span
    out = []
    for row in rows:
        for i in range(max([1, *(len(lines) for lines, _ in row)])):
            parts, column = [], 0
            for lines, span in row:
                room = sum(widths[column : column + span]) + 2 * (span - 1)
                parts.append((lines[i] if i < len(lines) else "").ljust(min(room, WIDE)))
                column += span
            out.append("  ".join(parts).rstrip())
    return [x for x in out if x]


def render(root: Node) -> str:
    """Visible text of a tree, walked with a stack of its own."""
    page = Page()
    pages: list[Page] = [page]
    tables: list[list[list[tuple[list[str], int]]]] = []
    counters: list[int | None] = []
    # (node, visible, pre) to enter, or (leave function,) to call
    todo: list[tuple] = [(root, True, False)]

    def push_children(node: Node, visible: bool, pre: bool) -> None:
        for child in reversed(node.children):
            todo.append((child, visible, pre))

    while todo:
        item = todo.pop()
        if len(item) == 1:
            item[0]()
            continue
        node, visible, pre = item
        page = pages[-1]
        if isinstance(node, str):
            if visible and node:
                page.verbatim(node) if pre else page.inline(node)
            continue
        if is_hidden(node):
            continue
        tag = node.tag
        style = node.attributes.get("style")
        if style and (found := VISIBILITY_STYLE.search(style)):
            visible = found[1].lower() == "visible"
        if tag == "br":
            if visible:
                page.start()
                page.end_line() if page.line != [""] else page.lines.append("")
                page.line = []
            continue
        if tag == "hr":
            page.block(2)
            continue
        if tag == "details" and "open" not in node.attributes:
            shown = Node("div", {})
            shown.children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo.append((shown, visible, pre))
            continue
        if tag == "table" and len(tables) < TABLES:
            page.block(2)
            tables.append([])

            def end_table(page: Page = page) -> None:
                lines = aligned(tables.pop())
                page.block(2)
                page.preset(lines)
                page.block(2)

            todo.append((end_table,))
            push_children(node, visible, pre)
            continue
        if tables and tag == "tr":
            tables[-1].append([])
            push_children(node, visible, pre)
            continue
        if tables and tag in CELLS:
            if not tables[-1]:
                tables[-1].append([])
            row, span = tables[-1][-1], number_of(node.attributes, "colspan", 1, 1, 1000)
            pages.append(Page())

            def end_cell(row: list = row, span: int = span) -> None:
                row.append((pages.pop().text().split("\n"), span))

            todo.append((end_cell,))
            push_children(node, visible, pre)
            continue
        if tag in LISTS:
            page.block(2 if not counters else 1)
            counters.append(number_of(node.attributes, "start", 1, -(10**9), 10**9) if tag == "ol" else None)
            depth = len(counters)

            def end_list(page: Page = page, depth: int = depth) -> None:
                del counters[depth - 1 :]
                page.block(2 if not counters else 1)

            todo.append((end_list,))
            push_children(node, visible, pre)
            continue
        if tag == "li":
            page.block(1)
            mark = "- "
            if counters and counters[-1] is not None:
                value = number_of(node.attributes, "value", counters[-1], -(10**9), 10**9)
                mark, counters[-1] = f"{value}. ", value + 1
            page.indents.append(" " * len(mark))
            page.marker = mark

            def end_item(page: Page = page) -> None:
                page.indents.pop()
                page.marker = None
                page.block(1)

            todo.append((end_item,))
            push_children(node, visible, pre)
            continue
        if tag in BLOCKS:
            gap = 2 if tag in SET_OFF else 1
            page.block(gap)
            if tag == "dd" or tag == "blockquote":
                page.indents.append("  ")

            def end_block(page: Page = page, gap: int = gap, indented: bool = tag in ("dd", "blockquote")) -> None:
                page.block(gap)
                if indented:
                    page.indents.pop()

            todo.append((end_block,))
            push_children(node, visible, pre or tag == "pre")
            continue
        push_children(node, visible, pre)
    return pages[0].text()


def page_text(page: str | None) -> str:
    return render(parse(page.replace("\x00", ""))) if page else ""


def rendered(pages: DataFrame) -> DataFrame:
    """All columns of the pages, and ``text``; an input column of that name is replaced."""
    small_batches(pages.sparkSession)
    rows = pages.select("html", F.struct(*pages.columns).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "text": pa.array(texts, pa.string())})

    out = rows.mapInArrow(scan, f"row {kind}, text string")
    return out.select(*(F.col("row").getField(c).alias(c) for c in pages.columns if c != "text"), "text")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


QUERIES = {"op10_html_text": op10_html_text}
SQL: dict[str, str] = {}
