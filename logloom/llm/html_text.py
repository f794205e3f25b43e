"""Operator 2: HTML to text, by a tree builder and a layout-aware renderer.

The builder makes a tree with implied tags (an open paragraph ends before a block, a cell
gets its row, a list item ends the one before). The renderer walks it with
visibility rules and emits all visible text: blocks on lines of their own with blank
lines where margins would be, lists with bullets or numbers, tables with aligned cells, labels of drawings.
What is hidden by attributes and by an element's own style is left out; style sheets aren't read.
Elements may nest as deep as they like: the renderer keeps its own stack of steps.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import short_batches, table


def names(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Element classes of HTML.
VOID = names("area base br col embed hr img input link meta param source track wbr")
RAW = names("script style xmp iframe noembed noframes noscript template")
TEXT_ONLY = names("title textarea")
UNSEEN = names("head script style title template noscript iframe noembed noframes datalist audio video object canvas colgroup defs desc metadata symbol clippath marker")
SPACED = names("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset menu")
BLOCK = SPACED | names("html body address article aside dd details dialog div dt footer form header hgroup legend li main nav optgroup option search section summary caption tr td th thead tbody tfoot center figcaption")
ENDS_PARAGRAPH = BLOCK - names("html body td th tr thead tbody tfoot caption option optgroup legend")
#: Which open elements a start tag closes, and which elements bound the search for them.
CLOSES = {
    "li": (names("li"), names("ul ol menu")),
    "dt": (names("dt dd"), names("dl")),
    "dd": (names("dt dd"), names("dl")),
    "option": (names("option"), names("select datalist optgroup")),
    "optgroup": (names("option optgroup"), names("select")),
    "tr": (names("tr td th caption"), names("table")),
    "td": (names("td th caption"), names("table tr")),
    "th": (names("td th caption"), names("table tr")),
    "thead": (names("thead tbody tfoot tr td th caption"), names("table")),
    "tbody": (names("thead tbody tfoot tr td th caption"), names("table")),
    "tfoot": (names("thead tbody tfoot tr td th caption"), names("table")),
    "body": (names("head"), names("html")),
}
#: What an open head can hold; any other start tag or text ends it.
HEAD_CONTENT = names("head title meta link base basefont bgsound style script template noscript")
WALLS = names("table td th caption html")
SECTIONS = names("thead tbody tfoot")

#: Lists, quotations and tables inside one another that are indented, marked and aligned. What
#: lies deeper keeps its visibility and its line breaks and stands at the last indentation.
LEVELS = 24
#: Blanks that a table may take to align its cells: so many for each of its characters, and so
#: many besides. A table that needs more (a page laid out by a table) has two blanks between cells.
BLANKS_EACH, BLANKS_LEAST = 8, 4000
# Bounds that HTML sets on spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
DECLARATION = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*", re.I)
STYLE_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: What visibility may be; a declaration of anything else doesn't count.
VISIBILITY = names("visible hidden collapse inherit initial unset revert")
BLANKS = re.compile(r"[ \t\n\f\r]+")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def attributes_of(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text.rstrip(">")):
        found.setdefault(name.lower(), unescape(value.strip("\"'")))
    return found


class TreeBuilder:
    """Builds the element tree of one page; every text ends up in it."""

    def __init__(self) -> None:
        self.root = Element("html")
        self.open = [self.root]
        #: Open elements by tag, so that a tag that isn't open costs no walk.
        self.count = Counter(["html"])

    def cut(self, to: int) -> None:
        """End the open elements from place to on."""
        for element in self.open[to:]:
            self.count[element.tag] -= 1
        del self.open[to:]

    def text(self, content: str) -> None:
        if self.open[-1].tag == "head" and content.strip(" \t\n\f\r"):
            self.cut(len(self.open) - 1)
        if content:
            self.open[-1].children.append(unescape(content) if "&" in content else content)

    def close_until(self, tags: frozenset[str], walls: frozenset[str]) -> None:
        """End the outermost open element among tags that no wall hides, with all inside it."""
        left = sum(self.count[tag] for tag in tags)
        cut = 0
        for k in range(len(self.open) - 1, 0, -1):
            if not left:
                break
            tag = self.open[k].tag
            if tag in tags:
                cut, left = k, left - 1
            elif tag in walls:
                break
        if cut:
            self.cut(cut)

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        element = Element(tag, attributes)
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)
            self.count[tag] += 1

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "html":
            return
        if self.open[-1].tag == "head" and tag not in HEAD_CONTENT:
            self.cut(len(self.open) - 1)
        if tag in ENDS_PARAGRAPH:
            self.close_until(frozenset({"p"}), WALLS)
        if tag in CLOSES:
            self.close_until(*CLOSES[tag])
        if tag in ("td", "th") and self.open[-1].tag in SECTIONS | {"table"}:
            self.push("tr", {})
        self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "p" and not self.count["p"]:
            self.push("p", {})  # a lone end tag is an empty paragraph
        if not self.count[tag]:
            return
        if tag in ("table", "html", "body") or tag in CLOSES:
            walls = frozenset() if tag in ("html", "body") else frozenset({"table"}) - {tag}
        else:
            walls = WALLS
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self.cut(k)
                return
            if self.open[k].tag in walls:
                return


def tree(html: str) -> Element:
    """The element tree of a page. A broken tag at the end is dropped, as browsers do."""
    builder, at = TreeBuilder(), 0
    while found := MARKUP.search(html, at):
        builder.text(html[at : found.start()])
        at = found.end()
        if not found[2]:
            if found[0].startswith("<![CDATA["):
                builder.text(found[0][9:].removesuffix("]]>"))
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                builder.push("br", {})
            else:
                builder.end(tag)
            continue
        if not found[0].endswith(">"):
            continue
        builder.start(tag, attributes_of(found[3]) if len(found[3]) > 1 else {})
        if (tag in RAW or tag in TEXT_ONLY) and not found[0].endswith("/>"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])|\Z", re.I).search(html, at)
            if tag in TEXT_ONLY:
                builder.text(html[at : close.start()])
            at = close.start()
    builder.text(html[at:])
    return builder.root


def width(text: str) -> int:
    """Columns that a text takes: wide East Asian characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def declared(style: str) -> dict[str, str]:
    """display and visibility by a style attribute: of several declarations the last holds, an important one before others."""
    held: dict[str, tuple[bool, str]] = {}
    for part in STYLE_COMMENT.sub("", style).split(";"):
        if found := DECLARATION.fullmatch(part):
            name, value, important = found[1].lower(), found[2].lower(), bool(found[3])
            if (name == "display" or value in VISIBILITY) and important >= held.get(name, (False, ""))[0]:
                held[name] = important, value
    return {name: value for name, (_, value) in held.items()}


def state_of(element: Element, hidden: bool) -> tuple[bool, bool]:
    """Whether the element is out of the layout, and whether its own text is invisible."""
    attributes = element.attributes
    if element.tag in UNSEEN or "hidden" in attributes:
        return True, hidden
    if element.tag == "dialog" and "open" not in attributes:
        return True, hidden
    if element.tag == "input" and attributes.get("type", "").lower() == "hidden":
        return True, hidden
    if style := attributes.get("style"):
        held = declared(style)
        if held.get("display") == "none":
            return True, hidden
        if (own := held.get("visibility", "inherit")) not in ("inherit", "unset", "revert"):
            return False, own in ("hidden", "collapse")
    return False, hidden


#: A step of the renderer: it yields the steps it waits for and returns lines, if any.
Step = Generator["Step", "list[str] | None", "list[str] | None"]


def walked(step: Step) -> list[str] | None:
    """Run a step with all those it waits for, on a stack of its own."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


class Renderer:
    """Collects lines: inline text gathers in one until a block or a break ends it. In a
    tight one, as for list items, lists have no margin. level counts the layouts it lies in."""

    def __init__(self, level: int = 0, tight: bool = False) -> None:
        self.level, self.tight = level, tight
        self.lines: list[str] = []
        self.current: list[str] = []
        self.gap = False

    def flush(self) -> None:
        line = "".join(self.current).rstrip(" ")
        self.current = []
        if line.strip():
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(line)

    def margin(self) -> None:
        self.flush()
        self.gap = True

    def inline(self, text: str, preformatted: bool) -> None:
        if preformatted:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self.current.append(first)
            for line in more:
                self.hard_break()
                self.current.append(line)
            return
        text = BLANKS.sub(" ", text)
        if not self.current or self.current[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.current.append(text)

    def hard_break(self) -> None:
        if "".join(self.current).strip():
            self.flush()
        else:
            self.current = []
            if self.lines and not self.gap and self.lines[-1]:
                self.lines.append("")

    def extend(self, lines: list[str]) -> None:
        self.flush()
        if any(lines):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.extend(lines)

    def finished(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines

    def children(self, element: Element, hidden: bool, preformatted: bool) -> Step:
        for child in element.children:
            if isinstance(child, str):
                if not hidden:
                    self.inline(child, preformatted)
            else:
                yield self.element(child, hidden, preformatted)

    def element(self, element: Element, hidden: bool, preformatted: bool) -> Step:
        gone, hidden = state_of(element, hidden)
        tag = element.tag
        if gone:
            return
        deep = self.level >= LEVELS
        if tag == "br":
            self.hard_break()
        elif tag == "table" and not deep:
            self.margin()
            self.extend((yield table_lines(element, hidden, self.level + 1)))
            self.margin()
        elif tag in ("ul", "ol", "menu") and not deep:
            edge = self.flush if self.tight else self.margin
            edge()
            self.extend((yield list_lines(element, hidden, self.level + 1)))
            edge()
        elif tag == "details" and "open" not in element.attributes:
            self.flush()
            for child in element.children:
                if not isinstance(child, str) and child.tag == "summary":
                    yield self.element(child, hidden, preformatted)
                    break
            self.flush()
        elif tag in BLOCK or tag == "text":  # a label of a drawing
            edge = self.margin if tag in SPACED else self.flush
            edge()
            if tag in ("blockquote", "dd") and not deep:
                lines = yield rendered(element, hidden, self.level + 1)
                self.extend(["  " + line if line else line for line in lines])
            else:
                yield self.children(element, hidden, preformatted or tag == "pre")
            edge()
        elif tag == "q":
            if not hidden:
                self.inline('"', preformatted)
            yield self.children(element, hidden, preformatted)
            if not hidden:
                self.inline('"', preformatted)
        else:
            yield self.children(element, hidden, preformatted)


def rendered(element: Element, hidden: bool, level: int, tight: bool = False) -> Step:
    """The lines of an element's content, laid out on its own."""
    inner = Renderer(level, tight)
    yield inner.children(element, hidden, False)
    return inner.finished()


def lone(element: Element, hidden: bool, level: int) -> Step:
    """The lines of one element, laid out on its own."""
    inner = Renderer(level)
    yield inner.element(element, hidden, False)
    return inner.finished()


def list_lines(element: Element, hidden: bool, level: int) -> Step:
    """Items behind bullets or numbers, further lines of an item indented; an item without
    text still takes a number."""
    out: list[str] = []
    start = element.attributes.get("start", "")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in element.children:
        if isinstance(child, str):
            if not hidden and child.strip():
                out.append(BLANKS.sub(" ", child).strip())
            continue
        gone, unseen = state_of(child, hidden)
        if gone:
            continue
        if child.tag != "li":
            lines = yield lone(child, hidden, level)
            out.extend("  " + line if line else line for line in lines)
            continue
        value = child.attributes.get("value", "")
        if re.fullmatch(r"-?\d{1,9}", value):
            number = int(value)
        mark = f"{number}. " if element.tag == "ol" else "- "
        number += 1
        for k, line in enumerate((yield rendered(child, unseen, level, tight=True))):
            out.append((mark if k == 0 else " " * len(mark)) + line if line else line)
    return out


def rows_of(element: Element, hidden: bool) -> Iterator[tuple[Element, bool, int]]:
    """The visible rows of a table with whether their text is invisible and how many rows their
    section has left, sections opened up. Sections never hold sections: a start tag ends the open one."""
    seen = [(child, *state_of(child, hidden)) for child in element.children if not isinstance(child, str)]
    rows = [(child, unseen) for child, gone, unseen in seen if child.tag == "tr" and not gone]
    at = iter(rows)
    left = len(rows)
    for child, gone, unseen in seen:
        if gone:
            continue
        if child.tag == "tr":
            yield (*next(at), left)
            left -= 1
        elif child.tag in SECTIONS:
            yield from rows_of(child, unseen)


def span_of(cell: Element, name: str, most: int) -> int:
    """A span as HTML reads it: 1 if it is no number, at most what HTML allows; 0 rows are all."""
    value = cell.attributes.get(name, "1").strip()
    if not re.fullmatch(r"[0-9]+", value):
        return 1
    span = int(value) if len(value) < 9 else most
    return min(span or (most if name == "rowspan" else 1), most)


def stray_lines(element: Element, hidden: bool, level: int) -> Step:
    """What stands in a table or its visible sections outside rows."""
    out: list[str] = []
    for child in element.children:
        if isinstance(child, str):
            if not hidden and child.strip():
                out.append(BLANKS.sub(" ", child).strip())
        elif child.tag in SECTIONS:
            gone, unseen = state_of(child, hidden)
            if not gone:
                out.extend((yield stray_lines(child, unseen, level)))
        elif child.tag != "tr":
            out.extend((yield lone(child, hidden, level)))
    return out


class Columns:
    """Deals cells to columns: a cell that spans rows keeps its columns in the rows below."""

    def __init__(self) -> None:
        #: First column, end, and rows that are still taken, in order of columns.
        self.taken: list[tuple[int, int, int]] = []

    def row(self, cells: list[tuple[int, int]]) -> list[int]:
        """The first column of each of a row's cells (columns, rows)."""
        out, added, column, at = [], [], 0, 0
        for columns, rows in cells:
            while at < len(self.taken) and self.taken[at][0] <= column:
                column = max(column, self.taken[at][1])
                at += 1
            out.append(column)
            if rows > 1:
                added.append((column, column + columns, rows))
            column += columns
        merged: list[tuple[int, int, int]] = []
        for start, end, rows in sorted([*self.taken, *added]):
            if rows > 1:
                if merged and merged[-1][1] >= start and merged[-1][2] == rows - 1:
                    merged[-1] = (merged[-1][0], max(end, merged[-1][1]), rows - 1)
                else:
                    merged.append((start, end, rows - 1))
        self.taken = merged
        return out


def table_lines(element: Element, hidden: bool, level: int) -> Step:
    """Caption and stray content first, then rows whose cells start in the same columns."""
    out = yield stray_lines(element, hidden, level)
    grid: list[list[tuple[int, int, list[str]]]] = []
    columns = Columns()  # no span reaches beyond its section
    for row, unseen, left in rows_of(element, hidden):
        spans, contents = [], []
        for cell in row.children:
            if isinstance(cell, str):
                if not unseen and cell.strip():
                    spans.append((1, 1))
                    contents.append([BLANKS.sub(" ", cell).strip()])
                continue
            gone, own = state_of(cell, unseen)
            if gone:
                continue
            spans.append((span_of(cell, "colspan", MOST_COLUMNS), min(span_of(cell, "rowspan", MOST_ROWS), left)))
            contents.append((yield rendered(cell, own, level)))
        grid.append([(column, span, lines) for column, (span, _), lines in zip(columns.row(spans), spans, contents, strict=True)])
    if all(len(cells) <= 1 for cells in grid) and not any(cells[0][0] for cells in grid if cells):
        return out + [line for cells in grid for _, _, lines in cells for line in lines]
    return out + laid_out(grid)


def laid_out(grid: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """The lines of rows of cells (column, columns, lines), each cell from where its column starts."""
    widths: dict[int, int] = {}
    for cells in grid:
        for column, span, lines in cells:
            # Cells over several columns don't widen one.
            widths[column] = max(widths.get(column, 0), *(width(line) for line in lines), 0) if span == 1 else widths.get(column, 0)
    lefts, left = {}, 0
    for column in sorted(widths):
        lefts[column] = left
        left += widths[column] + 2 if widths[column] else 0
    text = sum(len(line) for cells in grid for _, _, lines in cells for line in lines)
    blanks = sum(max(lefts[c] for c, _, _ in cells) * max(len(lines) for _, _, lines in cells) for cells in grid if cells)
    aligned = blanks <= BLANKS_EACH * text + BLANKS_LEAST
    out = []
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, used = [], 0
            for column, _, lines in cells:
                if k < len(lines) and lines[k]:
                    least = 1 if line else 0
                    pad = max(lefts[column] - used, least) if aligned else 2 * least
                    line += [" " * pad, lines[k]]
                    used += pad + width(lines[k])
            if any(part.strip() for part in line):
                out.append("".join(line).rstrip())
    return out


def page_text(html: str) -> str:
    """All visible text of a page, laid out in lines."""
    return "\n".join(walked(rendered(tree(html), False, 0))).strip("\n")


def html_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Add the visible text of each page; rows and other columns stay.

    A null or empty page gives the empty text, repeated rows equal texts, an empty table
    an empty one; an existing column of the new name is replaced. Pages may be of any length and
    depth: hidden text is left out and visible text kept at every depth, in time about in
    proportion to the page; LEVELS and BLANKS_EACH bound the layout only.
    """
    short_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_at in batches:
            yield pd.Series([page_text(p or "") for p in pages_at], dtype=object)

    return pages.withColumn(into, text(F.col(html)))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages").select("page_id", "html")).select(
        "page_id", "text", F.length("text").cast("long").alias("n_chars")
    )
