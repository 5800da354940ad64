"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied end tags give start, text and end events in document order; a renderer keeps
a stack of open boxes and writes all visible text as a text browser would: blank lines around paragraphs and headings,
line breaks, list markers with indents, preformatted text as it stands, and tables with cells padded to columns, spans and
double-width letters included. Elements that are not rendered (scripts, styles, the head, a dialog or the body of a details
element that is not open), and those hidden by an attribute or by display: none, give nothing. What visibility hides may
show again further in.

What counts as visible besides: formulas, without their annotations; text elements and foreign content of drawings; of a
drop-down list the selected option, or else the first, of a list box all options and the labels of groups; what fields and
buttons have as their value, unless the field is a password or of a kind that shows no text; alternative texts of images.

Both work with explicit stacks, so nesting depth is bounded by memory only, and in time linear in the page, tables apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from unicodedata import combining, east_asian_width

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import prepare
from .shared import map_columns

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title template noscript iframe object audio video canvas datalist noembed noframes meta link base param source track area annotation annotation-xml".split())
#: Unseen inside a drawing, and kinds of fields whose value is no text on the page.
UNDRAWN = frozenset("defs symbol desc metadata clippath mask pattern marker filter lineargradient radialgradient".split())
NO_TEXT = frozenset("hidden checkbox radio password file image color range date time month week datetime-local".split())
BLOCK1 = frozenset("address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup html legend li main nav search section summary tr thead tbody tfoot caption option".split())
BLOCK2 = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl pre blockquote table figure hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_ONLY = frozenset("base link meta script style template title noscript".split())
#: An end tag is implied for these open elements by these start tags, up to an element that is a wall.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "caption": (frozenset(["caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
#: End tags do not reach beyond these.
WALLS = frozenset("table td th caption template html button object marquee applet".split())

# In a tag a quote delimits only straight after the = of an attribute; one that is never closed delimits nothing.
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|</?([a-zA-Z][^\s/>]*)((?>[\s/]+|=?[^\s/>=]+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)?|=)*+)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<(?![a-zA-Z!?/])", re.S)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_GONE = re.compile(r"(?<![-\w])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?<![-\w])visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Most columns and rows of a cell.
COLSPAN, ROWSPAN = 1000, 65534
_SPACE = re.compile(r"[ \t\r\n\f]+")


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind start, end or text; start and end nest."""
    stack: list[str] = []
    opened: dict[str, int] = {}
    at, n = 0, len(html)

    def close_to(k: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > k:
            name = stack.pop()
            opened[name] -= 1
            yield "end", name, ""

    def last(names: frozenset[str], walls: frozenset[str]) -> int:
        """Index of the innermost open one of names this side of any wall, or -1; the outermost that is still implied."""
        if not any(opened.get(x) for x in names):
            return -1
        found = -1
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in walls:
                break
            if stack[k] in names:
                found = k
        return found

    while at < n:
        m = _TOKEN.match(html, at)
        if m is None:  # the page ends inside a tag
            break
        at, token, name = m.end(), m[0], m[1]
        if name is None:
            if token[0] != "<" or token == "<":
                if opened.get("head") and token.strip():
                    yield from close_to(stack.index("head"))
                yield "text", unescape(token) if "&" in token else token, ""
            continue
        name = name.lower()
        if token[1] == "/":
            if name == "p" and not opened.get("p"):
                yield "start", "p", ""
                yield "end", "p", ""
            elif name == "br":
                yield "start", "br", ""
                yield "end", "br", ""
            elif opened.get(name) or name in HEADINGS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] == name or name in HEADINGS and stack[k] in HEADINGS:
                        yield from close_to(k)
                        break
                    if stack[k] in WALLS and name not in ("table", "body", "html", "tr", "thead", "tbody", "tfoot"):
                        break
            continue
        if name in ("html", "body", "head") and opened.get(name):
            continue
        if opened.get("head") and name not in HEAD_ONLY:
            yield from close_to(stack.index("head"))
        if name in CLOSES_P and opened.get("p"):
            k = last(frozenset(["p"]), WALLS)
            if k >= 0:
                yield from close_to(k)
        if name in HEADINGS and stack and stack[-1] in HEADINGS:
            yield from close_to(len(stack) - 1)
        if name in IMPLIED:
            k = last(*IMPLIED[name])
            if k >= 0:
                yield from close_to(k)
        if name in ("td", "th") and opened.get("table") and not (stack and stack[-1] == "tr"):
            k = last(frozenset(["tr"]), frozenset(["table"]))
            if k < 0:
                stack.append("tr")
                opened["tr"] = opened.get("tr", 0) + 1
                yield "start", "tr", ""
        yield "start", name, m[2]
        if name in VOID or m[2].endswith("/") and (opened.get("svg") or opened.get("math")):  # foreign elements may close themselves
            yield "end", name, ""
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body, at = (html[at : end.start()], end.end()) if end else (html[at:], n)
            yield "text", unescape(body) if name in ("title", "textarea") else body, ""
            yield "end", name, ""
        else:
            stack.append(name)
            opened[name] = opened.get(name, 0) + 1
    yield from close_to(0)


class Box:
    """Lines of text of a page or of a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.want = 0
        self.space = False
        self.indents: list[str] = []
        self.marker = ""

    def end_line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.want = max(self.want, gap)

    def open(self) -> None:
        """Before text: the blank line that is due, the indent and the marker."""
        if not self.now:
            if self.want == 2 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.want = 0
            indent = "".join(self.indents)
            if self.marker:
                indent = indent[: max(0, len(indent) - len(self.marker))] + self.marker
                self.marker = ""
            if indent:
                self.now.append(indent)
            self.space = False

    def text(self, s: str, keep: bool) -> None:
        if keep:
            for k, part in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                if k:
                    if self.now:
                        self.end_line()
                    else:
                        self.lines.append("")
                if part:
                    self.open()
                    self.now.append(part)
            return
        core = _SPACE.sub(" ", s)
        if core == " " or not core:
            self.space = self.space or bool(core and self.now)
            return
        lead = core[0] == " " or self.space
        if not self.now:
            lead = False
            self.open()
        self.now.append((" " if lead else "") + core.strip(" "))
        self.space = core[-1] == " "

    def line_break(self) -> None:
        if self.now:
            self.end_line()
        elif self.lines and self.want == 0:
            self.lines.append("")

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


def wide(s: str) -> int:
    """Columns that a text takes: two for a double-width letter, none for a combining mark."""
    return len(s) if s.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in s)


class Cell:
    """Lines of a table cell, and how many columns and rows it takes; no rows stand for all that are left."""

    def __init__(self, lines: list[str], columns: int = 1, rows: int = 1) -> None:
        self.lines, self.columns, self.rows, self.at = lines, columns, rows, 0


def place(rows: list[list[Cell]]) -> None:
    """Gives each cell its first column: the next that no cell from above takes."""
    busy: dict[int, int] = {}  # column: the last row that it is taken in
    for r, row in enumerate(rows):
        k = 0
        for cell in row:
            while busy.get(k, -1) >= r:
                k += 1
            cell.at = k
            if cell.rows != 1:
                for c in range(k, k + cell.columns):
                    busy[c] = r + (cell.rows or len(rows)) - 1
            k += cell.columns


def lay_out(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table: the lines of each cell in columns as wide as their longest line, two blanks apart.

    A cell over several columns widens the last of them if they are too narrow. A cell over several rows stands in its first.
    """
    place(rows)
    width = [0] * max((c.at + c.columns for row in rows for c in row), default=0)
    for cell in sorted((c for row in rows for c in row), key=lambda c: c.columns):
        need = max(map(wide, cell.lines), default=0)
        if need:
            have = sum(width[cell.at : cell.at + cell.columns]) + 2 * (cell.columns - 1)
            width[cell.at + cell.columns - 1] += max(0, need - have)
    starts = [0, *accumulate(w + 2 for w in width)]
    out = []
    for row in rows:
        for i in range(max((len(c.lines) for c in row), default=0)):
            line, at = [], 0
            for cell in row:
                if i < len(cell.lines) and cell.lines[i]:
                    line += [" " * (starts[cell.at] - at), cell.lines[i]]
                    at = starts[cell.at] + wide(cell.lines[i])
            out.append("".join(line).rstrip())
    return out


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTR.finditer(raw)))}


def _span(value: str, most: int, least: int) -> int:
    """A span attribute as a number; 1 if it is none."""
    value = value.strip()
    return max(least, min(most, int(value[:9]))) if value.isascii() and value.isdigit() else 1


class Element:
    """An open element that is rendered: whether visibility shows its text, whether it is a closed details element, and, in a
    drawing, whether it is part of it and whether its text is drawn."""

    def __init__(self, name: str, shown: bool, shut: bool = False, drawing: bool = False, drawn: bool = True) -> None:
        self.name, self.shown, self.shut, self.summary, self.drawing, self.drawn = name, shown, shut, False, drawing, drawn

    def inside(self, name: str, shown: bool, shut: bool) -> Element:
        """An element in this one."""
        if name == "svg":
            return Element(name, shown, shut, True, False)
        if self.drawing and name == "foreignobject":
            return Element(name, shown, shut)
        return Element(name, shown, shut, self.drawing, self.drawn or self.drawing and name == "text")


class Choice:
    """The options of an open drop-down list."""

    def __init__(self, depth: int) -> None:
        self.depth, self.labels, self.chosen = depth, [], -1

    def option(self, a: dict[str, str]) -> None:
        if "selected" in a:
            self.chosen = len(self.labels)
        self.labels.append([a.get("label", ""), ""])

    def text(self, text: str) -> None:
        if self.labels:
            self.labels[-1][1] += text

    def label(self) -> str:
        """What the closed list shows; the label of an option goes before its text."""
        given, text = self.labels[max(0, self.chosen)] if self.labels else ("", "")
        return given if given.strip() else text


def render(html: str | None) -> str | None:
    """The visible text of a page; null for a null, empty for a page that shows nothing."""
    if html is None:
        return None
    boxes = [Box()]
    spans: list[tuple[int, int]] = []
    tables: list[list[list[Cell]]] = []
    lists: list[int | None] = []
    pre = 0
    hidden: list[str] = []  # open elements from the outermost hidden one on
    path = [Element("", True)]
    choice: Choice | None = None
    for kind, name, raw in events(html):
        box, within = boxes[-1], path[-1]
        if kind == "text":
            if hidden or within.shut:
                continue
            if choice:
                choice.text(name)
            elif within.shown and within.drawn:
                box.text(name, pre > 0)
            continue
        if kind == "start":
            a = _attributes(raw) if raw and not raw.isspace() else {}
            first = within.shut and name == "summary" and not within.summary
            if first:
                within.summary = True
            style = a.get("style", "")
            if hidden or name in UNSEEN or "hidden" in a or within.drawing and name in UNDRAWN or within.shut and not first or name == "dialog" and "open" not in a or style and _GONE.search(style):
                hidden.append(name)
                continue
            shown = within.shown
            if style:
                for m in _VISIBILITY.finditer(style):
                    shown = m[1].lower() == "visible"
            path.append(within.inside(name, shown, name == "details" and "open" not in a))
            if choice:
                if name == "option":
                    choice.option(a)
                continue
            if name == "select" and "multiple" not in a and a.get("size", "1").strip() in ("", "0", "1"):
                choice = Choice(len(path))
                continue
            if name in BLOCK2:
                box.block(1 if name in ("ul", "ol", "menu", "dir") and lists else 2)
            elif name in BLOCK1:
                box.block(1)
            if within.drawing and name == "text":
                box.block(1)
            if name == "br":
                box.line_break()
            elif name == "input":
                if shown and a.get("type", "text").strip().lower() not in NO_TEXT and a.get("value", "").strip():
                    box.text(a["value"], False)
                elif shown and a.get("type", "").strip().lower() == "image" and a.get("alt", "").strip():
                    box.text(a["alt"], False)
            elif name == "optgroup":
                box.block(1)
                if shown and a.get("label", "").strip():
                    box.text(a["label"], False)
                box.block(1)
            elif name == "hr":
                if shown:
                    box.open()
                    box.now.append("---")
                box.block(2)
            elif name == "img":
                if shown and a.get("alt", "").strip():
                    box.text(a["alt"], False)
            elif name == "pre":
                pre += 1
            elif name in ("ul", "menu", "dir"):
                lists.append(None)
            elif name == "ol":
                start = a.get("start", "1").strip()
                lists.append(int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
            elif name == "li":
                mark = "* "
                if lists and lists[-1] is not None:
                    value = a.get("value", "").strip()
                    at = int(value) if re.fullmatch(r"-?\d{1,9}", value) else lists[-1]
                    mark, lists[-1] = f"{at}. ", at + 1
                box.indents.append(" " * len(mark))
                box.marker = mark
            elif name in ("blockquote", "dd"):
                box.indents.append("    ")
            elif name == "table":
                tables.append([])
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                boxes.append(Box())
                spans.append((_span(a.get("colspan", ""), COLSPAN, 1), _span(a.get("rowspan", ""), ROWSPAN, 0)))
            continue
        if hidden:
            hidden.pop()
            continue
        if choice:
            if len(path) == choice.depth:
                label, choice = choice.label(), None
                if within.shown and label.strip():
                    box.text(label, False)
            path.pop()
            continue
        path.pop()
        if path[-1].drawing and name == "text":
            box.block(1)
        if name == "pre":
            pre -= 1
        elif name in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
        elif name in ("li", "blockquote", "dd"):
            box.end_line()
            box.marker = ""
            if box.indents:
                box.indents.pop()
        elif name in ("td", "th") and tables and len(boxes) > 1:
            tables[-1][-1].append(Cell(boxes.pop().done(), *spans.pop()))
            box = boxes[-1]
        elif name == "table" and tables:
            rows = tables.pop()
            for line in lay_out(rows):
                box.open()
                box.now.append(line)
                box.end_line()
        if name in BLOCK2:
            box.block(1 if name in ("ul", "ol", "menu", "dir") and lists else 2)
        elif name in BLOCK1:
            box.block(1)
    return "\n".join(boxes[0].done())


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The table with a column of visible text. A null page gives null, an empty one an empty text; pages are read whole.

    A column of that name is replaced, others pass through, or only those named by keep. No rows give no rows.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() != out_col.lower()]
    work = lambda: lambda htmls: [[render(h) for h in htmls]]
    return map_columns(pages, [html_col], keep, StructType().add(out_col, "string"), work)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: page_id, url, text."""
    return extract_text(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
