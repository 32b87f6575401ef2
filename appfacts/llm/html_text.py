"""Visible text of HTML pages with their layout.

A page becomes a tree (unclosed and implied tags are completed as browsers do), invisible parts are left out, and the
rest is laid out as text: blocks stand on lines of their own with blank lines between paragraphs, list items have
bullets or numbers and are indented by depth, preformatted text keeps its spaces, and table cells are aligned in columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from appfacts.llm.tables import map_batches

#: Elements without content, with raw content, and those whose content isn't shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
HIDDEN = frozenset(
    "head script style template noscript iframe object audio video canvas datalist title meta link noembed"
    " noframes area param source track desc metadata defs symbol clippath mask".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr caption"
    " tbody thead tfoot".split()
)
#: Blocks with a blank line before and behind.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset menu dir".split())

#: An open element that a start tag ends (by the tag).
_PARAGRAPH_ENDS = BLOCK - {"body", "html", "tr", "tbody", "thead", "tfoot", "caption", "li", "dt", "dd"}
_SELF_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: An end tag doesn't reach beyond these.
_SCOPE = frozenset("table td th caption html template".split())

_TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<decl>[!?][^>]*)(?:>|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|/[^a-zA-Z>][^>]*(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SELECTOR = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z", re.I)
#: What a button without a caption of its own shows.
CAPTIONS = {"submit": "Submit", "reset": "Reset", "button": ""}


class Element:
    __slots__ = ("attrs", "cells", "content", "name", "rows", "shown", "visibility")

    def __init__(self, name: str, attrs: str):
        self.name, self.attrs = name, attrs
        self.content: list[Element | str] = []
        # Set by ``mark``: whether it is laid out, what it says on visibility, and whether rows or cells are shown inside.
        self.shown, self.visibility, self.rows, self.cells = True, "", False, False

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, value in _ATTR.findall(self.attrs):
            quoted = value[:1] in "\"'" and value
            out.setdefault(name.lower(), unescape(value.strip(value[0]) if quoted else value))
        return out


class Open:
    """The elements that are open, innermost last, with how many there are of each name."""

    def __init__(self, root: Element):
        self.all: list[Element] = [root]
        self.count: dict[str, int] = {}

    def push(self, e: Element) -> None:
        self.all.append(e)
        self.count[e.name] = self.count.get(e.name, 0) + 1

    def cut(self, at: int) -> None:
        for e in self.all[at:]:
            self.count[e.name] -= 1
        del self.all[at:]

    def has(self, names) -> bool:
        return any(self.count.get(n) for n in names)

    def close(self, names, barrier) -> None:
        """End the outermost of the named elements that no barrier parts from here."""
        if not self.has(names):
            return
        for i in range(len(self.all) - 1, 0, -1):
            if self.all[i].name in names:
                while i > 1 and self.all[i - 1].name in names:
                    i -= 1
                self.cut(i)
                return
            if self.all[i].name in barrier:
                return


def parse(page: str) -> Element:
    """The tree of a page, with the ends that its author left out."""
    root = Element("html", "")
    tree = Open(root)
    open_ = tree.all

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        if lt > at:
            _text(open_, page[at:lt])
        if lt == len(page):
            break
        m = _TAG.match(page, lt)
        if not m:
            _text(open_, "<")
            at = lt + 1
            continue
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name == "br":
                open_[-1].content.append(Element("br", ""))
            elif name == "p" and not tree.has(("p",)):
                open_[-1].content.append(Element("p", ""))
            elif tree.has((name,)):
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].name == name:
                        tree.cut(i)
                        break
                    if open_[i].name in _SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        if name in ("html", "body"):
            root.attrs = root.attrs or m["attrs"]
            if name == "body":
                tree.cut(1)
                root.content.append(body := Element("body", m["attrs"]))
                tree.push(body)
            continue
        if name in _PARAGRAPH_ENDS:
            tree.close({"p"}, _SCOPE)
            if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", open_[-1].name):
                tree.cut(len(open_) - 1)
        if name in _SELF_ENDS:
            if name in ("li", "dt", "dd"):
                tree.close({"p"}, _SCOPE | {"li", "dt", "dd"})
            tree.close(*_SELF_ENDS[name])
        if name in ("td", "th") and open_[-1].name in ("table", "tbody", "thead", "tfoot"):
            row = Element("tr", "")
            open_[-1].content.append(row)
            tree.push(row)
        element = Element(name, m["attrs"])
        open_[-1].content.append(element)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else len(page)
            element.content.append(unescape(page[at:stop]) if name == "textarea" else page[at:stop])
            gt = page.find(">", stop)
            at = gt + 1 if end and gt >= 0 else len(page)
        elif name not in VOID:
            tree.push(element)
    return root


def _text(open_: list[Element], text: str) -> None:
    open_[-1].content.append(unescape(text))


class Sheet:
    """Rules of the page's own style sheets on display and visibility, for selectors of one element.

    A selector is a name, classes and ids; rules for several elements (descendants, states) and those inside other media
    than the screen have no effect here.
    """

    def __init__(self, text: str):
        self.rules: list[tuple[tuple, str, set[str], str, dict[str, str]]] = []
        text, at = _COMMENT.sub(" ", text), 0
        while (brace := text.find("{", at)) >= 0:
            head, depth, end = text[at:brace].rpartition(";")[2].strip(), 1, brace + 1
            while depth and end < len(text):
                m = re.compile(r"[{}]").search(text, end)
                end = m.end() if m else len(text)
                depth += 0 if not m else 1 if m[0] == "{" else -1
            body = text[brace + 1 : end - 1]
            at = end
            if head.startswith("@"):
                if re.match(r"@media\s+(all|screen)\s*\Z", head, re.I):
                    self.rules += Sheet(body).rules
                continue
            said = {k.lower(): v.lower() for k, v in _STYLE.findall(body)}
            for selector in head.split(",") if said else []:
                if (m := _SELECTOR.match(selector.strip())) and m[0]:
                    marks = re.findall(r"[.#][\w-]+", m[2])
                    ids = [x[1:] for x in marks if x[0] == "#"]
                    name = (m[1] or "*").lower()
                    weight = (len(ids), len(marks) - len(ids), name != "*")
                    if len(set(ids)) < 2:
                        self.rules.append((weight, name, {x[1:] for x in marks if x[0] == "."}, "".join(ids[:1]), said))
        self.rules.sort(key=lambda r: r[0])

    def said(self, e: Element, a: dict[str, str]) -> dict[str, str]:
        out: dict[str, str] = {}
        classes, id_ = set(a.get("class", "").split()), a.get("id", "")
        for _, name, of, own, said in self.rules:
            if name in ("*", e.name) and of <= classes and (not own or own == id_):
                out |= said
        return out


def mark(root: Element) -> None:
    """Set on every element whether it is laid out, and what rows and cells it holds.

    Hidden elements, closed dialogs, all but the summary of closed details, and those with ``display: none`` aren't laid
    out; ``visibility`` is inherited, and may be taken back further in.
    """
    every, at = [root], 0
    while at < len(every):
        every += [x for x in every[at].content if isinstance(x, Element)]
        at += 1
    sheet = Sheet("\n".join(x for e in every if e.name == "style" for x in e.content if isinstance(x, str)))
    for e in every:
        a = e.attributes() if e.attrs and e.attrs.strip(" /") else {}
        said = (sheet.said(e, a) if sheet.rules else {}) | {k.lower(): v.lower() for k, v in _STYLE.findall(a.get("style", ""))}
        e.visibility = said.get("visibility", "")
        e.shown = (
            e.name not in HIDDEN and "hidden" not in a and said.get("display") != "none"
            and not (e.name == "dialog" and "open" not in a)
            and not (e.name == "input" and a.get("type", "").lower() not in CAPTIONS)
        )
        if e.name == "details" and "open" not in a:
            e.content = next(([x] for x in e.content if isinstance(x, Element) and x.name == "summary"), [])
    for e in reversed(every):  # what stands inside comes later, so it is done before
        inside = [x for x in e.content if isinstance(x, Element) and x.name != "table" and x.shown]
        e.rows = any(x.name == "tr" or x.rows for x in inside)
        e.cells = any(x.name in ("td", "th") or x.cells for x in inside)


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Layout:
    """Lines of text with pending spaces and blank lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indent = ""
        self.mark = ""
        self.space = False
        self.blank = False
        self.hidden = False

    def word(self, text: str) -> None:
        """Inline text, spaces already collapsed."""
        if self.hidden:
            return
        if text.startswith(" "):
            self.space, text = True, text[1:]
        if not text:
            return
        trailing = text.endswith(" ")
        if self.space and self.parts:
            self.parts.append(" ")
        self.parts.append(text[:-1] if trailing else text)
        self.space = trailing

    def line(self) -> None:
        """End the line, if one has begun."""
        if self.parts:
            self._put("".join(self.parts))
            self.parts = []
        self.space = False

    def _put(self, text: str) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        lead = self.indent[: max(0, len(self.indent) - len(self.mark))] + self.mark if self.mark else self.indent
        self.mark = ""
        self.lines.append((lead + text).rstrip())

    def gap(self) -> None:
        self.line()
        self.blank = True

    def hard_break(self) -> None:
        if self.parts:
            self.line()
        elif self.lines and not self.blank:
            self.blank = True

    def raw(self, text: str) -> None:
        self.line()
        if self.hidden:
            return
        for row in text.strip("\n").split("\n"):
            self._put(row.rstrip("\r"))

    def text(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def render(root: Element) -> str:
    mark(root)
    out = Layout()
    _run(_content(root, out, False, []))
    return out.text()


def _run(task: Iterator) -> None:
    """Run a task that yields the tasks it waits for: an explicit stack, so that any depth of nesting works."""
    stack = [task]
    while stack:
        inner = next(stack[-1], None)
        stack.append(inner) if inner is not None else stack.pop()


def _content(e: Element, out: Layout, pre: bool, lists: list) -> Iterator:
    for x in e.content:
        if isinstance(x, str):
            out.raw(x) if pre and "\n" in x else out.word(x if pre else _SPACES.sub(" ", x))
        elif x.shown:
            was = out.hidden
            out.hidden = x.visibility != "visible" if x.visibility in ("hidden", "collapse", "visible") else was
            yield _element(x, out, pre, lists)
            out.hidden = was


def _apart(text: str, out: Layout) -> None:
    """A caption with spaces around."""
    out.word(" ")
    out.word(_SPACES.sub(" ", text).strip())
    out.word(" ")


def _element(e: Element, out: Layout, pre: bool, lists: list) -> Iterator:
    name = e.name
    if name == "br":
        out.hard_break()
    elif name == "hr":
        out.gap()
        out.raw("---")
        out.gap()
    elif name == "img":
        if alt := e.attributes().get("alt", "").strip():
            out.word(_SPACES.sub(" ", alt))
    elif name == "table":
        out.gap()
        yield _table(e, out, lists)
        out.gap()
    elif name in ("ul", "ol", "menu", "dir"):
        out.line() if lists else out.gap()
        start = e.attributes().get("start", "1") if name == "ol" else "1"
        inner = [[name, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1]]
        yield _content(e, out, pre, inner)
        out.line() if lists else out.gap()
    elif name == "li":
        out.line()
        kind = lists[-1] if lists else ["ul", 1]
        mark = "- "
        if kind[0] == "ol":
            mark = f"{kind[1]}. "
            kind[1] += 1
        was, out.indent, out.mark = out.indent, out.indent + " " * len(mark), mark
        yield _content(e, out, pre, lists)
        out.line()
        out.indent, out.mark = was, ""
    elif name in ("dd", "blockquote"):
        out.line() if name == "dd" else out.gap()
        was, out.indent = out.indent, out.indent + "  "
        yield _content(e, out, pre, lists)
        out.line() if name == "dd" else out.gap()
        out.indent = was
    elif name in BLOCK:
        spaced = name in SPACED
        out.gap() if spaced else out.line()
        yield _content(e, out, pre or name == "pre", lists)
        out.gap() if spaced else out.line()
    elif name == "input":
        a = e.attributes()
        _apart(a.get("value", CAPTIONS[a["type"].lower()]), out)
    elif name in ("option", "optgroup"):
        label = e.attributes().get("label", "") if e.attrs else ""
        _apart(label, out)
        if name == "optgroup" or not label:
            yield _content(e, out, pre, lists)
        out.word(" ")
    elif name == "textarea":
        yield _content(e, out, True, lists)
    elif name == "semantics":  # of a formula: its annotations aren't shown
        e.content = [x for x in e.content if isinstance(x, str) or not x.name.startswith("annotation")]
        yield _content(e, out, pre, lists)
    elif name in ("td", "th"):  # outside a table
        yield _content(e, out, pre, lists)
        out.word(" ")
    else:
        yield _content(e, out, pre, lists)


_SECTIONS = frozenset(("tbody", "thead", "tfoot", "colgroup"))


_ROW, _CELL = frozenset(("tr",)), frozenset(("td", "th"))


def _parts(e: Element, names: frozenset[str], hidden: bool) -> list[tuple[bool, Element | str, bool]]:
    """What a table, section or row holds in order: (True, an element with one of the names) or (False, stray content),
    and whether it is hidden.

    Elements between, such as a form around cells, are looked through; those without such a part inside stay whole.
    """
    out: list[tuple[bool, Element | str, bool]] = []
    stack = [(iter(e.content), hidden)]
    while stack:
        content, hidden = stack[-1]
        x = next(content, None)
        if x is None:
            stack.pop()
        elif isinstance(x, str):
            out.append((False, x, hidden))
        elif x.shown:
            own = x.visibility != "visible" if x.visibility in ("hidden", "collapse", "visible") else hidden
            if x.name in names:
                out.append((True, x, own))
            elif x.name != "table" and (x.name in _SECTIONS or (x.rows and "tr" in names) or (x.cells and "td" in names)):
                stack.append((iter(x.content), own))
            else:
                out.append((False, x, own))
    return out


def _rows(e: Element, hidden: bool) -> tuple[list[list[tuple[Element, bool]]], list[tuple[Element | str, bool]]]:
    """(cells of each row, stray content of the table and its rows), each with whether it is hidden.  Cells outside rows
    make a row."""
    rows: list[list[tuple[Element, bool]]] = []
    stray: list[tuple[Element | str, bool]] = []
    loose = False
    for wanted, x, unseen in _parts(e, _ROW | _CELL, hidden):
        if not wanted:
            stray.append((x, unseen))
        elif x.name in _CELL:
            if not loose:
                rows.append([])
            rows[-1].append((x, unseen))
            loose = True
        else:
            inner = _parts(x, _CELL, unseen)
            rows.append([(y, no) for cell, y, no in inner if cell])
            stray += [(y, no) for cell, y, no in inner if not cell]
            loose = False
    return rows, stray


def _number(value: str | None) -> int:
    return max(1, min(int(value), 1000)) if value and re.fullmatch(r"\d{1,6}", value) else 1


def _table(e: Element, out: Layout, lists: list) -> Iterator:
    """Cells in columns as wide as their widest cell of one column; a cell's further lines stand below its first."""
    was = out.hidden
    rows, stray = _rows(e, was)
    for x, out.hidden in stray:  # caption, and what the page misplaced into the table
        if isinstance(x, str):
            out.word(_SPACES.sub(" ", x))
        else:
            out.line()
            yield _element(x, out, False, lists)
            out.line()
    out.line()
    grid: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines)
    taken: dict[int, int] = {}  # column: rows that a cell above still takes
    for cells in rows:
        row, column = [], 0
        for x, unseen in cells:
            while taken.get(column, 0):
                column += 1
            a = x.attributes() if x.attrs else {}
            span, down = _number(a.get("colspan")), _number(a.get("rowspan"))
            cell = Layout()
            cell.hidden = unseen
            yield _content(x, cell, False, [])
            row.append((column, span, cell.text().split("\n")))
            for c in range(column, column + span):
                taken[c] = max(taken.get(c, 0), down)
            column += span
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        grid.append(row)
    out.hidden = False  # cells know by themselves
    widths: dict[int, int] = {}
    for row in grid:
        for column, span, lines in row:
            if span == 1:
                widths[column] = max(widths.get(column, 0), max(map(width, lines)))
    starts, total = {}, 0
    for column in range(max(widths, default=-1) + 1):
        starts[column] = total
        total += widths.get(column, 0) + (2 if widths.get(column, 0) else 0)
    for row in grid:
        for n in range(max((len(c[2]) for c in row), default=0)):
            line, used = [], 0
            for column, _, lines in row:
                if n < len(lines) and lines[n]:
                    lead = max(starts.get(column, total) - used, 2 if used else 0)
                    line.append(" " * lead + lines[n])
                    used += lead + width(lines[n])
            if line:
                out.raw("".join(line))
    out.hidden = was


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and n_lines of the visible text of every row; null and empty pages have empty text.

    Repeated rows give repeated rows; other columns are not read.  A page is read whole, however long and deeply nested;
    an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [page_text(h).encode("utf-8", "replace").decode() for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
            ],
            names=["page_id", "text", "n_chars", "n_lines"],
        )

    return map_batches(pages.select("page_id", "html"), run, "page_id bigint, text string, n_chars bigint, n_lines bigint")
