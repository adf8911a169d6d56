"""HTML extraction by layout-aware rendering.

A tolerant tree builder keeps the stack of open elements, with the implied tags of HTML (an open paragraph ends before a
block, list items and table cells end each other, rows and bodies of tables come into being, text astray in a table
moves before it). What the tree says is visible is rendered as it is met: blocks apart by lines, paragraphs and
headings by blank ones, list items with bullets or numbers, preformatted text as it is, table cells in aligned columns,
over row and column spans and by the width that characters take.

The builder streams. It knows where on the stack each tag is open, so no search goes through the stack, and lines are
indented as they are written; only tables hold back what is in them. So time and memory are linear in the page, nesting
included: text more than DEEPEST levels in isn't indented further, tables more than DEEPEST_TABLE levels in show their
cells as blocks.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import col, map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("textarea title".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes datalist object audio video canvas title param source".split())
#: Parts of SVG and MathML that aren't rendered where they stand.
HIDDEN_IN = {"svg": frozenset("title desc metadata defs symbol clippath mask pattern marker".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
#: Elements of SVG that show their text; those of MathML whose parts stand apart; HTML within either.
SVG_TEXT = frozenset("text foreignobject".split())
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtr".split())
WITHIN = frozenset("foreignobject mi mo mn ms mtext".split())
#: Start tags of HTML that end an SVG or MathML element.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Elements before which an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt xmp".split())
BLOCK = ENDS_P | frozenset("body html caption legend optgroup option tr".split())
#: Blocks with blank lines around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre xmp table figure hr menu dir fieldset".split())
#: Open elements that a start tag ends, and those where the search for them stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "caption"), ("table",)), "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "caption": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
}
_TABLE_PARTS = frozenset("table tbody thead tfoot tr colgroup".split())
_BARRIERS = ("td", "th", "table", "caption", "html", "template")
_HEAD_TAGS = frozenset("base link meta title style script noscript template head html".split())
_LISTS = ("ul", "ol", "menu", "dir")
_CELLS = ("td", "th", "caption")

_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_COMMENT_END = re.compile(r"--!?>")
_NUMBER = re.compile(r"-?\d{1,9}")
_SPAN = re.compile(r"\d{1,6}")
#: Levels of lists and quotations that are indented, and of tables that are laid out in columns.
DEEPEST, DEEPEST_TABLE = 32, 8
#: Cells that aren't their row's last are wrapped at this width; single words and preformatted lines may widen a column
#: to LONGEST, and beyond that push the rest of their own line aside. Spans are as wide as HTML lets them be.
WIDEST, LONGEST, MOST_SPAN = 60, 200, 1000


def width(text: str) -> int:
    """The columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Frame:
    """Text being rendered: finished lines, the line being written, and the break that is due before more text.

    ``inside`` has what lines begin with: for each list item or quotation the first line's start (None once written) and
    that of the others.
    """

    __slots__ = ("lines", "line", "due", "space", "inside", "shallowest", "marks", "beyond")

    def __init__(self):
        self.lines, self.line, self.due, self.space = [], [], 0, False
        self.inside, self.shallowest, self.marks, self.beyond = [], 0, [], 0

    def enter(self, first: str, others: str) -> None:
        """Lines begin with this from now on."""
        if len(self.inside) < DEEPEST:
            self.inside.append([first, others])
        else:
            self.beyond += 1
            if first != others:
                self.marks.append(first)

    def leave(self) -> None:
        if self.beyond:
            self.beyond -= 1
            if not self.beyond:
                self.marks.clear()
        else:
            self.inside.pop()
            self.shallowest = min(self.shallowest, len(self.inside))

    def _start(self) -> str:
        out = []
        for entry in self.inside:
            out.append(entry[1] if entry[0] is None else entry[0])
            entry[0] = None
        out += self.marks
        self.marks.clear()
        self.shallowest = len(self.inside)
        return "".join(out)

    def brk(self, n: int) -> None:
        """At least n line ends before the next text (1: a new line, 2: a blank line between)."""
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.due, self.space = max(self.due, n), False

    def _begin(self) -> None:
        """A line is begun, if none is: blank lines that are due, then what lines begin with here."""
        if self.line:
            return
        if self.due and self.lines:
            blank = "".join(x[1] for x in self.inside[: self.shallowest] if x[0] is None).rstrip(" ")
            self.lines.extend([blank] * (self.due - 1))
        self.due = 0
        self.line.append(self._start())

    def write(self, text: str, pre: bool = False) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            if first:
                self._begin()
                self.line.append(first)
            for more in rest:
                self.end_line()
                if more:
                    self._begin()
                    self.line.append(more)
            return
        if not text:
            return
        text = _SPACES.sub(" ", text)
        lead = text[0] == " "
        text = text.lstrip(" ") if lead else text
        if lead and self.line:
            self.space = True
        if not text:
            return
        tail = text[-1] == " "
        inner = bool(self.line)
        self._begin()
        if self.space and inner:
            self.line.append(" ")
        self.line.append(text[:-1] if tail else text)
        self.space = tail

    def end_line(self) -> None:
        """End the line as it is, empty or not."""
        self._begin()
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space = [], False

    def put_lines(self, lines: list[str], space: int) -> None:
        """Lines that are laid out already, ``space`` line ends apart from the rest."""
        if not lines:
            return
        self.brk(space)
        for line in lines:
            self._begin()
            self.line.append(line)
            self.brk(0)
        self.due = space

    def text_lines(self) -> list[str]:
        self.brk(0)
        out = self.lines
        while out and not out[-1].strip():
            out.pop()
        first = next((i for i, x in enumerate(out) if x.strip()), 0)
        return out[first:]


class _Node:
    __slots__ = ("tag", "hidden", "mute", "pre", "frame", "extra")

    def __init__(self, tag, hidden, mute, pre, frame=None, extra=None):
        self.tag, self.hidden, self.mute, self.pre, self.frame, self.extra = tag, hidden, mute, pre, frame, extra


class Renderer:
    """Builds and renders one page: ``title`` and ``text`` afterwards."""

    def __init__(self, html: str):
        self.root = _Frame()
        self.stack = [_Node("html", False, False, False, self.root)]
        self.frames = [self.root]
        #: Where on the stack each tag is open, innermost last.
        self.open: dict[str, list[int]] = {"html": [0]}
        self.title, self.has_body = "", False
        self._parse(html)
        while len(self.stack) > 1:
            self._pop()
        self.text = "\n".join(self.root.text_lines())

    # -- tokens -----------------------------------------------------------------------------------------------

    def _parse(self, html: str) -> None:
        at, size, lower = 0, len(html), None
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                return
            if lt > at:
                self._text(html[at:lt])
            nxt = html[lt + 1 : lt + 2]
            if nxt == "!" or nxt == "?":
                at = self._skip(html, lt)
                if at < 0:
                    return
                continue
            closing = nxt == "/"
            m = _TAG.match(html, lt + 1 + closing)
            if not m:
                if closing:  # </ followed by no letter is a comment up to >
                    end = html.find(">", lt)
                    at = end + 1 if end >= 0 else size
                else:
                    self._text("<")
                    at = lt + 1
                continue
            tag, at = m.group().lower(), m.end()
            attrs: dict[str, str] = {}
            closed = False
            if html[at : at + 1] == ">":
                at += 1
            else:
                while True:
                    a = _ATTR.match(html, at)
                    if not a:
                        break
                    at = a.end()
                    if not closing:
                        attrs.setdefault(a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or "")
                end = html.find(">", at)
                if end < 0:
                    return
                closed = end > at and html[end - 1] == "/"
                at = end + 1
            if closing:
                self._end(tag)
                continue
            foreign = self._foreign()
            if foreign and tag in ENDS_FOREIGN:
                while self._foreign():
                    self._pop()
                foreign = None
            self._start(tag, attrs)
            if closed and (foreign or tag in ("svg", "math")):
                if self.stack[-1].tag == tag:
                    self._pop()
                continue
            if tag == "plaintext" and not foreign:  # nothing after it is a tag
                self._raw(html[at:])
                return
            if tag in RAW or tag in ESCAPABLE:
                lower = html.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at) if len(lower) == size else html.find(f"</{tag}", at)
                body = html[at : end if end >= 0 else size]
                if tag in ESCAPABLE:
                    self._text(body)
                elif tag == "xmp":
                    self._raw(body)
                if tag == "title" and not foreign and not self.title:
                    self.title = _SPACES.sub(" ", unescape(body)).strip()
                at = size if end < 0 else end
                if end < 0:
                    self._end(tag)

    @staticmethod
    def _skip(html: str, lt: int) -> int:
        """Where a comment, doctype or instruction ends; -1 if it doesn't."""
        if not html.startswith("<!--", lt):
            end = html.find(">", lt)
            return end + 1 if end >= 0 else -1
        for short in ("<!-->", "<!--->"):
            if html.startswith(short, lt):
                return lt + len(short)
        m = _COMMENT_END.search(html, lt + 4)
        return m.end() if m else -1

    def _raw(self, body: str) -> None:
        if not self.stack[-1].hidden and not self.stack[-1].mute:
            self.frames[-1].write(body, True)

    # -- tree -------------------------------------------------------------------------------------------------

    def _at(self, *tags: str) -> int:
        """Where on the stack the innermost open element of these tags is; -1 if none is open."""
        return max((x[-1] for t in tags if (x := self.open.get(t))), default=-1)

    def _foreign(self) -> str | None:
        """The SVG or MathML element that the next tag belongs to."""
        at = self._at("svg", "math")
        return self.stack[at].tag if at > self._at(*WITHIN) else None

    def _unpainted(self) -> bool:
        """Whether text here stands in an SVG element outside its text elements."""
        return self._at("svg") > self._at(*SVG_TEXT)

    def _pop_to(self, at: int) -> None:
        """End the element at a place of the stack and all in it."""
        while len(self.stack) > at:
            self._pop()

    def _close_to(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """End the innermost open element of ``tags`` and all in it, unless one of ``stops`` is nearer."""
        at = self._at(*tags)
        if at > 0 and at >= self._at(*stops):
            self._pop_to(at)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if tag == "body" and not self.has_body:
                self._close_to(("head",), ())
                self.has_body, root = True, self.stack[0]
                root.hidden, root.mute = self._hidden(attrs), self._mute(attrs.get("style", ""), False)
            return
        if tag == "head" and self._at("head") >= 0:
            return
        if self.stack[-1].tag == "head" and tag not in _HEAD_TAGS:
            self._pop()  # the body is implied
        if tag in ENDS_P:
            self._close_to(("p",), _BARRIERS)
        if tag in ENDS:
            tags, stops = ENDS[tag]
            self._close_to(tags, stops)
        if tag in ("td", "th", "tr") and self._at("table") >= 0:
            part = self._at(*_TABLE_PARTS)
            self._pop_to(part + 1)  # back to the innermost open part of the table
            if self.stack[-1].tag == "table":
                self._push("tbody", {})
            if tag != "tr" and self.stack[-1].tag != "tr":
                self._push("tr", {})
        if tag == "a":
            self._close_to(("a",), _BARRIERS)
        if tag in VOID:
            self._void(tag, attrs)
        else:
            self._push(tag, attrs)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._void("br", {})
            return
        if self._at(tag) < 0:
            if tag == "p" and not self.stack[-1].hidden:
                self.frames[-1].brk(2)
            return
        self._close_to((tag,), ("table",) if tag in (*_CELLS, "tr", "tbody", "thead", "tfoot") else ("html",) if tag == "table" else (*_CELLS, "table"))

    # -- rendering --------------------------------------------------------------------------------------------

    @staticmethod
    def _hidden(attrs: dict[str, str]) -> bool:
        """By its own attributes; the last display that its style has goes before the attribute hidden."""
        shown = _DISPLAY.findall(attrs["style"]) if "style" in attrs else []
        return shown[-1].lower() == "none" if shown else "hidden" in attrs

    @staticmethod
    def _mute(style: str, otherwise: bool) -> bool:
        seen = _VISIBILITY.findall(style) if style else []
        return seen[-1].lower() != "visible" if seen else otherwise

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        parent = self.stack[-1]
        style = attrs.get("style", "")
        hidden = parent.hidden or tag in HIDDEN or self._hidden(attrs)
        if tag == "dialog" and "open" not in attrs or parent.tag == "details" and parent.extra is not None and tag != "summary":
            hidden = True
        foreign = self._foreign()
        if foreign and (tag in HIDDEN_IN[foreign] or attrs.get("display") == "none"):
            hidden = True
        if foreign == "svg" and "visibility" in attrs and not _VISIBILITY.search(style):
            style = f"visibility:{attrs['visibility']}"
        node = _Node(tag, hidden, self._mute(style, parent.mute), parent.pre or tag in ("pre", "textarea", "listing", "xmp", "plaintext"))
        if tag == "details" and "open" not in attrs:
            node.extra = "closed"
        if not hidden:
            self._open_block(tag, attrs, node, parent, foreign)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)

    def _open_block(self, tag: str, attrs: dict[str, str], node: _Node, parent: _Node, foreign: str | None) -> None:
        frame, in_table = self.frames[-1], len(self.open.get("table", ()))
        if tag == "li":
            frame.brk(1)
            mark = self._mark(attrs)
            frame.enter(mark, " " * len(mark))
        elif tag == "dd":
            frame.brk(1)
            frame.enter("    ", "    ")
        elif tag == "blockquote":
            frame.brk(2)
            frame.enter("> ", "> ")
        elif tag == "table" and in_table < DEEPEST_TABLE:
            node.frame, node.extra = _Frame(), {"rows": [], "caption": [], "outside": len(self.frames) - 1}
        elif (tag in _CELLS or tag == "tr") and in_table and self.stack[self._at("table")].frame is not None:
            node.frame, node.extra = _Frame(), [] if tag == "tr" else tuple(self._span(attrs.get(x, "1")) for x in ("colspan", "rowspan"))
        elif tag in SPACED and tag != "table":
            nested = tag in _LISTS and self._at(*_LISTS) >= 0
            frame.brk(1 if nested else 2)
            if tag in _LISTS:
                start = attrs.get("start", "1")
                node.extra = [int(start) if _NUMBER.fullmatch(start) else 1, nested]
        elif tag in BLOCK or foreign == "svg" and tag in SVG_TEXT or foreign == "math" and tag == "mtr" or tag == "plaintext" or tag in _CELLS:
            frame.brk(1)
        elif tag == "q":
            self._write('"')
        elif foreign == "math" and parent.tag in APART:
            frame.space = frame.space or bool(parent.extra and frame.line)
            parent.extra = True
        if node.frame is not None:
            self.frames.append(node.frame)

    @staticmethod
    def _span(text: str) -> int:
        """How many columns or rows; 0 (all rows that follow) for rows alone."""
        return min(MOST_SPAN, int(text)) if _SPAN.fullmatch(text.strip()) else 1

    def _mark(self, attrs: dict[str, str]) -> str:
        """The nearest open list gives the mark of an item."""
        at = self._at(*_LISTS)
        if at < 0 or self.stack[at].tag != "ol" or not isinstance(self.stack[at].extra, list):
            return "- "
        count, value = self.stack[at].extra, attrs.get("value", "")
        if _NUMBER.fullmatch(value):
            count[0] = int(value)
        count[0] += 1
        return f"{count[0] - 1}. "

    def _pop(self) -> None:
        node = self.stack.pop()
        self.open[node.tag].pop()
        if node.hidden:
            return
        tag = node.tag
        if node.frame is None:
            frame = self.frames[-1]
            if tag in ("li", "dd", "blockquote"):
                frame.brk(2 if tag == "blockquote" else 1)
                frame.leave()
            elif tag in SPACED and tag != "table":
                frame.brk(1 if tag in _LISTS and node.extra[1] else 2)
            elif tag in BLOCK or tag in SVG_TEXT and self._at("svg") >= 0 or tag == "mtr" and self._at("math") >= 0 or tag == "plaintext" or tag in _CELLS:
                frame.brk(1)
            elif tag == "q":
                self._write('"')
            return
        self.frames.pop()
        lines = node.frame.text_lines()
        if tag == "table":
            self.frames[-1].put_lines(node.extra["caption"] + lines + aligned(node.extra["rows"]), 2)
            return
        table, row = self.stack[self._at("table")].extra, self._at("tr")
        if tag == "tr":
            if node.extra or lines:
                table["rows"].append(node.extra if not lines else [(lines, 1, 1), *node.extra])
        elif tag == "caption":
            table["caption"] += lines
        elif row > self._at("table") and isinstance(self.stack[row].extra, list):
            self.stack[row].extra.append((lines, *node.extra))
        else:
            self.frames[-1].put_lines(lines, 1)

    def _void(self, tag: str, attrs: dict[str, str]) -> None:
        node = self.stack[-1]
        if node.hidden or node.mute or self._hidden(attrs):
            return
        frame = self.frames[-1]
        if tag == "br":
            if frame.line or frame.due == 0:
                frame.end_line()
        elif tag == "hr":
            frame.put_lines(["---"], 2)
        elif tag == "img" and attrs.get("alt"):
            self._write(unescape(attrs["alt"]))
        elif tag == "input" and attrs.get("type", "").lower() in ("submit", "button", "reset") and attrs.get("value"):
            self._write(unescape(attrs["value"]))

    def _text(self, text: str) -> None:
        node = self.stack[-1]
        if node.tag == "head" and not text.isspace():
            self._pop()
            node = self.stack[-1]
        if node.hidden or node.mute or node.tag == "details" and node.extra is not None:
            return
        if self._unpainted():
            return
        if "&" in text:
            text = unescape(text)
        if node.tag in _TABLE_PARTS:
            if text.isspace():
                return
            table = self.stack[self._at("table")].extra if self._at("table") >= 0 else None
            if table is not None:  # astray in a table: before it
                self.frames[table["outside"]].write(text)
                return
        self.frames[-1].write(text, node.pre)

    def _write(self, text: str) -> None:
        if not self.stack[-1].mute:
            self.frames[-1].write(text)


def wrapped(line: str) -> list[str]:
    """The line in pieces of WIDEST columns at most where its spaces allow for it; lines with runs of spaces are laid out already."""
    if width(line) <= WIDEST or "  " in line:
        return [line]
    out, now, used = [], [], -1
    for word in line.split(" "):
        more = width(word)
        if now and used + 1 + more > WIDEST:
            out.append(" ".join(now))
            now, used = [], -1
        now.append(word)
        used += 1 + more
    return [*out, " ".join(now)]


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table: cells (lines, columns, rows that they span) of a column begin at one position.

    A row goes round the columns that cells from rows above span; a cell with rows to span 0 spans all that follow.
    """
    placed, busy, n_columns = [], {}, 0  # busy: column to the first row that is free again
    for y, row in enumerate(rows):
        at, cells = 0, []
        for lines, columns, down in row:
            while busy.get(at, 0) > y:
                at += 1
            columns = max(1, columns)
            cells.append((at, lines, columns))
            if down != 1:
                busy.update(dict.fromkeys(range(at, at + columns), y + down if down else len(rows)))
            at += columns
        placed.append(cells)
        n_columns = max(n_columns, at)
    widths = [0] * n_columns
    shown = []
    for cells in placed:
        last = len(cells) - 1
        shown.append([(at, lines if i == last else [x for line in lines for x in wrapped(line)], columns) for i, (at, lines, columns) in enumerate(cells)])
        for at, lines, columns in shown[-1]:
            if columns == 1:
                widths[at] = max(widths[at], max((w for w in map(width, lines) if w <= (LONGEST if at < n_columns - 1 else 0)), default=0))
    left = [0]
    for w in widths:
        left.append(left[-1] + w + 3)
    out = []
    for cells in shown:
        for i in range(max((len(lines) for _, lines, _ in cells), default=0)):
            parts, used = [], 0
            for at, lines, _ in cells:
                gap = left[at] - used
                if at:  # the bar stands three columns before the cell, or right after what reaches over it
                    parts.append(" " * (gap - 3) + " | " if gap >= 3 else " | ")
                    used += max(gap, 3)
                if i < len(lines):
                    parts.append(lines[i])
                    used += width(lines[i])
            out.append("".join(parts).rstrip(" "))
    return out


PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType())])


def extract(pages: DataFrame, key: str = "page_id", *, html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: the key, title, visible text and its number of lines with text.

    A null or empty page has an empty title and text. Rows are independent: repeated ones give equal results. Very long
    and very deep pages take time and memory in proportion to their length. An empty table gives an empty result. Other
    columns of ``pages`` may have any name; the key none of a result.
    """
    if key.lower() in PAGE.names:
        raise ValueError(f"the key {key} has the name of a result")
    slim = pages.select(col(pages, key).alias("k"), col(pages, html_col).alias("html"))

    def run(rows: dict[str, list]) -> dict[str, list]:
        done = [Renderer(h or "") for h in rows["html"]]
        return {"title": [r.title for r in done], "text": [r.text for r in done], "n_lines": [sum(1 for x in r.text.split("\n") if x.strip()) for r in done]}

    return map_arrow(slim, run, T.StructType([slim.schema["k"], *PAGE.fields]), carry=["k"]).withColumnRenamed("k", key)
