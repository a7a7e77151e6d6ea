"""Visible text of HTML pages, laid out as a browser would show it.

A tokenizer feeds a tree builder that follows the rules of HTML for implied tags: items, cells, rows, options
and paragraphs end where the next one or their container begins, tables get their rows, and stray end tags are
ignored. A renderer walks the tree: what isn't visible (head, scripts, styles, templates, hidden elements,
elements styled away, closed details, fallbacks of media, unselected options) is left out, blocks begin on
lines of their own with one blank line around paragraphs, headings, lists and tables, list items carry a bullet
or their number and are indented by depth, preformatted text keeps its white space, and the cells of a table
stand in aligned columns. visibility is inherited and can be set again inside; display can't.

Contract: null and empty pages give empty text. Any byte sequence of text is a page: broken markup never
fails, and no page takes more than about linear time: the tree is walked with a stack of its own at any depth,
tags are scanned without backtracking, and padding is at most LINE characters for each cell. Rules of a page's own style
sheets aren't applied. Of deep layouts only the shape is bounded, never the text: indentation
stops at INDENT characters, tables inside TABLES others aren't aligned, spans reach to column COLUMNS, and cells wider than WIDE
aren't padded for. Pages are
processed whole, row by row; repeated rows give equal results and an empty table gives none. Other columns are
kept, but for one named as the output.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.sentencepiece_bpe import text_slices

INDENT, TABLES, COLUMNS = 120, 16, 1000
#: Cells wider than WIDE don't widen their column: the row goes on in a new line behind them. Columns that would begin beyond
#: LINE begin on a further line. So padding is at most LINE for each cell.
WIDE, LINE = 120, 480
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content up to the matching end tag is text, not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title datalist rp progress meter audio video canvas area param source track link meta base defs desc metadata symbol clippath mask annotation annotation-xml".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table ul caption thead tbody tfoot tr".split())
#: Blocks with a blank line before and after them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote table figure hr".split())
LISTS = frozenset("ul ol menu dir".split())
#: An open paragraph ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: begin tag -> (open elements that it ends, elements beyond which it doesn't look)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}), "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}), "colgroup": ({"caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "body": ({"head"}, set()), "a": ({"a"}, {"td", "th", "table", "li", "div"}),
}
_SCOPE = frozenset({"table", "td", "th", "caption", "html", "template", "button", "object"})
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: Attributes up to the end of a tag; it stops early only before the value of a quote that nothing closes.
_ATTRS = re.compile(r"""(?:[\s/]++|(?:=(?!\s*+["']))?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)|\Z))?+|=(?!\s*+["']))*+""")
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_COMMENT = re.compile("--!?>")
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_SEEN = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
_WS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


class _Open:
    """The open elements, and for each name where it stands among them."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.stack[-1].kids.append(node)
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def nearest(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, i: int) -> None:
        """Close the elements from place i on."""
        while len(self.stack) > i:
            self.at[self.stack.pop().tag].pop()

    def close(self, tags: set[str] | frozenset[str], beyond: set[str] | frozenset[str]) -> None:
        """Close open elements of these names down to the nearest one that they don't reach beyond."""
        limit = self.nearest(beyond)
        while (i := self.nearest(tags)) > limit:
            self.cut(i)


_CELLS, _OUT_OF_CELLS = frozenset({"td", "th", "caption"}), frozenset({"table", "tr", "tbody", "thead", "tfoot", "html", "body"})


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    opened = _Open(root)
    stack = opened.stack

    def text(t: str) -> None:
        stack[-1].kids.append(html.unescape(t) if "&" in t else t)

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            text(page[at:begin])
        if begin == n:
            break
        mark = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            end = _COMMENT.search(page, begin + 2 if page.startswith("<!-->", begin) else begin + 4)
            at = end.end() if end else n
            continue
        name = _NAME.match(page, begin + 1 + (mark == "/"))
        if name is None:
            if mark and mark in "!?/":
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else n
            else:
                stack[-1].kids.append("<")
                at = begin + 1
            continue
        m = _ATTRS.match(page, name.end())
        at = m.end()
        if at < n and page[at] != ">":  # an open quote: all before it is text
            text(page[begin:at])
            continue
        at = min(n, at + 1)
        tag = name[0].lower()
        if mark == "/":
            i = opened.nearest({tag})
            if tag in ("br", "p") and not i:
                if tag == "br":
                    stack[-1].kids.append(Node("br"))
            elif tag in _OUT_OF_CELLS or i >= opened.nearest(_CELLS):  # other end tags don't reach out of a cell
                opened.cut(i or len(stack))
            continue
        attrs = _attributes(m[0]) if m[0].strip() else {}
        if tag in ENDS_P:
            opened.close({"p"}, _SCOPE)
        if tag in IMPLIED:
            opened.close(*IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            opened.push(Node("tr"))
        if tag in ("html", "body") and opened.nearest({tag}):
            continue
        node = Node(tag, attrs)
        if tag in VOID:
            stack[-1].kids.append(node)
        elif tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*+>?", re.I).search(page, at)
            raw = page[at : end.start() if end else n]
            node.kids.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            stack[-1].kids.append(node)
            at = end.end() if end else n
        elif not m[0].rstrip().endswith("/") or tag not in ("svg", "math", "path", "circle", "rect", "g"):
            opened.push(node)
        else:
            stack[-1].kids.append(node)
    return root


def _there(node: Node) -> bool:
    """Whether an element takes part in the layout at all."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or node.tag == "object" and a.get("data") or node.tag == "dialog" and "open" not in a:
        return False
    return not (node.tag == "input" and a.get("type", "").lower() == "hidden") and not ("style" in a and _GONE.search(a["style"]))


def _seen(node: Node, seen: bool) -> bool:
    found = _SEEN.search(node.attrs["style"]) if "style" in node.attrs else None
    return found[1].lower() == "visible" if found else seen


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines of text, the open line, and the blank lines that are due before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank, self.space, self.indent, self.mark = 0, False, "", ""

    def deeper(self, by: str) -> str:
        return self.indent + by if len(self.indent) + len(by) <= INDENT else self.indent

    def text(self, s: str) -> None:
        s = _WS.sub(" ", s)
        if not s:
            return
        if s == " ":
            self.space = True
            return
        if (self.space or s[0] == " ") and self.line:
            self.line.append(" ")
        self.line.append(s.strip(" "))
        self.space = s[-1] == " "

    def raw(self, s: str) -> None:
        for i, part in enumerate(s.split("\n")):
            if i:
                self.end(True)
            if part:
                self.line.append(part)

    def end(self, keep: bool = False) -> None:
        """End the open line; with keep, an empty one counts."""
        if self.line or keep:
            while self.blank and self.lines:
                self.lines.append("")
                self.blank -= 1
            self.blank = 0
            own = "".join(self.line)
            own = own if keep else own.rstrip(" ")
            self.lines.append((self.mark or self.indent) + own if own or self.mark else "")
            self.mark = ""
        self.line, self.space = [], False

    def gap(self) -> None:
        self.end()
        self.blank = 1


#: A renderer yields the renderers of what it holds, which _run works off, so that depth costs no call stack.
Steps = Iterator["Steps"]


def _run(steps: Steps) -> None:
    stack = [steps]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _inline(nodes: list, out: _Page, pre: bool, depth: int, tables: int, seen: bool) -> Steps:
    for k in nodes:
        if isinstance(k, str):
            if seen:
                out.raw(k.replace("\r\n", "\n")) if pre else out.text(k)
        elif _there(k):
            yield _element(k, out, pre, depth, tables, _seen(k, seen))


def _element(node: Node, out: _Page, pre: bool, depth: int, tables: int, seen: bool) -> Steps:
    tag = node.tag
    if tag == "br":
        out.end(True)
    elif tag == "hr":
        out.gap()
        if seen:
            out.line.append("---")
        out.gap()
    elif tag == "img":
        if seen and node.attrs.get("alt"):
            out.text(node.attrs["alt"])
    elif tag == "input":
        if seen and node.attrs.get("type", "text").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
            out.text(node.attrs["value"])
    elif tag == "select":
        yield _select(node, out, depth, tables, seen)
    elif tag == "details" and "open" not in node.attrs:
        out.end()
        yield _inline([k for k in node.kids if isinstance(k, Node) and k.tag == "summary"][:1], out, pre, depth, tables, seen)
        out.end()
    elif tag == "table":
        out.gap()
        yield _table(node, out, depth, tables, seen)
        out.gap()
    elif tag not in BLOCK:
        yield _inline(node.kids, out, pre, depth, tables, seen)
    else:
        yield _block(node, out, pre, depth, tables, seen)


def _block(node: Node, out: _Page, pre: bool, depth: int, tables: int, seen: bool) -> Steps:
    tag = node.tag
    spaced = tag in SPACED and not (tag in LISTS and depth)
    out.gap() if spaced else out.end()
    if tag in LISTS:
        yield _list(node, out, pre, depth, tables, seen)
    elif tag in ("blockquote", "dd"):
        old, out.indent = out.indent, out.deeper("    ")
        yield _inline(node.kids, out, pre, depth, tables, seen)
        out.end()
        out.indent = old
    elif tag == "pre":
        kids = list(node.kids)
        if kids and isinstance(kids[0], str):
            kids[0] = kids[0].removeprefix("\r").removeprefix("\n")
        yield _inline(kids, out, True, depth, tables, seen)
        out.end()
    else:
        yield _inline(node.kids, out, pre, depth, tables, seen)
    out.gap() if spaced else out.end()


def _select(node: Node, out: _Page, depth: int, tables: int, seen: bool) -> Steps:
    """The selected option, or the first one; all options of a list box."""
    options, todo = [], node.kids[::-1]
    while todo:
        k = todo.pop()
        if isinstance(k, Node) and _there(k):
            options.append(k) if k.tag == "option" else todo.extend(k.kids[::-1])
    box = "multiple" in node.attrs or _span(node, "size") > 1
    shown = options if box else ([k for k in options if "selected" in k.attrs][-1:] or options[:1])
    for k in shown:
        if box:
            out.end()
        yield _inline(k.kids, out, False, depth, tables, _seen(k, seen))
        if box:
            out.end()


def _list(node: Node, out: _Page, pre: bool, depth: int, tables: int, seen: bool) -> Steps:
    number = node.attrs.get("start", "")
    number = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
    for k in node.kids:
        if isinstance(k, str) or not _there(k):
            if isinstance(k, str) and k.strip() and seen:
                out.text(k)
            continue
        own = _seen(k, seen)
        if k.tag != "li":
            yield _element(k, out, pre, depth + 1, tables, own)
            continue
        out.end()
        if re.fullmatch(r"-?\d{1,9}", k.attrs.get("value", "")):
            number = int(k.attrs["value"])
        bullet = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        old, out.mark = out.indent, out.indent + bullet if own else ""
        out.indent = out.deeper(" " * len(bullet))
        yield _inline(k.kids, out, pre, depth + 1, tables, own)
        out.end()
        out.indent, out.mark = old, ""


def _span(node: Node, name: str) -> int:
    v = node.attrs.get(name, "")
    return min(int(v), COLUMNS) if re.fullmatch(r"[1-9]\d{0,5}", v) else 1


def _parts(node: Node) -> tuple[list[tuple[Node, bool]], list[Node], list]:
    """A table's rows (head, body, foot, each with its own visibility rules), captions, and misplaced content."""
    captions, rows, loose = [], {"thead": [], "tbody": [], "tfoot": []}, []
    todo = [(k, "tbody", None) for k in node.kids[::-1]]
    while todo:
        k, part, seen = todo.pop()
        if isinstance(k, str):
            if k.strip():
                loose.append(k)
        elif not _there(k) or k.tag in ("col", "colgroup"):
            continue
        elif k.tag == "caption":
            captions.append(k)
        elif k.tag in rows:
            todo += [(x, k.tag, _seen(k, seen)) for x in k.kids[::-1]]
        elif k.tag == "tr":
            rows[part].append((k, _seen(k, seen)))
        else:
            loose.append(k)
    return rows["thead"] + rows["tbody"] + rows["tfoot"], captions, loose


def _table(node: Node, out: _Page, depth: int, tables: int, seen: bool) -> Steps:
    """Cells in a grid with spans, each column as wide as its widest line; two spaces between columns."""
    rows, captions, loose = _parts(node)
    for c in captions:
        yield _inline(c.kids, out, False, depth, tables, _seen(c, seen))
        out.end()
    if loose:  # misplaced content stands before the table
        yield _inline(loose, out, False, depth, tables, seen)
        out.end()
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}  # columns that cells from above still fill, and for how many rows
    for tr, row_seen in rows:
        line, col, after = {}, 0, {c: n - 1 for c, n in held.items() if n > 1}
        for td in tr.kids:
            if isinstance(td, str) and not td.strip() or isinstance(td, Node) and not _there(td):
                continue
            cell = isinstance(td, Node) and td.tag in ("td", "th")
            while col in held:
                col += 1
            wide, tall = (_span(td, "colspan"), _span(td, "rowspan")) if cell and col < COLUMNS else (1, 1)
            wide = max(1, min(wide, COLUMNS - col))
            own = seen if row_seen is None else row_seen
            kids, own = (td.kids, _seen(td, own)) if cell else ([td], own)
            if tables >= TABLES:
                yield _inline(kids, out, False, depth + 1, tables, own)
                out.space = True
            else:
                inner = _Page()
                yield _inline(kids, inner, False, depth + 1, tables + 1, own)
                inner.end()
                line[col] = (inner.lines or [""], wide)
            if tall > 1:
                after |= {c: tall - 1 for c in range(col, col + wide)}
            col += wide
        held = after
        grid.append(line)
        if tables >= TABLES:
            out.end()
    if tables < TABLES:
        _aligned(grid, out)


def _aligned(grid: list[dict[int, tuple[list[str], int]]], out: _Page) -> None:
    width: dict[int, int] = {}
    for line in grid:
        for c, (text, wide) in line.items():
            if wide == 1:
                width[c] = max(width.get(c, 0), *(n for n in map(_width, text) if n <= WIDE), 0)
    spans = sorted(((wide, c, min(WIDE, max(map(_width, text)))) for line in grid for c, (text, wide) in line.items() if wide > 1))
    for wide, c, need in spans:  # the last column of a span takes what its columns lack
        room = sum(width[i] + 2 for i in range(c, c + wide) if i in width) - 2
        if need > max(0, room):
            last = c + wide - 1
            width[last] = width.get(last, 0) + need - max(0, room) - (2 if room >= 0 and last not in width else 0)
            width[last] = max(0, width[last])
    begin, band, at, bands = {}, {}, 0, 0
    for c in range(max([*width, *(c for line in grid for c in line)], default=-1) + 1):
        if at > LINE:
            at, bands = 0, bands + 1
        begin[c], band[c] = at, bands
        at += width[c] + 2 if c in width else 0

    def put(text: list[str]) -> None:
        row = "".join(text).rstrip(" ")
        out.line.append(row)
        out.end(bool(row.strip()))

    for line in grid:
        cells = sorted((c, cell) for c, (cell, _) in line.items())
        for k in range(max((len(t) for _, t in cells), default=0)):
            cells = [x for x in cells if k < len(x[1])]
            text, filled, over, now = [], 0, False, 0
            for c, cell in cells:
                if cell[k]:
                    if text and (over or band[c] != now):  # a wide cell stands before, or the line is full
                        put(text)
                        text, filled = [], 0
                    text.append(" " * (begin[c] - filled) + cell[k])
                    filled, over, now = max(filled, begin[c]) + _width(cell[k]), _width(cell[k]) > WIDE, band[c]
            put(text)


def extract(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    out = _Page()
    _run(_inline(parse(page).kids, out, False, 0, 0, True))
    out.end()
    lines = [x.rstrip(" ") for x in out.lines]
    begin, end = 0, len(lines)
    while end and not lines[end - 1]:
        end -= 1
    while begin < end and not lines[begin]:
        begin += 1
    return "\n".join(lines[begin:end])


def extracted(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """pages with the html column replaced by the visible text."""
    keep = [c for c in pages.columns if c not in (column, into)]
    source = pages.select(column, *keep)
    schema = source.select(*keep).schema.add(into, "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, 0):
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([extract(p) for p in b.column(0).to_pylist()], pa.string())], names=[*keep, into])

    return source.mapInArrow(run, schema)
