"""HTML extraction: a tree builder with implied tags, visibility rules, and a renderer that keeps the layout of blocks.

The tree builder closes and opens what a page leaves out (paragraphs, list items, table rows and cells, options,
definition terms), ignores stray end tags and never fails. Hidden elements (scripts, styles, heads, hidden attributes,
inline styles that hide) are not rendered. The renderer writes blocks on lines of their own with an empty line between
paragraphs, list items with bullets or numbers and indented by depth, quoted and preformatted text, and tables with
their cells padded to the width of their columns.

Defined results: a null or empty page gives the empty text; unclosed tags, attributes and comments run to the end of
the page; text in tables nested in cells is rendered inside the cell; any depth of nesting is followed without recursion
by the builder, and beyond MOST_DEPTH levels elements are flattened into their parent, but hidden ones stay hidden.
Form controls, formulas, the text of pictures, open dialogs and what only readers of screens skip (aria-hidden) are
visible; all options of a list are written, a line each. What visibility hides takes no part but for descendants that
are visible again; of closed details the summary is written. A table's columns are those at which some cell begins.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_DEPTH = 120
#: The largest spans of the HTML standard.
MOST_ACROSS, MOST_DOWN = 1000, 65534

#: Elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template title meta link base noscript iframe noembed noframes object canvas audio video map datalist input param source track area".split())
#: What pictures and formulas hold but do not show.
UNDRAWN = frozenset("defs desc metadata symbol annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SECTIONS = frozenset("tbody thead tfoot".split())
#: An opening tag closes an open element of these, unless one of the scopes stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
P_SCOPE = frozenset("table td th caption button object html body li dd dt".split())
END_SCOPE = frozenset("table td th caption html".split())

TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)|(?P<bogus>[!?][^>]*)(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))""", re.S)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]*))?""")
HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
SEEN = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z-]+)", re.I)
LONG_REFERENCE = re.compile(r"&#(?:([xX])([0-9a-fA-F]{7,})|([0-9]{8,}));?")
BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []


def unescape(s: str) -> str:
    """s with character references as characters; of whatever number of digits, what is no character is U+FFFD."""
    def short(m: re.Match) -> str:
        digits = (m[2] or m[3]).lstrip("0")
        return "\ufffd" if len(digits) > 7 else f"&#{m[1] or ''}{digits or '0'};"

    if "&" not in s:
        return s
    return html.unescape(LONG_REFERENCE.sub(short, s) if "&#" in s else s)


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTR.findall(raw):
        if value[:1] in ("'", '"'):
            value = value[1:].removesuffix(value[0])
        out.setdefault(name.lower(), unescape(value))
    return out


def tree(page: str) -> Node:
    """The page as a tree of elements and strings."""
    root = Node("html")
    stack = [root]
    sinks = [root]  # where the content of each open element goes
    opened: Counter[str] = Counter()

    def cut(k: int) -> None:
        opened.subtract(n.name for n in stack[k:])
        del stack[k:], sinks[k:]

    def push(node: Node) -> None:
        into = sinks[-1]
        stack.append(node)
        opened[node.name] += 1
        own = len(stack) <= MOST_DEPTH or hidden(node) and not hidden(into)
        sinks.append(node if own else into)

    def close(names, scope) -> None:
        """Closes the nearest open element of these names and all inside it, if no scope element stands between."""
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                cut(k)
                return
            if stack[k].name in scope:
                return

    def close_all(names, scope) -> None:
        if not any(opened[n] for n in names):
            return
        low = len(stack)
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in scope:
                break
            if stack[k].name in names:
                low = k
        cut(low)

    def open_(name: str, attrs: dict[str, str]) -> Node:
        node = Node(name, attrs)
        sinks[-1].children.append(node)
        return node

    def text(s: str) -> None:
        if s:
            sinks[-1].children.append(s)

    pos = 0
    while True:
        m = TAG.search(page, pos)
        if not m:
            text(unescape(page[pos:]))
            return root
        text(unescape(page[pos : m.start()]))
        pos = m.end()
        if m["start"]:
            name = m["start"].lower()
            attrs = _attrs(m["attrs"]) if m["attrs"] else {}
            if name in ("html", "body"):
                stack[0].attrs |= {k: v for k, v in attrs.items() if k not in stack[0].attrs}
                close({"head"}, ())
                continue
            if name in ENDS_P:
                close({"p"}, P_SCOPE)
                if stack[-1].name == "head":
                    cut(len(stack) - 1)
            if name in HEADINGS and stack[-1].name in HEADINGS:
                cut(len(stack) - 1)
            if name in IMPLIED:
                close_all(*IMPLIED[name])
            if name in ("td", "th") and stack[-1].name != "tr":
                if opened["table"]:
                    close({"p"}, P_SCOPE)
                    push(open_("tr", {}))
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
                node = open_(name, attrs)
                body = page[pos : end.start() if end else len(page)]
                if body:
                    node.children.append(unescape(body) if name in ("textarea", "title") else body)
                pos = end.end() if end else len(page)
                continue
            foreign = name in ("svg", "math") or opened["svg"] or opened["math"]
            if foreign and name in UNDRAWN:
                attrs["hidden"] = ""
            node = open_(name, attrs)
            if name not in VOID and not (foreign and m["attrs"].rstrip().endswith("/")):
                push(node)
        elif m["end"]:
            name = m["end"].lower()
            if name == "br":
                open_("br", {})
            elif name == "p" and not opened["p"]:
                open_("p", {})
            elif name not in ("html", "body"):
                close({name}, () if name in END_SCOPE else END_SCOPE - {name})


def hidden(node: Node) -> bool:
    a = node.attrs
    if node.name in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found" or node.name == "dialog" and "open" not in a:
        return True
    return bool(a.get("style")) and bool(HIDES.search(a["style"]))


def unseen(node: Node, above: bool) -> bool:
    """Whether the element's own text is unseen: visibility is inherited, and can be taken back."""
    style = node.attrs.get("style")
    found = SEEN.findall(style) if style else ()
    value = found[-1].lower() if found else ""
    return value in ("hidden", "collapse") if value in ("hidden", "collapse", "visible", "initial") else above


def width(s: str) -> int:
    """Columns that a text takes: wide East Asian characters two, combining marks none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Renderer:
    """Collects lines; inline text is joined with its white space collapsed."""

    def __init__(self, unseen: bool = False):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.prefix: list[str] = []
        self.mark: str | None = None
        self.gap = 0
        self.unseen = unseen

    def inline(self, s: str) -> None:
        if not self.unseen:
            self.run.append(s)

    def flush(self) -> None:
        """Ends the line that inline text has filled."""
        if not self.run:
            return
        parts = BLANK.sub(" ", "".join(self.run)).split("\x00")
        self.run = []
        parts = [p.strip(" ") for p in parts]
        while parts and not parts[-1]:
            parts.pop()
        if not any(parts):
            return
        for p in parts:
            self.line(p)

    def line(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines.append("".join(p for p in self.prefix if p.startswith(">")).rstrip())
        self.gap = 0
        pre = "".join(self.prefix)
        if self.mark is not None:
            pre = "".join(self.prefix[:-1]) + self.mark
            self.mark = None
        self.lines.append((pre + s).rstrip())

    def block(self, spaced: bool) -> None:
        self.flush()
        if spaced:
            self.gap = 1

    def text(self) -> str:
        self.flush()
        return "\n".join(self.lines)


def _children(node: Node, out: Renderer, depth: int) -> None:
    for c in node.children:
        if isinstance(c, str):
            out.inline(c.replace("\x00", ""))
        else:
            _element(c, out, depth)


def _element(node: Node, out: Renderer, depth: int) -> None:
    """A visible element; one that is only unseen takes part in nothing but what its seen descendants show."""
    if hidden(node):
        return
    before, out.unseen = out.unseen, unseen(node, out.unseen)
    _seen(node, out, depth)
    out.unseen = before


def _seen(node: Node, out: Renderer, depth: int) -> None:
    name = node.name
    if name == "br":
        out.inline("\x00")
    elif name == "img":
        if node.attrs.get("alt", "").strip():
            out.inline(node.attrs["alt"])
    elif name == "hr":
        out.block(True)
        if not out.unseen:
            out.line("-" * 3)
        out.gap = 1
    elif name == "table":
        out.block(True)
        _table(node, out, depth)
        out.gap = 1
    elif name in ("ul", "ol", "menu", "dir"):
        out.block(not depth)
        _list(node, out, depth)
        out.block(not depth)
    elif name == "li":  # outside a list
        _item(node, out, depth, "* ")
    elif name in ("dd", "blockquote"):
        out.block(name == "blockquote")
        out.prefix.append("> " if name == "blockquote" else "    ")
        _children(node, out, depth)
        out.flush()
        out.prefix.pop()
        out.block(name == "blockquote")
    elif name == "pre":
        out.block(True)
        body = _plain(node, out.unseen).replace("\r\n", "\n")
        for s in body.removeprefix("\n").rstrip("\n").split("\n") if body or not out.unseen else ():
            out.line(s.rstrip())
        out.gap = 1
    elif name == "textarea":
        out.block(False)
        body = _plain(node, out.unseen).replace("\r\n", "\n").removeprefix("\n").rstrip("\n")
        for s in body.split("\n") if body else ():
            out.line(s.rstrip())
    elif name == "details" and "open" not in node.attrs:  # its first summary alone
        out.block(False)
        for c in [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]:
            _element(c, out, depth)
        out.block(False)
    elif name in ("option", "optgroup"):
        out.block(False)
        if node.attrs.get("label", "").strip():
            out.inline(node.attrs["label"])
            out.flush()
        if name == "optgroup" or not node.attrs.get("label", "").strip():
            _children(node, out, depth)
        out.block(False)
    elif name == "q":
        out.inline('"')
        _children(node, out, depth)
        out.inline('"')
    elif name in BLOCKS or name in SECTIONS or name in ("tr", "caption"):
        out.block(name in SPACED)
        _children(node, out, depth)
        out.block(name in SPACED)
    elif name in ("td", "th", "button", "text"):  # text: of a picture
        out.inline(" ")
        _children(node, out, depth)
        out.inline(" ")
    else:
        _children(node, out, depth)


def _plain(node: Node, away: bool = False) -> str:
    return "".join(("" if away else c) if isinstance(c, str) else "\n" if c.name == "br" else "" if hidden(c) else _plain(c, unseen(c, away)) for c in node.children)


def _item(node: Node, out: Renderer, depth: int, mark: str) -> None:
    out.flush()
    before = len(out.lines)
    out.prefix.append(" " * len(mark))
    out.mark = mark
    _children(node, out, depth + 1)
    out.flush()
    if len(out.lines) == before and not out.unseen:
        out.line("")
    out.mark = None
    out.prefix.pop()
    out.gap = 0


def _list(node: Node, out: Renderer, depth: int) -> None:
    n = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "").strip()) else 1
    step = -1 if "reversed" in node.attrs else 1
    for c in node.children:
        if isinstance(c, str):
            out.inline(c)
        elif c.name == "li" and not hidden(c):
            value = c.attrs.get("value", "").strip()
            n = int(value) if re.fullmatch(r"-?\d{1,9}", value) else n
            before, out.unseen = out.unseen, unseen(c, out.unseen)
            _item(c, out, depth, f"{n}. " if node.name == "ol" else "* ")
            out.unseen = before
            n += step
        else:
            _element(c, out, depth + 1)


def _table(node: Node, out: Renderer, depth: int) -> None:
    """Rows as lines, with the cells of a column equally wide; a cell of several lines takes several lines."""
    rows: list[list[Node]] = []
    head: list[Node] = []

    def gather(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                if c.strip():
                    out.inline(c)  # stray text stands before the table
            elif hidden(c) or c.name in ("col", "colgroup"):
                continue
            elif c.name == "caption":
                head.append(c)
            elif c.name in SECTIONS:
                gather(c)
            elif c.name == "tr":
                rows.append([x for x in c.children if isinstance(x, Node) and x.name in ("td", "th") and not hidden(x)])
                for x in c.children:
                    if isinstance(x, str) and x.strip():
                        out.inline(x)
                    elif isinstance(x, Node) and x.name not in ("td", "th"):
                        _element(x, out, depth)
            else:
                _element(c, out, depth)

    gather(node)
    out.flush()
    for c in head:
        _children(c, out, depth)
        out.flush()
    # where each cell begins; columns at which none begins are not written, so spans add no more than there are cells
    laid: list[list[tuple[int, int, Node]]] = []
    held: list[tuple[int, int, int]] = []  # first column, one past the last, and one past the last row of cells from above
    for y, cells in enumerate(rows):
        held = sorted(h for h in held if h[2] > y)
        line, x, k = [], 0, 0
        for cell in cells:
            while k < len(held) and held[k][0] <= x:
                x, k = max(x, held[k][1]), k + 1
            across, down = (max(1, min(int(v.lstrip("0")[:9] or 0), most)) if (v := cell.attrs.get(name, "").strip()).isdigit() and v.isascii() else 1 for name, most in (("colspan", MOST_ACROSS), ("rowspan", min(MOST_DOWN, len(rows) - y))))
            line.append((x, x + across, cell))
            if down > 1:
                held.append((x, x + across, y + down))
            x += across
        laid.append(line)
    columns_at = sorted({x for line in laid for x, _, _ in line})
    starts = {x: k for k, x in enumerate(columns_at)}
    grid: list[list[list[str]]] = []
    for line in laid:
        row: list[list[str]] = []
        more = False
        for x, end, cell in line:
            inner = Renderer(unseen(cell, out.unseen))
            _children(cell, inner, 0)
            text = inner.text()
            more = not text or starts[x] < bisect.bisect_left(columns_at, end) - 1
            if text:
                row += [[""]] * (starts[x] - len(row))
                row.append(text.split("\n"))
        grid.append([*row, [""]] if row and more else row)  # what is empty at a row's end is one cell, however wide
    columns = max(map(len, grid), default=0)
    widths = [max((width(s) for row in grid if x < len(row) for s in row[x]), default=0) for x in range(columns)]
    for row in grid:
        for k in range(max(map(len, row), default=0)):
            cells = [cell[k] if k < len(cell) else "" for cell in row]
            out.line(" | ".join(s + " " * (w - width(s)) for s, w in zip(cells, widths, strict=False)).rstrip() if len(row) > 1 else cells[0])


def render(page: str | None) -> str:
    """All visible text of a page."""
    if not page:
        return ""
    out = Renderer()
    _children(tree(page), out, 0)
    return out.text()


def extract_text(pages: DataFrame, page_id: str = "page_id", markup: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines: of every whole page. No shuffle."""
    src = common.plain(pages, page_id=page_id, html=markup)
    kind = src.schema["page_id"].dataType.simpleString()
    common.small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [render(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    out = src.mapInArrow(common.trimmed(run), f"page_id {kind}, text string")
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).alias("n_lines"))
