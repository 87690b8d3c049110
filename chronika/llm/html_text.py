"""Text of HTML pages as a reader sees it.

A tree is built from the tags, with the implied ones: a paragraph ends where a block begins, an
item, row, cell, term or option where its next sibling does, void elements hold nothing, and an end
tag closes what is open within it, but for blocks within formatting. Comments, declarations, scripts and styles are skipped.

Visibility. Not shown is what stands in the head, in templates, noscript (scripts are taken to run),
embedded media and other elements that show no text of their own, what has the attribute hidden, all
but the summary of a details element that is not open, and what an inline style sets to display:none.
visibility:hidden or collapse holds for all text below, until an element within sets it to visible. Of
several declarations of a property in one style the last holds, or the last with !important. Text areas,
options of a choice, formulas and text in drawings are shown.

All visible text is then laid out: white space collapses but in preformatted text, blocks start on
lines of their own, paragraphs, headings, lists and tables are set off by a blank line, items carry
a bullet or their number and are indented by depth, and the cells of a table stand in aligned
columns, spans included.

Null and empty pages give the empty text. Broken markup never fails: what looks like no tag is
text. Elements nested deeper than MAX_DEPTH show their text in order within the one at that depth, as
lines if they are blocks, and hide it by the same rules. Each row is laid out by
itself, repeated ids too; columns beyond those named are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronika.llm.common import ship_package, text_chunks

MAX_DEPTH = 200
#: Fixed: the most columns that a cell may span; rows end with the table.
MAX_COLUMN_SPAN = 1000
MOST_INDENT = 80
#: Fixed: elements by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure article section".split())
UNSEEN = frozenset("head title script style template noscript iframe object audio video canvas datalist noframes noembed desc metadata defs annotation annotation-xml".split())
RAW_TEXT = frozenset("script style textarea title noframes noembed iframe xmp".split())
#: What a start tag closes, and the elements that keep it from reaching further out.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Blocks that leave an open paragraph as it is.
KEEPS_PARAGRAPH = frozenset("li dt dd tr td th thead tbody tfoot option optgroup caption body html".split())
SCOPE = frozenset("table td th caption button html template".split())
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
DECLARATION = re.compile(r"\s*([\w-]+)\s*:\s*([^;]*?)\s*(!\s*important)?\s*(?:;|\Z)", re.I)


def declared(style: str) -> dict[str, str]:
    """The values that an inline style gives to its properties."""
    found: dict[str, tuple[bool, str]] = {}
    for name, value, important in DECLARATION.findall(style.lower()):
        if important or not found.get(name, (False,))[0]:
            found[name] = bool(important), value
    return {k: v for k, (_, v) in found.items()}


class Node:
    """gone: not laid out, with all below. unseen: whether its own text is invisible, None: as around it."""

    __slots__ = ("tag", "attributes", "children", "gone", "unseen")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag = tag
        self.children: list[Node | str] = []
        found = {}
        if attributes and not attributes.isspace():
            for m in ATTRIBUTE.finditer(attributes):  # of a repeated attribute the first holds
                found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        self.attributes = found
        style = declared(found["style"]) if "style" in found else {}
        display = style.get("display")
        self.gone = tag in UNSEEN or display == "none" or "hidden" in found and display is None
        self.unseen = {"hidden": True, "collapse": True, "visible": False}.get(style.get("visibility"))

    def number(self, name: str, default: int) -> int:
        value = self.attributes.get(name, "")
        return int(value) if re.fullmatch(r"-?\d{1,9}", value, re.A) else default


class Open:
    """The elements that are open. Beyond MAX_DEPTH they are no nodes of the tree: their text goes to the last that is one."""

    def __init__(self):
        self.nodes = [Node("html")]
        self.tags = Counter(["html"])
        self.unseen = [False]

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    @property
    def into(self) -> Node:
        """The node of the tree that takes what comes now."""
        return self.nodes[min(len(self.nodes), MAX_DEPTH) - 1]

    def add(self, node: Node, stays: bool) -> None:
        deep = len(self.nodes) >= MAX_DEPTH
        if not deep:
            self.top.children.append(node)
        elif node.tag in BLOCK or node.tag == "br":
            self.into.children.append(Node("div"))
        if stays:
            node.gone |= deep and self.top.gone
            self.nodes.append(node)
            self.tags[node.tag] += 1
            self.unseen.append(self.unseen[-1] if node.unseen is None else node.unseen)

    def text(self, text: str) -> None:
        top = self.top
        outside = len(self.nodes) > MAX_DEPTH and (top.gone or top.tag == "details" and "open" not in top.attributes)
        if not self.unseen[-1] and not outside:
            self.into.children.append(html.unescape(text) if "&" in text else text)

    def cut(self, k: int, end: int | None = None) -> None:
        """Close the k-th element and all within it, or up to another one."""
        for node in self.nodes[k:end]:
            self.tags[node.tag] -= 1
            if len(self.nodes) > MAX_DEPTH and node.tag in BLOCK:
                self.into.children.append(Node("div"))
        del self.nodes[k:end], self.unseen[k:end]

    def close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of these tags, and all within it, unless a stop lies between."""
        if not any(self.tags[t] for t in tags):
            return
        for k in range(len(self.nodes) - 1, 0, -1):
            tag = self.nodes[k].tag
            if tag in tags:
                self.cut(k)
                if "tr" in tags or "option" in tags:
                    continue
                return
            if tag in stop:
                return

    def end(self, tag: str) -> None:
        """An end tag."""
        if not self.tags[tag]:
            return
        blocks = False
        for k in range(len(self.nodes) - 1, 0, -1):
            open_ = self.nodes[k].tag
            if open_ == tag:
                # The end of formatting leaves the blocks within it open.
                self.cut(k, k + 1 if blocks and tag not in BLOCK else None)
                return
            if open_ in ("table", "template") and tag not in ("body", "html"):
                return
            blocks = blocks or open_ in BLOCK


def next_markup(page: str, at: int, last: int) -> tuple[re.Match | None, int, int]:
    """The next tag, comment or declaration, where the text before it ends, and where to go on.

    Only a comment may end without a '>', so nothing else is looked for behind the last one: each search ends at a '>'.
    A comment that is not closed hides all that follows.
    """
    m = MARKUP.search(page, at, last) if at < last else None
    if m and m[0].startswith("<!--") and not (m[0].endswith("-->") and len(m[0]) >= 7):
        return m, m.start(), len(page)
    if m:
        return m, m.start(), m.end()
    rest = page.find("<!--", max(at, last))
    return None, rest if rest >= 0 else len(page), len(page)


def build(page: str) -> Node:
    """The tree of a page, without invisible text."""
    open_ = Open()
    at, last = 0, page.rfind(">") + 1
    while True:
        m, until, after = next_markup(page, at, last)
        text = page[at:until]
        if text:
            if open_.top.tag == "head" and not text.isspace():
                open_.cut(len(open_.nodes) - 1)  # text ends a head that was not closed
            open_.text(text)
        if not m:
            return open_.nodes[0]
        at = after
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.end(tag)
            continue
        if tag == "html":
            continue
        if open_.top.tag == "head" and tag not in UNSEEN and tag not in ("meta", "link", "base"):
            open_.cut(len(open_.nodes) - 1)
        if tag in CLOSES:
            open_.close(*CLOSES[tag])
        if tag in BLOCK and tag not in KEEPS_PARAGRAPH:
            open_.close({"p"}, SCOPE)
        if tag in ("td", "th") and open_.top.tag in ("table", "thead", "tbody", "tfoot"):
            open_.add(Node("tr"), True)
        node = Node(tag, m[3].rstrip("/"))
        if open_.top.tag == "details" and "open" not in open_.top.attributes and tag != "summary":
            node.gone = True
        if tag in VOID:
            open_.add(node, False)
        elif tag in RAW_TEXT:
            open_.add(node, True)
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            raw = page[at : end.start() if end else len(page)]
            if tag in ("textarea", "xmp") and not node.gone:
                open_.text(raw.replace("&", "&amp;") if tag == "xmp" else raw)
            open_.cut(len(open_.nodes) - 1)
            at = page.find(">", end.end()) + 1 or len(page) if end else len(page)
        else:
            open_.add(node, tag in BLOCK or not m[3].endswith("/"))


class Layout:
    """Lines of text that grow as a tree is walked."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = 0  # blank lines wanted before the next text
        self.indent = 0
        self.mark = ""  # bullet or number that waits for the first text of its item

    def newline(self, blank: int = 0) -> None:
        text = "".join(self.line)
        self.line = []
        if text.strip():
            if self.lines and self.blank:
                self.lines.append("")
            pad = " " * max(0, min(self.indent, MOST_INDENT) - len(self.mark))
            self.lines.append((pad + self.mark + text.strip(" ")).rstrip())
            self.mark, self.blank = "", 0
        self.blank = max(self.blank, blank)

    def text(self, value: str) -> None:
        for k, part in enumerate(re.split(r"[ \t\n\r\f]+", value)):
            if k and self.line and not self.line[-1].endswith(" "):
                self.line.append(" ")
            if part:
                self.line.append(part)

    def block(self, lines: list[str]) -> None:
        """Lines that keep their spaces."""
        self.newline(1)
        indent = min(self.indent, MOST_INDENT)
        if any(x.strip() for x in lines):
            if self.lines:
                self.lines.append("")
            self.lines += [(" " * max(0, indent - len(self.mark)) + self.mark + x).rstrip() if not i and self.mark else (" " * indent + x).rstrip() for i, x in enumerate(lines)]
            self.mark, self.blank = "", 1


def shown(node: Node) -> Iterator[Node | str]:
    closed = node.tag == "details" and "open" not in node.attributes
    for c in node.children:
        if not closed if isinstance(c, str) else not c.gone:
            yield c


def walk(node: Node, out: Layout, lists: int = 0) -> None:
    tag = node.tag
    if tag == "br":
        out.newline()
        return
    if tag == "img":
        return
    if tag == "hr":
        out.newline(1)
        return
    if tag in ("pre", "textarea", "xmp"):
        lines = "".join(raw_text(node)).replace("\r\n", "\n").expandtabs().split("\n")
        while lines and not lines[0].strip():
            lines.pop(0)
        while lines and not lines[-1].strip():
            lines.pop()
        out.block(lines)
        return
    if tag == "table":
        out.block(table_lines(node, lists))
        return
    if tag in BLOCK:
        out.newline(1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 0)
    if tag in ("ul", "ol", "menu"):
        number = node.number("start", 1)
        for c in shown(node):
            if isinstance(c, str):
                out.text(c)
            elif c.tag == "li":
                out.newline()
                number = c.number("value", number)
                mark = f"{number}. " if tag == "ol" else "- "
                number += 1
                before, out.indent, out.mark = out.indent, out.indent + len(mark), mark
                for x in shown(c):
                    out.text(x) if isinstance(x, str) else walk(x, out, lists + 1)
                out.newline()
                out.indent, out.mark = before, ""
            else:
                walk(c, out, lists + 1)
    else:
        deeper = 2 if tag in ("blockquote", "dd") else 0
        out.indent += deeper
        for c in shown(node):
            out.text(c) if isinstance(c, str) else walk(c, out, lists)
        if deeper:
            out.newline()
            out.indent -= deeper
    if tag in BLOCK:
        out.newline(1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 0)


def raw_text(node: Node) -> Iterator[str]:
    for c in shown(node):
        if isinstance(c, str):
            yield c
        elif c.tag == "br":
            yield "\n"
        else:
            yield from raw_text(c)


def table_lines(table: Node, lists: int) -> list[str]:
    """The rows of a table with aligned columns; text outside of cells comes first."""
    rows: list[list[Node]] = []
    outside = Layout()

    def collect(node: Node) -> None:
        for c in shown(node):
            if isinstance(c, str):
                outside.text(c)
            elif c.tag == "tr":
                rows.append([x for x in shown(c) if isinstance(x, Node) and x.tag in ("td", "th")])
                for x in shown(c):
                    if isinstance(x, str):
                        outside.text(x)
                    elif x.tag not in ("td", "th"):
                        walk(x, outside, lists)
            elif c.tag in ("thead", "tbody", "tfoot"):
                collect(c)
            else:
                walk(c, outside, lists)

    collect(table)
    outside.newline()
    grid: list[list[tuple[int, int, list[str]]]] = []  # of each row its cells: first column, column behind, lines
    busy: list[tuple[int, int, int]] = []  # columns that cells of earlier rows span, and the row behind
    for r, cells in enumerate(rows):
        busy = sorted(b for b in busy if b[2] > r)
        placed, column, k, more = [], 0, 0, []
        for cell in cells:
            while k < len(busy) and busy[k][0] <= column:
                column, k = max(column, busy[k][1]), k + 1
            wide = min(max(1, cell.number("colspan", 1)), MAX_COLUMN_SPAN)
            high = cell.number("rowspan", 1)
            inner = Layout()
            for x in shown(cell):
                inner.text(x) if isinstance(x, str) else walk(x, inner, lists)
            inner.newline()
            placed.append((column, column + wide, inner.lines or [""]))
            if high > 1 or high == 0:
                more.append((column, column + wide, r + high if high else len(rows)))
            column += wide
        busy += more
        grid.append(placed)
    # Only columns where a cell begins or ends tell; what lies between two of them is one column.
    edges = sorted({x for placed in grid for a, b, _ in placed for x in (a, b)})
    place = {x: i for i, x in enumerate(edges)}
    spans = [[(place[a], place[b], lines) for a, b, lines in placed] for placed in grid]
    width = [0] * len(edges)
    for a, b, lines in sorted((x for placed in spans for x in placed), key=lambda x: (x[1] - x[0] > 1, x[1])):
        have = sum(width[a:b]) + 3 * (b - a - 1)  # a spanning cell widens its last column where the columns are too narrow for it
        width[b - 1] += max(0, max(map(len, lines)) - have)
    starts = [0, *accumulate(w + 3 for w in width)]
    out = list(outside.lines)
    for placed in spans:
        for k in range(max((len(lines) for _, _, lines in placed), default=0)):
            line = ""
            for a, _, lines in placed:
                if a:
                    line = line.ljust(starts[a] - 3) + " | "
                line += lines[k] if k < len(lines) else ""
            out.append(line.rstrip())
    return out


def visible_text(page: str | None) -> str:
    if not page:
        return ""
    out = Layout()
    walk(build(page), out)
    out.newline()
    return "\n".join(out.lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_lines) of every page; one pass without a shuffle."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            found = [visible_text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in found], pa.int64())], names=["id", "text", "n_lines"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, text string, n_lines long").withColumnRenamed("id", id_col)
