"""Layout-aware rendering of HTML to text (operator 8).

A tokenizer and a tree builder with implied end tags make an element tree; visibility rules drop what a browser would not
paint; the renderer walks the tree without recursion and keeps block spacing, list markers with nesting, preformatted text and table
cells aligned in columns.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, text_of

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INVISIBLE = frozenset("head script style template noscript iframe noembed noframes object canvas audio video map datalist title meta link base desc defs metadata symbol annotation annotation-xml".split())
#: limit of HTML itself for the columns that a cell spans
MOST_COLUMNS = 1000
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
#: start tag -> elements that it closes when they are open inside the given scope
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
TABLE_PARTS = frozenset("table colgroup tbody thead tfoot tr".split())
#: table elements and the parents, within the table, that they go into
TABLE_PARENTS = {
    "td": {"tr"}, "th": {"tr"}, "tr": {"tbody", "thead", "tfoot", "table"}, "col": {"colgroup", "table"},
    "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "colgroup": {"table"}, "caption": {"table"},
}
STAYS_IN_TABLE = TABLE_PARENTS.keys() | {"style", "script", "template", "form"}
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|opacity\s*:\s*0(?:\.0*)?\s*(?:;|$)|font-size\s*:\s*0)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
MAX_DEPTH = 400  # deeper elements are attached to the element at this depth: nothing is lost but nesting


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def parse(html: str) -> Node:
    """Element tree of a page; every input gives one."""
    root = Node("#root")
    stack, pos, n = [root], 0, len(html)
    while pos < n:
        lt = html.find("<", pos)
        if lt < 0:
            insert(stack, unescape(html[pos:]))
            break
        if lt > pos:
            insert(stack, unescape(html[pos:lt]))
        m = TOKEN.match(html, lt)
        if not m:
            insert(stack, "<")
            pos = lt + 1
            continue
        pos = m.end()
        if m.group(2):
            tag = m.group(2).lower()
            raw = m.group(3)
            attrs = {k.lower(): unescape(a or b or c or "") for k, a, b, c in reversed(ATTRIBUTE.findall(raw))} if raw and not raw.isspace() else {}
            open_tag(stack, tag)
            node = Node(tag, attrs)
            in_table = stack[-1].tag in TABLE_PARTS
            insert(stack, node)
            if tag in VOID or (tag == "form" and in_table):
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, pos)
                stop = end.start() if end else n
                node.children.append(html[pos:stop] if tag not in ("textarea", "title") else unescape(html[pos:stop]))
                close = html.find(">", stop)
                pos = n if close < 0 or not end else close + 1
                continue
            if len(stack) < MAX_DEPTH and not (raw and raw.rstrip().endswith("/") and tag in ("svg", "math", "path")):
                stack.append(node)
        elif m.group(1):
            close_tag(stack, m.group(1).lower())
    return root


def open_tag(stack: list[Node], tag: str) -> None:
    """Close what the start tag implies to be closed."""
    if tag in CLOSES_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in ("td", "th", "table", "button", "object", "li"):
                break
    if tag in IMPLIED:
        closing, scope = IMPLIED[tag]
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in scope:
                break
            if stack[i].tag in closing:
                cut = i
        if cut is not None:
            del stack[cut:]
    if tag in TABLE_PARENTS:
        table_context(stack, tag)
    elif tag == "table" and stack[-1].tag in TABLE_PARTS:
        close_tag(stack, "table")


def table_context(stack: list[Node], tag: str) -> None:
    """Close what stands between a table element and its parent; a cell outside a row gets a row."""
    place = None
    for i in range(len(stack) - 1, 0, -1):
        if place is None and stack[i].tag in TABLE_PARENTS[tag]:
            place = i
        if stack[i].tag == "table":
            break
    else:
        return
    if place is None:
        table_context(stack, "tr")
        row = Node("tr")
        stack[-1].children.append(row)
        stack.append(row)
    else:
        del stack[place + 1 :]


def insert(stack: list[Node], child: Node | str) -> None:
    """Append to the open element; what is no part of a table but stands between its parts goes before the table."""
    if stack[-1].tag in TABLE_PARTS and (child.strip() if isinstance(child, str) else child.tag not in STAYS_IN_TABLE):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "table":
                around = stack[i - 1].children
                at = len(around) - 1
                while at >= 0 and around[at] is not stack[i]:
                    at -= 1
                around.insert(at if at >= 0 else len(around), child)
                return
    stack[-1].children.append(child)


def close_tag(stack: list[Node], tag: str) -> None:
    if tag == "br":
        insert(stack, Node("br"))
        return
    barrier = {"table"} if tag not in ("table", "body", "html") else set()
    if tag in ("b", "i", "em", "strong", "a", "span", "font", "u", "small", "code"):
        barrier = BLOCK - {"p"}
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in barrier:
            return


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in INVISIBLE or (node.tag == "dialog" and "open" not in a) or (node.tag == "input"):
        return False
    if a and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or ("style" in a and HIDDEN_STYLE.search(a["style"]))):
        return False
    return True


class Page:
    """Lines under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.pending_space = False
        self.blank = False
        self.indent = ""
        self.marker = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._put(first)
            for r in rest:
                self.newline(keep=True)
                self._put(r)
            return
        flat = SPACES.sub(" ", s)
        if flat.startswith(" "):
            self.pending_space = True
        core = flat.strip(" ")
        if core:
            self._put((" " if self.pending_space and self.line else "") + core)
            self.pending_space = flat.endswith(" ")

    def _put(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.blank and self.lines and self.lines[-1]:
                self.lines.append("")
            self.blank = False
            self.line = (self.indent[:-2] if self.marker else self.indent) + self.marker
            self.marker = ""
        self.line += s

    def newline(self, keep: bool = False) -> None:
        if self.line:
            self.lines.append(self.line.rstrip())
        elif keep:
            self.lines.append("")
        self.line, self.pending_space = "", False

    def block(self, spaced: bool) -> None:
        self.newline()
        self.blank = self.blank or spaced

    def result(self) -> str:
        self.newline()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return "\n".join(self.lines)


def render(node: Node, depth: int = 0) -> str:
    """Text of a subtree as it would be laid out."""
    page = Page()
    work: list = [("open", child, False, 0) for child in reversed(node.children)]
    lists: list[list] = []
    while work:
        what, x, pre, _ = work.pop()
        if what == "close":
            tag = x.tag
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if tag in ("li", "dd", "blockquote"):
                page.block(False)
                page.indent, page.marker = page.indent[:-2], ""
            if tag in BLOCK:
                page.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            continue
        if isinstance(x, str):
            page.text(x, pre)
            continue
        if not visible(x):
            continue
        tag = x.tag
        if tag == "br":
            page.newline(keep=not page.line)
        elif tag == "img":
            if x.attrs.get("alt", "").strip():
                page.text(f"[{x.attrs['alt'].strip()}]", False)
        elif tag == "hr":
            page.block(True)
            page.text("---", False)
            page.block(True)
        elif tag == "table":
            page.block(True)
            grid = render_table(x, depth)
            page.text(grid, True) if grid else None
            page.block(True)
        else:
            if tag in BLOCK:
                page.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag, whole_number(x.attrs.get("start", ""), 1)])
            elif tag == "li":
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] = whole_number(x.attrs.get("value", ""), lists[-1][1])
                    page.marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    page.marker = "- "
                page.indent += "  "
            elif tag in ("dd", "blockquote"):
                page.indent += "  "
            work.append(("close", x, pre, 0))
            inner = pre or tag in ("pre", "textarea", "listing")
            work.extend(("open", child, inner, 0) for child in reversed(shown(x)))
    return page.result()


def whole_number(text: str, default: int) -> int:
    text = text.strip()
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text) else default


def shown(node: Node) -> list:
    """The children that are painted: of closed details the summary, of a drop-down list the chosen option."""
    if node.tag == "details" and "open" not in node.attrs:
        return next(([c] for c in node.children if isinstance(c, Node) and c.tag == "summary"), [])
    if node.tag == "select":
        options, todo = [], list(reversed(node.children))
        while todo:
            c = todo.pop()
            if isinstance(c, Node) and c.tag == "option":
                options.append(c)
            elif isinstance(c, Node):
                todo.extend(reversed(c.children))
        if "multiple" in node.attrs or whole_number(node.attrs.get("size", ""), 1) > 1:
            return [x for o in options for x in (o, Node("br"))]
        return [o for o in options if "selected" in o.attrs][-1:] or options[:1]
    return node.children


def rows_of(node: Node):
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, Node) and visible(c):
            if c.tag in ("tr", "caption"):
                yield c
            elif c.tag != "table":
                todo.extend(reversed(c.children))


def render_table(node: Node, depth: int) -> str:
    """Rows as lines, cells padded to their column's width; a cell that spans rows leaves its columns empty in the rows below. The depth of the tree bounds the nesting."""
    out, grid = [], []
    taken: dict[int, int] = {}  # column -> rows below that a cell above still covers
    for row in rows_of(node):
        if row.tag == "caption":
            out.append(render(row, depth + 1))
            continue
        cells: list[str] = []
        below: dict[int, int] = {}

        def fill(cells=cells):
            while taken.get(len(cells), 0):
                cells.append("")

        for c in row.children:
            if isinstance(c, Node) and c.tag in ("td", "th") and visible(c):
                fill()
                columns = min(max(1, whole_number(c.attrs.get("colspan", ""), 1)), MOST_COLUMNS)
                rows = whole_number(c.attrs.get("rowspan", ""), 1)
                if rows > 1 or rows == 0:  # 0: to the end of the table
                    below |= dict.fromkeys(range(len(cells), len(cells) + columns), rows - 1 if rows else 1 << 30)
                cells += [render(c, depth + 1)] + [""] * (columns - 1)
        fill()
        taken = {k: n - 1 for k, n in taken.items() if n > 1} | below
        grid.append(cells)
    if len({len(r) for r in grid}) == 1 and grid and len(grid[0]) == 1:
        return "\n".join(out + [r[0] for r in grid])
    width: dict[int, int] = {}
    for cells in grid:
        for i, c in enumerate(cells):
            width[i] = max([width.get(i, 0), *(min(len(line), 80) for line in c.split("\n"))])
    for cells in grid:
        parts = [c.split("\n") for c in cells]
        for k in range(max((len(p) for p in parts), default=0)):
            out.append("  ".join((p[k] if k < len(p) else "").ljust(width[i]) for i, p in enumerate(parts)).rstrip())
    return "\n".join(out)


def html_to_text(html: str) -> str:
    return render(parse(html))


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and the visible text of every page. Null and empty pages give an empty text; malformed markup never fails; ids may be null or repeat; an empty table gives none."""
    kind = dict(df.dtypes)[id_col]

    def run(batch):
        return {id_col: batch.column(0), "text": [html_to_text(h) for h in batch.column(1).to_pylist()]}

    return map_batches(df.select(F.col(id_col), text_of(html_col)), run, f"{id_col} {kind}, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
