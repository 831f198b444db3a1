"""Visible text of web pages, laid out.

Each page is cut into tags and text, built into a tree (end tags implied where HTML implies them, unclosed and stray
tags tolerated) and rendered: hidden parts left out, blocks on lines of their own with a blank line where the page
has a margin, list items marked and indented, table cells aligned in columns, ``pre`` kept as it is.

Visibility: elements that show nothing by themselves, ``hidden``, closed ``details`` and ``dialog``, ``display: none`` and
``visibility`` (which a descendant may set back) of style attributes and of style sheets in the page, as far as their selectors
are lists of a tag, classes and an id; rules inside ``@`` blocks and with other selectors are passed by. A drop-down list shows its
chosen option, a list box all of them; text fields and buttons show their value.

Tables: ``colspan`` and ``rowspan`` keep columns in place; a cell may hold several lines, lists, ``pre`` or tables of its own.

A page is a row's work, so the operator is one scan without a shuffle. Edge cases: a null or empty page has an empty
text and a null title; broken markup is read as browsers do in spirit (a lone ``<`` is text); nesting of any depth
works in linear time, as no step recurses or searches the open elements; null ids, repeated rows and other columns do no harm; an
empty table gives no rows.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |</(?P<end>[A-Za-z][^\s>/]*)[^>]*(?:>|\Z)
    |<(?P<tag>[A-Za-z][^\s>/]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<odd>[A-Za-z][^\s>/]*)[^>]*(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([A-Za-z][A-Za-z0-9]*|\*)?((?:[.#][A-Za-z_-][A-Za-z0-9_-]*)*)")
_PART = re.compile(r"([.#])([A-Za-z0-9_-]+)")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")

# Fixed values of the HTML standard: void elements, raw-text elements, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template head noscript iframe object datalist svg math audio video canvas noembed noframes".split())
PRE = frozenset("pre xmp listing textarea".split())
SHOWN_INPUTS = frozenset("text search url tel email number submit button reset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption xmp listing".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset menu xmp listing".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption li dd dt".split())
# start tag -> (open elements that it ends, elements that stop the search)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}


MOST_INDENT = 80


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attrs(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(rest)} if rest.strip(" /\n\t") else {}


class Path:
    """The open elements, with their places by tag, so that nothing is ever searched for."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def top(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def open(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, at: int) -> None:
        for n in self.nodes[at:]:
            self.places[n.tag].pop()
        del self.nodes[at:]

    def imply(self, ends: set[str], stops: set[str]) -> None:
        """Close the innermost open element of ``ends`` if none of ``stops`` is open inside it, and those of ``ends`` right around it."""
        at = self.top(ends)
        if at > self.top(stops):
            while at > 1 and self.nodes[at - 1].tag in ends:
                at -= 1
            self.close(at)


CELL = frozenset({"td", "th", "table"})
ENDS_CELLS = frozenset("table tr tbody thead tfoot body html td th".split())
P_STOPS = frozenset("table td th button object".split())


def parse(page: str) -> tuple[Node, str | None]:
    """(tree, title)."""
    root, title = Node("#root", {}), None
    path, at, size = Path(root), 0, len(page)

    def text(s: str) -> None:
        if s:
            path.nodes[-1].children.append(s)

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m["end"]:
            tag = m["end"].lower()
            place = path.top((tag,))
            if place and (tag in ENDS_CELLS or path.top(CELL) < place):
                path.close(place)
            continue
        tag = (m["tag"] or m["odd"] or "").lower()
        if not tag:
            continue
        if tag in CLOSES_P:
            path.imply({"p"}, P_STOPS)
        if tag in IMPLIED:
            path.imply(*IMPLIED[tag])
        node = Node(tag, _attrs(m["rest"] or ""))
        path.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I).search(page, at)
            inside = page[at : end.start() if end else size]
            at = end.end() if end else size
            if tag == "title" and title is None:
                title = _SPACE.sub(" ", html.unescape(inside)).strip()
            elif tag in ("textarea", "style"):
                node.children.append(inside)
            elif tag == "xmp":
                node.children.append(html.escape(inside, quote=False))  # its text has no entities
        elif tag not in VOID:
            path.open(node)
    return root, title


class Styles:
    """Display and visibility by the style sheets of a page and the elements' own style attributes."""

    def __init__(self, root: Node):
        self.rules: dict[str, list] = {}  # by the last class or id of the selector, else its tag
        stack, number = [root], 0
        while stack:
            node = stack.pop()
            if node.tag == "style" and not re.search("print|speech", node.attrs.get("media", ""), re.I):
                for selectors, body in _RULE.findall(_flat(_COMMENT.sub("", "".join(node.children)))):
                    declared = _declared(body)
                    for selector in selectors.split(",") if declared else ():
                        m = _SELECTOR.fullmatch(selector.strip())
                        if m and m[0]:
                            parts = _PART.findall(m[2])
                            tag = (m[1] or "*").lower()
                            weight = (sum(k == "#" for k, _ in parts), sum(k == "." for k, _ in parts), int(tag != "*"), number)
                            key = "".join(parts[-1]) if parts else tag
                            self.rules.setdefault(key, []).append((weight, tag, frozenset(parts), declared))
                            number += 1
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]

    def of(self, node: Node) -> dict[str, str]:
        """``display`` and ``visibility`` as far as they are set for the element."""
        own = node.attrs.get("style")
        if not self.rules and not own:
            return {}
        hits = []
        if self.rules:
            has = {(".", c) for c in node.attrs.get("class", "").split()} | ({("#", node.attrs["id"])} if "id" in node.attrs else set())
            for key in ("*", node.tag, *("".join(p) for p in has)):
                hits += [r for r in self.rules.get(key, ()) if r[1] in ("*", node.tag) and r[2] <= has]
        hits.sort(key=lambda r: r[0])
        sets = [r[3] for r in hits] + ([_declared(own)] if own else [])
        found = {}
        for important in (False, True):
            for declared in sets:
                found |= {k: v for k, (v, strong) in declared.items() if strong == important}
        return found


def _flat(css: str) -> str:
    """A style sheet without ``@`` rules and blocks."""
    out, at, depth = [], 0, 0
    for m in re.finditer(r"@[^{};]*[{;]|[{}]", css):
        if depth == 0 and m[0][0] == "@":
            out.append(css[at : m.start()])
            at, depth = m.end(), int(m[0].endswith("{"))
        elif depth and m[0] == "}":
            depth -= 1
            at = m.end()
        elif depth:
            depth += m[0].endswith("{")
    return "".join(out) + (css[at:] if depth == 0 else "")


def _declared(body: str) -> dict[str, tuple[str, bool]]:
    return {m[1].lower(): (m[2].lower(), bool(m[3])) for m in _DECLARED.finditer(body)}


class Lines:
    """Rendered lines of a page or a cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.gap = False  # white space is due before the next inline text
        self.margin = False
        self.indent = 0
        self.mark = ""

    def add(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.split("\n")
            self.words.append(first)
            for line in more:
                self.end(keep=True)
                self.words.append(line)
            return
        body = _SPACE.sub(" ", s)
        if body.startswith(" "):
            self.gap = True
        if word := body.strip(" "):
            self.words.append((" " if self.gap and self.words else "") + word)
            self.gap = body.endswith(" ")

    def end(self, keep: bool = False) -> None:
        line = "".join(self.words).rstrip()
        self.words, self.gap = [], False
        if not line and not keep:
            return
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = False
        pad = " " * min(self.indent, MOST_INDENT)
        self.lines.append((pad[: -len(self.mark)] if self.mark else pad) + self.mark + line if line else "")
        self.mark = ""

    def block(self, spaced: bool) -> None:
        self.end()
        self.margin |= spaced


class Cell:
    __slots__ = ("lines", "wide", "high")

    def __init__(self, lines: list[str], wide: int, high: int):
        self.lines, self.wide, self.high = lines, wide, high


def _span(node: Node, name: str, most: int) -> int:
    n = node.attrs.get(name, "1").strip()
    return max(1, min(int(n), most)) if n.isascii() and n.isdigit() and len(n) < 9 else 1


def _grid(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table: cells in columns, those that span rows keep their columns in the rows below."""
    placed: list[list[tuple[int, Cell]]] = []
    taken: dict[int, int] = {}  # column -> rows below that a cell above still covers
    for row in rows:
        column, out, covers = 0, [], {}
        for cell in row:
            while taken.get(column, 0):
                column += 1
            out.append((column, cell))
            if cell.high > 1:
                covers |= dict.fromkeys(range(column, column + cell.wide), cell.high - 1)
            column += cell.wide
        placed.append(out)
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | covers
    widths: dict[int, int] = {}
    for wide in (False, True):
        for column, cell in (x for row in placed for x in row if (x[1].wide > 1) == wide):
            own = max(map(len, cell.lines), default=0)
            room = sum(widths.get(c, 0) + 2 for c in range(column, column + cell.wide)) - 2
            last = column + cell.wide - 1
            widths[last] = max(widths.get(last, 0), widths.get(last, 0) + own - room)
    starts, at = {}, 0
    for c in range(max(widths, default=-1) + 1):
        starts[c] = at
        at += widths.get(c, 0) + 2
    lines = []
    for row in placed:
        for i in range(max((len(cell.lines) for _, cell in row), default=0)):
            line = ""
            for column, cell in row:
                if i < len(cell.lines) and cell.lines[i]:
                    line = line.ljust(starts[column]) + cell.lines[i]
            lines.append(line.rstrip())
    return lines


def _options(select: Node) -> list[Node]:
    """Options and labelled groups of a list, in order."""
    found, stack = [], [select]
    while stack:
        node = stack.pop()
        if node.tag in ("option", "optgroup") and node is not select:
            found.append(node)
        if node.tag != "option":
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return found


def _option_text(node: Node) -> str:
    return html.unescape("".join(c for c in node.children if isinstance(c, str))) or node.attrs.get("label", "")


def _select(out: Lines, select: Node) -> None:
    found = _options(select)
    if "multiple" in select.attrs or _span(select, "size", 1000) > 1:
        for node in found:
            out.end()
            out.add(node.attrs.get("label", "") if node.tag == "optgroup" else _option_text(node), False)
        out.end()
        return
    options = [n for n in found if n.tag == "option"]
    chosen = [n for n in options if "selected" in n.attrs][-1:] or [n for n in options if "disabled" not in n.attrs][:1]
    for node in chosen:
        out.add(_option_text(node), False)


def render(root: Node) -> tuple[str, int]:
    """(visible text, tables) of a tree."""
    page, styles = Lines(), Styles(root)
    sinks, tables = [page], 0
    lists: list[list] = []  # [kind, number]
    grids: list[list[list[Cell]]] = []
    cells: list[int] = []
    pres = 0
    stack: list[tuple[Node, int, bool]] = [(root, 0, True)]
    while stack:
        node, i, seen = stack.pop()
        out = sinks[-1]
        if i < len(node.children):
            stack.append((node, i + 1, seen))
            child = node.children[i]
            if isinstance(child, str):
                if seen and (node.tag != "details" or "open" in node.attrs):
                    out.add(html.unescape(child), pres > 0)
                continue
            tag = child.tag
            if tag in UNSEEN or "hidden" in child.attrs or child.attrs.get("aria-hidden") == "true" or (tag == "dialog" and "open" not in child.attrs):
                continue
            if node.tag == "details" and "open" not in node.attrs and child is not next((c for c in node.children if not isinstance(c, str) and c.tag == "summary"), None):
                continue
            style = styles.of(child)
            if style.get("display") == "none":
                continue
            seen = style.get("visibility", "visible" if seen else "hidden") not in ("hidden", "collapse")
            if tag == "br":
                out.end(keep=True)
                continue
            if tag in BLOCKS:
                out.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
            if tag == "select":
                if seen:
                    _select(out, child)
                continue
            if tag == "input":
                if seen and child.attrs.get("type", "text").lower() in SHOWN_INPUTS:
                    out.add(child.attrs.get("value", ""), False)
                continue
            if tag in ("ul", "ol", "menu"):
                start = child.attrs.get("start", "1")
                lists.append([tag, int(start) if start.isascii() and start.isdigit() and len(start) < 10 else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                out.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                out.indent += max(2, len(out.mark))
                stack.append((Node("#outdent", {"n": max(2, len(out.mark))}), 0, seen))
            elif tag in ("dd", "blockquote"):
                out.indent += 2
                stack.append((Node("#outdent", {"n": 2}), 0, seen))
            elif tag == "table":
                grids.append([])
                tables += 1
            elif tag == "tr" and grids:
                grids[-1].append([])
            elif tag in ("td", "th") and grids:
                sinks.append(Lines())
                cells.append(id(child))
            elif tag in PRE:
                pres += 1
            stack.append((child, 0, seen))
            continue
        # the end of an element
        tag = node.tag
        if tag == "#outdent":
            out.end()
            out.indent -= node.attrs["n"]
            out.mark = ""
        elif tag in ("td", "th") and cells and cells[-1] == id(node):
            cells.pop()
            sinks.pop()
            out.end()
            if not grids[-1]:
                grids[-1].append([])
            lines = out.lines
            while lines and not lines[-1].strip():
                lines.pop()
            first = next((k for k, line in enumerate(lines) if line.strip()), 0)
            grids[-1][-1].append(Cell(lines[first:], _span(node, "colspan", 100), _span(node, "rowspan", 65534)))
        elif tag == "table" and grids:
            lines = _grid(grids.pop())
            out.end()
            for line in lines:
                out.words = [line]
                out.end()
            out.margin = True
        elif tag in ("ul", "ol", "menu") and lists:
            lists.pop()
            out.block(not lists)
        elif tag in PRE:
            pres -= 1
            if tag in BLOCKS:
                out.block(True)
        elif tag in BLOCKS:
            out.block(tag in SPACED)
    page.end()
    return "\n".join(page.lines), tables


def _extract(batches):
    for batch in batches:
        titles, texts, blocks, tables = [], [], [], []
        for page in batch.column("html"):
            tree, title = parse(page.as_py() or "")
            text, n = render(tree)
            titles.append(title)
            texts.append(text)
            blocks.append(sum(1 for b in text.split("\n\n") if b.strip()))
            tables.append(n)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                pa.array(titles, pa.string()),
                pa.array(texts, pa.string()),
                pa.array(blocks, pa.int32()),
                pa.array(tables, pa.int32()),
            ],
            ["page_id", "title", "text", "n_blocks", "n_tables"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title, text, n_blocks, n_tables of every page (page_id, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, title string, text string, n_blocks int, n_tables int"
    return pages.select("page_id", "html").mapInArrow(_extract, schema)
