"""HTML to text as a page is laid out (operator 9).

A tolerant tree builder (implied and missing tags, void and raw-text elements) is followed by a renderer that leaves
out what a browser does not show and lays the rest out: blocks on lines of their own with blank lines where margins are,
lists with markers and indents, preformatted text as it is, and table cells in aligned columns, with colspan and rowspan. All visible
text is kept, navigation and footers too. Every step is a loop with a stack and works in time linear in the page but for indents and
padding, so deep nesting does no harm: the builder knows the places of the open elements by tag, and tables are laid out from the innermost.

Visibility: hidden attributes, closed dialogs and details, elements without text of their own (``HIDDEN``), and display and visibility
from style attributes and style elements, by the cascade's order. Of style elements, selectors of one element (tag, classes, id) count;
at-rules other than for screens and selectors of several elements do not. Visibility is inherited, so a visible child of a hidden
parent shows. In a drawing (svg) only text elements show, each on a line.

Defined cases: a null or empty page gives an empty text. An unfinished tag or comment ends with the page. Layout has three widths that keep
a page's text bounded and lose none of it: a column counts as at most ``WIDEST`` characters wide, and a wider cell moves the rest of its line;
a run of blanks before a cell has at most ``GAP``; indents at most ``INDENT``. Rows are independent, so repeated rows and null page_ids stay; extra
columns pass through, text and n_chars are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDEST, GAP, INDENT = 80, 400, 80
#: The greatest spans that HTML knows.
COLSPAN, ROWSPAN = 1000, 65534

#: A quote delimits a value only directly after the equals sign; anywhere else it is a letter like others.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])[^\s>]*+))?+|=)*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""(=?[^\s=>/]++)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|((?!["'])[^\s>]*+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas datalist title meta link noembed noframes rp annotation annotation-xml".split())
#: What a drawing defines and does not show, and what shows text in it.
DEFINED, INK = frozenset("defs symbol desc metadata clippath mask marker pattern".split()), frozenset({"text", "foreignobject"})
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table ul xmp caption tr".split()
)
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre xmp table figure hr fieldset".split())
#: What an opening tag closes, and where looking for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot", "caption", "colgroup")},
}
ENDS_P = BLOCK - {"option", "tr", "caption", "body", "html", "legend"}
#: An end tag of something outside does not close these.
WALLS = frozenset({"table", "td", "th", "caption", "template", "html"})
INLINE_WALLS = WALLS | (BLOCK - {"p", "li"})
PARTS = frozenset({"table", "tr", "thead", "tbody", "tfoot"})
GROUPS = frozenset({"thead", "tbody", "tfoot"})
LISTS = frozenset({"ul", "ol", "menu", "dir"})


class Node:
    """An element. Until the page's visibility is known it counts as ``gone``; ``ink`` tells whether its own text shows."""

    __slots__ = ("attributes", "children", "gone", "ink", "lines", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []
        self.gone, self.ink, self.lines = True, False, None


class Open:
    """The open elements, and by tag their places among them, so that the innermost of a tag is found without a walk."""

    def __init__(self, root: Node):
        self.stack, self.places, self.walls = [root], {}, []

    def add(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in INLINE_WALLS:
            self.walls.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        places = self.places
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(self, tags, wall: int) -> bool:
        """Close the innermost of ``tags``, and all within, unless it is outside of the place ``wall``."""
        at = self.last(tags)
        if not at or at < wall:
            return False
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in INLINE_WALLS:
                self.walls.pop()
        return True


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    opened = Open(root)
    stack, places = opened.stack, opened.places
    at, n = 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if found.start() > at:
            stack[-1].children.append(html.unescape(page[at : found.start()]))
        at = found.end()
        if not found[2]:
            continue
        if not found[0].endswith(">"):
            break  # an unfinished tag
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag in BLOCK or tag in CLOSES:
                opened.close((tag,), opened.last((WALLS if tag not in PARTS else {"table", "html"}) - {tag}))
            else:
                opened.close((tag,), opened.walls[-1] if opened.walls else 0)
            continue
        attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(ATTRIBUTE.findall(found[3]))} if found[3] else {}
        if tag in ENDS_P and places.get("p"):
            opened.close(("p",), opened.last(WALLS | {"button"}))
        if tag in CLOSES:
            tags, walls = CLOSES[tag]
            while opened.close(tags, opened.last(walls | {"table"} - tags)) and tag not in ("li", "dt", "dd"):
                pass
        if tag in ("td", "th") and stack[-1].tag != "tr" and places.get("table"):
            opened.add(Node("tr"))
        node = Node(tag, attributes)
        if tag in RAW:
            stack[-1].children.append(node)
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            body = page[at : end.start() if end else n]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = end.end() if end else n
        elif tag in VOID or found[0].endswith("/>") and (tag in ("svg", "math") or places.get("svg") or places.get("math")):
            stack[-1].children.append(node)
        else:  # outside of drawings and formulas the slash of an element that can have content has no meaning
            opened.add(node)
    return root


# Visibility

COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SELECTOR = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)")
SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:screen|all)\s*", re.I)


def declarations(text: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a list of declarations: (important, value), the last of the most important."""
    out: dict[str, tuple[bool, str]] = {}
    for part in text.lower().split(";"):
        name, _, value = part.partition(":")
        if (name := name.strip()) in ("display", "visibility"):
            value, _, mark = value.partition("!")
            now = (mark.strip() == "important", value.strip())
            if value.strip() and (name not in out or now[0] >= out[name][0]):
                out[name] = now
    return out


class Sheet:
    """The rules of a page's style elements that concern visibility, by their id, a class, or their tag."""

    def __init__(self, texts: list[str]):
        self.rules: dict[str, list[tuple]] = {}
        self.known: dict[tuple, dict] = {}
        order = 0
        for text in texts:
            opened: list[str] = []
            skip = 0
            for found in re.finditer(r"([^{}]*+)([{}])", COMMENT.sub(" ", text)):
                words, brace = found[1].rpartition(";")[2].strip() if found[2] == "{" else found[1], found[2]
                if brace == "{":
                    opened.append(words)
                    skip += words.startswith("@") and not SCREEN.fullmatch(words)
                elif opened:
                    selectors = opened.pop()
                    if selectors.startswith("@"):
                        skip -= not SCREEN.fullmatch(selectors)
                    elif not skip and (told := declarations(words)):
                        for s in selectors.split(","):
                            order += 1
                            self._add(s.strip(), told, order)

    def _add(self, selector: str, told: dict, order: int) -> None:
        found = SELECTOR.fullmatch(selector)
        if not selector or found is None:
            return
        names = re.findall(r"[.#][\w-]+", found[2])
        ids, classes = [x[1:] for x in names if x[0] == "#"], frozenset(x[1:] for x in names if x[0] == ".")
        tag = (found[1] or "*").lower()
        if len(set(ids)) > 1:
            return
        key = "#" + ids[0] if ids else "." + max(classes) if classes else tag
        self.rules.setdefault(key, []).append((tag, classes, (len(ids), len(classes), tag != "*", order), told))

    def of(self, node: Node) -> dict[str, tuple]:
        """(importance and rank, value) of the rules that match a node."""
        a = node.attributes
        if not self.rules:
            return {}
        who = (node.tag, a.get("id", ""), a.get("class", ""))
        if (out := self.known.get(who)) is None:
            out = self.known[who] = {}
            classes = set(who[2].split())
            for key in ("#" + who[1], *("." + c for c in classes), who[0], "*"):
                for tag, needs, rank, told in self.rules.get(key, ()):
                    if tag in ("*", who[0]) and needs <= classes:
                        for name, (important, value) in told.items():
                            now = ((important, rank), value)
                            if name not in out or now > out[name]:
                                out[name] = now
        return out


def show(root: Node) -> list[Node]:
    """Tell of every element whether it shows; returns the tables, outer ones first."""
    texts, queue = [], [root]
    while queue:
        for x in queue.pop().children:
            if isinstance(x, Node):
                if x.tag == "style":
                    texts += x.children
                elif x.children:
                    queue.append(x)
    sheet = Sheet([t for t in texts if "display" in t.lower() or "visibility" in t.lower()])
    tables = []
    # a node, whether visibility is inherited as visible, and whether its text is drawn
    queue = [(root, True, True)]
    while queue:
        node, seen, drawn = queue.pop()
        tag, a = node.tag, node.attributes
        told = sheet.of(node)
        if "style" in a:
            told = dict(told)
            for name, (important, value) in declarations(a["style"]).items():
                now = ((important, (9,)), value)
                if name not in told or now > told[name]:
                    told[name] = now
        display = told["display"][1] if "display" in told else "none" if "hidden" in a and a["hidden"].lower() != "until-found" or tag == "dialog" and "open" not in a else ""
        if tag in HIDDEN or display == "none":
            continue
        if "visibility" in told and told["visibility"][1] not in ("inherit", "unset"):
            seen = told["visibility"][1] not in ("hidden", "collapse")
            if tag in PARTS and tag != "table" and told["visibility"][1] == "collapse":
                continue
        if tag == "svg":
            drawn = False
        elif not drawn and tag in INK:
            drawn = True
        elif not drawn and tag in DEFINED:
            continue
        node.gone, node.ink = False, seen and drawn
        if tag == "table":
            tables.append(node)
        queue += [(x, seen, drawn) for x in reversed(_children(node)) if isinstance(x, Node)]
    return tables


def _children(node: Node) -> list:
    """The children that can show: of closed details the first summary."""
    if node.tag == "details" and "open" not in node.attributes:
        return [x for x in node.children if isinstance(x, Node) and x.tag == "summary"][:1]
    return node.children


# Layout


class Page:
    """Lines under way, with what is due before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False
        self.ends_in_space = True
        self.widths: list[int] = []
        self.width = 0
        self.marks: list[str] = []

    def indent(self, mark: str) -> None:
        """Later lines are indented by a mark's width; the first of them bears the mark."""
        self.widths.append(len(mark))
        self.marks.append(mark)

    def outdent(self) -> None:
        width = self.widths.pop()
        if self.marks:
            self.marks.pop()  # no line was made under it
        else:
            self.width -= width

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if self.ends_in_space:
            s = s.lstrip(" ")
        if s:
            self.now.append(s)
            self.ends_in_space = s.endswith(" ")

    def line(self, s: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = " " * min(self.width, INDENT)
        if self.marks:
            lead += "".join(self.marks)
            self.width += sum(map(len, self.marks))
            self.marks.clear()
        self.lines.append((lead + s).rstrip(" "))

    def block(self, lines: list[str]) -> None:
        """Lines that are laid out already, set off by blank ones."""
        self.edge(True)
        if lines:
            self.line(lines[0])
            lead = " " * min(self.width, INDENT)
            self.lines += [(lead + x).rstrip(" ") for x in lines[1:]] if lead else lines[1:]
            self.blank = True

    def flush(self) -> None:
        s = "".join(self.now).rstrip(" ")
        self.now.clear()
        self.ends_in_space = True
        if s:
            self.line(s)

    def br(self) -> None:
        before = len(self.lines)
        self.flush()
        if len(self.lines) == before and self.lines and self.lines[-1]:
            self.lines.append("")

    def edge(self, margin: bool) -> None:
        self.flush()
        self.blank |= margin


def render(root: Node) -> list[str]:
    """The visible text of a node, in lines; tables within it are laid out already."""
    page = Page()
    pre = 0
    stack: list[tuple[Node | str | None, Node | None]] = [(x, root) for x in reversed(root.children)]
    counts: list[int | None] = []
    while stack:
        node, parent = stack.pop()
        if isinstance(node, str):
            if not parent.ink:
                continue
            if pre:
                first, *more = node.split("\n")
                page.now.append(first)
                for x in more:
                    s = "".join(page.now)
                    page.now.clear()
                    page.line(s) if s or page.lines else None
                    page.now.append(x)
                page.ends_in_space = False
            else:
                page.text(node)
            continue
        if node is None:  # the end of ``parent``
            tag = parent.tag
            if tag in BLOCK or tag in ("td", "th") or tag == "text":
                page.edge(tag in MARGIN and not (tag in LISTS and len(counts) > 1))
            if tag in ("pre", "xmp"):
                pre -= 1
            if tag in LISTS:
                counts.pop()
            if tag in ("li", "dd", "blockquote"):
                page.outdent()
            continue
        tag = node.tag
        if node.gone:
            continue
        if tag == "br":
            page.br()
            continue
        if tag == "table":
            page.block(node.lines)
            node.lines = None
            continue
        if tag in BLOCK or tag in ("td", "th") or tag == "text":
            page.edge(tag in MARGIN and not (tag in LISTS and counts))
        if tag in LISTS:
            start = node.attributes.get("start", "1").strip()
            counts.append(int(start) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 1 if tag == "ol" else None)
        if tag == "li":
            mark = "- "
            if counts and counts[-1] is not None:
                mark = f"{counts[-1]}. "
                counts[-1] += 1
            page.indent(mark)
        elif tag in ("dd", "blockquote"):
            page.indent("  ")
        if tag in ("pre", "xmp"):
            pre += 1
        stack.append((None, node))
        stack += [(x, node) for x in reversed(_children(node))]
    page.flush()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return page.lines


def _alone(node: Node) -> list[str]:
    holder = Node("#part")
    holder.children = [node]
    return render(holder)


def _span(cell: Node, name: str, most: int) -> int:
    told = cell.attributes.get(name, "1").strip()
    return min(most, int(told)) if re.fullmatch(r"[0-9]{1,9}", told) else 1


def _groups(table: Node, before: list[str]) -> list[list[Node]]:
    """The rows of a table by group, a head first and a foot last, wherever they are written; what is no row goes to ``before``."""
    heads, bodies, feet = [], [], []
    loose = None
    for x in table.children:
        if isinstance(x, Node) and not x.gone and x.tag == "tr":
            if loose is None:
                bodies.append(loose := [])
            loose.append(x)
        elif isinstance(x, Node) and not x.gone and x.tag in GROUPS:
            loose = None
            place = heads if x.tag == "thead" and not heads else feet if x.tag == "tfoot" and not feet else bodies
            place.append(rows := [])
            for y in x.children:
                rows.append(y) if isinstance(y, Node) and y.tag == "tr" and not y.gone else _stray(y, x, before)
        else:
            _stray(x, table, before)
    return heads + bodies + feet


def _stray(x: Node | str, parent: Node, before: list[str]) -> None:
    if isinstance(x, Node):
        if not x.gone and x.tag not in ("col", "colgroup"):
            before += _alone(x)
    elif parent.ink and (s := SPACE.sub(" ", x).strip(" ")):
        before.append(s)


def table_lines(table: Node) -> list[str]:
    """The rows of a table, their cells in columns two spaces apart; what is no cell stands before.

    A cell takes the first columns that are free, of which cells from rows above may hold some, as HTML has it.
    """
    before: list[str] = []
    rows: list[list[tuple[int, int, list[str]]]] = []
    for group in _groups(table, before):
        held: list[tuple[int, int, int]] = []  # columns that cells from above hold: start, stop, first row that is free
        for r, row in enumerate(group):
            held = [x for x in held if x[2] > r]
            rows.append(placed := [])
            column, k = 0, 0
            new = []
            for x in row.children:
                if not isinstance(x, Node) or x.gone or x.tag not in ("td", "th"):
                    _stray(x, row, before)
                    continue
                while k < len(held) and held[k][0] <= column:
                    column = max(column, held[k][1])
                    k += 1
                wide, down = _span(x, "colspan", COLSPAN) or 1, _span(x, "rowspan", ROWSPAN) or ROWSPAN
                placed.append((column, column + wide, render(x)))
                if down > 1:
                    new.append((column, column + wide, r + down))
                column += wide
            if new:
                held = sorted(held + new)
    edges = sorted({e for row in rows for a, b, _ in row for e in (a, b)})
    index = {e: i for i, e in enumerate(edges)}
    widths = [0] * len(edges)  # of the columns from each edge to the next
    spanning = []
    for row in rows:
        for a, b, lines in row:
            need = min(WIDEST, max(map(len, lines), default=0))
            if index[b] == index[a] + 1:
                widths[index[a]] = max(widths[index[a]], need)
            elif need:
                spanning.append((index[b] - index[a], index[a], index[b], need))
    for _, a, b, need in sorted(spanning):
        inner = [w for w in widths[a:b] if w]
        if (lack := need - sum(inner) - 2 * (len(inner) - 1)) > 0:
            widths[b - 1] += lack if inner else need
    starts, place = {}, 0
    for e, w in zip(edges, widths, strict=True):
        starts[e] = place
        place += w + 2 if w else 0
    out = before
    for row in rows:
        if len(row) == 1 and not starts[row[0][0]]:
            out += row[0][2]
            continue
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            parts, length = [], 0
            for a, _, lines in row:
                if k < len(lines) and lines[k]:
                    gap = min(GAP, max(starts[a] - length, 2 if length else 0))
                    parts.append(" " * gap + lines[k])
                    length += gap + len(lines[k])
            out.append("".join(parts))
    while out and not out[-1]:
        out.pop()
    return out


def page_text(page: str | None) -> str:
    if not page:
        return ""
    root = build(page)
    for table in reversed(show(root)):
        table.lines = table_lines(table)
    return "\n".join(render(root))


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with text, and n_chars, its characters."""

    @F.pandas_udf("string")
    def text(of: pd.Series) -> pd.Series:
        return pd.Series([page_text(x) for x in of], dtype="object")

    return pages.withColumn("text", text(source)).withColumn("n_chars", F.length("text").cast("long"))
