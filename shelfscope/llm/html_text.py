"""Visible text of web pages, laid out: a tree builder with implied tags, visibility, and a block renderer.

The tree follows what browsers build from loose markup as far as it shows in
the text: tags that are opened or closed by others, void and raw-text elements.
The renderer puts blocks on lines of their own with the empty lines their tags
ask for, numbers and indents lists, keeps preformatted text, and sets table
cells in aligned columns.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfscope.llm.base import scan, struct

TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = set(
    "script style template noscript head title meta link iframe noembed noframes object audio video canvas datalist area param".split()
)
HIDDEN_IN = {
    "svg": set("title desc metadata defs symbol clippath mask pattern marker filter lineargradient radialgradient".split()),
    "math": set("annotation annotation-xml mphantom".split()),
}
#: Tags of HTML that end a drawing or formula they stand in.
BREAKS_OUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
TOKENS_OF_MATH = set("mi mn mo ms mtext".split())  # hold text, and HTML
APART = set("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtable mtr mtd".split())  # parts that do not run on
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table ul xmp".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu pre blockquote figure table hr listing xmp".split())
KEPT_SPACE = {"pre", "textarea", "listing", "xmp"}
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "optgroup", "option", "legend"} | {"li", "dd", "dt"}

#: An opening tag closes these open elements, looking up to the given borders.
TABLE_PARTS = {"thead", "tbody", "tfoot"}
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table", *TABLE_PARTS}),
    **{part: ({"td", "th", "tr", "caption", "colgroup", *TABLE_PARTS}, {"table"}) for part in TABLE_PARTS},
    "caption": ({"caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
    **{f"h{i}": ({f"h{j}" for j in range(1, 7)}, {"div", "section", "article", "td", "th", "li", "body"}) for i in range(1, 7)},
}
IN_TABLE = {"td", "th", "tr", "caption", "colgroup", "col", *TABLE_PARTS}  # means nothing outside a table
WIDEST = 60  # characters of a cell that may set the width of a column
MOST_PADDING = 240  # spaces that align the cells of one line
MOST_DEPTH = 512  # open elements; a tag below that is a neighbour of the last, as in browsers
SCOPE = {"td", "th", "caption", "table", "html", "template"}  # an end tag inside does not reach elements outside
STOPS_P = SCOPE | {"button"}


class Node:
    __slots__ = ("tag", "attributes", "children", "space")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, space: str = "html"):
        self.tag, self.attributes, self.children = tag, attributes or {}, []
        self.space = space  # what it holds is html, svg, svg text or math


def space_in(parent: str, name: str, attributes: dict[str, str]) -> str:
    """What an element holds, by what its parent holds."""
    if name in ("svg", "math") and parent in ("html", name):
        return name
    if parent in ("svg", "svg text"):
        if name in ("foreignobject", "desc", "title"):
            return "html"
        return "svg text" if name in (("text",) if parent == "svg" else ("tspan", "textpath", "a")) else "svg"
    if parent == "math":
        html_inside = name in TOKENS_OF_MATH or (name == "annotation-xml" and "html" in attributes.get("encoding", "").lower())
        return "html" if html_inside else "math"
    return "html"


def tokens(source: str, foreign: Callable[[], bool]) -> Iterator[tuple]:
    """("text", words), ("open", name, attributes, whether it closes itself), ("close", name).

    ``foreign`` tells whether the reader stands in a drawing or formula, where no tag makes its content raw.
    """
    at = 0
    while at < len(source):
        m = TAG.search(source, at)
        if not m:
            break
        if m.start() > at:
            yield "text", source[at : m.start()]
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>")
            continue
        if m["close"]:
            yield "close", name
            continue
        found = {}
        for a in ATTRIBUTE.finditer(m["rest"]):
            found.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        yield "open", name, found, m["rest"].endswith("/")
        if foreign():
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            stop = end.start() if end else len(source)
            yield "raw" if name not in ("textarea", "title") else "text", source[at:stop]
            at = stop
        elif name == "plaintext":
            yield "raw", source[at:]
            return
    if at < len(source):
        yield "text", source[at:]


def built(source: str) -> Node:
    """The tree; every text lies under the root whatever tags are missing."""
    root = Node("html")
    stack = [root]

    def close(names: set[str], borders: set[str], all_of_them: bool = False) -> None:
        """Close the innermost open element of these names (or all of them) that no border hides."""
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                found = i
                if not all_of_them:
                    break
            elif stack[i].tag in borders:
                break
        if found is not None:
            del stack[found:]

    def foreign() -> bool:
        return stack[-1].space != "html"

    def leave_foreign() -> None:
        while foreign():
            stack.pop()

    for kind, *rest in tokens(source, foreign):
        if kind in ("text", "raw"):
            words = rest[0] if kind == "raw" else html.unescape(rest[0])
            if stack[-1].tag == "head" and words.strip():
                close({"head"}, set())
            if stack[-1].space != "svg":  # a drawing shows text in its text elements only
                stack[-1].children.append(words)
            continue
        name = rest[0]
        if foreign() and (name in BREAKS_OUT if kind == "open" else name in ("p", "br")):
            leave_foreign()
        if kind == "open" and (foreign() or stack[-1].tag in TOKENS_OF_MATH and name in ("mglyph", "malignmark")):
            node = Node(name, rest[1], space_in(stack[-1].space, name, rest[1]))
            stack[-1].children.append(node)
            if not rest[2] and len(stack) < MOST_DEPTH:
                stack.append(node)
            continue
        if kind == "close":
            if name == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p"))
            elif name not in ("html", "body") and name not in VOID:
                if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    close({f"h{i}" for i in range(1, 7)}, SCOPE)
                else:
                    close({name}, SCOPE - {name} if name not in ("table", *TABLE_PARTS, "tr", "td", "th", "caption") else {"table"} - {name})
            elif name == "br":
                stack[-1].children.append(Node("br"))
            continue
        if name in ("html", "frameset") or (name in IN_TABLE and not any(n.tag == "table" for n in stack)):
            continue
        if stack[-1].tag == "head" and name not in ("meta", "link", "title", "style", "script", "base", "template", "noscript", "head"):
            close({"head"}, set())
        if name in CLOSES_P:
            close({"p"}, STOPS_P)
        if name in CLOSED_BY:
            close(*CLOSED_BY[name], all_of_them=name not in ("li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"))
        if name in ("td", "th") and stack[-1].tag in ("table", *TABLE_PARTS):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
        if name == "body" and any(n.tag == "body" for n in stack):
            continue
        node = Node(name, rest[1], space_in("html", name, rest[1]))
        stack[-1].children.append(node)
        if name in ("svg", "math") and rest[2]:
            continue
        if name not in VOID and len(stack) < MOST_DEPTH:
            stack.append(node)
    return root


STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.I)


def shown(node: Node, visible: bool, space: str = "html") -> tuple[bool, bool]:
    """Whether the element is laid out at all, and whether its own text is visible (what it holds may differ)."""
    a = node.attributes
    if space != "html":
        if node.tag in HIDDEN_IN[space.split()[0]] or a.get("display", "").lower() == "none":
            return False, False
        if "visibility" in a:
            visible = a["visibility"].lower() == "visible"
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False, False
    if node.tag == "dialog" and "open" not in a:
        return False, False
    for what, value in STYLE.findall(a.get("style", "")):
        if what.lower() == "display" and value.lower() == "none":
            return False, False
        if what.lower() == "visibility":
            visible = value.lower() == "visible"
    return True, visible


class Layout:
    """Lines under construction: inline text collects until a block begins or ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0  # empty lines owed before the next line

    def words(self, text: str, keep_space: bool) -> None:
        if keep_space:
            first, *others = text.split("\n")
            self.inline.append(("kept", first))
            for line in others:
                self.end_line(force=True)
                self.inline.append(("kept", line))
        else:
            self.inline.append(("flow", text))

    def end_line(self, force: bool = False) -> None:
        line = ""
        for kind, text in self.inline:
            if kind == "kept":
                line += text
            else:
                text = re.sub(r"[ \t\n\r\f]+", " ", text)
                line += text[1:] if text[:1] == " " and (not line or line[-1] == " ") else text
        self.inline = []
        if line.strip() or force:
            self.add([line.rstrip(" ")])

    def add(self, lines: list[str]) -> None:
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.extend(lines)

    def edge(self, empty_lines: int) -> None:
        """The border of a block: the line ends, and at least so many empty lines come next."""
        self.end_line()
        self.gap = max(self.gap, empty_lines)

    def take(self, lines: list[str]) -> None:
        if lines:
            self.add(lines)


def rendered(root: Node) -> list[str]:
    """The lines of a tree, without recursion: a frame for every element that is open."""
    out = Layout()
    frames = [[root, iter(root.children), out, True, False, None]]
    while frames:
        node, children, layout, visible, keep_space, state = frames[-1]
        child = next(children, None)
        if child is None:
            frames.pop()
            if frames:
                finish(node, layout, frames[-1], state)
            else:
                layout.end_line()
            continue
        if isinstance(child, str):
            if node.tag == "details" and "open" not in node.attributes:
                continue
            if visible and not (node.tag in ("table", "tr", *TABLE_PARTS, "ul", "ol") and not child.strip()):
                layout.words(child, keep_space)
            continue
        laid_out, seen = shown(child, visible, node.space)
        if not laid_out or (node.tag == "details" and "open" not in node.attributes and child.tag != "summary"):
            continue
        if child.tag == "br":
            layout.end_line(force=True)
        elif child.tag == "hr":
            layout.edge(1)
        elif child.tag == "wbr":
            pass
        elif child.tag in ("table", "tr", "td", "th", "li", "dd", "blockquote"):
            # Laid out apart, then set into the lines of what holds it.
            inside = Layout()
            own = [] if child.tag in ("table", "tr") else None
            if child.tag == "li":
                own = 1 + (state if isinstance(state, int) else 0)
                if not isinstance(state, list):
                    frames[-1][5] = own
            frames.append([child, iter(child.children), inside, seen, keep_space, own])
        else:
            if child.tag in BLOCK:
                layout.edge(spacing(child, node))
            if set_apart(child, node):
                layout.words(" ", False)
            start = int(child.attributes["start"]) - 1 if child.attributes.get("start", "").lstrip("-").isdigit() else 0
            rows = state if child.tag in TABLE_PARTS and isinstance(state, list) else start
            frames.append([child, iter(child.children), layout, seen, keep_space or child.tag in KEPT_SPACE, rows])
    lines = out.lines
    while lines and not lines[-1].strip():
        lines.pop()
    return lines


def set_apart(node: Node, parent: Node) -> bool:
    """Whether a space parts it from its neighbours: a text of a drawing, a span with a place of its own, a part of a formula."""
    if parent.space == "svg text":
        return node.tag == "tspan" and not node.attributes.keys().isdisjoint(("x", "y", "dx", "dy"))
    return node.space == "svg text" or (parent.space == "math" and parent.tag in APART)


def spacing(node: Node, parent: Node) -> int:
    return int(node.tag in SPACED and not (node.tag in ("ul", "ol", "menu", "dir") and parent.tag == "li"))


def finish(node: Node, inside: Layout, parent: list, state) -> None:
    """Put a closed element into the one that holds it."""
    holder, _, layout, _, _, above = parent
    tag = node.tag
    if tag not in ("table", "tr", "td", "th", "li", "dd", "blockquote"):
        if tag in BLOCK:
            layout.edge(spacing(node, holder))
        if set_apart(node, holder):
            layout.words(" ", False)
        return
    inside.end_line()
    lines = inside.lines
    if tag in ("td", "th"):
        across = number_of(node.attributes.get("colspan", ""), 100) or 1
        cell = (lines, across, number_of(node.attributes.get("rowspan", ""), 65534))
        if holder.tag == "tr":
            above.append(cell)
            return
        state, tag = [cell], "tr"
    if tag == "tr":
        if isinstance(above, list):  # rows of a table, with what else the row held
            above.append(state)
            if inside.lines and node.tag == "tr":
                layout.take(inside.lines)
        else:
            layout.edge(0)
            layout.take(inside.lines if node.tag == "tr" else [])
            layout.take(aligned([state]))
        return
    if tag == "table":
        layout.edge(1)
        layout.take(lines + aligned(state))
        layout.edge(1)
        return
    if tag == "li":
        value = node.attributes.get("value", "")
        number = int(value) if value.lstrip("-").isdigit() else state
        mark = f"{number}. " if holder.tag == "ol" else "- "
        layout.edge(0)
        layout.take([(mark if i == 0 else " " * len(mark)) + line if line or i == 0 else "" for i, line in enumerate(lines)])
        layout.edge(0)
        return
    layout.edge(int(tag == "blockquote"))
    layout.take([("    " if tag == "dd" else "> ") + line if line else "" for line in lines])
    layout.edge(int(tag == "blockquote"))


def number_of(text: str, most: int, otherwise: int = 1) -> int:
    """The whole number a span attribute gives, ``most`` at most."""
    digits = text.strip()
    return min(int(digits[:9]), most) if digits.isascii() and digits.isdigit() else otherwise


def placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Per row its cells with the columns they take (first, number), beside cells that reach down from rows above."""
    taken: dict[int, int] = {}  # column -> the row it is free in again
    out = []
    for r, row in enumerate(rows):
        column, cells = 0, []
        for lines, span, down in row:
            while taken.get(column, 0) > r:
                column += 1
            cells.append((column, span, lines))
            if down != 1:
                taken.update(dict.fromkeys(range(column, column + span), r + down if down else len(rows)))
            column += span
        out.append(cells)
    return out


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells as lines: columns as wide as their widest cell of one column, two spaces between.

    Cells wider than WIDEST set no width: what follows them in their line comes
    two spaces behind.  A line is padded with MOST_PADDING spaces at most, so
    that what comes out grows with what goes in; no text is left out.
    """
    grid = placed(rows)
    widths: dict[int, int] = {}
    for row in grid:
        for column, span, lines in row:
            width = max(map(len, lines), default=0)
            if span == 1 and width <= WIDEST:
                widths[column] = max(widths.get(column, 0), width)
    last = max(widths, default=-1) + 1
    begins = list(itertools.accumulate((widths.get(c, 0) + 2 for c in range(last)), initial=0))
    out = []
    for row in grid:
        for i in range(max((len(lines) for _, _, lines in row), default=0)):
            line, size, padding = [], 0, MOST_PADDING
            for column, _, lines in row:
                if i >= len(lines) or not lines[i]:
                    continue
                begin = begins[column] if column <= last else begins[-1] + 2 * (column - last)
                gap = min(max(begin - size, 2 if size else 0), max(padding, 2))
                padding -= gap
                line.append(" " * gap + lines[i])
                size += gap + len(lines[i])
            out.append("".join(line).rstrip())
    return out


def visible_text(source: str) -> str:
    source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    return "\n".join(rendered(built(source)))


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``id``, ``keep`` columns, and the ``text`` of every page.

    One row per input row, repeated rows and null ids included; other columns
    are left out.  A null or empty page has an empty text.  Style sheets are not
    applied, only attributes are: what a rule of a sheet hides is shown.  Each page is parsed
    and laid out whole, by one task.  No shuffle.
    """

    def run(texts: pa.Array) -> dict:
        return {"text": [visible_text(x) if x else "" for x in texts.to_pylist()]}

    return scan(pages, [id_col, *(keep or [])], html_col, struct(text=T.StringType()), lambda: run)
