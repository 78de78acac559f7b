"""Visible text of web pages, laid out.

A small tree builder (void elements, raw text elements, implied end tags) and visibility
rules, then a rendering from the leaves up: blocks stand on lines of their own, paragraphs
and headings between blank lines, list items behind "- " or a number and indented, table rows
as lines whose cells are padded to their columns, a cell of several lines (paragraphs, lists,
tables) on as many lines. All visible text comes out, navigation, footers, labels of buttons
and values of fields included. Hidden are what a browser doesn't draw, ``display: none`` and
``visibility: hidden`` (but for descendants that are visible again), by attributes or by rules
of style elements whose selector is a name, a class or an id, or a name with one of these.
Pages are independent: rows stay in their partitions, without a shuffle.

Nulls and ties: a null or empty page gives an empty text; broken markup never fails (what
isn't a tag is text); repeated rows each come out; an empty table gives an empty result;
columns named in ``keep`` pass through and others aren't read.

Time and memory grow with a page's length whatever its markup: no recursion, no walk over the
open elements, no pattern that backtracks. Lists and tables are laid out to LEVELS within each
other; deeper ones come out as lines. Spans can be made to ask for more blanks than a machine
holds: a table that would take PADDING blanks for each of its characters, and over a million,
comes out with all its cells but unpadded.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

LEVELS = 16
PADDING = 16

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HIDDEN = frozenset("head script style title template noscript iframe object audio video canvas datalist noembed noframes".split())
#: What isn't drawn inside svg and math.
_FOREIGN_HIDDEN = {"svg": frozenset("title desc defs metadata symbol marker pattern mask clippath".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
#: Elements of svg and math that hold HTML again, and start tags that end svg and math elsewhere.
_HOLDS_HTML = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
_ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
_LINES = frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header html legend li main menu nav option section summary tr caption thead tbody tfoot".split())
_CELLS = frozenset(("td", "th"))
_GROUPS = frozenset(("thead", "tbody", "tfoot"))
#: A start tag ends open elements of these names, up to the nearest of the fences.
_IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (frozenset(("tr", "caption")) | _CELLS, frozenset(("table",))),
    "td": (_CELLS, frozenset(("tr", "table"))),
    "th": (_CELLS, frozenset(("tr", "table"))),
    "body": (frozenset(("head",)), frozenset()),
} | dict.fromkeys(_GROUPS, (_GROUPS | _CELLS | {"tr", "caption"}, frozenset(("table",))))
_ENDS_P = (_PARAGRAPHS | _LINES) - {"option", "tr", "caption", "thead", "tbody", "tfoot", "html", "body", "legend"}
_P_FENCE = frozenset(("td", "th", "caption", "table", "button", "object", "body"))
_IN_HEAD = frozenset("html head base link meta title style script noscript template".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\Z""")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_SELECTOR = re.compile(r"([a-z][a-z0-9-]*+|\*)?(?:([.#])([\w-]++))?\Z", re.IGNORECASE)
_LONG_NUMBER = re.compile(r"&#(?:0*+[0-9]{9,}+|[xX]0*+[0-9a-fA-F]{9,}+);?")
#: Inputs that show no text of their own.
_SILENT = frozenset("hidden password checkbox radio file image color range".split())

#: A value of a style property, after what it is ranked by.
Ranked = tuple[tuple[int, ...], str]


def _unescape(text: str) -> str:
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def _declared(css: str, rank: tuple[int, ...]) -> dict[str, Ranked]:
    """display and visibility of some declarations, each with its rank."""
    out: dict[str, Ranked] = {}
    for d in css.split(";"):
        name, _, value = d.partition(":")
        name = name.strip().lower()
        if name in ("display", "visibility"):
            value, _, more = value.lower().partition("!")
            new = (int(more.strip() == "important"), *rank), value.strip()
            out[name] = max(out.get(name, new), new, key=lambda x: x[0]) if name in out and out[name][0] > new[0] else new
    return out


class Styles:
    """What rules of style elements say of the elements of a name, class or id. Blocks of at-rules are left out."""

    def __init__(self) -> None:
        self.rules: dict[tuple[str, str, str], dict[str, Ranked]] = {}
        self.n = 0

    def add(self, css: str) -> None:
        css = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.DOTALL)
        depth = start = body = 0
        for m in re.finditer(r"[{}]", css):
            if m[0] == "{":
                depth += 1
                if depth == 1:
                    body = m.end()
            elif depth:
                depth -= 1
                if not depth:
                    selectors = css[start : body - 1].rpartition(";")[2].strip()
                    if not selectors.startswith("@"):
                        self._rule(selectors, css[body : m.start()])
                    start = m.end()
            else:
                start = m.end()

    def _rule(self, selectors: str, css: str) -> None:
        self.n += 1
        told = _declared(css, ())
        if not told:
            return
        for selector in selectors.split(","):
            m = _SELECTOR.match(selector.strip())
            if m and (m[1] or m[3]):
                tag = (m[1] or "*").lower().replace("*", "")
                rank = (0, int(m[2] == "#"), int(m[2] == "."), int(bool(tag)), self.n)
                held = self.rules.setdefault((tag, m[2] or "", m[3] or ""), {})
                for name, (important, value) in told.items():
                    new = (*important, *rank), value
                    held[name] = max(held.get(name, new), new)

    def of(self, node: Node) -> dict[str, str]:
        """display and visibility of an element, where anything says them."""
        a = node.attributes
        found: dict[str, Ranked] = {name: ((0, 0), a[name].strip().lower()) for name in ("display", "visibility") if name in a} if node.inside else {}
        told = [_declared(a["style"], (1,))] if "style" in a else []
        if self.rules:
            names = [("", ""), *([("#", a["id"])] if "id" in a else []), *((".", c) for c in a.get("class", "").split())]
            told += [self.rules[key] for kind, name in names for tag in ("", node.tag) if (key := (tag, kind, name)) in self.rules]
        for some in told:
            for name, new in some.items():
                found[name] = max(found.get(name, new), new)
        return {name: value for name, (_, value) in found.items()}


class Node:
    __slots__ = ("tag", "attributes", "children", "inside")

    def __init__(self, tag: str, attributes: dict[str, str], inside: str = ""):
        self.tag, self.attributes, self.inside = tag, attributes, inside  # inside: svg, math or neither
        self.children: list[Node | str] = []

    def foreign(self) -> str:
        """svg or math where its children are of these, else empty."""
        return "" if self.inside and self.tag in _HOLDS_HTML[self.inside] else self.inside

    def visible(self, styles: Styles, inherited: bool) -> bool | None:
        """Whether its own text is seen; None if nothing in it can be."""
        a = self.attributes
        if self.tag in _HIDDEN or (self.inside and self.tag in _FOREIGN_HIDDEN[self.inside]) or (self.tag == "dialog" and "open" not in a):
            return None
        if not a and not styles.rules:
            return inherited
        style = styles.of(self)
        if style.get("display", "none" if "hidden" in a else "") == "none":
            return None
        seen = style.get("visibility", "inherit")
        return seen == "visible" if seen in ("visible", "hidden", "collapse") else inherited


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m[2] or ""
        if value[:1] in "\"'" and value[:1]:
            value = value[1:-1]
        out.setdefault(m[1].lower(), _unescape(value))
    return out


class _Open:
    """The open elements, and where in them those of each name stand."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def close(self, at: int) -> None:
        """Closes the element at a place and all in it."""
        for node in reversed(self.stack[at:]):
            self.places[node.tag].pop()
        del self.stack[at:]

    def last(self, names: frozenset[str]) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def end(self, names: frozenset[str], fences: frozenset[str]) -> None:
        """Closes everything from the outermost of these names inside the nearest fence."""
        held = [p for n in names if (p := self.places.get(n))]
        if held:
            fence = self.last(fences)
            inside = [p[bisect_right(p, fence)] for p in held if p[-1] > fence]
            if inside:
                self.close(min(inside))


_HEAD, _P, _TABLE, _NONE = frozenset(("head",)), frozenset(("p",)), frozenset(("table",)), frozenset()


def build(page: str) -> tuple[Node, Styles]:
    """The tree of a page and what its style elements say."""
    root, styles = Node("#root", {}), Styles()
    open_ = _Open(root)
    stack = open_.stack

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and raw.strip():
                open_.end(_HEAD, _NONE)
            stack[-1].children.append(_unescape(raw))

    at = told = 0  # told: up to where text is in the tree
    last_end = page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        if at > last_end and page[at + 1 : at + 2] not in ("!", "?"):
            break  # no tag ends any more
        m = _TAG.match(page, at)
        if not m:
            at += 1
            continue
        text(page[told:at])
        at = told = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if stack[-1].foreign() and page.startswith("<![CDATA[", m.start()):
                shut_at = page.find("]]>", m.start())
                stack[-1].children.append(page[m.start() + 9 : shut_at if shut_at >= 0 else len(page)])
                at = told = shut_at + 3 if shut_at >= 0 else len(page)
            continue
        name = name.lower()
        if closing:
            place = open_.places.get(name)
            fence = open_.last(_TABLE) if name != "table" else 0
            if name not in _GROUPS and name not in ("tr", "table") and name not in _CELLS:
                fence = max(fence, open_.last(_CELLS))
            if place and place[-1] > fence:
                open_.close(place[-1])
            continue
        if name in _ENDS_FOREIGN:
            while stack[-1].foreign():
                open_.close(len(stack) - 1)
        if name not in _IN_HEAD:
            open_.end(_HEAD, _NONE)
        if name in _ENDS_P:
            open_.end(_P, _P_FENCE)
        if name in _IMPLIED:
            open_.end(*_IMPLIED[name])
        node = Node(name, _attributes(rest) if rest else {}, name if name in ("svg", "math") else stack[-1].foreign())
        stack[-1].children.append(node)
        if node.inside and _SELF_CLOSED.search(rest):
            continue
        if name in _RAW:
            shut = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*+>?", re.IGNORECASE).search(page, at)
            inner = page[at : shut.start() if shut else len(page)]
            node.children.append(_unescape(inner) if name in ("title", "textarea") else inner)
            at = told = shut.end() if shut else len(page)
            if name == "style":
                styles.add(inner)
        elif name not in _VOID:
            open_.push(node)
    text(page[told:])
    return root, styles


# What a node shows is a list of parts: inline text; an int, the line ends between two blocks
# (1, or 2 for a blank line); a tuple of finished lines; a row of a table; or a list of parts.


class _Row:
    """Cells: lines, columns and rows that it spans. A row without cells ends a group of rows."""

    __slots__ = ("cells",)

    def __init__(self, cells: list[tuple[list[str], int, int]]):
        self.cells = cells


def _flat(parts: list) -> Iterator:
    stack = [iter(parts)]
    while stack:
        for p in stack[-1]:
            if isinstance(p, list):
                stack.append(iter(p))
                break
            yield p
        else:
            stack.pop()


def _lines(parts: list) -> list[str]:
    lines: list[str] = []
    inline: list[str] = []
    gap = 0

    def put(new: tuple[str, ...] | list[str]) -> None:
        nonlocal gap
        if lines and gap > 1:
            lines.append("")
        lines.extend(new)
        gap = 0

    for p in _flat([parts, 1]):
        if isinstance(p, str):
            inline.append(p)
            continue
        line = _BLANK.sub(" ", "".join(inline)).strip(" ")
        inline = []
        if line:
            put([line])
        if isinstance(p, int):
            gap = max(gap, p)
        elif found := _grid([p]) if isinstance(p, _Row) else p:
            put(found)
    return lines


def _grid(rows: list[_Row]) -> tuple[str, ...]:
    """Lines of rows whose cells stand below each other, column by column."""
    budget = (1 << 20) + PADDING * sum(8 + sum(map(len, lines)) + len(lines) for r in rows for lines, _, _ in r.cells)
    wide: dict[int, int] = {}
    below: dict[int, int] = {}  # rows that a cell from above still takes, by column
    placed: list[dict[int, list[str]]] = []
    for row in rows:
        if not row.cells:
            below = {}
            continue
        cells: dict[int, list[str]] = {}
        longer: dict[int, int] = {}
        at = 0
        for lines, across, down in row.cells:
            while at in below:
                at += 1
                budget -= 1
            cells[at] = lines
            wide[at] = max([wide.get(at, 0), *map(len, lines)])
            if down > 1:
                longer.update(dict.fromkeys(range(at, at + across), down - 1))
                budget -= across
            at += across
        budget -= len(below)
        if budget < 0:
            break
        below = {c: n - 1 for c, n in below.items() if n > 1} | longer
        if any(map(any, cells.values())):
            placed.append(cells)
    columns = max((max(c) for c in placed), default=-1) + 1
    if columns <= budget:
        upto = [0]
        for c in range(columns):
            upto.append(upto[-1] + wide.get(c, 0) + 3)
        budget -= sum(upto[max(c)] * max(map(len, c.values())) for c in placed)
    if budget < columns:
        return tuple(line for r in rows if (line := " | ".join(" ".join(filter(None, lines)) for lines, _, _ in r.cells)).strip(" |"))
    out = []
    for cells in placed:
        for k in range(max(1, *map(len, cells.values())) if len(cells) > 1 else max(map(len, cells.values()))):
            shown = {c: lines[k] if k < len(lines) else "" for c, lines in cells.items()}
            last = max(shown) if not k else max((c for c, text in shown.items() if text), default=-1)
            out.append(" | ".join(shown.get(c, "").ljust(wide.get(c, 0)) for c in range(last + 1)).rstrip())
    return tuple(out)


def _number(value: str, least: int, most: int, default: int) -> int:
    return min(most, max(least, int(value))) if re.fullmatch(r"-?[0-9]{1,9}", value.strip()) else default


def _items(node: Node, inner: list[tuple[Node | None, list]], level: int) -> list:
    out: list = [2]
    items = sum(child is not None and child.tag == "li" for child, _ in inner)
    falls = node.tag == "ol" and "reversed" in node.attributes
    number = _number(node.attributes.get("start", ""), -(10**9), 10**9, items if falls else 1)
    for child, parts in inner:
        if child is None or child.tag != "li":
            out += [1, parts, 1]
            continue
        if node.tag == "ol":
            number = _number(child.attributes.get("value", ""), -(10**9), 10**9, number)
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += -1 if falls else 1
        if level > LEVELS:
            out += [1, mark, parts[1:], 1]  # without the line end before an item
        elif lines := _lines(parts):
            out += [1, tuple((mark if i == 0 else " " * len(mark)) + x if x else x for i, x in enumerate(lines))]
    return [*out, 2]


def _rows(inner: list[tuple[Node | None, list]]) -> list:
    """A table from its rows, and what stands between them."""
    out: list = [2]
    rows: list[_Row] = []
    for p in _flat([parts for _, parts in inner]):
        if isinstance(p, _Row):
            rows.append(p)
        elif not isinstance(p, str) or p.strip():
            if any(r.cells for r in rows):
                out += [1, _grid(rows)]
            rows = []
            out.append(p)
    return [*out, 1, _grid(rows), 2]


#: Around what stands in a pre within another one, whose lines the outer one makes.
_OPEN, _CLOSE = object(), object()
_KEPT = ("pre", "textarea")


def _kept(parts: list) -> str:
    """Text as it stands, that of inner ones without empty lines at its ends, on lines of its own; each piece is touched once or twice."""
    out: list[str] = []
    begun: list[tuple[int, int, list[bool]]] = [(0, 0, [False])]  # where it was opened, where its text starts, whether it has any
    for p in _flat(parts):
        opened, start, full = begun[-1]
        if p is _OPEN:
            opened = len(out)
            if opened > start:
                out.append("\n")
            begun.append((opened, len(out), [False]))
            continue
        if p is _CLOSE:
            begun.pop()
            if full[0]:
                while not (last := out.pop().rstrip("\n")):
                    pass
                out += [last, "\n"]
                begun[-1][2][0] = True
            else:
                del out[opened:]
            continue
        text = p if isinstance(p, str) else "\n" if isinstance(p, int) else "\n".join(_grid([p]) if isinstance(p, _Row) else p)
        if len(out) == start:
            text = text.lstrip("\n")
        if text:
            out.append(text)
            full[0] = full[0] or bool(text.strip())
    return "".join(out)


def _shown(node: Node, inner: list[tuple[Node | None, list]], level: int, kept: bool) -> list:
    """Parts of a node from those of its children; ``level`` counts the lists and tables around it, itself included;
    ``kept`` says that a pre around it makes its lines."""
    tag = node.tag
    if tag == "br":
        return [1]
    parts = [ps for _, ps in inner]
    if tag == "input":
        return [] if node.attributes.get("type", "").strip().lower() in _SILENT else [node.attributes.get("value", "")]
    if tag in _KEPT and kept:
        return [_OPEN, parts, _CLOSE]
    if tag in _KEPT:
        whole = _kept(parts)
        return [2, tuple(line.rstrip() for line in whole.strip("\n").split("\n")), 2] if whole.strip() else []
    if tag == "hr":
        return [2]
    if tag in _LISTS:
        return _items(node, inner, level)
    if tag == "tr" and level <= LEVELS:
        cells = []
        for child, ps in inner:
            a = child.attributes if child is not None and child.tag in _CELLS else {}
            if a or (child is not None and child.tag in _CELLS) or any(not isinstance(p, str) or p.strip() for p in _flat(ps)):
                cells.append((_lines(ps), _number(a.get("colspan", ""), 1, 1000, 1), _number(a.get("rowspan", ""), 0, 65534, 1) or 65534))  # the standard's limits
        return [_Row(cells)] if cells else []
    if tag in _GROUPS and level <= LEVELS:
        return [parts, _Row([])]
    if tag == "table" and level <= LEVELS:
        return _rows(inner)
    gap = 2 if tag in _PARAGRAPHS else 1 if tag in _LINES or (tag == "text" and node.inside == "svg") else 0
    if tag in _CELLS:
        parts.append([1] if level > LEVELS else [" "])
    return [gap, parts, gap] if gap else parts


_LISTS = frozenset(("ul", "ol", "menu", "dir"))
#: Elements that make lines or cells of what stands in them.
_MADE = _LISTS | _CELLS | _GROUPS | {"li", "tr", "table"}


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    root, styles = build(page)
    work: list[tuple[Node, Iterator, list, bool, int, bool]] = [(root, iter(root.children), [], True, 0, False)]
    while True:
        node, rest, inner, seen, level, kept = work[-1]
        closed = node.tag == "details" and "open" not in node.attributes
        within = node.tag in _KEPT or (kept and not (level <= LEVELS and node.tag in _MADE))
        for child in rest:
            if closed and (isinstance(child, str) or child.tag != "summary" or inner):
                continue
            if isinstance(child, str):
                if seen:
                    inner.append((None, [child]))
                continue
            shows = child.visible(styles, seen)
            if shows is not None:
                if child.tag == "input" and not shows:
                    continue
                work.append((child, iter(child.children), [], shows, level + (child.tag in _LISTS or child.tag == "table"), within))
                break
        else:
            work.pop()
            parts = _shown(node, inner, level, kept)
            if not work:
                return "\n".join(_lines(parts))
            work[-1][2].append((node, parts))


def extract_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` and text, the visible text of each row's page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [render(x) for x in pdf.pop("_html")]
            yield pdf

    rows = df.select(*(F.col(c).cast("string").alias(c) for c in keep), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    out = rows.mapInPandas(run, T.StructType([*(T.StructField(c, T.StringType()) for c in keep), T.StructField("text", T.StringType())]))
    return out.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) for c in keep), "text")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
