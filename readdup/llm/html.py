"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer.

The renderer emits all text that a reader would see. Inline text is collapsed as browsers do, blocks stand on lines of
their own with blank lines where browsers put margins, list items carry bullets or numbers and are indented by depth,
preformatted text keeps its spaces, and table cells stand in columns that are as wide as their widest cell.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import slices

#: A tag's attributes: names, and values in quotes or up to white space. Nothing is given back, so a page is read once.
_BODY = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)({_BODY})(>?)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style noscript template iframe noembed noframes datalist audio video canvas object title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption".split())
#: Blocks with a blank line before and after.
MARGIN = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir hr".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt option optgroup legend caption".split()) | {"table"}
#: What an opening tag ends, and the elements beyond which it doesn't look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
ENDS["tbody"] = ENDS["tfoot"] = ENDS["thead"]
#: Parts of a table in which browsers leave only further parts, and what stays in a table or in one of them.
PARTS = frozenset("thead tbody tfoot tr colgroup".split())
STAYS = frozenset("caption col td th".split())
TABLE = PARTS | {"table"}
#: Elements that an end tag of another kind doesn't reach across.
SCOPES = frozenset("table td th caption html body".split())
#: Characters of indent beyond which deeper levels get no more; levels of tables in tables that are laid out as grids.
MOST_INDENT, GRIDS = 400, 20
#: A column of a table starts at its place unless that would pad the table to more than about so many times its text and so many characters a row.
PADDING, REACH = 16, 1000
_ROW_PARTS = frozenset("tr thead tbody tfoot".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.IGNORECASE) for t in RAW}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, name: str) -> str | None:
        """The value of an attribute, empty if it has none; None if it is absent."""
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


class Open:
    """The open elements, with the places of each tag among them, so that finding one takes no walk."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, kinds: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((p[-1] for t in kinds if (p := self.places.get(t))), default=0)

    def cut(self, place: int) -> None:
        for node in self.stack[place:]:
            self.places[node.tag].pop()
        del self.stack[place:]

    def close(self, kinds: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        """End the elements of these tags that no element of the scope stands above."""
        while (place := self.last(kinds)) and place > self.last(scope):
            self.cut(place)


def build(page: str) -> Node:
    """The page's tree. Missing end tags are implied, stray ones ignored; a tag that the page ends in is dropped."""
    root = Node("html")
    known = Open(root)
    stack, at = known.stack, 0
    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m[1]:
            stack[-1].children.append(m[1])
        if not m[3]:
            continue
        if not m[5]:
            break
        tag = m[3].lower()
        if m[2]:
            if tag in ("html", "body"):
                continue
            place = known.last({tag})
            barrier = 0 if tag in SCOPES or tag in _ROW_PARTS else known.last(SCOPES)
            if place > barrier:
                known.cut(place)
            elif not place and not barrier and tag == "p":
                stack[-1].children.append(Node("p"))
            if tag == "br":
                stack[-1].children.append(Node("br"))
            continue
        if tag == "html":
            root.attributes = root.attributes or m[4] or ""
            continue
        if tag in CLOSES_P:
            known.close({"p"}, SCOPES)
        if tag in ENDS:
            known.close(*ENDS[tag])
        if tag == "table" and (stack[-1].tag == "table" or stack[-1].tag in _ROW_PARTS):
            known.cut(known.last({"table"}) or len(stack))  # a table doesn't stand in a table, only in its cells
        if tag == "body" or tag in BLOCK or tag == "span":
            known.close({"head"}, set())  # the head ends where content starts
        node = Node(tag, m[4] or "")
        stack[-1].children.append(node)
        if tag in VOID or (m[4] or "").rstrip().endswith("/") and tag not in BLOCK | RAW and tag not in ("a", "span", "b", "i", "td", "th", "tr"):
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            inner = page[at : end.start() if end else len(page)]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or len(page)
        else:
            known.push(node)
    return root


class Rules:
    """What a page's own style sheets hide or show by a tag, a class, an id, or a tag with one of them.

    Other selectors, and rules for other media, are passed over. The later of equal selectors counts.
    """

    def __init__(self, root: Node):
        self.of: dict[str, dict[str, str]] = {}
        waiting = [root]
        while waiting:
            node = waiting.pop()
            if node.tag == "style":
                self.read("".join(x for x in node.children if isinstance(x, str)))
            waiting += [x for x in reversed(node.children) if isinstance(x, Node)]

    def read(self, sheet: str) -> None:
        depth, skipped, selector = 0, None, ""
        for m in re.finditer(r"[{}]|[^{}]+", re.sub(r"/\*.*?(?:\*/|$)", "", sheet, flags=re.DOTALL)):
            x = m[0]
            if x == "{":
                depth += 1
                if skipped is None and selector.lstrip().startswith("@"):
                    skipped = depth
            elif x == "}":
                if skipped == depth:
                    skipped, selector = None, ""
                depth = max(0, depth - 1)
            elif depth == 0:
                selector = x.rpartition(";")[2]  # behind @import and the like
            elif depth == 1 and skipped is None and (found := declared(x)):
                for one in selector.split(","):
                    if re.fullmatch(r"\s*(?:[a-zA-Z][\w-]*)?(?:[.#][\w-]+)?\s*", one) and one.strip():
                        tag, sign, name = re.fullmatch(r"([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?", one.strip()).groups()
                        self.of.setdefault(f"{(tag or '').lower()}{sign or ''}{name or ''}", {}).update(found)

    def __call__(self, node: Node) -> dict[str, str]:
        """display and visibility as the sheets set them, ids over classes over tags."""
        if not self.of:
            return {}
        found = dict(self.of.get(node.tag, ()))
        if node.attributes:
            for name, sign in (("class", "."), ("id", "#")):
                for value in (node.attribute(name) or "").split():
                    found |= self.of.get(f"{sign}{value}", {}) | self.of.get(f"{node.tag}{sign}{value}", {})
        return found


def declared(style: str) -> dict[str, str]:
    """display and visibility of a list of declarations."""
    return {k: v for k, v in re.findall(r"(?:^|;)(display|visibility):([a-z-]+)", re.sub(r"\s+", "", style.lower()))}


def displayed(node: Node, rules: Rules) -> tuple[bool, bool | None]:
    """Whether the element has a place (no metadata, script, closed dialog or hidden input, not hidden by attribute or display), and whether it sets its text visible or not."""
    if node.tag in HIDDEN:
        return False, None
    style = rules(node)
    if node.attributes:
        lower = node.attributes.lower()
        if "style" in lower:
            style = style | declared(node.attribute("style") or "")
        if "hidden" in lower:
            hidden = node.attribute("hidden")
            if hidden is not None and hidden.lower() != "until-found":
                return False, None
            if node.tag == "input" and (node.attribute("type") or "").lower() == "hidden":
                return False, None
    if style.get("display") == "none" or node.tag == "dialog" and node.attribute("open") is None:
        return False, None
    seen = style.get("visibility")
    return True, None if seen is None or seen == "inherit" else seen not in ("hidden", "collapse")


class Lines:
    """Collects lines: inline text is collapsed, blocks break lines, margins ask for one blank line between.

    Blocks with a bullet or an indent stand inside a level: its first line has the mark, the others the indent, and
    margins at its beginning and end are the outer ones.
    """

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.space = False
        self.indent, self.mark = "", None
        self.levels: list[tuple] = []
        self.fresh = 0  # lines there were when the level began

    def text(self, s: str) -> None:
        words = SPACE.split(s)
        if len(words) > 1 and words[0] == "" and self.now:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(body)
            self.space = len(words) > 1 and words[-1] == ""

    def raw(self, s: str) -> None:
        parts = s.replace("\r\n", "\n").split("\n")
        for i, p in enumerate(parts):
            if i:
                self.end(keep=True)
            if p:
                self.now.append(p)
        self.space = False

    def put(self, line: str) -> None:
        if self.gap and self.done and self.done[-1]:
            self.done.append("")
        self.gap = False
        self.done.append(((self.indent if self.mark is None else self.mark) + line).rstrip())
        self.mark = None

    def end(self, keep: bool = False) -> None:
        line = "".join(self.now)
        self.now.clear()
        self.space = False
        if line.strip() or keep:
            self.put(line)

    def margin(self) -> None:
        self.end()
        if len(self.done) > self.fresh or not self.levels:
            self.gap = True

    def into(self, mark: str, indent: str) -> None:
        self.end()
        self.levels.append((self.indent, self.mark, self.fresh, len(self.done), self.gap))
        self.mark = (self.indent if self.mark is None else self.mark) + mark
        self.indent += indent if len(self.indent) < MOST_INDENT else ""
        self.fresh = len(self.done)

    def out(self) -> None:
        self.end()
        indent, mark, fresh, begun, gap = self.levels.pop()
        some = len(self.done) > begun
        while len(self.done) > begun and not self.done[-1]:
            self.done.pop()
        self.indent, self.fresh = indent, fresh
        self.mark, self.gap = (None, False) if some else (mark, gap)

    def all(self) -> list[str]:
        self.end()
        while self.done and not self.done[-1]:
            self.done.pop()
        return self.done


def number(n: int, kind: str) -> str:
    if kind in "aA" and n > 0:
        s = ""
        while n:
            n, k = divmod(n - 1, 26)
            s = chr(97 + k) + s
        return s if kind == "a" else s.upper()
    if kind in "iI" and 0 < n < 4000:
        s = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            s += sign * (n // value)
            n %= value
        return s if kind == "i" else s.upper()
    return str(n)


def integer(s: str | None, otherwise: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", s or "")
    return int(m[1]) if m else otherwise


def fostered(part: Node) -> Iterator[str | Node]:
    """What browsers move out of a table to the place before it: text that isn't blank and elements that are no part of a table."""
    for child in part.children:
        if isinstance(child, str):
            if not SPACE.fullmatch(child):
                yield child
        elif child.tag in PARTS:
            yield from fostered(child)
        elif child.tag not in STAYS:
            yield from in_place(child)


def in_place(child: str | Node) -> Iterator[str | Node]:
    """A child of an element, behind what is moved out of it if it is a table; that is shown even where the table is hidden."""
    if isinstance(child, Node) and child.tag == "table":
        yield from fostered(child)
    yield child


class Frame:
    """An element that is being rendered: what is left of its children, and what to do behind them."""

    __slots__ = ("left", "node", "pre", "shown", "count", "leave")

    def __init__(self, node: Node, pre: bool, shown: bool, leave: Callable[[], None] | None = None):
        own = node.children if node.tag not in TABLE else [x for x in node.children if isinstance(x, Node) and (x.tag in PARTS or x.tag in STAYS)]
        self.left = chain.from_iterable(map(in_place, own)) if any(type(x) is Node and x.tag == "table" for x in own) else iter(own)
        self.node, self.pre, self.shown, self.count, self.leave = node, pre, shown, None, leave


FIELDS = frozenset("submit button reset text search email url tel number".split())


def render(node: Node, rules: Rules, pre: bool = False, shown: bool = True, grids: int = 0) -> list[str]:
    """The lines of what is in an element. Takes no recursion but for tables in tables."""
    out = Lines()
    frames = [Frame(node, pre, shown)]
    while frames:
        f = frames[-1]
        child = next(f.left, None)
        if child is None:
            frames.pop()
            if f.leave:
                f.leave()
            continue
        if isinstance(child, str):
            if f.shown:
                out.raw(child) if f.pre else out.text(child)
            continue
        tag = child.tag
        place, own = displayed(child, rules)
        if not place:
            continue
        seen = f.shown if own is None else own
        if tag == "br":
            out.end(keep=True)
        elif tag == "hr":
            out.margin()
            if seen:
                out.put("---")
            out.margin()
        elif tag == "table" and grids < GRIDS:
            out.margin()
            for line in grid(child, rules, seen, grids + 1):
                out.put(line)
            out.margin()
        elif tag == "li":
            mark = "- "
            if f.node.tag == "ol":
                f.count = integer(child.attribute("value"), integer(f.node.attribute("start"), 1) if f.count is None else f.count + 1)
                mark = f"{number(f.count, f.node.attribute('type') or '1')}. "
            out.into(mark if seen else "", " " * len(mark) if seen else "")
            frames.append(Frame(child, f.pre, seen, out.out))
        elif tag in ("blockquote", "dd"):
            edge = out.margin if tag in MARGIN else out.end
            edge()
            out.into("  ", "  ")
            frames.append(Frame(child, f.pre, seen, lambda edge=edge: (out.out(), edge())))
        elif tag == "details" and child.attribute("open") is None:
            out.end()
            first = next((x for x in child.children if isinstance(x, Node) and x.tag == "summary"), None)
            if first is not None:
                frames.append(Frame(first, f.pre, seen, out.end))
        elif tag == "input":
            if seen and (child.attribute("type") or "text").lower() in FIELDS:
                out.text(child.attribute("value") or "")
        elif tag in BLOCK or f.node.tag in TABLE and (tag in PARTS or tag in STAYS):
            nested = tag in ("ul", "ol", "menu", "dir") and f.node.tag == "li"
            edge = out.margin if tag in MARGIN and not nested else out.end
            edge()
            frames.append(Frame(child, f.pre or tag == "pre", seen, edge))
        else:
            frames.append(Frame(child, f.pre or tag == "textarea", seen))
    return out.all()


def grid(node: Node, rules: Rules, shown: bool, grids: int) -> list[str]:
    """A table's caption and rows; cells of a column start at one place, cells with several lines take several lines."""
    rows: list[list[tuple[list[str], int, int]]] = []
    before: list[str] = []

    def lines_of(n: Node, seen: bool) -> list[str]:
        return render(n, rules, shown=seen, grids=grids)

    def collect(n: Node, seen: bool) -> None:
        for child in n.children:
            if isinstance(child, str):
                continue
            place, own = displayed(child, rules)
            if not place:
                continue
            here = seen if own is None else own
            if child.tag == "tr":
                cells = []
                for c in child.children:
                    if isinstance(c, Node) and c.tag in ("td", "th", "caption"):
                        place, own = displayed(c, rules)
                        if place:
                            lines = lines_of(c, here if own is None else own)
                            # as many columns and rows as HTML allows
                            before.extend(lines) if c.tag == "caption" else cells.append((lines, max(1, min(1000, integer(c.attribute("colspan"), 1))), max(1, min(65534, integer(c.attribute("rowspan"), 1)))))
                rows.append(cells)
            elif child.tag in PARTS:
                collect(child, here)
            elif child.tag in ("td", "th", "caption"):
                before.extend(lines_of(child, here))

    collect(node, shown)
    placed: list[list[tuple[int, int, list[str]]]] = []
    hanging: list[tuple[int, int, int]] = []  # (first column, end, row up to which) that cells of rows above take
    for r, cells in enumerate(rows):
        hanging = [x for x in hanging if x[2] > r]
        line, fresh, c, h = [], [], 0, 0
        for lines, across, down in cells:
            while h < len(hanging) and hanging[h][0] <= c:
                c = max(c, hanging[h][1])
                h += 1
            line.append((c, across, lines))
            if down > 1:
                fresh.append((c, c + across, min(len(rows), r + down)))
            c += across
        placed.append(line)
        merged: list[tuple[int, int, int]] = []
        for x in sorted(hanging + fresh):
            if merged and merged[-1][1] == x[0] and merged[-1][2] == x[2]:
                merged[-1] = (merged[-1][0], x[1], x[2])
            else:
                merged.append(x)
        hanging = merged
    width: dict[int, int] = {}
    for line in placed:
        for c, across, lines in line:
            if across == 1:
                width[c] = max(width.get(c, 0), max(map(len, lines), default=0))
    wide = [(c, across, most) for line in placed for c, across, lines in line if across > 1 and (most := max(map(len, lines), default=0))]
    columns = sorted({*width, *(c + a - 1 for c, a, _ in wide)})
    size = [width.get(c, 0) for c in columns]
    sums = [0, *accumulate(size)]
    for c, across, most in wide:  # a cell across several columns widens the last one
        i, j = bisect_left(columns, c), bisect_left(columns, c + across - 1)
        lacking = most - (sums[j] - sums[i] + size[j] + 2 * across - 2)
        if lacking > 0:
            size[j] += lacking
    sums = [0, *accumulate(size)]
    text = sum(len(x) for line in placed for _, _, lines in line for x in lines)
    reach = max(REACH, PADDING * text // max(1, len(placed)))
    out = before
    for line in placed:
        if len(line) == 1 and not line[0][0]:
            out += line[0][2]
            continue
        starts = [2 * c + sums[bisect_left(columns, c)] for c, _, _ in line]
        for k in range(max((len(lines) for _, _, lines in line), default=0)):
            row = []
            at = 0
            for (_, _, lines), start in zip(line, starts, strict=True):
                if k < len(lines) and lines[k]:
                    space = start - at if at <= start <= reach else 2
                    row += [" " * space, lines[k]]
                    at += space + len(lines[k])
            out.append("".join(row).rstrip())
    return out


def visible_text(page: str) -> str:
    """The page's visible text; lines end with one line feed, there is no blank line at either end."""
    root = build(page)
    lines = render(root, Rules(root))
    at = next((i for i, x in enumerate(lines) if x), len(lines))
    return "\n".join(lines[at:])


def extract(pages: DataFrame) -> DataFrame:
    """The rows of ``pages`` (html and others) with ``text``; null and empty pages have empty text. A column named text is replaced; repeated pages stay; pages of any size and depth are read whole."""
    names = [c for c in pages.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [visible_text(p or "") for p in part.column(names.index("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return pages.select(*names).mapInArrow(run, StructType([*(f for f in pages.schema if f.name != "text"), StructField("text", StringType())]))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
