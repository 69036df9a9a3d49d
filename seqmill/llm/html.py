"""HTML extraction by layout: all visible text, with blocks, lists and aligned tables kept.

A tree builder closes implied tags and adds implied rows, visibility rules hide scripts, styles,
templates, comments, fallback content that browsers never show and elements marked hidden, and a
renderer writes blocks on their own lines, list items with their marks and depth, preformatted
text as it is, and table cells padded to columns. What stands in a table outside its cells comes
before it, as in browsers. Of svg, text elements and embedded HTML are text.

Defined cases: null html gives null, empty html an empty text; broken markup never fails
(unclosed tags end with their parent, stray end tags are ignored, a tag without end hides the
rest as in browsers, after an open quote tags end at the next ">"); pages are handled row by
row, so repeated rows agree; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from seqmill.llm.common import chunks

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)|([^<]+|<)", re.S)
QUOTED = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*+")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
HIDES = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: Attributes that matter, as seen in lower case.
TELLING = re.compile("hid|none|start|collapse|visib|span|value", re.I)
# Fixed element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes audio video canvas datalist".split())
#: Start tags that leave a head open.
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Parts of svg and math that are never drawn where they stand, and parts that hold HTML again.
UNDRAWN = {"svg": frozenset("desc metadata defs symbol clippath mask pattern marker".split()), "math": frozenset("annotation annotation-xml".split())}
HOLDS = {"svg": frozenset("foreignobject desc".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
#: HTML tags that end an open svg or math element.
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dd dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table ul caption tr".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure".split())
#: Tag -> (open tags that it closes, tags beyond which nothing is closed).
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset()),
}
SECTION = frozenset("thead tbody tfoot".split())
#: Tags of a table -> open parts of it that they may stand in.
WITHIN = {"td": SECTION | {"table", "tr"}, "th": SECTION | {"table", "tr"}, "tr": SECTION | {"table"}} | dict.fromkeys([*SECTION, "caption", "colgroup"], frozenset(["table"]))
FLOW = BLOCK - {"html", "body", "li", "dt", "dd", "tr", "caption", "legend", "summary"}
HALTS = frozenset("td th table button caption html body".split())


#: Elements nested deeper than this are flattened, as in browsers, which keeps broken pages linear.
NESTED = 512


@dataclass
class Node:
    tag: str
    hidden: bool = False
    start: int | None = None
    children: list[Node | str] = field(default_factory=list)
    #: Text right inside isn't shown, though children may be (visibility).
    veiled: bool = False
    columns: int = 1
    rows: int = 1

    def parts(self) -> list[Node | str]:
        """The children that may show."""
        return [c for c in self.children if not isinstance(c, str)] if self.veiled else self.children


def number(text: str, least: int, most: int) -> int | None:
    m = re.match(r"\s*([+-]?\d{1,9})", text)
    return max(least, min(most, int(m[1]))) if m else None


def tree(source: str) -> Node:
    """The element tree, with implied end tags and rows."""
    root = Node("#root")
    open_ = [root]
    #: Open svg and math elements and the parts of them that hold HTML, with their places.
    foreign: list[tuple[int, Node]] = []
    at, size = 0, len(source)
    last, quoting = source.rfind(">"), True
    #: Open elements that were flattened: their end tags end nothing.
    flat: dict[str, int] = {}
    opened: set[str] = set()

    def add(text: str) -> None:
        if open_[-1].tag == "head" and text.strip(" \t\n\r\f"):
            del open_[-1]
        open_[-1].children.append(text)

    while at < size:
        m = TOKEN.match(source, at)
        if m is None:
            end = source.find("<", at + 1)
            add(source[at : end if end > 0 else size])
            at = end if end > 0 else size
            continue
        at = m.end()
        closing, name, text = m.groups()
        if text is not None:
            add(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if at > last:
            break  # an unfinished tag ends the page
        stop = QUOTED.match(source, at).end() if quoting else source.index(">", at)  # type: ignore[union-attr]
        if source[stop : stop + 1] != ">":
            quoting, stop = False, source.index(">", at)  # an open quote: tags end at the next > from here on
        attributes, at = source[at:stop], stop + 1
        if closing:
            if flat.get(name):
                flat[name] -= 1
                continue
            if name not in opened:
                continue
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == name:
                    del open_[i:]
                    break
                if open_[i].tag in ("td", "th", "table") and name not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "body", "html", "template"):
                    break
                if open_[i].tag == "table" and name not in ("body", "html", "template"):
                    break
            continue
        if open_[-1].tag == "head" and name not in HEAD:
            del open_[-1]
        while foreign and not (foreign[-1][0] < len(open_) and open_[foreign[-1][0]] is foreign[-1][1]):
            foreign.pop()
        while name in BREAKS and foreign and foreign[-1][1].tag in UNDRAWN:
            del open_[foreign.pop()[0] :]
        inside = foreign[-1][1].tag if foreign and foreign[-1][1].tag in UNDRAWN else ""
        closes, halts = CLOSES.get(name, (frozenset(), frozenset())) if not inside else (frozenset(), frozenset())
        if name in FLOW and not inside:
            closes, halts = frozenset(["p"]), HALTS
        for i in range(len(open_) - 1, 0, -1) if closes else ():
            if open_[i].tag in halts:
                break
            if open_[i].tag in closes:
                del open_[i:]
                if name in FLOW or name in ("li", "dt", "dd"):
                    break
        if name in WITHIN and not inside:
            scope = next((i for i in range(len(open_) - 1, 0, -1) if open_[i].tag in ("table", "template")), 0)
            if open_[scope].tag == "table":
                while open_[-1].tag not in WITHIN[name]:
                    open_.pop()
                if name in ("td", "th") and open_[-1].tag != "tr":
                    open_[-1].children.append(Node("tr"))
                    open_.append(open_[-1].children[-1])  # type: ignore[arg-type]
        node = Node(name, name == "dialog" or name in UNDRAWN.get(inside, ()), veiled=open_[-1].veiled)
        if attributes and (name == "dialog" or TELLING.search(attributes)):
            known = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attributes)}
            style = known.get("style", "")
            node.hidden = (node.hidden and not (name == "dialog" and "open" in known)) or "hidden" in known or bool(HIDES.search(style)) or (name == "input" and known.get("type", "").lower() == "hidden")
            for shown in VISIBILITY.findall(style):
                node.veiled = shown.lower() != "visible"
            if name in ("ol", "li"):
                node.start = number(known.get("start" if name == "ol" else "value", ""), -(10**9), 10**9)
            elif name in ("td", "th"):
                node.columns = number(known.get("colspan", ""), 1, 1000) or 1
                node.rows = number(known.get("rowspan", ""), 0, 65534) or (1 if number(known.get("rowspan", ""), 0, 1) is None else 65534)
        open_[-1].children.append(node)
        bare = attributes.rstrip().endswith("/")
        if name in RAW and not (inside and (bare or name not in ("script", "style", "title"))):
            end = re.compile(f"</{name}", re.I | re.A).search(source, at)
            stop = end.start() if end else size
            node.children.append(source[at:stop])
            close = source.find(">", stop)
            at = close + 1 if end and close >= 0 else size
        elif name == "form" and open_[-1].tag in WITHIN["td"]:
            continue  # a form between the parts of a table holds nothing
        elif name not in VOID and not bare:
            if len(open_) > NESTED and not (len(open_) == NESTED + 1 and (node.hidden or name in UNSEEN)):
                flat[name] = flat.get(name, 0) + 1
                if node.veiled != open_[-1].veiled or node.hidden or name in UNSEEN:
                    open_[-1].children[-1] = Node("")
                continue
            opened.add(name)
            if name in UNDRAWN or name in HOLDS.get(inside, ()):
                foreign.append((len(open_), node))
            open_.append(node)
    return root


class Page:
    """Lines of text with the space between blocks collapsed to at most one empty line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []
        self.gap = 0

    def write(self, text: str) -> None:
        self.words.append(text)

    def end(self, gap: int = 0) -> None:
        line = re.sub(r"[ \t\n\r\f]+", " ", "".join(self.words)).strip(" ")
        self.words = []
        if line:
            self.put([line])
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str]) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.lines += lines
        self.gap = 0


def cells(table: Node) -> tuple[list[list[Node]], list[Node | str]]:
    """Rows of visible cells of a table, and what stands outside of them; nested tables left alone."""
    rows: list[list[Node]] = []
    stray: list[Node | str] = []
    todo: list[tuple[Node | str, bool]] = [(x, False) for x in reversed(table.parts())]
    while todo:
        x, in_row = todo.pop()
        if isinstance(x, str):
            stray.append(x)
        elif x.hidden:
            continue
        elif x.tag in ("td", "th") and in_row:
            rows[-1].append(x)
        elif x.tag == "tr" and not in_row:
            rows.append([])
            todo += [(y, True) for y in reversed(x.parts())]
        elif x.tag in SECTION and not in_row:
            todo += [(y, False) for y in reversed(x.parts())]
        elif x.tag != "caption":
            stray.append(x)
    return rows, stray


def drawn(svg: Node) -> list[Node | str]:
    """The parts of an svg element that show text, each followed by a space."""
    out: list[Node | str] = []
    todo = list(reversed(svg.parts()))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not x.hidden and x.tag not in UNSEEN:
            if x.tag in ("text", "foreignobject"):
                out += [x, " "]
            else:
                todo += reversed(x.parts())
    return out


#: A longer cell doesn't widen its column, and a grid has at most so many places for each cell.
WIDEST, ROOM = 120, 20


def placed(found: list[list[Node]], depth: int) -> list[list[tuple[int, int, str]]]:
    """First column, column after the last, and text of every cell, row by row.

    Cells over several rows keep their columns free below, unless that makes nearly all of the
    grid empty.
    """
    texts = [[" ".join(y for y in render(c, depth + 1) if y) for c in row] for row in found]
    room = ROOM * sum(map(len, found)) + 10_000
    out: list[list[tuple[int, int, str]]] = []
    held: list[tuple[int, int, int]] = []  # first column, column after the last, rows still to come
    for row, words in zip(found, texts, strict=True):
        held.sort()
        at, own, k = 0, [], 0
        for c, text in zip(row, words, strict=True):
            while k < len(held) and held[k][0] <= at:
                at = max(at, held[k][1])
                k += 1
            own.append((at, at + c.columns, text))
            at += c.columns
        held = [(a, z, n - 1) for a, z, n in held if n > 1] + [(a, z, c.rows - 1) for (a, z, _), c in zip(own, row, strict=True) if c.rows > 1]
        room -= len(held)
        if room < 0:
            held = []
        out.append(own)
    return out


def laid(found: list[list[Node]], depth: int) -> list[str]:
    """Lines of a table's rows: cells padded to columns; a cell over several columns has their width.

    Only columns at which some cell begins count, so wide spans cost nothing.
    """
    rows = placed(found, depth)
    begins = sorted({a for own in rows for a, _, _ in own})
    index = {a: i for i, a in enumerate(begins)}
    width = [0] * len(begins)
    spans = [[(index[a], bisect.bisect_left(begins, z), text) for a, z, text in own] for own in rows]
    for own in spans:
        for i, j, text in own:
            if j == i + 1 and len(text) <= WIDEST:
                width[i] = max(width[i], len(text))
    edge = [0, *itertools.accumulate(w + 3 for w in width)]
    lines = []
    for own in spans:
        line, end = "", 0
        if any(text for _, _, text in own):
            for i, j, text in own:
                line += " " * (edge[i] - edge[end]) + text.ljust(edge[j] - edge[i] - 3) + " | "
                end = j
            lines.append(line.removesuffix(" | ").rstrip())
    return lines


#: Lists and tables nested deeper than this are written as plain blocks.
DEEPEST = 60


def render(node: Node, depth: int = 0) -> list[str]:
    """Lines of all that is visible below ``node``."""
    page = Page()
    stack: list[tuple[Node | str, str]] = [(x, "") for x in reversed(node.parts())]
    while stack:
        x, what = stack.pop()
        if what == "end":
            page.end(1 if x.tag in SPACED else 0)  # type: ignore[union-attr]
        elif isinstance(x, str):
            page.write(entities.unescape(x))
        elif x.hidden or x.tag in UNSEEN:
            continue
        elif x.tag == "br":
            page.end()
        elif x.tag == "svg":
            stack += [(y, "") for y in reversed([" ", *drawn(x)])]
        elif x.tag == "textarea":
            page.end()
            lines = [line.rstrip() for line in plain(x).strip("\n").split("\n")]
            if any(lines):
                page.put(lines)
        elif x.tag == "pre":
            page.end(1)
            page.put([line.rstrip() for line in plain(x).strip("\n").split("\n")])
            page.gap = 1
        elif x.tag in ("ul", "ol", "menu") and depth < DEEPEST:
            page.end(1)
            n, lines = 1 if x.start is None else x.start, []
            for item in x.parts():
                if isinstance(item, Node) and not item.hidden and item.tag not in UNSEEN:
                    n = item.start if item.tag == "li" and item.start is not None else n
                    body = [y for y in (render(item, depth + 1) if item.tag == "li" else render(Node("", children=[item]), depth + 1)) if y]
                    mark = f"{n}. " if x.tag == "ol" else "- "
                    if body and item.tag == "li":
                        lines += [mark + body[0], *[" " * len(mark) + y for y in body[1:]]]
                        n += 1
                    else:
                        lines += body
                elif isinstance(item, str) and item.strip():
                    lines.append(entities.unescape(item).strip())
            if lines:
                page.put(lines)
            page.gap = 1
        elif x.tag == "table" and depth < DEEPEST:
            page.end(1)
            found, stray = cells(x)
            lines = render(Node("", children=stray), depth + 1)
            if lines:
                page.put(lines)
                page.gap = 1
            for c in x.children:
                if isinstance(c, Node) and c.tag == "caption" and not c.hidden:
                    page.put(render(c, depth + 1))
            lines = laid(found, depth)
            if lines:
                page.put(lines)
            page.gap = 1
        else:
            if x.tag in BLOCK or x.tag in ("option", "optgroup"):
                page.end(1 if x.tag in SPACED else 0)
                stack.append((x, "end"))
            elif x.tag in ("td", "th", "mi", "mn", "mo", "ms", "mtext"):
                page.write(" ")
            stack += [(y, "") for y in reversed(x.parts())]
    page.end()
    return page.lines


def plain(node: Node) -> str:
    """Text below a preformatted element, as it stands."""
    out, todo = [], list(reversed(node.parts()))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(entities.unescape(x))
        elif x.tag == "br":
            out.append("\n")
        elif not x.hidden and x.tag not in UNSEEN:
            todo += reversed(drawn(x) if x.tag == "svg" else x.parts())
    return "".join(out)


def visible_text(source: str | None) -> str | None:
    return None if source is None else "\n".join(render(tree(source)))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html", 4_000_000):
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), pa.array([visible_text(x) for x in part.column("html").to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string")
