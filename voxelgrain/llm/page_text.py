"""Visible text of web pages, laid out by blocks. General: the library keeps no pages. A table of pages has (page_id, html)."""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxelgrain.llm.records import text_slices

# fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template noscript title svg annotation annotation-xml mphantom iframe object audio video canvas select datalist".split())
# what may stand in a head; anything else ends it
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure menu".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
ENDS_PARAGRAPH = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
GAPS = re.compile(r"[ \t\n\r\f]+")
ROOT = "#root"
WIDEST = 1000


class Element:
    """A node of the page's tree; children are elements and strings."""

    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str | None]):
        self.name, self.attributes, self.children = name, attributes, []

    def hidden(self) -> bool:
        if self.name in HIDDEN or "hidden" in self.attributes or (self.name == "dialog" and "open" not in self.attributes):
            return True
        return bool(NOT_SHOWN.search(self.attributes.get("style") or ""))


class TreeBuilder(HTMLParser):
    """Builds the tree with the tags that HTML implies: open items, cells and paragraphs end where the next ones begin."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element(ROOT, {})
        self.open = [self.root]
        # where the open elements of each name stand, so that deep pages need no search
        self.places: dict[str, list[int]] = {}

    def _last(self, names: set[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def _cut(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().name].pop()

    def _end(self, names: set[str], within: set[str]) -> None:
        fence = self._last(within)
        while (at := self._last(names)) > fence:
            self._cut(at)

    def _end_head(self, tag: str | None) -> None:
        if self.open[-1].name == "head" or tag == "body":
            self._end({"head"}, {"template"})

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in HEAD:
            self._end_head(tag)
        if tag in CLOSES:
            self._end(*CLOSES[tag])
        if tag in ENDS_PARAGRAPH and self.places.get("p"):
            self._end({"p"}, {"table", "td", "th", "li", "div", "article", "section", "body"})
        if tag in ("td", "th") and self.open[-1].name in ("table", "tbody", "thead", "tfoot"):
            self._push(Element("tr", {}))
        element = Element(tag, dict(attrs))
        if tag in VOID:
            self.open[-1].children.append(element)
        else:
            self._push(element)

    def _push(self, element: Element) -> None:
        self.open[-1].children.append(element)
        self.places.setdefault(element.name, []).append(len(self.open))
        self.open.append(element)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = self._last({tag})
        inner = tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html")
        if at and (inner or self._last({"table", "td", "th"}) <= at):
            self._cut(at)

    def handle_data(self, data: str) -> None:
        if data.strip(" \t\n\r\f"):
            self._end_head(None)
        self.open[-1].children.append(data)


class Layout:
    """Lines of visible text. Blocks begin lines, some leave a blank line around them, white space collapses outside ``pre``."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.blank = False

    def word(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.split("\n")
            self._add(first)
            for part in rest:
                self.break_line()
                self._add(part)
            return
        text = GAPS.sub(" ", text)
        if not self.line or self.line.endswith(" "):
            text = text.lstrip(" ")
        self._add(text)

    def _add(self, text: str) -> None:
        if not text:
            return
        if self.blank and not self.line and self.lines:
            self.lines.append("")
        self.blank = False
        self.line += text

    def break_line(self) -> None:
        if self.line:
            self.lines.append(self.line.rstrip())
        self.line = ""

    def space(self) -> None:
        self.break_line()
        self.blank = True

    def text(self) -> str:
        self.break_line()
        return "\n".join(self.lines).strip("\n")


def _whole(text: str | None, least: int, most: int) -> int | None:
    """An attribute as a whole number within bounds."""
    return min(max(int(text), least), most) if re.fullmatch(r"\s*-?\d{1,9}\s*", text or "", re.A) else None


def _cells(table: Element) -> Generator[list[Element], str, list[list[str]]]:
    """The cells of every row, through any element between a table, its rows and their cells; cells outside a row begin one.

    Asks for the text of each cell; a cell over several columns leaves the others empty.
    """
    rows: list[list[str]] = []
    waiting: list[tuple[object, list[str] | None]] = [(iter(table.children), None)]
    while waiting:
        children, row = waiting[-1]
        child = next(children, None)
        if child is None:
            waiting.pop()
        elif isinstance(child, Element) and not child.hidden():
            if child.name in ("td", "th"):
                if row is None:
                    row = []
                    rows.append(row)
                    waiting[-1] = (children, row)
                row.append(" ".join((yield [child]).split("\n")))
                row += [""] * ((_whole(child.attributes.get("colspan"), 1, WIDEST) or 1) - 1)
            else:
                if child.name in ("tr", "table"):
                    row = [] if child.name == "tr" else None
                    if row is not None:
                        rows.append(row)
                waiting.append((iter(child.children), row))
    return [r for r in rows if r]


def _only_cells(table: Element) -> bool:
    """Whether all visible text of a table stands in its cells."""
    waiting = [*table.children]
    while waiting:
        child = waiting.pop()
        if isinstance(child, str):
            if child.strip():
                return False
        elif not child.hidden() and child.name not in ("td", "th"):
            if child.name == "img" and (child.attributes.get("alt") or "").strip():
                return False
            waiting += child.children
    return True


def rendered(children: list) -> str:
    """Visible text of nodes; what waits for the text of a cell stands on a stack of its own, however deep tables nest."""
    waiting, text = [_rendered(children)], None
    while waiting:
        try:
            inner = waiting[-1].send(text)
            waiting.append(_rendered(inner))
            text = None
        except StopIteration as done:
            waiting.pop()
            text = done.value
    return text


def _rendered(children: list) -> Generator[list[Element], str, str]:
    """Visible text of nodes, asking for the text of table cells."""
    out = Layout()
    lists: list[list] = []
    waiting: list[tuple[object, bool, str]] = [(c, False, "in") for c in reversed(children)]
    while waiting:
        node, keep, move = waiting.pop()
        if isinstance(node, str):
            out.word(node, keep)
            continue
        name = node.name
        if move == "out":
            if name in ("ul", "ol", "menu"):
                lists.pop()
            if name in SPACED and not (name in ("ul", "ol", "menu") and lists):
                out.space()
            elif name in BLOCK:
                out.break_line()
            continue
        if node.hidden():
            continue
        if name == "br":
            if out.line:
                out.break_line()
            continue
        if name == "img":
            out.word(node.attributes.get("alt") or "", False)
            continue
        if name in SPACED and not (name in ("ul", "ol", "menu") and lists):
            out.space()
        elif name in BLOCK:
            out.break_line()
        if name in ("ul", "ol", "menu"):
            given = _whole(node.attributes.get("start"), -(10**9), 10**9)
            lists.append([name, 0 if given is None else given - 1])
        if name == "li":
            mark = "- "
            if lists and lists[-1][0] == "ol":
                given = _whole(node.attributes.get("value"), -(10**9), 10**9)
                lists[-1][1] = lists[-1][1] + 1 if given is None else given
                mark = f"{lists[-1][1]}. "
            out.word("  " * max(len(lists) - 1, 0) + mark, True)
        if name == "table" and _only_cells(node):
            rows = yield from _cells(node)
            widths = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
            for row in rows:
                out.word(" | ".join(c.ljust(w) for c, w in zip(row, widths, strict=False)).rstrip(), True)
                out.break_line()
            out.space()
            continue
        waiting.append((node, keep, "out"))
        inner = keep or name == "pre"
        waiting.extend((c, inner, "in") for c in reversed(node.children))
    return out.text()


def page_text(html: str | None) -> str:
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    return rendered(builder.root.children)


def extract_pages(pages: DataFrame, *, key: str = "page_id", html: str = "html", text: str = "text") -> DataFrame:
    """(key, text): all visible text of every page, in reading order.

    Blocks begin lines and paragraphs, headings, lists and tables leave a blank line; list items carry a dash or number and
    indent by depth; table cells are padded to columns. Hidden elements, scripts, styles and form choices are left out.
    Null and empty pages give an empty text, broken markup what a browser would show of it. Repeated rows repeat; other
    columns are not read; no rows in, no rows out. Pages of any length and depth are walked without recursion.
    """
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, html):
                texts = [page_text(h) for h in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(texts, pa.string())], names=[key, text])

    return pages.select(key, html).mapInArrow(run, schema)
