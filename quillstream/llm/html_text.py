"""Layout-aware text of HTML pages.

A tree builder turns tags into elements, supplying the end tags that HTML lets authors leave out;
visibility rules (elements that never render, hidden attributes, inline styles, and the page's own style
sheets as a screen of SCREEN pixels applies them: tags, classes, ids, descendants and children, by
specificity) hide subtrees, or texts where only their visibility is taken; a renderer then emits all visible
text: inline text flows with collapsed white space, blocks stand on lines of their own, paragraphs and headings
keep a blank line around them, lists get bullets or numbers, and tables are aligned cell by cell, cells over
several rows or columns included.

Selectors of other kinds (attributes, states, siblings) hide nothing. Elements nest to any depth.

Defined results: a null or empty page has an empty text; a page of any length is rendered whole; a null id keeps
its row; unclosed tags, comments and quotes end with the page; repeated rows get a row each; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm._support import named, ship


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Fixed values of the HTML standard: element categories.
VOID = _names("area base br col embed hr img input link meta param source track wbr")
RAW = _names("script style textarea title xmp iframe noembed noframes")
UNSEEN = _names(
    "head script style template noscript iframe noembed noframes object audio video canvas "
    "datalist select title meta link base input param source track dialog desc metadata defs"
)
BLOCK = _names(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table "
    "caption colgroup thead tbody tfoot tr td th ul"
)
SPACED = _names("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure")
CLOSES_P = BLOCK - _names("html body caption colgroup thead tbody tfoot tr td th legend")
#: A start tag ends an open element of these kinds, searched up to the elements that bound it.
IMPLIED_END = {
    "li": (_names("li"), _names("ul ol menu dir")),
    "dt": (_names("dt dd"), _names("dl")),
    "dd": (_names("dt dd"), _names("dl")),
    "td": (_names("td th"), _names("tr table")),
    "th": (_names("td th"), _names("tr table")),
    "tr": (_names("tr td th caption colgroup"), _names("table thead tbody tfoot")),
    "thead": (_names("thead tbody tfoot tr td th caption colgroup"), _names("table")),
    "tbody": (_names("thead tbody tfoot tr td th caption colgroup"), _names("table")),
    "tfoot": (_names("thead tbody tfoot tr td th caption colgroup"), _names("table")),
    "option": (_names("option"), _names("select datalist optgroup")),
    "optgroup": (_names("option optgroup"), _names("select")),
    "body": (_names("head"), _names("html")),
}
#: What must stand around a cell or row; missing ones are supplied.
PARENT = {"td": "tr", "th": "tr", "tr": "table"}
PARENT_OK = {"td": _names("tr"), "th": _names("tr"), "tr": _names("table thead tbody tfoot")}

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)")
WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([0-9.]+)px\s*\)")
#: Width in pixels for which media rules are decided.
SCREEN = 1280
SPACES = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None" = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def build(page: str) -> tuple[Element, list[str], int]:
    """The tree of a page, the texts of its style sheets, and how deep elements nest."""
    root = Element("html", {})
    stack, styles, at, deepest = [root], [], 0, 1

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece))

    def close_within(tags: frozenset[str], bounds: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in bounds:
                return
            if stack[k].tag in tags:
                outer = k
                while outer > 1 and stack[outer - 1].tag in tags:
                    outer -= 1
                del stack[outer:]
                return

    def close_p() -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                return
            if stack[k].tag in BLOCK:
                return

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break  # an end tag does not reach out of its cell
            continue
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), _attributes(m[3])
        if tag == "html":
            root.attrs.update(attrs)
            continue
        if tag in IMPLIED_END:
            close_within(*IMPLIED_END[tag])
        if tag in CLOSES_P:
            close_p()
        if tag in PARENT and stack[-1].tag not in PARENT_OK[tag]:
            for missing in ([PARENT[tag]] if PARENT[tag] != "tr" or stack[-1].tag in PARENT_OK["tr"] else ["table", "tr"]):
                extra = Element(missing, {}, stack[-1])
                stack[-1].children.append(extra)
                stack.append(extra)
        element = Element(tag, attrs, stack[-1])
        stack[-1].children.append(element)
        deepest = max(deepest, len(stack) + 1)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            body = page[at : close.start()] if close else page[at:]
            at = close.end() if close else end
            if tag == "style":
                styles.append(body)
            elif tag == "textarea":
                element.children.append(html.unescape(body))
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(element)
        elif tag not in VOID:
            stack.append(element)  # a slash does not close an HTML element
    return root, styles, deepest


def on_screen(query: str) -> bool:
    """Whether a media query list holds on a screen of SCREEN pixels."""

    def holds(one: str) -> bool:
        words = one.split()
        if not words or words[0] == "not":
            return not words
        kind = words[1] if words[0] == "only" and len(words) > 1 else words[0]
        if not kind.startswith("(") and kind not in ("all", "screen"):
            return False
        return all(SCREEN >= float(x) if side == "min" else SCREEN <= float(x) for side, x in WIDTH.findall(one))

    return any(holds(one.strip()) for one in query.lower().split(","))


def rules_of(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet that hold on a screen, rules inside @media and @supports among them."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
    at, open_ = 0, []  # open_: whether each enclosing block's rules hold
    for m in re.finditer(r"[{}]", sheet):
        if m[0] == "}":
            if open_:
                open_.pop()
            at = m.end()
            continue
        head = sheet[at : m.start()].rpartition(";")[2].strip()
        at = m.end()
        if head.startswith("@"):
            name, _, query = head.partition(" ")
            open_.append(name.lower() == "@supports" or name.lower() in ("@media", "@layer", "@container") and (name.lower() != "@media" or on_screen(query)))
            continue
        end = re.compile(r"[{}]|\Z").search(sheet, at)
        if all(open_):
            yield head, sheet[at : end.start()]
        open_.append(False)


def declared(style: str) -> dict[str, str]:
    return {name.lower(): value.lower() for name, value in DECLARED.findall(style)}


class Styles:
    """What the page's style sheets declare of display and visibility, by the last part of each selector."""

    def __init__(self, sheets: list[str]):
        self.by_key: dict[str, list[tuple]] = {}
        order = 0
        for sheet in sheets:
            for selectors, body in rules_of(sheet):
                found = declared(body)
                if not found:
                    continue
                for selector in selectors.split(","):
                    parts = re.sub(r"\s*>\s*", " >", selector.strip().lower()).split()
                    chain = [self.compound(x.lstrip(">")) for x in parts]
                    if chain and all(chain):
                        weight = tuple(sum(c[k] for c in (self.weight(x) for x in chain)) for k in range(3))
                        tag, classes, ids = chain[-1]
                        key = "#" + min(ids) if ids else "." + min(classes) if classes else tag
                        steps = [(c, x.startswith(">")) for c, x in zip(chain, parts, strict=True)]
                        order += 1
                        self.by_key.setdefault(key, []).append((weight, order, steps, found))

    @staticmethod
    def compound(text: str) -> tuple[str, frozenset, frozenset] | None:
        m = COMPOUND.fullmatch(text)
        if not m or not text:
            return None
        names = re.findall(r"[.#][\w-]+", m[2])
        return (m[1] or "*", frozenset(n[1:] for n in names if n[0] == "."), frozenset(n[1:] for n in names if n[0] == "#"))

    @staticmethod
    def weight(c: tuple[str, frozenset, frozenset]) -> tuple[int, int, int]:
        return len(c[2]), len(c[1]), int(c[0] != "*")

    @staticmethod
    def fits(e: "Element", c: tuple[str, frozenset, frozenset]) -> bool:
        tag, classes, ids = c
        if tag not in ("*", e.tag):
            return False
        if classes and not classes <= {x.lower() for x in e.attrs.get("class", "").split()}:
            return False
        return not ids or ids == {e.attrs.get("id", "").lower()}

    def reaches(self, e: "Element", steps: list) -> bool:
        """Whether the selector's parts fit e and elements above it; a part after > asks for the parent itself."""
        if not self.fits(e, steps[-1][0]):
            return False
        if len(steps) == 1:
            return True
        path = [e]
        while path[-1].parent is not None:
            path.append(path[-1].parent)
        met = {0}  # how far up the path the part before may lie
        for (c, _), (_, child) in zip(reversed(steps[:-1]), reversed(steps), strict=False):
            within = {i + 1 for i in met} if child else set(range(min(met) + 1, len(path)))
            met = {i for i in within if i < len(path) and self.fits(path[i], c)}
            if not met:
                return False
        return True

    def of(self, e: "Element") -> dict[str, str]:
        """The winning values for e: inline style over specificity over order."""
        found: dict[str, str] = {}
        if self.by_key:
            keys = ["*", e.tag, *{"." + x.lower() for x in e.attrs.get("class", "").split()}, *(["#" + e.attrs["id"].lower()] if "id" in e.attrs else [])]
            met = [r for k in keys for r in self.by_key.get(k, ()) if self.reaches(e, r[2])]
            for _, _, _, values in sorted(met, key=lambda r: r[:2]):
                found |= values
        if style := e.attrs.get("style"):
            found |= declared(style)
        return found


def is_hidden(e: Element, styles: Styles) -> bool:
    if e.tag in UNSEEN and not (e.tag == "dialog" and "open" in e.attrs):
        return True
    display = styles.of(e).get("display")
    return display == "none" or display is None and "hidden" in e.attrs


def is_seen(e: Element, styles: Styles, above: bool) -> bool:
    """Visibility, which elements inside may take back."""
    value = styles.of(e).get("visibility")
    return above if value in (None, "inherit") else value not in ("hidden", "collapse")


def width(text: str) -> int:
    """Columns of a text on a fixed-width page."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines under construction: a current inline run, and how many blank lines must precede it."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.space, self.blank = False, False

    def add(self, text: str) -> None:
        if text[:1] in " \t\n\r\f":
            self.space = True
        for word in SPACES.split(text.strip(" \t\n\r\f")):
            if word:
                if self.space and self.run:
                    self.run.append(" ")
                self.run.append(word)
                self.space = True
        if text.strip(" \t\n\r\f"):
            self.space = text[-1] in " \t\n\r\f"

    def end_line(self) -> None:
        if self.run:
            self.put(["".join(self.run)])
        self.run, self.space = [], False

    def put(self, lines: list[str]) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines += lines

    def want_blank(self) -> None:
        self.end_line()
        self.blank = True


def _render(e: Element, out: Lines, styles: Styles, seen: bool, item: bool = False) -> None:
    """e's children into out; seen: whether texts are visible; item: whether e is an entry of a list."""
    for child in e.children:
        if isinstance(child, str):
            out.add(child if seen else " ")
            continue
        tag = child.tag
        if is_hidden(child, styles):
            continue
        own = is_seen(child, styles, seen)
        if tag == "br":
            out.end_line() if out.run else out.put([""])
        elif tag == "hr":
            out.end_line()
            out.put(["---"])
        elif tag == "table":
            _spaced(out, _table(child, styles, own))
        elif tag in ("ul", "ol", "menu", "dir"):
            lines = _list(child, styles, own)
            if item:
                out.end_line()
                out.blank = False
                out.put(lines)
            else:
                _spaced(out, lines)
        elif tag in ("pre", "textarea"):
            raw = "".join(_flat(child, styles, own)).strip("\n").split("\n")
            _spaced(out, [x.rstrip() for x in raw] if any(raw) else [])
        elif tag == "blockquote":
            _spaced(out, [("> " + x).rstrip() for x in _block(child, styles, own)])
        elif tag in BLOCK:
            spaced = tag in SPACED
            out.want_blank() if spaced else out.end_line()
            if tag == "dd":
                out.put(["  " + x if x else x for x in _block(child, styles, own)])
            else:
                _render(child, out, styles, own, tag == "li")
            out.want_blank() if spaced else out.end_line()
        else:
            _render(child, out, styles, own)


def _spaced(out: Lines, lines: list[str]) -> None:
    out.want_blank()
    if lines:
        out.put(lines)
    out.blank = True


def _flat(e: Element, styles: Styles, seen: bool) -> list[str]:
    """All visible texts below e."""
    found, todo = [], [(c, seen) for c in reversed(e.children)]
    while todo:
        child, seen = todo.pop()
        if isinstance(child, str):
            found.append(child if seen else "")
        elif child.tag == "br":
            found.append("\n")
        elif not is_hidden(child, styles):
            own = is_seen(child, styles, seen)
            todo.extend((c, own) for c in reversed(child.children))
    return found


def _block(e: Element, styles: Styles, seen: bool) -> list[str]:
    out = Lines()
    _render(e, out, styles, seen, e.tag == "li")
    out.end_line()
    return out.lines


def _alone(child: Element | str, styles: Styles, seen: bool) -> list[str]:
    """A child that stands outside the entries or cells where it should be."""
    around = Element("div", {})
    around.children = [child]
    return _block(around, styles, seen)


def _list(e: Element, styles: Styles, seen: bool) -> list[str]:
    lines: list[str] = []
    number = _whole(e.attrs.get("start"), 1)
    for child in e.children:
        if isinstance(child, Element) and child.tag == "li":
            if is_hidden(child, styles):
                continue
            number = _whole(child.attrs.get("value"), number)
            mark = f"{number}. " if e.tag == "ol" else "- "
            number += 1
            own = _block(child, styles, is_seen(child, styles, seen))
            lines += [(mark if k == 0 else " " * len(mark)) + x if x else x for k, x in enumerate(own)] or [mark.rstrip()]
        elif isinstance(child, Element) or child.strip():
            lines += ["  " + x if x else x for x in _alone(child, styles, seen)]
    return lines


def _whole(text: str | None, otherwise: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", text) else otherwise


def _table(e: Element, styles: Styles, seen: bool) -> list[str]:
    before: list[str] = []
    rows: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # columns into which a cell of a row above reaches, and for how many rows more

    def take(group: Element, seen: bool) -> None:
        for child in group.children:
            if isinstance(child, str):
                if child.strip() and seen:
                    before.append(SPACES.sub(" ", child).strip())
            elif is_hidden(child, styles):
                continue
            elif child.tag == "tr":
                take_row(child, is_seen(child, styles, seen))
            elif child.tag in ("thead", "tbody", "tfoot"):
                take(child, is_seen(child, styles, seen))
                taken.clear()  # no cell reaches out of its group
            else:
                before.extend(_alone(child, styles, seen))

    def take_row(tr: Element, seen: bool) -> None:
        cells: dict[int, list[str]] = {}
        reach: dict[int, int] = {}
        at = 0
        for cell in tr.children:
            wide, high = 1, 1
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                if isinstance(cell, str) and not cell.strip():
                    continue
                lines = _alone(cell, styles, seen)
            elif is_hidden(cell, styles):
                continue
            else:
                lines = _block(cell, styles, is_seen(cell, styles, seen))
                wide, high = (min(max(1, _whole(cell.attrs.get(name), 1)), most) for name, most in (("colspan", 1000), ("rowspan", 65534)))
                if _whole(cell.attrs.get("rowspan"), 1) == 0:
                    high = 65534  # to the end of its group
            while at in taken:
                at += 1
            cells[at] = lines
            for c in range(at, at + wide):
                reach[c] = high - 1
            at += wide
        for c in [c for c, left in taken.items() if left == 1]:
            del taken[c]
        for c in taken:
            taken[c] -= 1
        taken.update({c: left for c, left in reach.items() if left > 0})
        rows.append(cells)

    take(e, seen)
    used = sorted({c for r in rows for c in r})
    wide = {c: max(width(x) for r in rows if c in r for x in [*r[c], ""]) for c in used}
    last = max(used, default=-1)
    lines = before
    for r in rows:
        for k in range(max((len(c) for c in r.values()), default=0)):
            line = ""
            for c in range(last + 1) if last < 4096 else used:
                piece = r[c][k] if c in r and k < len(r[c]) else ""
                line += piece + " " * (wide.get(c, 0) - width(piece) + 2)
            lines.append(line.rstrip())
    return lines


def page_text(page: str | None) -> str:
    """The visible text of one page."""
    root, sheets, deepest = build(page or "")
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 1000 + 6 * deepest))  # a level of elements is a few calls, all in Python
    try:
        lines = _block(root, Styles(sheets), True)
    finally:
        sys.setrecursionlimit(before)
    return "\n".join(lines).strip("\n")


def render(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines), one row per row of pages."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                ],
                names=["page_id", "text", "n_chars", "n_lines"],
            )

    rows = pages.select(named(pages, id_col).cast("long").alias("page_id"), named(pages, html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
