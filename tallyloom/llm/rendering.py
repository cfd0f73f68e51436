"""Layout-aware text of HTML pages.

A scanner finds tags, text and comments; a tree builder opens and closes
elements with the implied tags of HTML (a paragraph ends before a block, a list
item before the next, cells and rows before their like, everything at the end
of the page); style sheets and attributes decide what a browser shows on a
screen (``display`` removes an element, ``visibility`` hides text that inner
elements may show again; selectors of tags, classes and ids under descendant and
child combinators count); a renderer
writes blocks on lines of their own, paragraphs and headings with an empty line
around, list items with their mark and depth, and table cells in columns of one
width.

Defined cases: a null page gives a null text; an empty page, or one with
nothing visible, an empty one. Unknown tags are inline. End tags without a
start are passed over. Depth has no limit: nothing here recurses. Rows with a
repeated or null id are rendered like any other; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption legend".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure article section header footer main nav aside form fieldset hr".split())
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend".split())
UNSEEN = frozenset("head script style template noembed noframes iframe object audio video canvas datalist meta link title param source track area base".split())
UNSEEN_IN_PICTURES = frozenset("desc defs symbol metadata clippath mask pattern marker annotation annotation-xml".split())
WITHOUT_TEXT = frozenset("hidden checkbox radio password file color range image".split())
# What a start tag closes: the like elements, up to the nearest of these borders.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (frozenset(("td", "th")), frozenset(("table",))),
    "th": (frozenset(("td", "th")), frozenset(("table",))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "tbody": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset()),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
SCOPE = frozenset("table td th caption button html template".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'=<>`]+)))?")
_SHOWING = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([\w-]+)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_COMPOUND = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)", re.I)
_SCREEN = re.compile(r"\s*(?:only\s+)?(?:screen|all)?\s*", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if raw and not raw.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(raw):
            out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def build(page: str) -> tuple[Node, list[str]]:
    """The tree of a page and the texts of its style sheets."""
    root = Node("#root", {}, None)
    at, styles, pos = root, [], 0
    opened: Counter[str] = Counter()  # open elements by tag, so that what is not open is not looked for

    def enter(node: Node) -> None:
        nonlocal at
        at = node
        opened[node.tag] += 1

    def leave(node: Node) -> None:
        """Close everything up to the node."""
        nonlocal at
        end = node.parent
        while at is not end:
            opened[at.tag] -= 1
            at = at.parent

    def close(tags: frozenset, border: frozenset, all_: bool = False) -> None:
        """Close the nearest open element of these (or all up to the border) and what is open in it."""
        nonlocal at
        if not any(opened[t] for t in tags):
            return
        n, last = at, None
        while n is not root and n.tag not in border:
            if n.tag in tags:
                last = n
                if not all_:
                    break
            n = n.parent
        if last is not None:
            leave(last)

    while pos < len(page):
        m = _TOKEN.search(page, pos)
        if m is None:
            at.children.append(html.unescape(page[pos:]))
            break
        if m.start() > pos:
            at.children.append(html.unescape(page[pos : m.start()]))
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" or tag in BLOCK:
                close(frozenset((tag,)), frozenset(("table",)) - {tag} if tag not in ("body", "html", "div", "article") else frozenset())
            elif tag == "br":
                at.children.append(Node("br", {}, at))
            else:
                close(frozenset((tag,)), BLOCK | SCOPE if tag != "select" else SCOPE)
            continue
        if tag in ENDS_P:
            close(frozenset(("p",)), SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag], all_=tag in ("tr", "tbody", "thead", "tfoot"))
        elif at.tag == "head" and tag not in UNSEEN and tag != "noscript":
            leave(at)
        if tag in ("td", "th") and at.tag in ("table", "tbody", "thead", "tfoot"):
            at.children.append(Node("tr", {}, at))
            enter(at.children[-1])
        node = Node(tag, attributes(m[3]), at)
        at.children.append(node)
        if tag in RAW or tag in ESCAPABLE_RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, pos)
            body = page[pos : end.start()]
            if tag == "style":
                styles.append(body)
            node.children.append(html.unescape(body) if tag in ESCAPABLE_RAW else body)
            pos = max(end.end(), pos)
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path")):
            enter(node)
    return root, styles


class Rule:
    """A selector of compounds (tag, classes, ids) under descendant and child combinators, and what it says about display and visibility."""

    __slots__ = ("parts", "rank", "says")

    def __init__(self, parts: list[tuple[str, str, frozenset, frozenset]], says: dict[str, str], order: int):
        self.parts, self.says = parts, says
        self.rank = (sum(len(p[3]) for p in parts), sum(len(p[2]) for p in parts), sum(p[1] not in ("", "*") for p in parts), order)

    def fits(self, node: Node, k: int = -1) -> bool:
        """Whether compounds up to the ``k``th, counted from the end, fit the node and those above it."""
        link, tag, classes, ids = self.parts[k]
        if tag not in ("", "*", node.tag) or ids and node.attrs.get("id") not in ids or len(ids) > 1 or classes and not classes <= set(node.attrs.get("class", "").split()):
            return False
        if -k == len(self.parts):
            return True
        up = node.parent
        while up is not None and up.tag != "#root":
            if self.fits(up, k - 1):
                return True
            if link == ">":
                return False
            up = up.parent
        return False


def selector(text: str) -> list[tuple[str, str, frozenset, frozenset]] | None:
    """Compounds with the combinator before each; None for selectors of any other kind."""
    parts, link = [], ""
    for word in text.replace(">", " > ").split():
        if word == ">":
            link = ">"
            continue
        m = _COMPOUND.fullmatch(word)
        if not m or not word:
            return None
        names = re.findall(r"[.#][\w-]+", m[2])
        parts.append((link, (m[1] or "").lower(), frozenset(n[1:] for n in names if n[0] == "."), frozenset(n[1:] for n in names if n[0] == "#")))
        link = ""
    return parts or None


def says(declarations: str) -> dict[str, str]:
    return {name.lower(): value.lower() for name, value in _SHOWING.findall(declarations)}


def showing_rules(styles: list[str]) -> dict[str, list[Rule]]:
    """Rules on display and visibility that hold on a screen, by what the last compound asks for: an id, a class, a tag or nothing.

    Blocks of ``@media`` count where a query names the screen or all media without more conditions; ``@supports`` and ``@layer`` count, other at-rules don't.
    """
    found: dict[str, list[Rule]] = {}
    order = 0
    for sheet in styles:
        sheet = _COMMENT.sub("", sheet)
        holds, start = [True], 0  # a flag for each open block; a rule's own block is not in here
        pos = 0
        while (m := re.compile(r"[{};]").search(sheet, pos)) is not None:
            head = sheet[start : m.start()].strip()
            pos = start = m.end()
            if m[0] == "}":
                if len(holds) > 1:
                    holds.pop()
            elif m[0] == "{":
                if head.startswith("@"):
                    name, _, rest = head[1:].partition(" ")
                    applies = name.lower() in ("supports", "layer") or name.lower() == "media" and any(q.strip() and _SCREEN.fullmatch(q) for q in rest.split(","))
                    holds.append(holds[-1] and applies)
                    continue
                end = sheet.find("}", pos)
                body = sheet[pos : end if end >= 0 else len(sheet)]
                pos = start = end + 1 if end >= 0 else len(sheet)
                told = says(body)
                if told and holds[-1]:
                    for one in head.split(","):
                        if (parts := selector(one)) is not None:
                            order += 1
                            _, tag, classes, ids = parts[-1]
                            key = "#" + min(ids) if ids else "." + min(classes) if classes else tag or "*"
                            found.setdefault(key, []).append(Rule(parts, told, order))
    return found


def shown(node: Node, rules: dict[str, list[Rule]], inherited: bool) -> tuple[bool, bool]:
    """Whether the element is rendered at all, and whether its own text is visible."""
    tag, attrs = node.tag, node.attrs
    if tag in UNSEEN or tag == "dialog" and "open" not in attrs or tag == "input" and attrs.get("type", "").lower() == "hidden":
        return False, False
    p = node.parent
    if p.tag == "details" and "open" not in p.attrs and tag != "summary":
        return False, False
    if tag in UNSEEN_IN_PICTURES:
        up = p
        while up is not None:
            if up.tag in ("svg", "math"):
                return False, False
            up = up.parent
    told = {"display": "none"} if "hidden" in attrs else {}
    if rules:
        keys = [tag, "*", *("." + c for c in attrs.get("class", "").split()), "#" + attrs.get("id", "")]
        for r in sorted((r for k in keys for r in rules.get(k, ()) if r.fits(node)), key=lambda r: r.rank):
            told.update(r.says)
    if "style" in attrs:
        told.update(says(attrs["style"]))
    if told.get("display") == "none":
        return False, False
    seen = told.get("visibility", "inherit")
    return True, inherited if seen in ("inherit", "unset") else seen not in ("hidden", "collapse")


class Lines:
    """Text under construction: lines, with white space collapsed and empty lines around spaced blocks."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.indent, self.mark = "", ""

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        if s and not (s[0] == " " and (not self.line or self.line[-1][-1:] == " ")):
            self.line.append(s)
        elif len(s) > 1:
            self.line.append(s[1:])

    def end(self, keep_empty: bool = False) -> None:
        s = "".join(self.line).strip(" ")
        self.line = []
        if s or keep_empty:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.done.append(self.indent + self.mark + s if s else "")
            if self.mark:
                self.indent, self.mark = self.indent + " " * len(self.mark), ""

    def space(self) -> None:
        self.end()
        self.gap = True


def span(node: Node, name: str, most: int) -> int:
    raw = node.attrs.get(name, "1").strip()
    return min(most, max(1, int(raw))) if re.fullmatch(r"\d{1,9}", raw) else 1


def render(root: Node, rules: dict[str, list[Rule]]) -> str:
    """Visible text of a tree; a stack of steps stands in for recursion."""
    out = Lines()
    frames: list[Lines] = []
    todo: list[tuple] = [("in", root, True)]
    counts: list[list[int]] = []  # open lists: next number, or 0 for marks
    rows: list[list[list[tuple[list[str], int, int]]]] = []  # open tables: rows of cells of lines, with the columns and rows that they span
    pre = 0
    while todo:
        step, node, seen = todo.pop()
        if step == "out":
            tag = node.tag
            if tag in ("td", "th") and frames and rows:
                out.end()
                cell, out = out.done, frames.pop()
                rows[-1][-1].append((cell, span(node, "colspan", 1000), span(node, "rowspan", 65534)))
            elif tag == "table" and rows:
                grid = rows.pop()
                for line in aligned(grid):
                    if out.gap and out.done:
                        out.done.append("")
                    out.gap = False
                    out.done.append(out.indent + line)
                out.space()
            elif tag in ("ul", "ol", "menu", "dir"):
                counts.pop()
                out.end()
                out.gap = not counts
            elif tag == "li" or tag == "dd" or tag == "blockquote":
                out.end()
                out.indent, out.mark = node.attrs["\0before"], ""
                if tag == "blockquote":
                    out.space()
            elif tag == "pre":
                pre -= 1
                raw = "".join(out.line).rstrip()
                out.line = []
                if raw:
                    if out.gap and out.done:
                        out.done.append("")
                    out.done.append(out.indent + out.mark + raw)
                out.gap = True
            elif tag in SPACED:
                out.space()
            elif tag in BLOCK:
                out.end()
            continue
        if isinstance(node, str):
            if not seen:
                continue
            if pre:
                first, *rest = node.replace("\r\n", "\n").split("\n")
                out.line.append(first)
                for s in rest:
                    raw = "".join(out.line)
                    out.line = []
                    if out.gap and out.done:
                        out.done.append("")
                    out.gap = False
                    out.done.append((out.indent + out.mark + raw).rstrip())
                    out.line.append(s)
            elif rows and not frames and node.isspace():
                pass
            else:
                out.text(node)
            continue
        tag = node.tag
        if node is not root:
            rendered, seen = shown(node, rules, seen)
            if not rendered:
                continue
        if tag == "br":
            out.end(keep_empty=bool(out.line) or not out.gap)
            continue
        if tag == "wbr":
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            out.end()
            out.gap = out.gap or not counts
            start = node.attrs.get("start", "1") if tag == "ol" else "0"
            counts.append([int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            counts[-1].append(tag == "ol")
        elif tag == "li":
            out.end()
            node.attrs = dict(node.attrs) | {"\0before": out.indent}
            if counts and counts[-1][1]:
                out.mark = f"{counts[-1][0]}. "
                counts[-1][0] += 1
            else:
                out.mark = "- "
        elif tag in ("dd", "blockquote"):
            out.space() if tag == "blockquote" else out.end()
            node.attrs = dict(node.attrs) | {"\0before": out.indent}
            out.indent += "  "
        elif tag == "table":
            out.space()
            rows.append([])
        elif tag == "tr" and rows:
            rows[-1].append([])
        elif tag in ("td", "th") and rows:
            if not rows[-1]:
                rows[-1].append([])
            frames.append(out)
            out = Lines()
        elif tag == "pre":
            out.space()
            pre += 1
        elif tag in SPACED:
            out.space()
        elif tag in BLOCK:
            out.end()
        if tag == "input":
            if seen and node.attrs.get("type", "").lower() not in WITHOUT_TEXT:
                out.text(node.attrs.get("value", ""))
            continue
        todo.append(("out", node, seen))
        shut = tag == "details" and "open" not in node.attrs
        todo.extend(("in", c, seen) for c in reversed(node.children) if not (shut and isinstance(c, str)))
    out.end()
    while frames:  # cells left open
        cell, out = out.done, frames.pop()
        out.done.extend(cell)
    return "\n".join(s.rstrip() for s in out.done).strip("\n")


def placed(rows: list[list[tuple[list[str], int, int]]]) -> list[dict[int, tuple[list[str], int]]]:
    """Of each row its cells by column, with the columns that they span; a cell that spans rows keeps its columns free below."""
    out: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}  # of a column, rows that are still taken from above
    for r in rows:
        line, at, below = {}, 0, {}
        for cell, wide, tall in r:
            while taken.get(at, 0):
                at += 1
            line[at] = (cell, wide)
            if tall > 1:
                below.update((k, tall - 1) for k in range(at, at + wide))
            at += wide
        taken = {k: n - 1 for k, n in taken.items() if n > 1} | below
        out.append(line)
    return out


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table: cells of a column have one width, two spaces apart; a cell of several lines takes several, one of several columns their joint width."""
    grid = [r for r in placed(rows) if any(c for c, _ in r.values())]
    used = sorted({k for r in grid for k in r})
    order = {k: i for i, k in enumerate(used)}
    width = [0] * len(used)
    cells = [(order[k], sum(k <= u < k + wide for u in used), max(map(len, c), default=0)) for r in grid for k, (c, wide) in r.items()]
    for at, wide, n in sorted(cells, key=lambda c: c[1]):
        lack = n - sum(width[at : at + wide]) - 2 * (wide - 1)
        if lack > 0:
            width[at + wide - 1] += lack
    out = []
    for r in grid:
        for i in range(max(len(c) for c, _ in r.values())):
            line = ""
            for k, (c, _) in sorted(r.items()):
                line = line.ljust(sum(width[: order[k]]) + 2 * order[k])
                line += c[i] if i < len(c) else ""
            out.append(line.rstrip())
    return out


def visible_text(page: str | None) -> str | None:
    if page is None:
        return None
    root, styles = build(page)
    return render(root, showing_rules(styles))


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id and ``text``, the visible text, of each page."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([visible_text(h) for h in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), F.col(html_col).cast("string").alias("html")).mapInArrow(made, f"`{id_col}` long, text string")


ship(__name__)
