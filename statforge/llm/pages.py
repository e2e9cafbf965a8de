"""Visible text of web pages by layout-aware rendering.

A tokenizer feeds a tree builder that supplies implied tags (html, head, body,
tbody, tr; end tags of p, li, dt, dd, option, cells and rows), then a renderer
walks the tree.  Hidden are scripts, styles, templates, the head but for
nothing, elements with the hidden attribute or with display:none by their style
attribute or a rule of a style element (selectors of one tag, class or id, or a
tag with one of these; others are ignored), closed details and dialogs, and
form controls' values.  Visibility is inherited, and shown again by
visibility:visible.  Blank space collapses outside pre and textarea; blocks
start on new lines, with a blank line around paragraphs, headings, lists,
tables and the like; list items are bulleted or numbered (start, reversed and
value count) and indented, up to ``DEEPEST_INDENT`` columns; the cells of a
table are padded to columns of equal width, with spans over columns and rows.
Where that would take more than ``WIDEST`` columns of text, the cells follow
each other like blocks.

Both parts take time linear in the page, but for the padding of tables in
tables: counts of open elements by tag replace scans of the stack, and what is
put before a table is kept with it.  Nothing recurses.

Results: a null page gives a null text, one without visible text "".  Rows are
kept one to one, repeated ones too; an empty table gives an empty one and other
columns are ignored.  Pages of any length are read whole.  Broken markup never
fails: stray end tags are dropped, open elements are closed at the end, a tag
that never ends is text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import only

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
HIDDEN = RAW | frozenset("head template datalist audio video canvas object svg math param rp title meta link base input select".split()) - {"xmp"}
#: Blank lines around, or just lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl figure hr table ul ol menu fieldset listing xmp".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption tr td th".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section summary table ul li dd dt xmp".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
WIDEST = 1000
DEEPEST_INDENT = 120
_SCOPE = frozenset("table td th caption html button object template".split())
_PLAIN = frozenset("b i em strong span u s small font code sub sup".split())
_PLAIN_BLOCKS = frozenset("div section article main body center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TABLE_PARTS = frozenset("tbody thead tfoot tr td th caption colgroup col".split())

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<bogus>[!?][^>]*+(?:>|\Z))|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|/(?P<junk>[^a-zA-Z][^>]*+)>)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBLE = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
_RULE = re.compile(r"([^{}]*+)\{([^{}]*+)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?([.#][\w-]+)?")
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "before", "lines")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.before: list | None = None  # what stood in a table where it may not stand
        self.lines: list[str] | None = None  # a rendered table

    def items(self) -> list:
        """The children, each after what was put before it."""
        for c in self.children:
            if c.__class__ is Node and c.before:
                break
        else:
            return self.children
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, Node) and c.before:
                todo += [c, *reversed(c.before)]
                c.before = None
            else:
                out.append(c)
        self.children = out
        return out


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        out.setdefault(name.lower(), entities.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return out


class Builder:
    """Builds the tree of a page."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.head: Node | None = None
        self.body: Node | None = None
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag, but for the root
        self.styles: list[str] = []

    def top(self) -> Node:
        return self.stack[-1]

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.open[self.stack.pop().tag].pop()

    def _stand(self, node: Node) -> None:
        self.open.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def _enter_body(self) -> None:
        if self.body is None:
            self.body = Node("body")
            self.root.children.append(self.body)
            self._cut(1)
            self._stand(self.body)

    def _close(self, *tags: str, within: frozenset = _SCOPE) -> bool:
        """Close the innermost element of these tags, if no element of ``within`` hides it."""
        at = self._last(tags)
        if not at or at < self._last(within):
            return False
        self._cut(at)
        return True

    def _back_to_table(self) -> None:
        """Leave what was put before the innermost table, if no cell or the like is open in it."""
        at = self._last(_SCOPE | _TABLE_PARTS)
        if at and self.stack[at].tag in ("table", "tbody", "thead", "tfoot", "tr"):
            self._cut(at + 1)

    def _push(self, node: Node) -> None:
        self.top().children.append(node)
        self._stand(node)

    def text(self, data: str) -> None:
        if self.body is None:
            if self.top() is self.root or self.top() is self.head:
                if not data.strip():
                    return
                self._enter_body()
        at = self.top()
        if at.tag == "colgroup" and data.strip():
            self._cut(len(self.stack) - 1)
            at = self.top()
        if at.tag in ("table", "tbody", "thead", "tfoot", "tr") and data.strip():
            self._foster(data)
            return
        at.children.append(data)

    def _foster(self, item: "Node | str") -> None:
        """Content that may not stand in a table goes before it."""
        table = self.stack[self._last(("table",))]
        table.before = table.before or []
        table.before.append(item)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            self.root.attrs = {**attrs, **self.root.attrs}
            return
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = Node("head", attrs)
                self._push(self.head)
            return
        if tag == "body":
            if self.body is None:
                self._enter_body()
                self.body.attrs = attrs
            return
        top = self.stack[-1].tag
        if self.body is not None:
            if tag in _PLAIN and top in _PLAIN:  # nothing is implied between these
                self._push(Node(tag, attrs))
                return
            if tag in _PLAIN_BLOCKS and top in _PLAIN_BLOCKS and not self.open.get("p"):
                self._push(Node(tag, attrs))
                return
        if self.body is None and (tag not in IN_HEAD or self.top().tag not in ("html", "head")):
            if self.top().tag in ("html", "head"):
                self._enter_body()
        elif self.body is None and self.head is None:
            self.head = Node("head")
            self._push(self.head)
        if self.top().tag == "colgroup" and tag not in ("col", "template"):
            self._cut(len(self.stack) - 1)
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "colgroup", "col"):
            self._close("caption", within=frozenset({"table", "td", "th"}))
        if tag in _TABLE_PARTS:
            self._back_to_table()
        if tag in CLOSES_P:
            self._close("p")
        if tag == "li":
            self._close("li", within=_SCOPE | {"ul", "ol", "menu"})
        elif tag in ("dd", "dt"):
            self._close("dd", "dt", within=_SCOPE | {"dl"})
        elif tag in ("option", "optgroup"):
            self._close("option")
            if tag == "optgroup":
                self._close("optgroup")
        elif tag == "table" and self.top().tag in ("table", "tbody", "thead", "tfoot", "tr"):
            self.end("table")
        elif tag in ("td", "th"):
            self._close("td", "th", within=frozenset({"table", "tr"}))
            if self.top().tag in ("table", "tbody", "thead", "tfoot"):
                self.start("tr", {}, False)
            elif self.top().tag != "tr":
                return
        elif tag == "tr":
            self._close("tr", within=frozenset({"table"}))
            if self.top().tag == "table":
                self._push(Node("tbody"))
            elif self.top().tag not in ("tbody", "thead", "tfoot"):
                return
        elif tag in ("tbody", "thead", "tfoot", "caption", "colgroup"):
            self._close("tbody", "thead", "tfoot", "caption", "colgroup", within=frozenset({"table"}))
            if self.top().tag != "table":
                return
        elif tag in _HEADINGS and self.top().tag in _HEADINGS:
            self._cut(len(self.stack) - 1)
        elif tag in ("a", "button"):
            self._close(tag)
        node = Node(tag, attrs)
        if self.top().tag in ("table", "tbody", "thead", "tfoot", "tr") and tag not in _TABLE_PARTS and tag not in ("script", "style", "template", "form", "input"):
            self._foster(node)
            if tag not in VOID:
                self._stand(node)
            return
        formed = tag == "form" and self.top().tag in ("table", "tbody", "thead", "tfoot", "tr")  # it stands there empty
        if tag in VOID or formed or closed and tag in ("svg", "math", "path"):
            self.top().children.append(node)
        else:
            self._push(node)

    def end(self, tag: str) -> None:
        if tag == "p" and not self.open.get("p"):
            self.start("p", {}, False)  # an end tag alone makes an empty paragraph
        if tag == "br":
            self.start("br", {}, False)
            return
        if tag in ("html", "body"):
            return  # what follows still belongs to the body
        if tag in _HEADINGS:
            self._close("h1", "h2", "h3", "h4", "h5", "h6")
            return
        if tag == "table":
            self._close("table", within=frozenset({"html", "template"}))
            return
        wall = frozenset({"table"}) if tag in _TABLE_PARTS else _SCOPE
        self._close(tag, within=wall)


def parse(page: str) -> tuple[Node, "Rules", bool]:
    """The tree of a page, its style rules, and whether it has tables."""
    builder, at = Builder(), 0
    last = page.rfind(">")
    while True:
        m = _TAG.search(page, at) if at <= last or page.find("<!", at) >= 0 else None
        text = page[at : m.start() if m else len(page)]
        if text:
            builder.text(entities.unescape(text))
        if not m:
            return builder.root, Rules(builder.styles), "table" in builder.open
        at = m.end()
        name = m["name"]
        if not name:
            continue
        tag = name.lower()
        if m["close"]:
            builder.end(tag)
            continue
        raw = m["attrs"]
        builder.start(tag, _attrs(raw) if raw and not raw.isspace() else {}, raw.rstrip().endswith("/"))
        if tag in RAW or tag in ("title", "textarea"):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            data = page[at : stop.start() if stop else len(page)]
            if builder.top().tag == tag:
                builder.top().children.append(entities.unescape(data) if tag not in RAW else data)
                builder._cut(len(builder.stack) - 1)
            if tag == "style":
                builder.styles.append(data)
            if not stop:
                return builder.root, Rules(builder.styles), "table" in builder.open
            at = stop.end()


class Rules:
    """Display and visibility by simple selectors; of equal ones the last counts, else ids, then classes, then tags."""

    def __init__(self, styles: list[str]):
        self.of: dict[tuple[str, str], dict[str, str]] = {}
        for sheet in styles:
            sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
            at = 0
            for m in _RULE.finditer(sheet):
                if sheet.count("{", at, m.start()) == sheet.count("}", at, m.start()):  # not within an @ block
                    said = _said(m[2])
                    for one in m[1].split(",") if said else ():
                        if (k := _SELECTOR.fullmatch(one.strip())) and (k[1] or k[2]):
                            self.of.setdefault(((k[1] or "*").lower(), k[2] or ""), {}).update(said)
                    at = m.end()

    def style(self, n: Node) -> dict[str, str]:
        out: dict[str, str] = {}
        if self.of:
            tag = n.tag
            keys = [("*", ""), (tag, "")]
            marks = [f".{c}" for c in n.attrs.get("class", "").split()] + ([f"#{n.attrs['id']}"] if n.attrs.get("id") else [])
            keys += [(t, k) for k in marks for t in ("*", tag)]
            for k in keys:
                if k in self.of:
                    out.update(self.of[k])
        if "style" in n.attrs:
            out.update(_said(n.attrs["style"]))
        return out


def _said(style: str) -> dict[str, str]:
    return {k: m[-1].lower() for k, p in (("display", _DISPLAY), ("visibility", _VISIBLE)) if (m := p.findall(style))}


def _number(n: Node, name: str, most: int = 999_999_999) -> int | None:
    raw = n.attrs.get(name, "").strip()
    return max(-most, min(int(raw), most)) if re.fullmatch(r"-?\d{1,18}", raw) else None


class Renderer:
    """Turns a tree into lines of text."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.lines: list[str] = []
        self.line: list[str] = []
        self.last = ""  # the last character of the line
        self.pre = 0
        self.gap = 0  # blank lines due before the next text
        self.indent: list[str] = [""]  # prefixes of the open blocks
        self.marker = ""
        self.kept: list[tuple[int, int]] = []

    def shown(self, n: Node, seen: bool) -> bool | None:
        """Whether an element's own text is visible, None if nothing in it is."""
        if n.tag in HIDDEN or n.tag == "dialog" and "open" not in n.attrs:
            return None
        if not n.attrs and not self.rules.of:
            return seen
        style = self.rules.style(n)
        if style.get("display") == "none" or "hidden" in n.attrs and "display" not in style and n.attrs["hidden"].lower() != "until-found":
            return None
        said = style.get("visibility")
        return seen if said is None or said == "inherit" else said == "visible"

    def brk(self, blank: int = 0) -> None:
        if self.line and (self.pre or any(not x.isspace() for x in self.line)):
            self._flush()
        self.line.clear()
        self.last = ""
        self.gap = max(self.gap, blank)

    def _flush(self) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        lead, text = self.indent[-1], "".join(self.line)
        if self.marker:
            lead = lead[: max(0, len(lead) - len(self.marker))] + self.marker
            self.marker = ""
        self.lines.append((lead + (text if self.pre else text.strip(" "))).rstrip(" "))
        self.line.clear()
        self.last = ""

    def text(self, data: str) -> None:
        if self.pre:
            parts = data.split("\n")
            for k, part in enumerate(parts):
                if part:
                    self.line.append(part)
                    self.last = part[-1]
                if k + 1 < len(parts):
                    self._flush()
            return
        data = _BLANK.sub(" ", data)
        if self.last in (" ", ""):
            data = data.lstrip(" ")
        if data:
            self.line.append(data)
            self.last = data[-1]

    def _deeper(self, by: str) -> None:
        lead = self.indent[-1] + by
        self.indent.append(lead if len(lead) <= DEEPEST_INDENT else self.indent[-1])

    def walk(self, n: Node, seen: bool = True) -> None:
        self.walk_all([n], seen)

    def walk_all(self, items: list, seen: bool = True) -> None:
        todo: list = [(c, seen, False) for c in reversed(items)]
        while todo:  # no recursion: pages may nest without bound
            n, seen, leaving = todo.pop()
            if isinstance(n, str):
                if seen:
                    self.text(n)
                continue
            if leaving:
                self._leave(n)
                continue
            seen = self.shown(n, seen)
            if seen is None:
                continue
            if n.lines is not None:
                self._emit(n)
                continue
            self._enter(n, seen)
            todo.append((n, seen, True))
            children = n.items()
            if n.tag == "details" and "open" not in n.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if n.tag in ("ul", "ol", "menu"):
                own = [c for c in children if isinstance(c, Node) and c.tag == "li"]
                back = n.tag == "ol" and "reversed" in n.attrs
                count = _number(n, "start") if n.tag == "ol" else None
                count = count if count is not None else len(own) if back else 1
                for c in own:
                    value = _number(c, "value") if n.tag == "ol" else None
                    count = count if value is None else value
                    c.attrs["\0marker"] = f"{count}. " if n.tag == "ol" else "- "
                    count += -1 if back else 1
            todo += [(c, seen, False) for c in reversed(children)]

    def _enter(self, n: Node, seen: bool) -> None:
        tag = n.tag
        if tag == "br":
            if self.pre or any(not x.isspace() for x in self.line):
                self._flush()
            elif self.lines and not self.gap:
                self.gap = 1
        elif tag == "hr":
            self.brk(1)
        elif tag in BLOCKS:
            nested = tag in ("ul", "ol", "menu") and len(self.indent) > 1
            self.brk(1 if tag in SPACED and not nested else 0)
            if tag in ("pre", "listing", "xmp"):
                self.pre += 1
                if n.children and isinstance(n.children[0], str) and n.children[0].startswith("\n"):
                    n.children[0] = n.children[0][1:]
            elif tag == "li":
                self.marker = n.attrs.get("\0marker", "- ") if seen else ""
                self._deeper(" " * len(n.attrs.get("\0marker", "- ")))
            elif tag == "dd":
                self._deeper("    ")
            elif tag == "blockquote":
                self._deeper("  ")
            elif tag == "table":  # a table of one column: its cells follow each other like blocks
                self.kept.append((self.pre, len(self.lines)))
                self.pre = 0
        elif tag == "img" and seen and n.attrs.get("alt", "").strip():
            self.text(n.attrs["alt"])

    def _leave(self, n: Node) -> None:
        tag = n.tag
        if tag in BLOCKS and tag != "hr":
            nested = tag in ("ul", "ol", "menu") and len(self.indent) > 1
            self.brk(1 if tag in SPACED and not nested else 0)
            if tag in ("pre", "listing", "xmp"):
                self.pre -= 1
            elif tag == "li":
                self.indent.pop()
                self.marker = ""
            elif tag in ("dd", "blockquote"):
                self.indent.pop()
            elif tag in ("td", "th") and self.kept and len(self.lines) > self.kept[-1][1]:
                self.gap = 0
            elif tag == "table":
                self.pre, _ = self.kept.pop()

    def _emit(self, n: Node) -> None:
        """Write the lines of a rendered table."""
        self.brk(1)
        self.pre += 1
        for line in n.lines:
            self.line = [line] if line else []
            self._flush()
        self.pre -= 1
        self.gap = max(self.gap, 1)

    def finish(self) -> list[str]:
        self.brk()
        return self.lines


class Tables:
    """Renders the tables of a page, inner ones first, and leaves their lines at the nodes."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.judge = Renderer(rules)

    def render(self, root: Node) -> None:
        found: list[tuple[Node, bool, int]] = []  # with the number of the table around it
        todo: list[tuple[Node, bool, int]] = [(root, True, -1)]
        while todo:
            n, seen, around = todo.pop()
            seen = self.judge.shown(n, seen)
            if seen is None:
                continue
            if n.tag == "table":
                found.append((n, seen, around))
                around = len(found) - 1
            todo += [(c, seen, around) for c in reversed(n.items()) if isinstance(c, Node)]
        wide = [False] * (len(found) + 1)
        for k in range(len(found) - 1, -1, -1):
            n, seen, around = found[k]
            if wide[k] or self._table(n, seen):
                wide[k] = wide[around] = True  # what holds a wide table is wide

    def _inner(self, items: list, seen: bool) -> list[str]:
        inner = Renderer(self.rules)
        inner.walk_all(items, seen)
        return inner.finish()

    def _table(self, n: Node, seen: bool) -> bool:
        """Set a table's lines, or leave it to be rendered in place; whether it is too wide."""
        rows: list[list[tuple[Node, bool]]] = []
        ends: set[int] = set()  # numbers of rows before which a row group ends
        captions: list[tuple[Node, bool]] = []
        loose: list[tuple[Node | str, bool]] = []  # what has no place in a table comes before it
        todo: list = [(c, seen) for c in reversed(n.items())]
        while todo:
            c, own = todo.pop()
            if isinstance(c, str):
                if c.strip():
                    loose.append((c, own))
                continue
            kept = own
            own = self.judge.shown(c, own)
            if own is None:
                continue
            if c.tag in ("tbody", "thead", "tfoot"):
                ends.add(len(rows))
                todo += [(x, own) for x in reversed(c.items())]
            elif c.tag == "caption":
                captions.append((c, own))
            elif c.tag == "tr":
                row = []
                for cell in c.items():
                    if isinstance(cell, str):
                        if cell.strip():
                            loose.append((cell, own))
                    elif cell.tag not in ("td", "th"):
                        loose.append((cell, own))
                    elif (shown := self.judge.shown(cell, own)) is not None:
                        row.append((cell, shown))
                rows.append(row)
            else:
                loose.append((c, kept))
        if all(len(r) <= 1 for r in rows) and not loose and not captions:
            return False
        grid = self._grid(rows, ends)
        if grid is None:
            return True
        out = Renderer(self.rules)
        out.brk(1)
        for item, own in loose:
            out.walk_all([item], own)
        if loose:
            out.brk(1)
        for c, own in captions:
            out.walk_all(c.items(), own)
            out.brk()
        lines = out.finish()
        if lines and loose and not captions:
            lines.append("")
        n.lines = lines + grid
        return False

    def _grid(self, rows: list[list[tuple[Node, bool]]], ends: set[int]) -> list[str] | None:
        """Cells padded to columns, None if they are too wide."""
        placed: list[list[tuple[int, int, list[str]]]] = []
        taken: dict[int, int] = {}  # rows that a cell above still fills, by column
        for k, row in enumerate(rows):
            if k in ends:
                taken.clear()
            out, col, fresh = [], 0, {}
            for cell, own in row:
                while col in taken:
                    col += 1
                span = max(1, min(_number(cell, "colspan") or 1, 1000))
                down = _number(cell, "rowspan")
                down = 65534 if down == 0 else max(1, min(down or 1, 65534))
                out.append((col, span, self._inner(cell.items(), own)))
                if down > 1:
                    fresh.update({col + i: down - 1 for i in range(span)})
                col += span
            taken = {c: left - 1 for c, left in taken.items() if left > 1} | fresh
            placed.append(out)
        placed = [r for r in placed if any(lines for _, _, lines in r)]
        width: dict[int, int] = {}
        for r in placed:
            for col, span, lines in r:
                if span == 1 and lines:
                    width[col] = max(width.get(col, 0), max(map(len, lines)))
        columns = max((col + span for r in placed for col, span, _ in r), default=0)
        start = [0]
        for col in range(columns):
            start.append(start[-1] + width.get(col, 0) + 3)
        if start[-1] > WIDEST:
            return None
        lines = []
        for r in placed:
            cells, at = [], 0
            for col, span, own in r:
                cells += [([], start[c + 1] - start[c] - 3) for c in range(at, col)]  # below a cell that spans rows
                cells.append((own, start[col + span] - start[col] - 3))
                at = col + span
            for k in range(max(len(own) for own, _ in cells)):
                lines.append(" | ".join((own[k] if k < len(own) else "").ljust(w) for own, w in cells).rstrip(" "))
        return lines


def visible_text(page: str) -> str:
    root, rules, tables = parse(page)
    if tables:
        Tables(rules).render(root)
    out = Renderer(rules)
    out.walk(root)
    return "\n".join(out.finish()).strip("\n")


def page_texts(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of each row."""
    rows = only(df, page_id=id_col, html=html_col)
    id_type = rows.schema["page_id"].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if p is None else visible_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(text, pa.string())], names=["page_id", "text"])

    return rows.mapInArrow(render, f"page_id {id_type}, text string")
