"""HTML extraction by layout-aware rendering.

A tree builder reads tags, closes what HTML lets a page leave open (p, li, dt, dd, option, table parts), ignores
unmatched end tags and treats visible elements beyond ``DEPTH`` as siblings. Visibility: head, scripts, styles, templates
and the like, the hidden attribute, and what the display and visibility of inline styles and of the page's own rules
come to: the last declaration of the highest rank wins, by importance, place and specificity; display:none takes an element
away with all it holds, visibility is that of the nearest element that declares it. Selectors are tags, classes, ids and
their compounds, below each other by blank or ``>``; rules with other selectors, under a condition or for print do not
count. The renderer emits all visible text: blocks on lines of their own, paragraphs and headings set apart by an empty line, list items
with their mark and indent, preformatted text as it is, table cells in aligned columns: cells of over ``WIDE`` characters
and cells beyond ``FAR`` characters or ``ALIGNED`` columns are written whole but align nothing.

A null or empty html gives an empty text. Broken markup never fails a row: what cannot be read as a tag is text, from a
tag that never ends to the end of the page. Time is in proportion to the page, whose size is not limited. Rows come out
one for one, repeated rows included; a null page_id or url stays null; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_batches, table

#: The deepest nesting of elements; characters of a cell that widens its column, and characters and columns of a row that are aligned.
DEPTH, WIDE, FAR, ALIGNED = 150, 80, 400, 200
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe object audio video canvas svg math datalist noembed noframes".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure article section".split())
BLOCK = APART | frozenset("html body div header footer main nav aside form fieldset address li dt dd tr caption figcaption hr details summary legend option thead tbody tfoot td th center".split())
#: What a start tag closes, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"body"}),
}
_ENDS_P = APART | frozenset("div header footer main nav aside form fieldset address li dt dd hr table center details".split())
_SCOPE = frozenset("table td th button html body".split())
#: How a tag acts on what another one closes: it may be closed (1), or ends the search (2).
_GROUPS = [*CLOSES.values(), ({"p"}, _SCOPE)]
_ACTS = {tag: [1 if tag in names else 2 if tag in beyond else 0 for names, beyond in _GROUPS] for tag in set().union(*[a | b for a, b in _GROUPS])}
_GROUP_OF = {tag: [k for k, x in enumerate(CLOSES) if x == tag] + [len(CLOSES)] * (tag in _ENDS_P) for tag in set(CLOSES) | _ENDS_P}
_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_ON_SCREEN = re.compile(r"@media(?:\s+(?:only\s+)?(?:all|screen))?\s*|@layer\b[^{}]*", re.I)
_COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)")
_DISPLAYS = re.compile(r"none|contents|(?:inline-)?(?:block|flex|grid|table)|inline|table-[a-z-]+|list-item|flow-root|block flow|ruby[a-z-]*|run-in|inherit|initial|unset|revert(?:-layer)?|-webkit-[a-z-]+|-ms-[a-z-]+")
#: What a value of visibility means: seen, unseen, or as the element around.
_VISIBLE = {"visible": True, "initial": True, "hidden": False, "collapse": False, "inherit": None, "unset": None, "revert": None, "revert-layer": None}
_BLANKS = re.compile(r"[ \t\n\r\f\x0b]+")


class Node:
    __slots__ = ("attrs", "children", "names", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children, self.names = tag, attrs, [], None

    def get(self, name: str) -> str | None:
        for key, value in _ATTR.findall(self.attrs):
            if key.lower() == name:
                return unescape(value.strip("\"'"))
        return None

    def known_as(self) -> frozenset[str]:
        """The tag, .classes and #id by which a selector may name the element."""
        if self.names is None:
            own = {self.tag}
            if self.attrs:
                own.update("." + c.lower() for c in (self.get("class") or "").split())
                own.update("#" + i.lower() for i in [self.get("id")] if i)
            self.names = frozenset(own)
        return self.names


def declared(css: str) -> dict[str, tuple[bool, object]]:
    """Whether important, and the value, of the display (True: there, False: not) and visibility that declarations come to."""
    found: dict[str, tuple[bool, object]] = {}
    for one in css.lower().split(";"):
        name, colon, value = one.partition(":")
        name, (value, bang, rank) = name.strip(), value.partition("!")
        value, important = value.strip(), bool(bang) and rank.strip() == "important"
        if not colon or bang and not important or important < found.get(name, (False,))[0]:
            continue
        if name == "display" and _DISPLAYS.fullmatch(value):
            found[name] = important, value != "none"
        elif name == "visibility" and value in _VISIBLE:
            found[name] = important, _VISIBLE[value]
    return found


class Style:
    """The page's rules about display and visibility, by the last part of their selectors."""

    def __init__(self) -> None:
        self.rules: dict[str, dict[tuple, dict[str, tuple]]] = {}
        self.order = 0

    def read(self, css: str) -> None:
        """Take the rules of a style sheet that hold on every screen."""
        open_, start = [], 0
        css = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S)
        for brace in re.finditer(r"[{}]", css):
            part, start = css[start : brace.start()], brace.end()
            if brace.group() == "{":
                open_.append(part.rpartition(";")[2].strip())
            elif open_:
                rule = open_.pop()
                if rule[:1] != "@" and all(_ON_SCREEN.fullmatch(x) for x in open_) and (found := declared(part)):
                    self.order += 1
                    for selector in rule.lower().split(","):
                        self.add(selector, found)

    def add(self, selector: str, found: dict[str, tuple[bool, object]]) -> None:
        parts = re.sub(r"\s*>\s*", " > ", selector).split()
        chain, child = [], False
        for part in parts:
            if part == ">":
                child = True
                continue
            shape = _COMPOUND.fullmatch(part)
            if not shape:
                return
            names = frozenset(([shape[1]] if shape[1] and shape[1] != "*" else []) + re.findall(r"[.#][\w-]+", shape[2]))
            chain.append((child, names))
            child = False
        if not chain or child:
            return
        every = [x for _, names in chain for x in names]
        rank = tuple(sum(x[0] == c for x in every) for c in "#.") + (sum(x[0] not in "#." for x in every),)
        last = chain[-1][1]
        key = next((x for c in "#." for x in sorted(last) if x[0] == c), next(iter(last), "*"))
        held = self.rules.setdefault(key, {}).setdefault(tuple(chain), {})
        for name, (important, value) in found.items():
            new = (important, False, rank, self.order), value
            held[name] = max(held.get(name, new), new, key=lambda x: x[0])

    def of(self, node: Node, path: list[Node]) -> dict[str, object]:
        """The display and visibility that are declared for an element below others."""
        best: dict[str, tuple] = {}
        if self.rules:
            names = node.known_as()
            for key in (*names, "*"):
                for chain, held in self.rules.get(key, {}).items():
                    if chain[-1][1] <= names and (len(chain) == 1 or _below(chain, path)):
                        for name, new in held.items():
                            best[name] = max(best.get(name, new), new, key=lambda x: x[0])
        if "style" in node.attrs.lower() and (inline := node.get("style")):
            for name, (important, value) in declared(re.sub(r"/\*.*?(?:\*/|\Z)", " ", inline, flags=re.S)).items():
                new = (important, True, (), 0), value
                best[name] = max(best.get(name, new), new, key=lambda x: x[0][:2])
        return {name: value for name, (_, value) in best.items()}


def _below(chain: tuple, path: list[Node]) -> bool:
    """Whether the elements around one, outermost first, fit the parts of a selector before its last."""
    at, child = {len(path)}, chain[-1][0]
    for k in range(len(chain) - 2, -1, -1):
        places = [j - 1 for j in at if j] if child else range(max(at))
        at, child = {j for j in places if chain[k][1] <= path[j].known_as()}, chain[k][0]
        if not at:
            return False
    return True


def tree(html: str, known: Style | None = None) -> tuple[Node, Style]:
    """The document's root and its styles (``known``, if they have been read)."""
    root, style = Node("#root"), known or Style()
    # open elements: tag, where its children go, for each group the outermost open element that may be closed, and the element
    stack = [("#root", root.children, [0] * len(_GROUPS), root)]
    open_: dict[str, int] = {}
    at, text_from, end, last, flat = 0, 0, len(html), html.rfind(">"), False

    def pop(low: int) -> None:
        while len(stack) > low:
            tag, sink, _, _ = stack.pop()
            open_[tag] -= 1
            if len(stack) >= DEPTH and tag in BLOCK:
                sink.append(Node("div"))  # the block's children are its siblings, so its end has to show

    def put_text(upto: int) -> None:
        if upto > text_from:
            text = html[text_from:upto]
            stack[-1][1].append(unescape(text) if "&" in text else text)

    while (at := html.find("<", at)) >= 0 and (at < last or html.startswith("<!--", at)):
        found = _TAG.match(html, at)
        if not found:
            at += 1
            continue
        put_text(at)
        at = text_from = found.end()
        slash, name, attrs = found.groups()
        if not name:
            continue
        name = name.lower()
        if slash:
            if name == "br":
                stack[-1][1].append(Node("br"))
            elif open_.get(name):
                low = len(stack) - 1
                while stack[low][0] != name:
                    low -= 1
                pop(low)
            continue
        for group in _GROUP_OF.get(name, ()):
            if low := stack[-1][2][group]:
                pop(low)
        node = Node(name, attrs)
        stack[-1][1].append(node)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            raw = html[at : stop.start() if stop else end]
            at = text_from = (html.find(">", stop.start()) + 1 or end) if stop else end
            if name == "style" and known is None:
                style.read(raw)
            elif name == "textarea":
                node.children.append(unescape(raw))
        elif name not in VOID and not attrs.endswith("/"):
            sink, scopes = node.children, stack[-1][2]
            if len(stack) >= DEPTH:
                seen = shown(node, style, [x[3] for x in stack[1:DEPTH]] if style.rules else [], True)
                sink, flat = stack[-1][1] if seen else [], True  # what is not seen there is dropped with all it holds
            if acts := _ACTS.get(name):
                scopes = [low or len(stack) if act == 1 else 0 if act == 2 else low for low, act in zip(scopes, acts, strict=True)]
            stack.append((name, sink, scopes, node))
            open_[name] = open_.get(name, 0) + 1
    put_text(end)
    if flat and known is None and style.rules:  # a style that came later may hide what lies beyond DEPTH
        return tree(html, style)
    return root, style


def shown(node: Node, style: Style, path: list[Node], seen: bool) -> bool | None:
    """Whether an element's own text is seen, where that around it is or not; None if the element is not there at all."""
    if node.tag in UNSEEN:
        return None
    if not node.attrs and not style.rules and node.tag != "dialog":
        return seen
    found = style.of(node, path)
    there = found.get("display")
    if there is None:
        hidden = node.get("hidden") if "hidden" in node.attrs.lower() else None
        there = hidden in (None, "until-found") and not (node.tag == "dialog" and node.get("open") is None)
    if not there:
        return None
    own = found.get("visibility")
    return seen if own is None else own


class Lines:
    """Text of a block as it grows: pieces, and the line ends due before the next piece."""

    def __init__(self) -> None:
        self.parts, self.due, self.space, self.start = [], 0, False, True

    def text(self, raw: str, pre: bool) -> None:
        if pre:
            self.put(raw)
            return
        flat = _BLANKS.sub(" ", raw)
        if flat == " " or not flat:
            self.space |= bool(flat)
            return
        self.space |= flat[0] == " "
        self.put(flat.strip(" "))
        self.space = flat[-1] == " "

    def put(self, piece: str) -> None:
        if self.due and not self.start:
            self.parts.append("\n" * self.due)
        elif self.space and not self.start:
            self.parts.append(" ")
        self.parts.append(piece)
        self.due, self.space, self.start = 0, False, False

    def end(self, n: int) -> None:
        """At least n line ends are due."""
        self.due, self.space = max(self.due, n), False

    def line(self) -> None:
        """One line end more."""
        self.due, self.space = min(self.due + 1, 2), False

    def __str__(self) -> str:
        return "".join(self.parts)


def render(node: Node, style: Style, out: Lines, pre: bool = False, path: tuple[Node, ...] = (), seen: bool = True) -> None:
    """Emit the visible text of a node's children; ``path``: the elements around them, the node itself last."""
    number = int(start) if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", start := node.get("start") or "1") else 1
    for child in node.children:
        if isinstance(child, str):
            if seen:
                out.text(child.replace("\xa0", " "), pre)
            continue
        tag, own = child.tag, shown(child, style, path, seen)
        if own is None:
            continue
        within = (*path, child)
        if tag == "br":
            out.line()
        elif tag == "hr":
            out.end(2)
        elif tag == "li":
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            inner = Lines()
            render(child, style, inner, pre, within, own)
            if body := str(inner):
                out.end(1)
                out.put(mark + body.replace("\n", "\n" + " " * len(mark)))
                out.end(1)
        elif tag == "table":
            out.end(2)
            if text := grid(child, style, within, own):
                out.put(text)
                out.end(2)
        elif tag in BLOCK:
            gap = 2 if tag in APART and not (tag in ("ul", "ol") and node.tag == "li") else 1
            out.end(gap)
            if tag == "dd":
                inner = Lines()
                render(child, style, inner, pre, within, own)
                if body := str(inner):
                    out.put("  " + body.replace("\n", "\n  "))
            else:
                render(child, style, out, pre or tag == "pre", within, own)
            out.end(gap)
        else:
            render(child, style, out, pre, within, own)


def grid(node: Node, style: Style, path: tuple[Node, ...] = (), seen: bool = True) -> str:
    """A table's text: stray text and caption first, then its rows with columns aligned."""
    above, rows = Lines(), []

    def walk(part: Node, path: tuple[Node, ...], seen: bool) -> None:
        for child in part.children:
            if isinstance(child, str):
                if seen:
                    above.text(child, False)
            elif (own := shown(child, style, path, seen)) is None:
                continue
            elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
                walk(child, (*path, child), own)
            elif child.tag == "tr":
                rows.append(row(child.children, (*path, child), own))
            elif child.tag in ("td", "th"):  # a cell without a row
                rows.append(row([child], path, seen))
            else:
                above.end(1)
                holder = Node("#part")
                holder.children = [child]
                render(holder, style, above, False, path, seen)
                above.end(1)

    def row(cells: list[Node | str], path: tuple[Node, ...], seen: bool) -> list[tuple[str, int, int]]:
        out = []
        for child in cells:
            holder, within, own = child, path, seen
            if isinstance(child, str) or child.tag not in ("td", "th"):
                if isinstance(child, str) and not child.strip():
                    continue
                holder = Node("#part")
                holder.children = [child]
            elif (own := shown(child, style, path, seen)) is None:
                continue
            else:
                within = (*path, child)
            inner = Lines()
            render(holder, style, inner, False, within, own)
            out.append((_BLANKS.sub(" ", str(inner)), span(holder.get("colspan")), span(holder.get("rowspan"))))
        return out

    walk(node, path, seen)
    placed, widths, held = [], [0] * ALIGNED, [0] * ALIGNED  # rows that a cell above still takes of each column
    for cells in rows:
        line, column, taken = [], 0, held[:]
        for text, wide, high in cells:
            while column < ALIGNED and taken[column]:
                column += 1
            line.append((column, text))
            if wide == 1 and column < ALIGNED and len(text) <= WIDE:
                widths[column] = max(widths[column], len(text))
            for k in range(column, min(column + wide, ALIGNED)):
                held[k] = max(held[k], high)
            column += wide
        held = [max(n - 1, 0) for n in held]
        placed.append(line)
    starts = [0]
    for width in widths:
        starts.append(starts[-1] + (width + 2 if width else 0))
    lines = [str(above)]
    for cells in placed:
        parts, size = [], 0
        for column, text in cells:
            if text:
                start = starts[min(column, ALIGNED)]
                gap = start - size if start <= FAR else 0
                parts += [" " * max(gap, 2 if parts else 0), text]
                size += max(gap, 2 if size else 0) + len(text)
        lines.append("".join(parts))
    return "\n".join(x for x in lines if x)


def span(value: str | None) -> int:
    """Columns or rows that a cell takes: 1 unless a whole number says more, ALIGNED at most."""
    value = (value or "").strip()
    return min(max(int(value[:9]), 1), ALIGNED) if value.isascii() and value.isdecimal() else 1


def text_of(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    root, style = tree(html.replace("\r\n", "\n"))
    out = Lines()
    render(root, style, out)
    return "\n".join(line.rstrip(" \t") for line in str(out).split("\n")).strip("\n")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array([text_of(x.as_py()) for x in part.column(2)], pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").transform(in_batches, work, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
