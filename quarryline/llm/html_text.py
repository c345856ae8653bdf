"""HTML to text as a reader would see it: a tree with implied tags, visibility rules, then block layout.

The tokenizer and tree builder follow the shape of the public HTML parsing rules: raw-text elements, void
elements, start tags that close what they cannot stand in, end tags that close what is open above them.
Layout walks the tree without recursion, so depth costs nothing but memory: blocks start lines, paragraphs
and the like leave a blank line, list items carry bullets or numbers, table cells are aligned in columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.workers import released

_set = lambda names: frozenset(names.split())
#: Element groups of the HTML standard.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style xmp iframe noembed noframes noscript textarea title")
CHARREF_RAW = _set("textarea title")
NEVER_SHOWN = _set("area base datalist head iframe link meta noembed noframes noscript param script style template title source track object audio video canvas rp")
BLOCKS = _set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol p pre search section summary table caption tr ul xmp option optgroup textarea"
)
SPACED = _set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp dir fieldset")
CLOSES_P = BLOCKS - _set("body html tr caption option optgroup textarea legend")
LISTS = _set("ul ol menu dir")
TABLE_PARTS = _set("caption colgroup col tbody thead tfoot tr td th")
#: What a start tag closes when it is open, and within which elements the search stops.
IMPLIED_END = {
    "li": (_set("li"), _set("ul ol menu dir table td th")), "dt": (_set("dt dd"), _set("dl table td th")), "dd": (_set("dt dd"), _set("dl table td th")), "option": (_set("option"), _set("select datalist optgroup")),
    "optgroup": (_set("option optgroup"), _set("select")), "tr": (_set("tr td th caption colgroup"), _set("table")), "td": (_set("td th"), _set("tr table")), "th": (_set("td th"), _set("tr table")),
    "tbody": (_set("tbody thead tfoot tr td th caption colgroup"), _set("table")), "thead": (_set("tbody thead tfoot tr td th caption colgroup"), _set("table")), "tfoot": (_set("tbody thead tfoot tr td th caption colgroup"), _set("table")),
    "rp": (_set("rp rt"), _set("ruby")), "rt": (_set("rp rt"), _set("ruby")), "body": (_set("head"), _set("html")),
}
HEAD_CONTENT = _set("base link meta noscript script style template title")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/][^a-zA-Z>][^>]*>?|<!>|</?>|<![a-zA-Z][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s/=>\"'][^\s/=>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"(?:^|[;{\s])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"^([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?$", re.I)
_SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes): kind is start, end, empty or text."""
    at, low = 0, None
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            yield "text", unescape(html[at:]), {}
            return
        if lt > at:
            yield "text", unescape(html[at:lt]), {}
        m = _TOKEN.match(html, lt)
        if not m:
            yield "text", "<", {}
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            yield "end", name, {}
            continue
        raw = m[3]
        attributes: dict[str, str] = {}
        if raw.strip("/ \t\n"):
            for k, a, b, c in _ATTRIBUTE.findall(raw):
                attributes.setdefault(k.lower(), unescape(a or b or c))
        yield ("empty" if name in VOID else "start"), name, attributes
        if name in RAW:
            low = low if low is not None else html.lower()
            end = low.find(f"</{name}", at)
            end = len(html) if end < 0 else end
            body = html[at:end]
            if body:
                yield "text", unescape(body) if name in CHARREF_RAW else body, {}
            at = end


def tree(html: str) -> Node:
    """The document's element tree under a root; html, head and body are implied where they are missing."""
    root = Node("html", {})
    stack = [root]
    counts: dict[str, int] = {"html": 1}  # how often each tag is open: most searches end here

    def push(tag, attributes):
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        stack.append(node)
        counts[tag] = counts.get(tag, 0) + 1

    def pop():
        counts[stack.pop().tag] -= 1

    def close(targets: frozenset, within: frozenset, nearest: bool = True) -> None:
        """Pops to the nearest, or else the outermost, open target above a boundary."""
        if not any(counts.get(t) for t in targets):
            return
        found = None
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in targets:
                found = i
                if nearest:
                    break
            elif tag in within:
                break
        while found is not None and len(stack) > found:
            pop()

    for kind, name, attributes in tokens(html):
        top = stack[-1].tag
        if kind == "text":
            if top in ("html", "head") and not name.strip(" \t\n\f\r"):
                continue
            if top in ("html", "head"):
                if top == "head":
                    pop()
                push("body", {})
            stack[-1].children.append(name)
            continue
        if kind == "end":
            if name == "p" and not counts.get("p"):
                stack[-1].children.append(Node("p", {}))
            elif name == "br":
                stack[-1].children.append(Node("br", {}))
            elif name in HEADINGS:
                close(HEADINGS, _BOUNDARY)
            elif name not in ("html", "body"):
                close(frozenset((name,)), _BOUNDARY - {name} if name not in TABLE_PARTS and name != "table" else _TABLE)
            continue
        if name == "html":
            for k, v in attributes.items():
                root.attributes.setdefault(k, v)
            continue
        if name == "head":
            if len(stack) == 1 and not root.children:
                push("head", attributes)
            continue
        if name == "body":
            if counts.get("body"):
                continue
            close(frozenset(("head",)), frozenset())
            push("body", attributes)
            continue
        if not counts.get("body"):
            if name in HEAD_CONTENT:
                if not counts.get("head"):
                    push("head", {})
            else:
                close(frozenset(("head",)), frozenset())
                push("body", {})
        if name in CLOSES_P and counts.get("p"):
            close(frozenset(("p",)), _BOUNDARY)
        if name in IMPLIED_END:
            close(*IMPLIED_END[name], nearest=False)
        if name in HEADINGS and stack[-1].tag in HEADINGS:
            pop()
        if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr", {})
        if kind == "empty":
            stack[-1].children.append(Node(name, attributes))
        else:
            push(name, attributes)
    return root


_BOUNDARY = _set("table td th caption html template button")
_TABLE = _set("html template")


#: Media queries that a plain screen meets; those with conditions are taken as not met.
_SCREEN = _set("all screen") | {"", "only screen", "only all"}


def on_screen(sheet: str) -> str:
    """A style sheet without its at-rules, but with the rules inside those that concern a screen."""
    out, at = [], 0
    while (start := sheet.find("@", at)) >= 0:
        out.append(sheet[at:start])
        head = re.compile(r"[^;{]*").match(sheet, start + 1)
        at = head.end() + 1
        if sheet[head.end() : at] != "{":
            continue
        depth, opened = 1, at
        for brace in re.compile("[{}]").finditer(sheet, at):
            depth += 1 if brace[0] == "{" else -1
            at = brace.end()
            if not depth:
                break
        else:
            at = len(sheet) + 1
        name, _, query = head[0].strip().lower().partition(" ")
        if name in ("layer", "supports") or name == "media" and any(q.strip() in _SCREEN for q in query.split(",")):
            out.append(on_screen(sheet[opened : at - 1]))
    return "".join([*out, sheet[at:]])


def hiding_rules(root: Node) -> list[tuple[str, str, str]]:
    """(tag, kind, name) of the style sheets' simple selectors that hide; other selectors are not followed."""
    rules, todo = [], [root]
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, Node):
                todo.append(child)
        if node.tag == "style":
            sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", "".join(c for c in node.children if isinstance(c, str)), flags=re.S)
            for selectors, body in _RULE.findall(on_screen(sheet)):
                if _HIDDEN.search(body):
                    for s in selectors.split(","):
                        m = _SIMPLE.match(s.strip())
                        if m and (m[1] or m[3]):
                            rules.append(((m[1] or "").lower(), m[2] or "", m[3] or ""))
    return rules


def shown(node: Node, rules: list[tuple[str, str, str]]) -> bool:
    a = node.attributes
    if node.tag in NEVER_SHOWN:
        return False
    if a and ("hidden" in a or _HIDDEN.search(a.get("style", ""))):
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    for tag, kind, name in rules:
        if (not tag or tag == node.tag) and (not kind or (name in a.get("class", "").split() if kind == "." else name == a.get("id"))):
            return False
    return True


class Lines:
    """Text in lines: collapses white space, keeps at most one blank line between blocks, puts prefixes before lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.space = False
        self.blank = False
        self.prefixes: list[list[str]] = []

    def text(self, s: str) -> None:
        parts = _SPACES.split(s)
        if not parts[0]:
            self.space = True
        words = [p for p in parts if p]
        if words:
            if self.words and self.space:
                self.words.append(" ")
            self.words.append(" ".join(words))
            self.space = not parts[-1]

    def verbatim(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").split("\n")
        self.words.append(first)
        for line in rest:
            self.line_break()
            self.words.append(line)

    def _put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = ""
        for p in self.prefixes:
            lead += p[0]
            p[0] = p[1]
        self.lines.append((lead + line).rstrip())

    def line_break(self) -> None:
        self._put("".join(self.words))
        self.words, self.space = [], False

    def block(self, spaced: bool = False) -> None:
        """Ends the current line, if there is one; spaced asks for a blank line."""
        if "".join(self.words).strip():
            self.line_break()
        self.words, self.space = [], False
        self.blank = self.blank or spaced

    def result(self) -> list[str]:
        self.block()
        return self.lines


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,9}", value.strip()) else default


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Table rows of (lines, span) cells as text, columns padded to their widest single cell, two spaces apart."""
    widths: dict[int, int] = {}
    for row in rows:
        column = 0
        for lines, span in row:
            if span == 1:
                widths[column] = max(widths.get(column, 0), *(len(x) for x in lines), 0) if lines else widths.get(column, 0)
            column += span
    out = []
    for row in rows:
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            column, parts = 0, []
            for lines, span in row:
                width = sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
                parts.append((lines[i] if i < len(lines) else "").ljust(width))
                column += span
            out.append("  ".join(parts).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    rules = hiding_rules(root)
    outs = [Lines()]
    lists: list[list] = []  # [ordered, next number]
    tables: list[list] = []  # rows of the open tables
    verbatim = 0
    todo: list[tuple[bool, Node | str]] = [(True, root)]
    while todo:
        enter, node = todo.pop()
        out = outs[-1]
        if isinstance(node, str):
            (out.verbatim if verbatim else out.text)(node)
            continue
        tag = node.tag
        if not enter:
            if tag in ("td", "th") and tables and len(outs) > 1:
                cell = outs.pop().result()
                tables[-1][-1].append((cell, max(1, min(_number(node.attributes.get("colspan"), 1), 1000))))
            elif tag == "table":
                rows = tables.pop()
                for line in aligned([r for r in rows if r]):
                    out._put(line)
                out.blank = True
            elif tag in BLOCKS:
                out.block(tag in SPACED and not (tag in LISTS and len(lists) > 1))
                if tag in LISTS:
                    lists.pop()
                if tag in ("li", "blockquote", "dd") and out.prefixes:
                    out.prefixes.pop()
            if tag in ("pre", "xmp", "textarea"):
                verbatim -= 1
            continue
        if not shown(node, rules):
            continue
        if tag == "br":
            out.line_break()
            continue
        if tag == "img" or tag == "input":
            if tag == "input" and node.attributes.get("type", "").lower() in ("submit", "button", "reset") and node.attributes.get("value"):
                out.text(node.attributes["value"])
            continue
        if tag == "table":
            out.block(True)
            tables.append([[]])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            outs.append(Lines())
        elif tag in BLOCKS:
            out.block(tag in SPACED and not (tag in LISTS and lists))
            if tag in LISTS:
                lists.append([tag == "ol", _number(node.attributes.get("start"), 1)])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    number = _number(node.attributes.get("value"), lists[-1][1])
                    lists[-1][1] = number + 1
                    mark = f"{number}. "
                out.prefixes.append([mark, " " * len(mark)])
            elif tag == "blockquote":
                out.prefixes.append(["> ", "> "])
            elif tag == "dd":
                out.prefixes.append(["  ", "  "])
        elif tag == "q":
            out.text('"')
        if tag in ("pre", "xmp", "textarea"):
            verbatim += 1
        todo.append((False, node))
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if verbatim and children and isinstance(children[0], str) and children[0].startswith("\n") and tag in ("pre", "textarea"):
            children = [children[0][1:], *children[1:]]
        todo += [(True, c) for c in reversed(children)]
    return "\n".join(outs[0].result()).replace("\xa0", " ").strip("\n")


def extract(html: str | None) -> str:
    return render(tree(html.replace("\0", ""))) if html else ""


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            texts = [extract(p) for p in batch.column("html").slice(lo, 200).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(lo, 200), pa.array(texts, pa.string())], ["page_id", "text"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, text, n_chars.

    Null and empty pages give empty text; no page is too long or too deep. Repeated rows are rows of their own, ids
    may be null. An empty table gives an empty result; other columns, whatever their names, are not looked at.
    """
    found = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(released(_run), "page_id long, text string")
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
