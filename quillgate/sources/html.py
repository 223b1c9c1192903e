"""HTML pages to Markdown-like blocks, in one walk of a small element tree, as an Arrow function."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements without text of their own, and those that break a line of text.
SKIPPED = {"script", "style", "noscript", "template", "head", "title", "svg", "canvas", "iframe", "object"}
BREAKING = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "p", "pre", "section", "summary", "td", "th", "tr", "tbody", "thead", "tfoot",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


# How a browser ends elements whose end tag is left out. A start tag ends the open elements on the left, looking up no further than those on the right.
_TABLE_PARTS = {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"tbody", "thead", "tfoot", "table"}), **{tag: (_TABLE_PARTS, {"table"}) for tag in ("tbody", "thead", "tfoot", "caption", "colgroup")},
}
# Start tags that end an open paragraph, and elements that hold paragraphs of their own.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
SCOPES = {"table", "td", "th", "caption", "button", "object", "template", "html"}


class _Node:
    def __init__(self, tag: str, up: "_Node | None" = None):
        self.tag, self.up, self.kids = tag, up, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = _Node("#")

    def _end(self, tags: set[str], bounds: set[str]) -> None:
        """Ends the outermost of the open elements named, up to the nearest that bounds them."""
        node, last = self.at, None
        while node.up is not None and node.tag not in bounds:
            if node.tag in tags:
                last = node
            node = node.up
        if last is not None:
            self.at = last.up

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end({"p"}, SCOPES)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.at.tag):
            self.at = self.at.up
        node = _Node(tag, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(_Node(tag, self.at))

    def handle_endtag(self, tag):
        """Ends the nearest open element of the name; one outside of the table cell or button that is open is left alone. A heading's end tag ends any heading."""
        bounds = {"table", "html"} if tag in _TABLE_PARTS else SCOPES - {tag}
        names = {f"h{k}" for k in range(1, 7)} if re.fullmatch("h[1-6]", tag) else {tag}
        node = self.at
        while node.up is not None and node.tag not in names:
            if node.tag in bounds and tag not in ("table", "body", "html"):
                return
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.kids.append(data)


# What counts as white space, as in every other function of the library; Python's own class is another.
WHITE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_RUN = re.compile(f"[{WHITE}]+")


def _squeeze(s: str) -> str:
    return _RUN.sub(" ", s).strip(" ")


def _inline(node, raw: bool = False) -> str:
    """All text below a node; breaking elements are set apart by blanks. Nodes wait on a stack, so no depth is too deep."""
    parts: list[str] = []
    waiting = [node]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            parts.append(node)
        elif node.tag == "br":
            parts.append("\n" if raw else " ")
        elif node.tag not in SKIPPED:
            apart = [" "] if not raw and (node.tag in BREAKING or node.tag in ("ul", "ol", "table")) else []
            waiting += [*apart, *reversed(node.kids), *apart]
    return "".join(parts)


def _table(table: _Node) -> str:
    captions, rows = [], []
    stack = list(reversed(table.kids))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            continue
        if node.tag == "caption":
            captions += [t for t in [_squeeze(_inline(node))] if t]
        elif node.tag == "tr":
            rows.append([_squeeze(_inline(c)).replace("|", "\\|") for c in node.kids if not isinstance(c, str) and c.tag in ("td", "th")])
        else:
            stack += reversed(node.kids)
    width = max(map(len, rows), default=0)
    lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
    return "\n".join(captions + lines[:1] + ([f"| {' | '.join(['---'] * width)} |"] if rows else []) + lines[1:])


def _list(top: _Node) -> list[str]:
    """A line for each item, lists within lists further in; a list straight below a list counts as one within it."""
    out: list[str] = []
    open_ = [(top, 0, iter(top.kids), [0])]
    while open_:
        node, depth, kids, count = open_[-1]
        kid = next((k for k in kids if not isinstance(k, str)), None)
        if kid is None:
            open_.pop()
        elif kid.tag in ("ul", "ol"):
            open_.append((kid, depth + 1, iter(kid.kids), [0]))
        elif kid.tag == "li":
            count[0] += 1
            inner = [k for k in kid.kids if not isinstance(k, str) and k.tag in ("ul", "ol")]
            own = "".join(_inline(k) for k in kid.kids if k not in inner)
            out.append(f"{'  ' * depth}{f'{count[0]}.' if node.tag == 'ol' else '-'} {_squeeze(own)}")
            open_ += [(k, depth + 1, iter(k.kids), [0]) for k in reversed(inner)]
    return out


def to_blocks(html: str) -> str:
    """Blocks joined by blank lines: headings as #, lists, pipe tables, fenced pre, other text one block per breaking element."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        lines = [_squeeze(x) for x in "".join(held).split("\n")]
        text = "\n".join(x for x in lines if x)
        if text:
            out.append(text)
        held.clear()

    waiting: list = list(reversed(tree.top.kids))
    while waiting:
        node = waiting.pop()
        if node is None:  # the end of a breaking element
            flush()
        elif isinstance(node, str):
            held.append(node)  # line ends of the source stay line ends
        elif node.tag == "br":
            held.append("\n")
        elif re.fullmatch("h[1-6]", node.tag):
            flush()
            text = _squeeze(_inline(node))
            if text:
                out.append("#" * int(node.tag[1]) + " " + text)
        elif node.tag == "pre":
            flush()
            text = _inline(node, raw=True).lstrip("\n").rstrip(WHITE)
            if text:
                out.append(f"```\n{text}\n```")
        elif node.tag == "table":
            flush()
            out.extend(t for t in [_table(node)] if t)
        elif node.tag in ("ul", "ol"):
            flush()
            out.extend(t for t in ["\n".join(_list(node))] if t)
        elif node.tag not in SKIPPED:
            breaks = node.tag in BREAKING
            if breaks:
                flush()
            waiting += [None] * breaks + node.kids[::-1]
    flush()
    return "\n\n".join(out)


def html_blocks(c):
    """to_blocks of a column, null of null."""
    from pyspark.sql import functions as F

    return F.udf(lambda h: None if h is None else to_blocks(h), "string", useArrow=True)(c)
