"""Parsers of single files, bytes to text. They import nothing of Spark's, so that a child process is ready at once."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from .html import to_blocks

MOST_ENTRIES, MOST_INFLATED = 200, 60 << 20
MOST_PAGES = 500
PAGE = "\f"


def docx_text(content: bytes) -> str:
    """Paragraphs, headings and table cells of a DOCX file, within the budgets of entries and inflated bytes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        entries = z.infolist()
        if len(entries) > MOST_ENTRIES:
            raise ValueError("too many entries")
        total = 0
        for e in entries:  # headers aren't trusted: what comes out is counted
            with z.open(e) as f:
                while part := f.read(1 << 16):
                    total += len(part)
                    if total > MOST_INFLATED:
                        raise ValueError("inflated size over the limit")
        root = ElementTree.fromstring(z.read("word/document.xml"))
        links = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in z.namelist() else []
        forms = ElementTree.fromstring(z.read("word/numbering.xml")) if "word/numbering.xml" in z.namelist() else None
    targets = {r.get("Id"): r.get("Target") for r in links}
    ordered = _ordered_lists(forms)
    out: list[str] = []
    counts: dict[tuple[str, int], int] = {}
    waiting = list(reversed(root.find(f"{_W}body") if root.find(f"{_W}body") is not None else root))
    while waiting:
        node = waiting.pop()
        if node.tag == f"{_W}tbl":
            for row in node.findall(f"{_W}tr"):
                cells = [" ".join(t for t in (_run_text(p, targets) for p in cell.iter(f"{_W}p")) if t) for cell in row.findall(f"{_W}tc")]
                out.append("\t".join(cells).strip())
        elif node.tag == f"{_W}p":
            out.append(_paragraph(node, targets, ordered, counts))
        else:
            waiting += reversed(node)
    return _joined([x for x in out if x.strip()])


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _ordered_lists(forms) -> set[tuple[str, int]]:
    """(list, level) of the numbered ones among a document's lists."""
    if forms is None:
        return set()
    numbered = {}
    for form in forms.findall(f"{_W}abstractNum"):
        for level in form.findall(f"{_W}lvl"):
            kind = level.find(f"{_W}numFmt")
            if kind is not None and kind.get(f"{_W}val") not in ("bullet", "none"):
                numbered.setdefault(form.get(f"{_W}abstractNumId"), set()).add(int(level.get(f"{_W}ilvl", 0)))
    uses = {n.get(f"{_W}numId"): n.find(f"{_W}abstractNumId").get(f"{_W}val") for n in forms.findall(f"{_W}num")}
    return {(n, level) for n, form in uses.items() for level in numbered.get(form, ())}


def _run_text(node, targets: dict) -> str:
    """Text of a paragraph: tabs, breaks, and links as [text](target)."""
    parts = []
    for n in node:
        if n.tag == f"{_W}t":
            parts.append(n.text or "")
        elif n.tag in (f"{_W}tab", f"{_W}br"):
            parts.append("\t" if n.tag.endswith("tab") else "\n")
        elif n.tag == f"{_W}hyperlink" and targets.get(n.get(f"{_R}id")):
            parts.append(f"[{_run_text(n, targets)}]({targets[n.get(f'{_R}id')]})")
        elif n.tag != f"{_W}pPr":
            parts.append(_run_text(n, targets))
    return "".join(parts).strip() if node.tag == f"{_W}p" else "".join(parts)


def _paragraph(p, targets: dict, ordered: set, counts: dict) -> str:
    """A paragraph as a heading, an item of a list or plain text. `counts` holds the numbers that lists have reached."""
    text = _run_text(p, targets)
    style, number = p.find(f"{_W}pPr/{_W}pStyle"), p.find(f"{_W}pPr/{_W}numPr")
    name = style.get(f"{_W}val", "") if style is not None else ""
    level = name.removeprefix("Heading") if name.startswith("Heading") else ""
    if text and level.isdigit() and 1 <= int(level) <= 6:
        return f"{'#' * int(level)} {text}"
    if not text or number is None or number.find(f"{_W}numId") is None:
        return text
    depth = number.find(f"{_W}ilvl")
    at = number.find(f"{_W}numId").get(f"{_W}val"), int(depth.get(f"{_W}val")) if depth is not None else 0
    counts[at] = counts.get(at, 0) + 1
    for deeper in [k for k in counts if k[0] == at[0] and k[1] > at[1]]:
        del counts[deeper]
    return f"{'  ' * at[1]}{f'{counts[at]}.' if at in ordered else '-'} {text}"


def _joined(blocks: list[str]) -> str:
    """Blocks parted by blank lines, but items of a list by line ends."""
    import re

    item = re.compile(r" *(?:\d+\.|-) ")
    out = ""
    for before, block in zip(["", *blocks], blocks):
        out += ("" if not out else "\n" if item.match(before) and item.match(block) else "\n\n") + block
    return out


def plain_text(content: bytes) -> str:
    return content.decode("utf-8")


def html_text(content: bytes) -> str:
    return to_blocks(content.decode("utf-8"))


def pdf_text(content: bytes) -> str:
    """The texts of a PDF's pages, parted by form feeds, by the `pypdf` package where it is installed."""
    try:
        import pypdf
    except ImportError:
        raise NotImplementedError("pypdf is not installed") from None
    reader = pypdf.PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        raise ValueError("encrypted")
    if len(reader.pages) > MOST_PAGES:
        raise ValueError("too_many_pages")
    return PAGE.join((page.extract_text() or "").replace(PAGE, "\n") for page in reader.pages)
