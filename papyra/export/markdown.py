"""Pages and documents as Markdown."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.paging import by_page

# fixed values: block types left out, types drawn without lines, first lines made headings, and how headings are numbered
IGNORED = ("Header", "Footer", "PageNumber", "Footnote", "Aside", "FormulaNumber")
NO_LINES = ("Table", "Figure", "Chart", "Seal", "Formula", "FormulaNumber")
ABSTRACTS, REFERENCES = ("摘要", "abstract"), ("参考文献", "references")
NUMBERING = re.compile(
    r"^\s*((?:[1-9][0-9]*(?:\.[1-9][0-9]*)*[\.、]?|[\(（](?:[1-9][0-9]*|[一二三四五六七八九十百千万亿零壹贰叁肆伍陆柒捌玖拾]+)[\)）]|[一二三四五六七八九十百千万亿零壹贰叁肆伍陆柒捌玖拾]+[、\.]?|(?:I|II|III|IV|V|VI|VII|VIII|IX|X)(?:\.|\s)))(\s*)(.*)$"
)
TOLERANCE = 10.0
CJK_END, CJK_START = re.compile(r"[　-〿぀-ヿ㐀-鿿豈-﫿＀-￯]$"), re.compile(r"^[　-〿぀-ヿ㐀-鿿豈-﫿＀-￯]")


def heading(text: str) -> str:
    """A title as a heading one level below the number of dots in it."""
    text = text.strip()
    m = NUMBERING.match(text)
    if m:
        text = f"{m[1].strip()} {m[3].lstrip()}"
    text = text.rstrip(".")
    return f"{'#' * (text.count('.') + 2)} {text}".replace("-\n", "").replace("\n", " ")


def _promote(text: str, names: tuple[str, ...], by: str, end: str) -> str:
    parts = text.split(by)
    for i, p in enumerate(parts):
        if p.strip():
            if p.lower() in names:
                parts[i] = f"## {p}{end}"
            break
    return by.join(parts)


def render_block(b: dict, pretty: bool = True) -> str:
    kind, text = b["type"], b.get("text") or ""
    bare = text.strip()
    if kind == "DocTitle":
        return f"# {bare}".replace("-\n", "").replace("\n", " ") if bare else ""
    if kind == "Title":
        return heading(text) if bare else ""
    if kind == "Abstract":
        return _promote(text, ABSTRACTS, " ", "\n") if bare else ""
    if kind == "Reference":
        return _promote(text, REFERENCES, "\n", "") if bare else ""
    if kind == "Table":
        m = re.search(r"(?is)<table.*</table>", b.get("table_html") or "")
        if m:
            return m[0].replace("<table>", '<table border="1">') if pretty else m[0]
        return bare
    if kind == "Formula":
        latex = (b.get("latex") or "").strip()
        return f"$${latex}$$" if latex else ""
    if kind in ("Figure", "Chart", "Seal"):
        return f"![{kind}]()\n\n{bare}" if bare else f"![{kind}]()"
    if kind == "List":
        return text.replace("-\n", "  \n").replace("\n", "  \n")
    if kind == "Algorithm":
        return text.strip("\n")
    if kind in ("Text", "Paragraph"):
        return text.replace("-\n", "").replace("\n\n", "\n").replace("\n", "\n\n")
    return bare


def _edges(b: dict) -> tuple[float, float, int]:
    """Where a block's first line begins and its last ends, and its lines; without lines it neither begins nor ends anywhere."""
    lines = [] if b["type"] in NO_LINES else b.get("lines") or []
    return (lines[0]["min_x"] if lines else float("inf")), (lines[-1]["max_x"] if len(lines) > 1 else float("-inf")), max(1, len(b.get("lines") or []))


def continuation(b: dict, before: dict | None) -> tuple[bool, bool]:
    """(begins a paragraph, ends one): a line that starts at the left edge goes on, one that reaches the right edge is gone on from."""
    start, end, _ = _edges(b)
    left, right = b["min_x"], b["max_x"]
    if before is None:
        begins = start - left >= TOLERANCE
    else:
        _, before_end, n = _edges(before)
        full, apart = abs(before["max_x"] - before_end) < TOLERANCE, abs(b["min_x"] - before["max_x"])
        if left < before["max_x"] and right > before["min_x"]:
            left, right, apart = min(left, before["min_x"]), max(right, before["max_x"]), 0.0
            full = abs(right - before_end) < TOLERANCE
        wide = max(before["max_x"] - before["min_x"], b["max_x"] - b["min_x"])
        begins = not (full and start - left < TOLERANCE and n > 1 and apart < wide)
    return begins, not right - end < TOLERANCE


def render_page(blocks: list[dict], ignored=IGNORED, pretty: bool = True) -> tuple[str, bool, bool]:
    """(text, whether it begins a paragraph, whether it ends one) of blocks in order."""
    out, kind, before, first, ends = "", None, None, None, True
    for b in blocks:
        begins, ends = continuation(b, before)
        first = begins if first is None else first
        if b["type"] == "FormulaNumber" or b["type"] in ignored:
            continue
        text, before = render_block(b, pretty), b
        if text:
            goes_on = out and b["type"] == kind and b["type"] in ("Text", "Paragraph") and not begins
            out += text if not out or goes_on else "\n\n" + text
        kind = b["type"]
    return out.strip("\n"), True if first is None else first, ends


def splice(pages: list[tuple[str, bool, bool]], separator: str | None = None) -> str:
    """Pages as one text: where a paragraph goes on over the page, with a space, or none between CJK characters; else after a blank line."""
    out, ended = "", True
    for text, begins, ends in pages:
        text = text.strip() if separator is not None else text
        if not text:
            continue
        if not out:
            out = text
        elif separator is not None:
            out += separator + text
        elif not begins and not ended:
            out += ("" if CJK_END.search(out) or CJK_START.search(text) else " ") + text
        else:
            out += "\n\n" + text
        ended = ends
    return out


def markdown(blocks: DataFrame, document: str = "doc_id", page: str = "page_number", order: str = "block_order", separator: str | None = None, ignored=IGNORED, pretty: bool = True) -> DataFrame:
    """document, markdown. blocks may have `lines` (array of structs with min_x and max_x), table_html and latex. A document's blocks are what a task holds."""
    from itertools import groupby

    def render(rows: list[dict]):
        pages = [render_page(list(g), ignored, pretty) for _, g in groupby(rows, lambda r: r[page])]
        yield {document: rows[0][document], "markdown": splice(pages, separator)}

    return by_page(blocks, [document], [page, order], render, f"{document} {dict(blocks.dtypes)[document]}, markdown string")


def title_level(text) -> F.Column:
    """Level of a numbered title, in the JVM: dots in it, those at its end aside, and two; the document's title has one."""
    bare = F.regexp_replace(F.trim(text), r"\.+$", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit(""))) + 2
