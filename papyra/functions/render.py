"""Text of pages as a person sees it: character grids, joined lines of blocks, display order of right-to-left text."""

from __future__ import annotations

import re
import unicodedata
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.paging import by_page

_WIDE = ((0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x1F300, 0x1F64F), (0x1F900, 0x1F9FF), (0x20000, 0x3FFFD))
_RTL = re.compile("[֐-׿؀-ۿݐ-ݿࢠ-ࣿיִ-﷿ﹰ-﻿]")
# fixed values: brackets and their mirror images
_MIRROR = str.maketrans("()[]{}<>«»", ")(][}{><»«")
# fixed values: share of heights to be one line; short line ends; gaps; tall spans
LINE_OVERLAP, SHORT_END, SHORT_FIRST_END, LINE_GAP, TALL = 0.6, 0.3, 0.5, 1.5, 0.7


def width_of(text: str) -> int:
    seen = (c for c in text if unicodedata.category(c) not in ("Mn", "Me", "Cf", "Cc"))
    return sum(2 if any(a <= ord(c) <= b for a, b in _WIDE) else 1 for c in seen)


def is_rtl(text: str) -> bool:
    rtl = len(_RTL.findall(text))
    return rtl > sum(c.isalpha() and not _RTL.match(c) for c in text)


def group_rows(boxes: list[tuple[float, float, float, float]], least: float = 0.5) -> list[list[int]]:
    """Rows of indices: each box, from the top, joins the row with a member it overlaps most in height, unless one of the row stands above or below it."""
    rows: list[list[int]] = []
    for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0])):
        x0, y0, x1, y1 = boxes[i]

        def fit(row: list[int]) -> float:
            best = 0.0
            for a0, b0, a1, b1 in (boxes[j] for j in row):
                narrow, low = min(x1 - x0, a1 - a0), min(y1 - y0, b1 - b0)
                if narrow > 0 and min(x1, a1) - max(x0, a0) > 0.5 * narrow:
                    return 0.0
                if low > 0:
                    best = max(best, (min(y1, b1) - max(y0, b0)) / low)
            return best if best >= least else 0.0

        best = max(rows, key=fit, default=None)
        if best is not None and fit(best) > 0:
            best.append(i)
        else:
            rows.append([i])
    mean = lambda row: sum(boxes[i][1] + boxes[i][3] for i in row) / len(row)
    return sorted((sorted(r, key=lambda i: boxes[i][0]) for r in rows), key=mean)


def layout_lines(rows: list[dict], cell: float | None = None, blank_lines: int = 1, least: float = 0.5, right_align: bool = True) -> str:
    """A page's lines on a grid of characters: columns by the median width of one, empty lines for gaps, right-to-left text by its right end."""
    seen = [(t, (r["min_x"], r["min_y"], r["max_x"], r["max_y"])) for r in rows if (t := (r["text"] or "").strip())]
    if not seen:
        return ""
    texts, boxes = [t for t, _ in seen], [b for _, b in seen]
    if all(b[2] <= b[0] or b[3] <= b[1] for b in boxes):
        return "\n".join(texts)
    widths = [width_of(t) for t in texts]
    if cell is None:
        units = [(b[2] - b[0]) / w for b, w in zip(boxes, widths) if w > 0 and b[2] > b[0]]
        cell = median(units) if units else 1.0
    heights = [b[3] - b[1] for b in boxes if b[3] > b[1]]
    height = median(heights) if heights else 0.0
    columns = [round(b[2] / cell) - w if right_align and is_rtl(t) else round(b[0] / cell) for t, b, w in zip(texts, boxes, widths)]
    origin, out, bottom = min(columns), [], None
    for row in group_rows(boxes, least):
        top = min(boxes[i][1] for i in row)
        if bottom is not None and height > 0 and blank_lines > 0:
            out += [""] * max(0, min(blank_lines, int((top - bottom) // height)))
        line, at = "", 0
        for i in sorted(row, key=lambda i: (columns[i], boxes[i][0])):
            column = max(0, columns[i] - origin, at + 1 if line else 0)
            line += " " * (column - at) + texts[i]
            at = column + widths[i]
        out.append(line.rstrip())
        bottom = max(boxes[i][3] for i in row)
    return "\n".join(out)


def joined_rows(rows: list[dict]) -> str:
    """A page's lines as rows from the top, joined by spaces; a row that is right-to-left throughout begins at its right end."""
    seen = [(t, (r["min_x"], r["min_y"], r["max_x"], r["max_y"])) for r in rows if (t := (r["text"] or "").strip())]
    if not seen or all(b[2] <= b[0] or b[3] <= b[1] for _, b in seen):
        return "\n".join(t for t, _ in seen)
    out = []
    for row in group_rows([b for _, b in seen]):
        texts = [seen[i][0] for i in row]
        out.append(" ".join(texts[::-1] if len(texts) > 1 and all(map(is_rtl, texts)) else texts))
    return "\n".join(out)


def _page_text(lines: DataFrame, keys: list[str], name: str, make) -> DataFrame:
    types = dict(lines.dtypes)
    return by_page(lines, keys, ["line_index"], lambda rows: [{k: rows[0][k] for k in keys} | {name: make(rows)}], ", ".join(f"{k} {types[k]}" for k in keys) + f", {name} string")


def layout_text(lines: DataFrame, keys: list[str], **options) -> DataFrame:
    return _page_text(lines, keys, "layout_text", lambda rows: layout_lines(rows, **options))


def reading_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    return _page_text(lines, keys, "reading_text", joined_rows)


def _spaced(c: str) -> bool:
    """Characters of scripts that put spaces between words."""
    return c.isascii() and c.isalnum() or c.isalpha() and not any(a <= ord(c) <= b for a, b in _WIDE)


def _span_lines(spans: list[dict], axis: str) -> list[list[dict]]:
    """Runs of spans along an axis that overlap the run's extent by 0.6 of the smaller one."""
    lo, hi, other = (("min_y", "max_y", "min_x") if axis == "y" else ("min_x", "max_x", "min_y"))
    order = (lambda s: (s[lo], s[other])) if axis == "y" else (lambda s: (-s[lo], s[other]))
    out, a, b = [], 0.0, 0.0
    for s in sorted(spans, key=order):
        shared, least = min(b, s[hi]) - max(a, s[lo]), min(b - a, s[hi] - s[lo])
        if out and shared > 0 and least > 0 and shared / least >= LINE_OVERLAP:
            out[-1].append(s)
            a, b = min(a, s[lo]), max(b, s[hi])
        else:
            out.append([s])
            a, b = s[lo], s[hi]
    if axis == "y":
        return sorted((sorted(x, key=lambda s: (s["min_x"], s["min_y"])) for x in out), key=lambda x: (min(s["min_y"] for s in x), min(s["min_x"] for s in x)))
    return sorted((sorted(x, key=lambda s: (s["min_y"], -s["min_x"])) for x in out), key=lambda x: -max(s["max_x"] for s in x))


def _line_text(spans: list[dict]) -> str:
    out, formula = "", False
    for s in spans:
        text, is_formula = s["text"], bool(s.get("is_formula"))
        if not text:
            continue
        if is_formula and not text.startswith("$") and not text.endswith("$"):
            text = f"${text}$"
        if out and (formula or is_formula or _spaced(out[-1]) or _spaced(text[0])) and not out[-1].isspace() and not text[0].isspace():
            out += " "
        out, formula = out + text, is_formula
    return out.rstrip()


def block_text(spans: list[dict]) -> str:
    """A block's spans as text: lines (columns from the right where most spans are tall), words split by a hyphen joined, line ends kept after short lines and before gaps."""
    spans = [s for s in spans if s["text"]]
    if not spans:
        return ""
    if sum(s["max_y"] - s["min_y"] > s["max_x"] - s["min_x"] for s in spans) > TALL * len(spans):
        return "\n".join(t for t in map(_line_text, _span_lines(spans, "x")) if t)
    start, stop = min(s["min_x"] for s in spans), max(s["max_x"] for s in spans)
    lines = [(x, t) for x in _span_lines(spans, "y") if (t := _line_text(x))]
    out = ""
    for k, (line, text) in enumerate(lines):
        if k == len(lines) - 1:
            return out + text
        nxt, follow = lines[k + 1]
        if len(text) >= 2 and text[-1] == "-" and text[-2].isascii() and text[-2].isalpha() and "a" <= follow[0] <= "z":
            out += text[:-1]
            continue
        top, bottom = min(s["min_y"] for s in line), max(s["max_y"] for s in line)
        short = stop - max(s["max_x"] for s in line) > (stop - start) * (SHORT_FIRST_END if k == 0 else SHORT_END)
        far = min(s["min_y"] for s in nxt) - bottom > (bottom - top) * LINE_GAP
        out += text + ("\n" if short or far else " " if _spaced(text[-1]) or _spaced(follow[0]) else "")
    return out


def assemble_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: each block's lines (and formulas, where is_formula is set) as its text."""
    types = dict(lines.dtypes)
    return by_page(lines, keys, ["min_y", "min_x"], lambda rows: [{k: rows[0][k] for k in keys} | {"text": block_text(rows)}], ", ".join(f"{k} {types[k]}" for k in keys) + ", text string")


def display_order(text: str | None) -> str | None:
    """Logical order as shown: runs of one direction, right-to-left ones reversed with brackets mirrored; digits are left-to-right, and what has no direction takes its neighbours' if they agree, else the paragraph's."""
    if not text or not _RTL.search(text):
        return text
    kind = ["R" if _RTL.match(c) and not c.isdigit() else "L" if c.isdigit() or c.isalpha() else "N" for c in text]
    right, left = kind.count("R"), kind.count("L")
    whole = next((k for k in kind if k != "N"), "L") if right == left else "R" if right > left else "L"
    runs = [[k, "".join(c for _, c in g)] for k, g in _groups(zip(kind, text))]
    for i, run in enumerate(runs):
        if run[0] == "N":
            before, after = runs[i - 1][0] if i else whole, runs[i + 1][0] if i + 1 < len(runs) else whole
            run[0] = before if before == after else whole
    merged = [[k, "".join(t for _, t in g)] for k, g in _groups(runs)]
    shown = [t[::-1].translate(_MIRROR) if k == "R" else t for k, t in merged]
    return "".join(reversed(shown) if whole == "R" else shown)


def _groups(pairs):
    from itertools import groupby

    return ((k, list(g)) for k, g in groupby(pairs, key=lambda p: p[0]))


@F.pandas_udf(T.StringType())
def display_ordered(text: pd.Series) -> pd.Series:
    return text.map(display_order)
