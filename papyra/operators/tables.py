"""Tables: structure tokens, HTML to and from grids, cells."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.paging import by_page

TD = ("<td>", "<td", "<td></td>")
# fixed values: limits of a strict table
MOST_CHARS, MOST_SPAN = 4_000_000, 4096
GRID = T.ArrayType(T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("row", "col", "row_span", "col_span")], T.StructField("text", T.StringType()), T.StructField("header", T.BooleanType())]))


def decode_tokens(probs: np.ndarray, boxes: np.ndarray, vocabulary: list[str], begin: int, end: int, scale_x: float, scale_y: float, width: float, height: float) -> tuple[list[str], list[list[float]]]:
    """(tokens, boxes of cells) of a structure model's steps: the first best class each, until the end token; corners' extent, cut to the image."""
    best = probs.argmax(axis=1)
    stop = np.flatnonzero(best[1:] == end)
    best = best[: stop[0] + 1] if len(stop) else best
    tokens, cells = [], []
    for step, k in enumerate(best):
        if k in (begin, end):
            continue
        token = vocabulary[k] if k < len(vocabulary) else ""
        if token in TD and step < len(boxes):
            x, y = boxes[step][0::2].astype(np.float32) * np.float32(scale_x), boxes[step][1::2].astype(np.float32) * np.float32(scale_y)
            cells.append([float(np.clip(v, 0, top)) for v, top in ((x.min(), width), (y.min(), height), (x.max(), width), (y.max(), height))])
        tokens.append(token)
    return tokens, cells


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def visual_rows(lines: list[dict]) -> list[list[dict]]:
    """A cell's lines as rows from the top: a line joins the running band it overlaps by half the smaller height."""
    rows, top, bottom = [], 0.0, 0.0
    for r in sorted(lines, key=lambda r: (r["min_y"], r["min_x"])):
        overlap, least = min(bottom, r["max_y"]) - max(top, r["min_y"]), min(bottom - top, r["max_y"] - r["min_y"])
        if rows and overlap >= max(least, 0) * 0.5:
            rows[-1].append(r)
            top, bottom = min(top, r["min_y"]), max(bottom, r["max_y"])
        else:
            rows.append([r])
            top, bottom = r["min_y"], r["max_y"]
    return [sorted(x, key=lambda r: r["min_x"]) for x in rows]


def table_html(tokens: list[str], cells: dict[int, list[dict]]) -> str:
    """The table's markup with each cell's lines in place: rows of a cell apart by a break, lines of a row by a space."""
    out, cell = [], 0
    for token in tokens:
        if "</td>" not in token:
            out.append(token)
            continue
        body = "<br>".join(" ".join(_escape(x["text"]) for x in row) for row in visual_rows(cells.get(cell, [])))
        out.append(f"<td>{body}</td>" if token == "<td></td>" else body + token)
        cell += 1
    return f"<html><body><table>{''.join(out)}</table></body></html>"


def build_tables(tables: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, table_html: tables (keys, tokens) with their lines (keys, cell_index, text, box), as matched to cells."""
    packed = lines.groupBy(*keys).agg(F.collect_list(F.struct("cell_index", "text", "min_x", "min_y", "max_x", "max_y")).alias("l"))

    def build(rows: list[dict]):
        for r in rows:
            cells: dict[int, list[dict]] = {}
            for x in r["l"] or []:
                cells.setdefault(x["cell_index"], []).append(x)
            yield {k: r[k] for k in keys} | {"table_html": table_html(r["tokens"], cells)}

    joined = tables.join(packed, keys, "left")
    types = dict(joined.dtypes)
    return by_page(joined, keys, [], build, ", ".join(f"{k} {types[k]}" for k in keys) + ", table_html string")


class _Rows(HTMLParser):
    """Cells of the outermost table of lenient markup; a break is a line end, a nested table is text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.open, self.depth, self.done = False, 0, False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        if self.done or self.depth != 1:
            return
        if tag == "tr":
            self.open = False
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            span = {k: v for k, v in attrs}
            number = lambda k: max(1, min(MOST_SPAN, int(span[k]))) if re.fullmatch(r"\s*\d{1,6}\s*", span.get(k) or "") else 1
            self.rows[-1].append([number("rowspan"), number("colspan"), "", tag == "th"])
            self.open = True
        elif tag == "br" and self.open:
            self.rows[-1][-1][2] += "\n"

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
            self.done = self.done or self.depth == 0
        elif tag in ("td", "th", "tr") and self.depth == 1:
            self.open = False

    def handle_data(self, data):
        if self.open and not self.done:
            self.rows[-1][-1][2] += re.sub(r"[ \t\r\n]+", " ", data)


def fill_grid(rows: list[list[list]]) -> list[dict]:
    """Cells at their places: a cell takes the first free column of its row, spans block the places below and right, rows below the last are cut."""
    taken: set[tuple[int, int]] = set()
    out = []
    for i, row in enumerate(rows):
        col = 0
        for down, right, text, header in row:
            while (i, col) in taken:
                col += 1
            down = min(down, len(rows) - i)
            taken |= {(i + a, col + b) for a in range(down) for b in range(right)}
            out.append({"row": i, "col": col, "row_span": down, "col_span": right, "text": text.strip(), "header": header})
            col += right
    return out


def lenient_grid(html: str | None) -> list[dict] | None:
    """Cells of the first table in any markup; None if there is no row."""
    if not html or "<" not in html:
        return None
    parser = _Rows()
    parser.feed(html if re.search("<table", html, re.I) else f"<table>{html}</table>")
    parser.close()
    rows = [r for r in parser.rows if r]
    return fill_grid(rows) if rows else None


def strict_grid(html: str | None) -> list[dict]:
    """Cells of well-formed markup of one table that covers a rectangle; ValueError says what is wrong."""
    if not html or len(html) > MOST_CHARS:
        raise ValueError("no table, or a too long one")
    if "<!" in html:
        raise ValueError("declarations are not allowed")
    try:
        root = ET.fromstring(re.sub(r"<br\s*/?>", "\n", html))
    except ET.ParseError as e:
        raise ValueError(f"not well-formed: {e}") from None
    found = [x for x in root.iter() if x.tag == "table"]
    if len(found) != 1:
        raise ValueError("exactly one table is needed")
    rows = []
    for tr in found[0].iter("tr"):
        row = []
        for td in tr:
            if td.tag in ("td", "th"):
                spans = [td.get(k, "1") for k in ("rowspan", "colspan")]
                if not all(s.isdigit() and 1 <= int(s) <= MOST_SPAN for s in spans):
                    raise ValueError("a span is no number from 1 to 4096")
                row.append([int(spans[0]), int(spans[1]), "".join(td.itertext()), td.tag == "th"])
        rows.append(row)
    cells = fill_grid(rows)
    area = sum(c["row_span"] * c["col_span"] for c in cells)
    width = max((c["col"] + c["col_span"] for c in cells), default=0)
    if not cells or area != width * len(rows) or any(r[0] + i > len(rows) for i, row in enumerate(rows) for r in row):
        raise ValueError("the cells don't cover a rectangle")
    return cells


@F.pandas_udf(GRID)
def html_grid(html: pd.Series) -> pd.Series:
    return html.map(lenient_grid)


def table_cells(blocks: DataFrame, keys: list[str], html: str = "table_html") -> DataFrame:
    """keys and one row for each cell of each block's table."""
    return blocks.filter(F.col(html).isNotNull()).select(*keys, F.explode(html_grid(F.col(html))).alias("c")).select(*keys, "c.*")


def column_count(grid: Column) -> Column:
    return F.array_max(F.transform(grid, lambda c: c["col"] + c["col_span"]))


def first_row(grid: Column) -> Column:
    """Texts of the first row's cells by column."""
    return F.transform(F.array_sort(F.transform(F.filter(grid, lambda c: c["row"] == 0), lambda c: F.struct(c["col"].alias("col"), c["text"].alias("text")))), lambda c: c["text"])


def route_wired(score_wired: Column, threshold: float = 0.5) -> Column:
    """Which structure model reads a table: the one for drawn lines or the one without."""
    return F.when(score_wired >= threshold, "wired").otherwise("wireless")
