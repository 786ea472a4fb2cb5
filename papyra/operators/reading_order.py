"""Reading order of a page's lines or blocks."""

from __future__ import annotations

from statistics import median

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from papyra.functions.geometry import box
from papyra.functions.paging import by_page


def _with(schema: StructType, *names: str) -> StructType:
    return StructType([*[f for f in schema.fields if f.name not in names], *[StructField(n, IntegerType()) for n in names]])


def columns_of_page(lines: DataFrame, keys: list[str], id_col: str = "line_index") -> DataFrame:
    """`column` from 0 on: a gap to all boxes before of over max(20, 1.5 median height) begins a new one; in the JVM."""
    page = Window.partitionBy(*keys)
    h = F.when(box().height > 0, box().height)
    out = lines.withColumn("_gutter", F.greatest(F.lit(20.0), 1.5 * F.coalesce(F.percentile(h, 0.5).over(page), F.lit(0.0))))
    across = page.orderBy("min_x", id_col)
    before = F.max("max_x").over(across.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_new", (F.coalesce(F.col("min_x") - before, F.lit(0.0)) > F.col("_gutter")).cast("int"))
    return out.withColumn("column", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_gutter", "_new")


def same_row(centre: float, height: float, r: dict, tolerance: float) -> bool:
    own = r["max_y"] - r["min_y"]
    overlap = min(centre + height / 2, r["max_y"]) - max(centre - height / 2, r["min_y"])
    least = min(height, own)
    return least > 0 and overlap >= 0.5 * least or abs((r["min_y"] + r["max_y"]) / 2 - centre) <= tolerance


def reading_order(lines: DataFrame, keys: list[str], id_col: str = "line_index") -> DataFrame:
    """`column`, `row` and `position`: columns left to right, in them rows from the top, in a row left to right.

    A line joins the row before if it overlaps the running mean of its lines' centres and heights.
    """
    cols = columns_of_page(lines, keys, id_col)

    def rows_of(rows: list[dict]):
        heights = [r["max_y"] - r["min_y"] for r in rows if r["max_y"] > r["min_y"]]
        tolerance = max(4.0, 0.5 * (median(heights) if heights else 0.0))
        out, at, row = [], None, []
        for r in sorted(rows, key=lambda r: (r["column"], (r["min_y"] + r["max_y"]) / 2, r["min_x"], r[id_col])):
            mean = lambda f: sum(map(f, row)) / len(row)
            if row and r["column"] == at and same_row(mean(lambda x: (x["min_y"] + x["max_y"]) / 2), mean(lambda x: x["max_y"] - x["min_y"]), r, tolerance):
                row.append(r)
            else:
                row = [r]
                out.append(row)
            at = r["column"]
        position = 0
        for k, row in enumerate(out):
            for r in sorted(row, key=lambda r: r["min_x"]):
                yield r | {"row": k, "position": position}
                position += 1

    return by_page(cols, keys, [id_col], rows_of, _with(cols.schema, "row", "position"))


def skewed_reading_order(lines: DataFrame, keys: list[str], id_col: str = "line_index", skew_col: str = "skew") -> DataFrame:
    """reading_order by boxes turned back by the page's skew in degrees, if it is 0.5 or more; the lines' own boxes stay."""
    b = box()
    a = F.when(F.abs(F.col(skew_col)) >= 0.5, -F.radians(F.col(skew_col))).otherwise(F.lit(0.0))
    corner = [(x, y) for x in (b.min_x, b.max_x) for y in (b.min_y, b.max_y)]
    xs = [x * F.cos(a) - y * F.sin(a) for x, y in corner]
    ys = [x * F.sin(a) + y * F.cos(a) for x, y in corner]
    turned = lines.withColumns({"_o": F.struct("min_x", "min_y", "max_x", "max_y"), "_x0": F.least(*xs), "_y0": F.least(*ys), "_x1": F.greatest(*xs), "_y1": F.greatest(*ys)})
    turned = turned.withColumns({"min_x": F.col("_x0"), "min_y": F.col("_y0"), "max_x": F.col("_x1"), "max_y": F.col("_y1")}).drop("_x0", "_y0", "_x1", "_y1")
    out = reading_order(turned, keys, id_col)
    return out.withColumns({c: F.col(f"_o.{c}") for c in ("min_x", "min_y", "max_x", "max_y")}).drop("_o")


def sorted_boxes(lines: DataFrame, keys: list[str], id_col: str = "line_index", tolerance: float = 10.0) -> DataFrame:
    """`position` by (min_y, min_x), after which neighbours less than 10 points apart in height move left past each other."""

    def order(rows: list[dict]):
        rows = sorted(rows, key=lambda r: (r["min_y"], r["min_x"]))
        for i in range(1, len(rows)):
            j = i
            while j and abs(rows[j]["min_y"] - rows[j - 1]["min_y"]) < tolerance and rows[j]["min_x"] < rows[j - 1]["min_x"]:
                rows[j - 1], rows[j] = rows[j], rows[j - 1]
                j -= 1
        return [r | {"position": k} for k, r in enumerate(rows)]

    return by_page(lines, keys, [id_col], order, _with(lines.schema, "position"))


def xy_cut_order(boxes: list[tuple[float, float, float, float]], least_gap: float = 1.0) -> list[int]:
    """Indices in reading order: cut at empty vertical strips, then at horizontal ones, in turn, until neither divides a group."""

    def runs(group: list[int], axis: int) -> list[list[int]]:
        ends = lambda i: sorted((boxes[i][axis], boxes[i][axis + 2]))
        out, covered = [], float("-inf")
        for i in sorted(group, key=lambda i: ends(i)[0]):
            start, end = ends(i)
            if not out or start - covered > least_gap:
                out.append([])
            out[-1].append(i)
            covered = max(covered, end)
        return out

    done: list[int] = []
    work = [(list(range(len(boxes))), 0, False)]  # group, axis to cut, whether the other axis just failed
    while work:
        group, axis, failed = work.pop()
        parts = runs(group, axis) if len(group) > 1 else []
        if len(group) <= 1:
            done += group
        elif len(parts) > 1:
            work += [(p, 1 - axis, False) for p in reversed(parts)]
        elif axis == 0 and not failed:
            work.append((group, 1, True))
        else:
            done += sorted(group, key=lambda i: (boxes[i][1], boxes[i][0]))
    return done


def xy_cut(blocks: DataFrame, keys: list[str], id_col: str = "block_index") -> DataFrame:
    """`position` by recursive XY-cut."""

    def order(rows: list[dict]):
        for k, i in enumerate(xy_cut_order([(r["min_x"], r["min_y"], r["max_x"], r["max_y"]) for r in rows])):
            yield rows[i] | {"position": k}

    return by_page(blocks, keys, [id_col], order, _with(blocks.schema, "position"))


def bands(blocks: DataFrame, keys: list[str], axis: str = "y", id_col: str = "block_index", least_gap: float = 1.0) -> DataFrame:
    """`band` from 0 on: one level of the cut, along one axis; in the JVM."""
    lo, hi = F.least(f"min_{axis}", f"max_{axis}"), F.greatest(f"min_{axis}", f"max_{axis}")
    w = Window.partitionBy(*keys).orderBy(lo, id_col)
    covered = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = blocks.withColumn("_new", F.coalesce((lo - covered > least_gap).cast("int"), F.lit(0)))
    return out.withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def line_groups(lines: DataFrame, keys: list[str], id_col: str = "line_index", least: float = 0.5) -> DataFrame:
    """`row`: lines from the top that overlap the running band of the row before by half the smaller height or more."""

    def fold(rows: list[dict]):
        k, top, bottom = -1, 0.0, 0.0
        for r in sorted(rows, key=lambda r: (r["min_y"], r["min_x"], r[id_col])):
            overlap = min(bottom, r["max_y"]) - max(top, r["min_y"])
            smaller = min(bottom - top, r["max_y"] - r["min_y"])
            if k >= 0 and smaller > 0 and overlap / smaller >= least:
                top, bottom = min(top, r["min_y"]), max(bottom, r["max_y"])
            else:
                k, top, bottom = k + 1, r["min_y"], r["max_y"]
            yield r | {"row": k}

    return by_page(lines, keys, [id_col], fold, _with(lines.schema, "row"))


def paragraphs(lines: DataFrame, keys: list[str], id_col: str = "line_index", y_gap: float = 0.5, x_gap: float = 1.0) -> DataFrame:
    """`paragraph`: a line joins the first paragraph whose last line is near above it, and beside or over a fifth of the narrower one."""

    def near(a: dict, b: dict) -> bool:
        h = max(a["max_y"] - a["min_y"], b["max_y"] - b["min_y"])
        if not -h <= b["min_y"] - a["max_y"] <= h * y_gap:
            return False
        shared = min(a["max_x"], b["max_x"]) - max(a["min_x"], b["min_x"])
        return shared > 0.2 * min(a["max_x"] - a["min_x"], b["max_x"] - b["min_x"]) or -shared <= h * x_gap

    def fold(rows: list[dict]):
        last: list[dict] = []
        for r in sorted((r for r in rows if r["text"]), key=lambda r: (r["min_y"], r["min_x"], r[id_col])):
            k = next((i for i, p in enumerate(last) if near(p, r)), len(last))
            last[k : k + 1] = [r]
            yield r | {"paragraph": k}

    return by_page(lines, keys, [id_col], fold, _with(lines.schema, "paragraph"))


def merge_paragraphs(lines: DataFrame, keys: list[str], **options) -> DataFrame:
    """keys, paragraph, text, confidence and box: each paragraph's lines from the top, joined by line ends."""
    p = paragraphs(lines, keys, **options)
    g = p.groupBy(*keys, "paragraph").agg(F.array_sort(F.collect_list(F.struct("min_y", "min_x", "text"))).alias("l"), F.avg("confidence").alias("confidence"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    return g.select(*keys, "paragraph", F.array_join(F.col("l.text"), "\n").alias("text"), "confidence", "min_x", "min_y", "max_x", "max_y")


def sequence_edges(blocks: DataFrame, keys: list[str], order: str = "block_order", id_col: str = "block_index") -> DataFrame:
    """keys, from, to: each block and the next in reading order."""
    nxt = F.lead(id_col).over(Window.partitionBy(*keys).orderBy(order, id_col))
    return blocks.select(*keys, F.col(id_col).alias("from_block"), nxt.alias("to_block")).filter("to_block is not null")
