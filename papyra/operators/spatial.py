"""Spatial joins inside a page: an equality on the page's keys, a range on boxes, and the best partner by an ordered struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.geometry import Box, box, box_of, intersection, iou, overlap_of_smaller, overlap_x, overlap_y, within

STRONG, MATCH, HURDLE_PIXELS, FORMULA_ATTACH = 0.9, 0.6, 3.0, 0.5
_EDGES = ("min_x", "min_y", "max_x", "max_y")


def _renamed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def match_lines_to_blocks(lines: DataFrame, blocks: DataFrame, keys: list[str], line_id: str = "line_index", block_id: str = "block_index") -> DataFrame:
    """keys, line, block, ratio, status: each line's block by the share of the line in it.

    `strong` from 0.9 on; `hurdle` if it laps over two blocks or more by over 3 points each way (no block: its parts
    are to be read again); `match` from 0.6 on; else `orphan`, as is a line without area. Ties go to the first block.
    """
    b = _renamed(blocks, keys, "b_")
    line, block = box(), box("b_")
    area = line.area
    pairs = lines.select(*keys, line_id, *_EDGES).join(b, keys).filter((overlap_x(line, block) > 0) & (overlap_y(line, block) > 0) & (area > 0))
    ratio = intersection(line, block) / area
    straddles = (overlap_x(line, block) > HURDLE_PIXELS) & (overlap_y(line, block) > HURDLE_PIXELS)
    best = pairs.groupBy(*keys, line_id).agg(F.max(F.struct(ratio.alias("ratio"), (-F.col(f"b_{block_id}")).alias("i"))).alias("best"), F.sum(straddles.cast("int")).alias("over"))
    out = lines.select(*keys, line_id).join(best, [*keys, line_id], "left")
    r = F.coalesce("best.ratio", F.lit(0.0))
    status = F.when(r >= STRONG, "strong").when(F.col("over") >= 2, "hurdle").when(r >= MATCH, "match").otherwise("orphan")
    return out.select(*keys, line_id, F.when(status.isin("strong", "match"), -F.col("best.i")).alias(block_id), r.alias("ratio"), status.alias("status"))


def hurdle_fragments(lines: DataFrame, blocks: DataFrame, keys: list[str], line_id: str = "line_index", block_id: str = "block_index") -> DataFrame:
    """The parts of straddling lines, one for each block, that a recogniser is to read again."""
    status = match_lines_to_blocks(lines, blocks, keys, line_id, block_id).filter("status = 'hurdle'").select(*keys, line_id)
    b = _renamed(blocks, keys, "b_")
    line, block = box(), box("b_")
    pairs = lines.select(*keys, line_id, *_EDGES).join(status, [*keys, line_id]).join(b, keys)
    pairs = pairs.filter((overlap_x(line, block) > HURDLE_PIXELS) & (overlap_y(line, block) > HURDLE_PIXELS))
    cut = Box(F.greatest(line.min_x, block.min_x), F.greatest(line.min_y, block.min_y), F.least(line.max_x, block.max_x), F.least(line.max_y, block.max_y))
    return pairs.select(*keys, line_id, F.col(f"b_{block_id}").alias(block_id), *cut.columns())


def attach_formulas(formulas: DataFrame, blocks: DataFrame, keys: list[str], formula_id: str = "formula_index", block_id: str = "block_index") -> DataFrame:
    """keys, formula, block, target: a table that holds half of it, else a text block that does, or any for an inline formula; else alone."""
    b = _renamed(blocks, keys, "b_")
    f, block = box(), box("b_")
    pairs = formulas.join(b, keys).filter(f.area > 0)
    ratio = intersection(f, block) / f.area
    order = F.struct(ratio.alias("r"), (-F.col(f"b_{block_id}")).alias("i"))
    table = F.col("b_type") == "Table"
    best = pairs.groupBy(*keys, formula_id).agg(F.max(F.when(table & (ratio > 0), order)).alias("t"), F.max(F.when(~table & (ratio > 0), order)).alias("x"))
    out = formulas.join(best, [*keys, formula_id], "left")
    inline = F.coalesce(F.col("label") == "inline_formula", F.lit(False))
    target = F.when(F.col("t.r") >= FORMULA_ATTACH, "table").when((F.col("x.r") >= FORMULA_ATTACH) | (inline & (F.col("x.r") > 0)), "text").otherwise("alone")
    return out.select(*keys, formula_id, F.when(target == "table", -F.col("t.i")).when(target == "text", -F.col("x.i")).alias(block_id), target.alias("target"))


def corner_distance(a: Box, b: Box) -> Column:
    d = [F.abs(a.min_x - b.min_x), F.abs(a.min_y - b.min_y), F.abs(a.max_x - b.max_x), F.abs(a.max_y - b.max_y)]
    return d[0] + d[1] + d[2] + d[3] + F.least(d[0] + d[1], d[2] + d[3])


def match_lines_to_cells(lines: DataFrame, cells: DataFrame, keys: list[str], line_id: str = "line_index", cell_id: str = "cell_index") -> DataFrame:
    """Every line's cell of its table: the least 1 - IoU, then the least corner distance, then the first."""
    c = _renamed(cells, keys, "c_")
    pairs = lines.select(*keys, line_id, *_EDGES).join(c, keys)
    cost = F.struct((1 - iou(box(), box("c_"))).alias("a"), corner_distance(box(), box("c_")).alias("d"), F.col(f"c_{cell_id}").alias("i"))
    return pairs.groupBy(*keys, line_id).agg(F.min(cost).alias("m")).select(*keys, line_id, F.col("m.i").alias(cell_id))


def smallest_containers(blocks: DataFrame, keys: list[str], block_id: str = "block_index") -> DataFrame:
    """keys, block, container: the smallest block that strictly contains it, ties to the first."""
    outer = _renamed(blocks.select(*keys, block_id, *_EDGES), keys, "o_")
    b, o = box(), box("o_")
    inside = within(b, o) & (o.area > b.area) & (F.col(block_id) != F.col(f"o_{block_id}"))
    pairs = blocks.select(*keys, block_id, *_EDGES).join(outer, keys).filter(inside)
    return pairs.groupBy(*keys, block_id).agg(F.min(F.struct(o.area.alias("a"), F.col(f"o_{block_id}").alias("i"))).alias("m")).select(*keys, block_id, F.col("m.i").alias("container"))


def same_region(a: Box, b: Box) -> Column:
    """The overlap is 0.7 or more of the smaller box and 0.5 or more of the larger."""
    both = intersection(a, b)
    small, large = F.least(a.area, b.area), F.greatest(a.area, b.area)
    return F.when(small > 0, (both / small >= 0.7) & (both / large >= 0.5)).otherwise(F.lit(False))


def missing_regions(regions: DataFrame, lines: DataFrame, keys: list[str], region_id: str = "region_index") -> DataFrame:
    """Regions that no line covers, and of regions that cover each other only the first."""
    line = _renamed(lines.select(*keys, *_EDGES), keys, "l_")
    a, b = box("regions."), box("l_")
    hit = (overlap_of_smaller(a, b) > 0.5) & (intersection(a, b) / F.greatest(a.area, b.area) >= 0.5)
    on = [F.col(f"regions.{k}") == line[k] for k in keys]
    free = regions.alias("regions").join(line, [*on, hit], "left_anti")
    return greedy_keep(free, keys, [region_id], lambda k, x: same_region(k, x))


def greedy_keep(rows: DataFrame, keys: list[str], order: list, clash) -> DataFrame:
    """Rows of a page in order, each kept unless it clashes with one kept before; in the JVM, a page at a time.

    order: columns; those given as ("name", "desc") descend. clash(kept box, box) is a Column.
    """
    sort = [F.col(o).alias(f"_{i}") if isinstance(o, str) else (-F.col(o[0])).alias(f"_{i}") for i, o in enumerate(order)]
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*sort, *_EDGES, F.struct(*[c for c in rows.columns if c not in keys]).alias("_row")))).alias("_all"))
    empty = F.slice("_all", 1, 0)
    kept = F.aggregate("_all", empty, lambda acc, x: F.when(F.exists(acc, lambda k: clash(box_of(k), box_of(x))), acc).otherwise(F.array_append(acc, x)))
    return packed.select(*keys, F.explode(kept).alias("_k")).select(*keys, "_k._row.*")


def uncovered_regions(regions: DataFrame, natives: DataFrame, keys: list[str], region_id: str = "region_index", least: float = 0.95) -> DataFrame:
    """Regions of which native lines cover less than 0.95, and the share covered.

    A native counts if half of it lies inside. The union's area is exact: slabs between the sides of a region's natives,
    and in each slab the merged vertical spans (gaps and islands).
    """
    n = _renamed(natives.select(*keys, *_EDGES), keys, "n_")
    r, t = box(), box("n_")
    x0, x1 = F.greatest(r.min_x, t.min_x), F.least(r.max_x, t.max_x)
    y0, y1 = F.greatest(r.min_y, t.min_y), F.least(r.max_y, t.max_y)
    inside = regions.select(*keys, region_id, *_EDGES).join(n, keys).filter((intersection(r, t) > 0) & (intersection(r, t) / t.area >= 0.5))
    parts = inside.select(*keys, region_id, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    area = union_area(parts, [*keys, region_id])
    out = regions.join(area, [*keys, region_id], "left").withColumn("covered", F.coalesce(F.col("union_area") / F.when(r.area > 0, r.area), F.lit(0.0)))
    return out.filter(F.col("covered") < least).drop("union_area")


def union_area(rectangles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, union_area of rectangles x0, x1, y0, y1."""
    k = Window.partitionBy(*keys)
    edges = rectangles.select(*keys, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    slabs = edges.withColumn("right", F.lead("left").over(k.orderBy("left"))).filter("right is not null")
    spans = rectangles.join(slabs, keys).filter((F.col("x0") <= F.col("left")) & (F.col("x1") >= F.col("right")))
    w = Window.partitionBy(*keys, "left").orderBy("y0", "y1")
    before = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(before, F.col("y0"))))
    return spans.select(*keys, ((F.col("right") - F.col("left")) * added).alias("a")).groupBy(*keys).agg(F.sum("a").alias("union_area"))


#: Zones of a template, at most: they are broadcast.
MOST_ZONES = 10_000


def lines_in_zones(lines: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Per page and named zone, in the zones' order, the lines whose centre is in it, joined in line order; empty zones stay."""
    z = zones.select("zone_ordinal", "zone_name", *[F.col(c).alias(f"z_{c}") for c in _EDGES])
    b, zb = box(), box("z_")
    if z.limit(MOST_ZONES + 1).count() > MOST_ZONES:
        raise ValueError(f"more than {MOST_ZONES} zones")
    pages = lines.select(*keys).distinct().crossJoin(F.broadcast(z))  # every page has every zone
    hit = lines.crossJoin(F.broadcast(z)).filter(b.center_x.between(zb.min_x, zb.max_x) & b.center_y.between(zb.min_y, zb.max_y))
    found = hit.groupBy(*keys, "zone_ordinal").agg(F.array_sort(F.collect_list(F.struct("line_index", "text", "confidence"))).alias("l"))
    out = pages.select(*keys, "zone_ordinal", "zone_name").join(found, [*keys, "zone_ordinal"], "left")
    return out.select(*keys, "zone_ordinal", "zone_name", F.coalesce(F.array_join(F.col("l.text"), "\n"), F.lit("")).alias("text"), F.coalesce(F.size("l"), F.lit(0)).alias("line_count"))
