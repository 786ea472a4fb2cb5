"""Layout regions: thresholds, suppression, merging, label repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.geometry import box, box_of, clamp, contained, intersection, iou, unclip
from papyra.operators.spatial import greedy_keep

# fixed values: defaults of the layout step
SCORE, SAME_CLASS_IOU, OTHER_CLASS_IOU = 0.5, 0.6, 0.98
CLASS_SCORES = {"paragraph_title": 0.3, "text": 0.4, "formula": 0.3, "display_formula": 0.3, "inline_formula": 0.3, "seal": 0.45}
CLASS_MERGES = {"paragraph_title": "large", "image": "large", "formula": "large", "display_formula": "large", "inline_formula": "large", "chart": "large"}
PORTRAIT_IMAGE, LANDSCAPE_IMAGE, DUPLICATE_OVERLAP, TITLE_AREA, CONTAINMENT = 0.93, 0.82, 0.5, 0.3, 0.9
# fixed values: block types of raw labels
BLOCK_TYPES = {
    "text": "Text", "content": "Text", "paragraph_title": "Title", "doc_title": "DocTitle", "image": "Figure", "figure": "Figure", "figure_title": "FigureCaption", "chart_title": "FigureCaption", "table": "Table", "table_title": "TableCaption", "seal": "Seal",
    "chart": "Chart", "reference": "Reference", "formula": "Formula", "display_formula": "Formula", "inline_formula": "Formula", "formula_number": "FormulaNumber", "header": "Header", "footer": "Footer", "footnote": "Footnote",
    "number": "PageNumber", "abstract": "Abstract", "algorithm": "Algorithm", "aside_text": "Aside",
}


def _lookup(values: dict, key: Column, otherwise) -> Column:
    out = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return F.coalesce(out, otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def block_type(label: Column) -> Column:
    return _lookup(BLOCK_TYPES, F.translate(F.lower(F.trim(label)), " -", "__"), "Unknown")


def threshold(regions: DataFrame, score: float = SCORE, classes: dict[str, float] = CLASS_SCORES) -> DataFrame:
    """Regions with a score above their class's floor, strictly."""
    return regions.filter(F.col("score") > _lookup(classes, F.col("label"), float(score)))


def score_floor(score: float = SCORE, classes: dict[str, float] = CLASS_SCORES) -> float:
    """The least of all floors: what a detector may leave out already."""
    return min([score, *classes.values()])


def suppress_by_score(regions: DataFrame, keys: list[str], region_id: str = "region_index") -> DataFrame:
    """The best-scored first, each drops later ones from an IoU of 0.6 on in its class, 0.98 in another; pixels count whole."""
    packed = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(region_id).alias("i"), "label", "min_x", "min_y", "max_x", "max_y", F.struct(*[c for c in regions.columns if c not in keys]).alias("row")))).alias("all"))
    clash = lambda k, x: iou(box_of(k), box_of(x), 1.0) >= F.when(k["label"] == x["label"], SAME_CLASS_IOU).otherwise(OTHER_CLASS_IOU)
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(F.array_append(acc, x)))
    return packed.select(*keys, F.explode(kept).alias("k")).select(*keys, "k.row.*")


def suppress_by_area(regions: DataFrame, keys: list[str], most_iou: float, region_id: str = "region_index") -> DataFrame:
    """The largest first, each drops later ones above the IoU; 0 or less switches it off."""
    if most_iou <= 0:
        return regions
    sized = regions.withColumn("_area", box().area)
    return greedy_keep(sized, keys, [("_area", "desc"), region_id], lambda k, x: iou(k, x) > most_iou).drop("_area")


def drop_oversized_images(regions: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """Without images that fill the page, unless nothing else is there or a page has one region only."""
    most = (LANDSCAPE_IMAGE if width > height else PORTRAIT_IMAGE) * width * height
    b = box()
    w, h = F.least(F.lit(float(width)), b.max_x) - F.greatest(F.lit(0.0), b.min_x), F.least(F.lit(float(height)), b.max_y) - F.greatest(F.lit(0.0), b.min_y)
    fits = (F.col("label") != "image") | (w * h <= most)
    page = Window.partitionBy(*keys)
    out = regions.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(page)).withColumn("_n", F.count(F.lit(1)).over(page))
    return out.filter(F.col("_fits") | ~F.col("_any") | (F.col("_n") <= 1)).drop("_fits", "_any", "_n")


def merge_contained(regions: DataFrame, keys: list[str], mode: str | None = None, classes: dict[str, str] = CLASS_MERGES, region_id: str = "region_index") -> DataFrame:
    """Without regions that a merge rule drops.

    mode "large" keeps outer regions, "small" inner ones, of all classes. None goes by class: "large" looks at the
    outer region's class, "small" at the inner one's. A region is contained if 0.9 of it lies in the other. Where a
    page has a formula, formulas in other regions stay.
    """
    slim = regions.select(*keys, F.col(region_id).alias("_i"), "label", "min_x", "min_y", "max_x", "max_y")
    outer = slim.select(*keys, *[F.col(c).alias(f"o{c}" if c == "_i" else f"o_{c}") for c in slim.columns if c not in keys])
    pairs = slim.join(outer, keys).filter((F.col("_i") != F.col("o_i")) & contained(box(), box("o_"), CONTAINMENT) & ~((F.col("label") == "formula") & (F.col("o_label") != "formula")))
    rules = {None: mode} if mode else classes
    large = [k for k, how in rules.items() if how == "large"]
    drops = (pairs if None in large else pairs.filter(F.col("o_label").isin(*large))).select(*keys, "_i") if large else pairs.limit(0).select(*keys, "_i")
    for label in [k for k, how in rules.items() if how == "small"]:
        p = pairs if label is None else pairs.filter(F.col("label") == label)
        drops = drops.union(p.select(*keys, F.col("o_i").alias("_i")).join(p.select(*keys, "_i").distinct(), [*keys, "_i"], "left_anti"))
    return regions.join(drops.distinct().withColumnRenamed("_i", region_id), [*keys, region_id], "left_anti")


def model_order(regions: DataFrame, keys: list[str], region_id: str = "region_index") -> DataFrame:
    """`position` by the model's order if all of a page's regions have one, else by id."""
    page = Window.partitionBy(*keys)
    whole = F.count("order_index").over(page) == F.count(F.lit(1)).over(page)
    out = regions.withColumn("_k", F.when(whole, F.col("order_index")).otherwise(F.col(region_id)))
    return out.withColumn("position", (F.row_number().over(page.orderBy("_k", region_id)) - 1).cast("int")).drop("_k")


def unclip_regions(regions: DataFrame, ratio: float, width: float, height: float) -> DataFrame:
    b = unclip(box(), ratio, width, height)
    out = regions.withColumns({"_a": b.min_x, "_b": b.min_y, "_c": b.max_x, "_d": b.max_y}).filter("_c > _a and _d > _b")
    return out.withColumns({"min_x": F.col("_a"), "min_y": F.col("_b"), "max_x": F.col("_c"), "max_y": F.col("_d")}).drop("_a", "_b", "_c", "_d")


def drop_overlapping(regions: DataFrame, keys: list[str], order: str = "region_index") -> DataFrame:
    """Of two regions that overlap by over half of the smaller one, an image loses to another kind, else the smaller one.

    The fold over a page's pairs depends on their order, as one dropped early takes no part later; it stays in the JVM,
    and on rows that are together by page already nothing is shuffled.
    """
    row = F.struct(*[c for c in regions.columns if c not in keys]).alias("row")
    pages = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "min_x", "min_y", "max_x", "max_y", (F.col("label") == "image").alias("image"), row))).alias("all"))
    every, n = F.col("all"), F.size("all")
    after = lambda i: F.when(i + 1 < n, F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), after))

    def overlap(p: Column) -> Column:
        a, b = box_of(F.get(every, p["i"])), box_of(F.get(every, p["j"]))
        least = F.least(a.area, b.area)
        return (least > 0) & (intersection(a, b) / least > DUPLICATE_OVERLAP)

    def loser(p: Column) -> Column:
        a, b = F.get(every, p["i"]), F.get(every, p["j"])
        first = F.when(a["image"] != b["image"], a["image"]).otherwise(box_of(a).area <= box_of(b).area)
        return F.when(first, p["i"]).otherwise(p["j"])

    hits = pages.withColumn("hits", F.filter(pairs, overlap))  # few, so the fold is short
    gone = F.aggregate("hits", F.array().cast("array<int>"), lambda g, p: F.when(F.array_contains(g, p["i"]) | F.array_contains(g, p["j"]), g).otherwise(F.array_append(g, loser(p))))
    kept = hits.withColumn("gone", F.when(F.size("hits") > 0, gone)).select(*keys, F.explode(F.when(F.size("hits") > 0, F.filter(every, lambda r, i: ~F.array_contains(F.col("gone"), i))).otherwise(every)).alias("k"))
    return kept.select(*keys, "k.row.*").select(*regions.columns)


def fix_labels(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Footnotes above the lowest text are text; a page's only paragraph title is its document title if it is large and there is none."""
    page = Window.partitionBy(*keys)
    b = box()
    is_ = lambda x: F.col("label") == x
    bottom = F.coalesce(F.max(F.when(is_("text"), b.max_y)).over(page), F.lit(0.0))
    largest = F.greatest(F.lit(0.0), F.max(b.area).over(page))
    titles, documents = F.sum(is_("paragraph_title").cast("int")).over(page), F.sum(is_("doc_title").cast("int")).over(page)
    label = F.when(is_("footnote") & (b.max_y < bottom), "text").when(is_("paragraph_title") & (titles == 1) & (documents == 0) & (b.area > largest * TITLE_AREA), "doc_title").otherwise(F.col("label"))
    return regions.withColumn("label", label)


def decode_detections(rows: DataFrame, labels: list[str], width: float, height: float, least: float = 0.0) -> DataFrame:
    """Model rows `detection` = [class, score, x1, y1, x2, y2 (, order)] as regions, cut to the page; those outside go."""
    d = F.col("detection")
    at = lambda i: F.get(d, F.lit(i)).cast("double")
    name = F.coalesce(F.get(F.array(*map(F.lit, labels)), at(0).cast("int")), F.lit("other"))
    keep = [c for c in rows.columns if c != "detection"]
    out = rows.select(*keep, name.alias("label"), at(1).alias("score"), clamp(at(2), 0, width).alias("min_x"), clamp(at(3), 0, height).alias("min_y"), clamp(at(4), 0, width).alias("max_x"), clamp(at(5), 0, height).alias("max_y"), at(0).cast("int").alias("class_id"), at(6).cast("int").alias("order_index"))
    return out.filter((F.col("score") >= least) & (F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y")))


def post_process(regions: DataFrame, keys: list[str], width: float, height: float, region_id: str = "region_index", unclip_ratio: float | None = None) -> DataFrame:
    """All steps in their order; needs label, score and, for the model's order, order_index."""
    out = threshold(regions)
    out = suppress_by_score(out, keys, region_id)
    out = drop_oversized_images(out, keys, width, height)
    out = merge_contained(out, keys, region_id=region_id)
    out = out.withColumn("_o", -F.col("score"))
    page = Window.partitionBy(*keys)
    whole = F.count("order_index").over(page) == F.count(F.lit(1)).over(page)
    rank = F.row_number().over(page.orderBy(F.col("_o"), region_id))
    out = out.withColumn("position", rank.cast("long")).withColumn("position", F.when(whole, F.col("order_index").cast("long")).otherwise(F.col("position"))).drop("_o")
    if unclip_ratio:
        out = unclip_regions(out, unclip_ratio, width, height)
    return drop_overlapping(out, keys, "position")
