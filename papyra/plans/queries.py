"""One query for each operator over the derived views, with DuckDB SQL where that can say the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.export import formats, html, markdown, office, pdf
from papyra.functions import geometry as G
from papyra.functions import numbers as N
from papyra.functions import render
from papyra.functions import text as X
from papyra.operators import ctc, detection, documents, enhanced_order, evaluate, key_values, layout, patterns, pdf_text, quality, reading_order, spatial, structure, tables
from papyra.plans import views as V
from papyra.plans.registry import ORACLE_SQL, QUERIES, query
from papyra.sources import office as office_source
from papyra.streaming import incremental

DOC, PAGE = ["doc_id"], ["page_id"]
WIDTH, HEIGHT = 1024.0, 1100.0


def regions(spark, d):
    """The boxes with an id that is unique in its page."""
    w = Window.partitionBy("page_id").orderBy("box_index", "l_partkey", "l_suppkey", "max_x")
    return V.boxes(spark, d).withColumn("region_index", F.row_number().over(w).cast("long")).drop("l_partkey", "l_suppkey", "box_index")


REGIONS_SQL = V.BOXES_SQL + """, v_regions AS (
  SELECT page_id, label, score, min_x, min_y, max_x, max_y,
         row_number() OVER (PARTITION BY page_id ORDER BY box_index, l_partkey, l_suppkey, max_x) AS region_index FROM v_boxes
)"""


def page_lines(spark, d):
    w = Window.partitionBy("page_id").orderBy("line_index", "l_partkey", "min_x", "min_y")
    return V.page_lines(spark, d).withColumn("line_index", F.row_number().over(w).cast("long")).drop("l_partkey")


PAGE_LINES_SQL = REGIONS_SQL + """, v_page_lines0 AS (
  SELECT page_id, box_index AS li, l_partkey, 'line ' || l_partkey AS text,
         min_x + (l_suppkey % 7 * 6 - 12) AS min_x, min_y + (l_partkey % 5 * 4 - 8) AS min_y,
         min_x + (l_suppkey % 7 * 6 - 12) + 60 AS max_x, min_y + (l_partkey % 5 * 4 - 8) + 12 AS max_y FROM v_boxes
), v_page_lines AS (
  SELECT page_id, text, min_x, min_y, max_x, max_y, row_number() OVER (PARTITION BY page_id ORDER BY li, l_partkey, min_x, min_y) AS line_index FROM v_page_lines0
)"""

_COUNT = "length(regexp_replace(text, '\\s', '', 'g'))"
_QUALITY = f"""count(*) AS line_count, sum({_COUNT}) AS character_count, round(avg(confidence), 6) AS mean_confidence,
  round(sum(confidence * greatest(1, {_COUNT})) / sum(greatest(1, {_COUNT})), 6) AS weighted_confidence, min(confidence) AS min_confidence,
  CAST(sum(CASE WHEN confidence < 0.85 THEN 1 ELSE 0 END) AS BIGINT) AS low_count,
  round(sum(CASE WHEN confidence < 0.85 THEN 1 ELSE 0 END) / count(*), 6) AS low_ratio"""


def _round6(x):
    """A double to 6 digits as SQL has it: a million times x to the nearest whole number, halves away from zero. F.round goes by the decimal text."""
    y = F.abs(F.col(x) * 1e6)
    whole = F.floor(y).cast("double")
    rounded = F.signum(x) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / 1e6
    return F.when(y < 2.0**52, rounded).otherwise(F.col(x))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"""
WITH {V.LINES_SQL}, q AS (
  SELECT doc_id, count(*) AS line_count, CAST(sum(CASE WHEN confidence < 0.85 THEN 1 ELSE 0 END) AS BIGINT) AS low_count,
         round(sum(confidence * greatest(1, {_COUNT})) / sum(greatest(1, {_COUNT})), 6) AS weighted_confidence FROM v_lines GROUP BY doc_id
), c AS (
  SELECT doc_id, list_sum([CASE WHEN x[1] BETWEEN '2' AND '6' AND
      (list_sum(list_transform(generate_series(1, len(x)), lambda i: CASE WHEN (len(x) - i) % 2 = 0 THEN CAST(x[i] AS INTEGER)
        ELSE CASE WHEN CAST(x[i] AS INTEGER) * 2 > 9 THEN CAST(x[i] AS INTEGER) * 2 - 9 ELSE CAST(x[i] AS INTEGER) * 2 END END)) % 10 = 0) THEN 1 ELSE 0 END
      FOR x IN regexp_extract_all(replace(text, ' ', '  '), '(?:^|[^\\p{{L}}\\p{{Nd}}_-])([0-9]{{13,19}})(?:$|[^\\p{{L}}\\p{{Nd}}_])', 1)]) AS cards,
    len(regexp_extract_all(text, '[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z]{{2,24}}')) AS emails,
    len(regexp_extract_all(text, '\\+[0-9]{{1,3}}[ .-]?\\([0-9]{{1,4}}\\)[ .-]?[0-9]{{1,14}}(?:[ .-][0-9]{{1,5}}){{0,5}}')) AS phones
  FROM v_lines
)
SELECT q.*, CAST(e AS BIGINT) AS emails, CAST(p AS BIGINT) AS phones, CAST(k AS BIGINT) AS cards
FROM q JOIN (SELECT doc_id, sum(emails) e, sum(phones) p, sum(coalesce(cards, 0)) k FROM c GROUP BY doc_id) USING (doc_id)
""")
def flagship_review(spark, d):
    """Per document: lines to review, character-weighted confidence, e-mail addresses, phones and payment cards."""
    lines = V.lines(spark, d)
    q = quality.quality_summary(lines, DOC).select("doc_id", "line_count", "low_count", _round6("weighted_confidence").alias("weighted_confidence"))
    return q.join(patterns.count_kinds(lines), "doc_id")


@query(f"WITH {V.LINES_SQL} SELECT doc_id, {_QUALITY} FROM v_lines GROUP BY doc_id")
def quality_summary(spark, d):
    return _rounded(quality.quality_summary(V.lines(spark, d), DOC), "mean_confidence", "weighted_confidence", "low_ratio")


@query(f"WITH {V.LINES_SQL} SELECT doc_id, line_index, text, confidence FROM v_lines WHERE confidence < 0.85")
def lines_for_review(spark, d):
    return quality.lines_for_review(V.lines(spark, d)).select("doc_id", "line_index", "text", "confidence")


@query(f"WITH {V.LINES_SQL} SELECT doc_id, line_index, confidence FROM v_lines WHERE trim(text) <> '' AND confidence >= 0.5")
def drop_weak_lines(spark, d):
    return quality.drop_weak(V.lines(spark, d), 0.5).select("doc_id", "line_index", "confidence")


@query(f"""
WITH {V.CALIBRATION_SQL} SELECT split, CAST(least(9, floor(raw_confidence * 10)) AS INTEGER) AS bin, count(*) AS n,
  round(avg(raw_confidence), 6) AS mean_confidence, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM v_calib GROUP BY ALL""")
def reliability_bins(spark, d):
    s = V.calibration(spark, d).withColumnRenamed("raw_confidence", "confidence")
    return _rounded(quality.reliability(s, ["split"]), "mean_confidence", "accuracy")


@query(f"""
WITH {V.CALIBRATION_SQL}, b AS (SELECT split, least(9, floor(raw_confidence * 10)) AS bin, count(*) AS n, avg(raw_confidence) AS c, avg(CAST(correct AS DOUBLE)) AS a FROM v_calib GROUP BY ALL),
e AS (SELECT split, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b GROUP BY split)
SELECT split, ece, round(avg(power(raw_confidence - CAST(correct AS DOUBLE), 2)), 6) AS brier, count(*) AS n FROM v_calib JOIN e USING (split) GROUP BY split, ece""")
def calibration_errors(spark, d):
    s = V.calibration(spark, d).withColumnRenamed("raw_confidence", "confidence")
    return _rounded(quality.calibration_errors(s, ["split"]), "ece", "brier")


@query(f"""
WITH {V.CALIBRATION_SQL}, t AS (SELECT split, raw_confidence AS confidence, count(*) AS n, sum(CASE WHEN correct THEN 0 ELSE 1 END) AS wrong FROM v_calib GROUP BY ALL)
SELECT split, confidence, round(sum(n) OVER r / sum(n) OVER (PARTITION BY split), 6) AS coverage, round(sum(wrong) OVER r / sum(n) OVER r, 6) AS risk
FROM t WINDOW r AS (PARTITION BY split ORDER BY confidence DESC)""")
def risk_coverage(spark, d):
    s = V.calibration(spark, d).withColumnRenamed("raw_confidence", "confidence")
    return _rounded(quality.risk_coverage(s, ["split"]), "coverage", "risk")


@query(f"""
WITH {V.LINES_SQL}, r AS (SELECT doc_id AS page_id, line_index // 3 AS crop_id, ['latin','cyrillic','greek'][line_index % 3 + 1] AS pack, line_index % 3 AS pack_order, confidence FROM v_lines),
b AS (SELECT page_id, crop_id, arg_max({{'p': pack, 'o': pack_order, 'c': confidence}}, {{'c': confidence, 'o': -pack_order}}) AS b FROM r GROUP BY ALL),
s AS (SELECT page_id, b.p AS pack, sum(b.c) AS score, min(b.o) AS o FROM b GROUP BY ALL)
SELECT page_id, pack, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY round(score, 9) DESC, o) AS INTEGER) AS rank FROM s""")
def pack_vote(spark, d):
    i = F.col("line_index")
    r = V.lines(spark, d).select(F.col("doc_id").alias("page_id"), F.floor(i / 3).alias("crop_id"), F.element_at(F.array(F.lit("latin"), F.lit("cyrillic"), F.lit("greek")), (i % 3 + 1).cast("int")).alias("pack"), (i % 3).alias("pack_order"), "confidence")
    return _rounded(quality.pack_vote(r, PAGE), "score")


@query(f"""
WITH {V.LINES_SQL}, s AS (SELECT doc_id, line_index % 4 * 90 AS rotation, sum(confidence * length(text)) AS score FROM v_lines GROUP BY ALL)
SELECT doc_id, arg_max(rotation, {{'s': round(score, 6), 'r': -rotation}}) AS rotation, round(max(score), 6) AS score FROM s GROUP BY doc_id""")
def orientation_vote(spark, d):
    r = V.lines(spark, d).withColumn("rotation", F.col("line_index") % 4 * 90)
    return _rounded(quality.orientation_vote(r, DOC), "score")


@query(f"""
WITH {V.LINES_SQL}, w AS (SELECT doc_id, confidence, length(text) + 1 AS w FROM v_lines),
r AS (SELECT doc_id, confidence, sum(w) OVER (PARTITION BY doc_id ORDER BY confidence) AS so_far, sum(w) OVER (PARTITION BY doc_id) AS total FROM w)
SELECT doc_id, min(confidence) AS weighted_median FROM r WHERE so_far >= total / 2 GROUP BY doc_id""")
def weighted_median(spark, d):
    return quality.weighted_median(V.lines(spark, d).withColumn("w", F.length("text") + 1), DOC, "confidence", "w")


@query(f"""
WITH {REGIONS_SQL}, s AS (SELECT *, CASE label WHEN 'paragraph_title' THEN 0.3 WHEN 'text' THEN 0.4 WHEN 'formula' THEN 0.3 ELSE 0.5 END AS floor FROM v_regions)
SELECT page_id, region_index, label, round(score, 6) AS score FROM s WHERE score > floor""")
def layout_threshold(spark, d):
    return _rounded(layout.threshold(regions(spark, d)).select("page_id", "region_index", "label", "score"), "score")


def _iou(a, b, px):
    w = f"greatest(0, least({a}.max_x, {b}.max_x) - greatest({a}.min_x, {b}.min_x) + {px})"
    h = f"greatest(0, least({a}.max_y, {b}.max_y) - greatest({a}.min_y, {b}.min_y) + {px})"
    area = lambda k: f"({k}.max_x - {k}.min_x + {px}) * ({k}.max_y - {k}.min_y + {px})"
    return f"({w} * {h}) / ({area(a)} + {area(b)} - {w} * {h})"


def _greedy(order, clash):
    return f"""
WITH {REGIONS_SQL}, p AS (SELECT page_id, list({{'r': region_index, 'label': label, 'min_x': min_x, 'min_y': min_y, 'max_x': max_x, 'max_y': max_y}} ORDER BY {order}, region_index) AS l FROM v_regions GROUP BY page_id),
k AS (SELECT page_id, list_reduce(l[2:], lambda acc, x: CASE WHEN len(list_filter(acc.kept, lambda k: {clash})) > 0 THEN acc ELSE {{'kept': list_append(acc.kept, x)}} END, {{'kept': [l[1]]}}).kept AS kept FROM p)
SELECT page_id, x.r AS region_index FROM (SELECT page_id, unnest(kept) AS x FROM k)"""


@query(_greedy("score DESC", f"{_iou('k', 'x', 1)} >= CASE WHEN k.label = x.label THEN 0.6 ELSE 0.98 END"))
def layout_nms(spark, d):
    return layout.suppress_by_score(regions(spark, d), PAGE).select("page_id", "region_index")


@query(_greedy("(max_x - min_x) * (max_y - min_y) DESC", f"{_iou('k', 'x', 0)} > 0.1"))
def box_nms(spark, d):
    return layout.suppress_by_area(regions(spark, d), PAGE, 0.1).select("page_id", "region_index")


@query(f"""
WITH {REGIONS_SQL}, s AS (SELECT *, label <> 'image' OR (least(200, max_x) - greatest(0, min_x)) * (least(300, max_y) - greatest(0, min_y)) <= 0.93 * 60000 AS fits FROM v_regions),
w AS (SELECT *, bool_or(fits) OVER (PARTITION BY page_id) AS any_fits, count(*) OVER (PARTITION BY page_id) AS n FROM s)
SELECT page_id, region_index, label FROM w WHERE fits OR NOT any_fits OR n <= 1""")
def layout_oversized_images(spark, d):
    return layout.drop_oversized_images(regions(spark, d), PAGE, 200.0, 300.0).select("page_id", "region_index", "label")


_PAIRS = """p AS (SELECT i.page_id, i.region_index AS i, o.region_index AS o, i.label AS il, o.label AS ol FROM v_regions i JOIN v_regions o ON i.page_id = o.page_id AND i.region_index <> o.region_index
  WHERE greatest(0, least(i.max_x, o.max_x) - greatest(i.min_x, o.min_x)) * greatest(0, least(i.max_y, o.max_y) - greatest(i.min_y, o.min_y)) / ((i.max_x - i.min_x) * (i.max_y - i.min_y)) >= 0.9
    AND NOT (i.label = 'formula' AND o.label <> 'formula'))"""


@query(f"""WITH {REGIONS_SQL}, {_PAIRS}
SELECT page_id, region_index FROM v_regions r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page_id = r.page_id AND p.i = r.region_index AND ol IN ('paragraph_title', 'image', 'formula'))""")
def layout_merge_by_class(spark, d):
    return layout.merge_contained(regions(spark, d), PAGE).select("page_id", "region_index")


@query(f"""WITH {REGIONS_SQL}, {_PAIRS}
SELECT page_id, region_index FROM v_regions r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page_id = r.page_id AND p.o = r.region_index) OR EXISTS (SELECT 1 FROM p WHERE p.page_id = r.page_id AND p.i = r.region_index)""")
def layout_merge_small(spark, d):
    return layout.merge_contained(regions(spark, d), PAGE, "small").select("page_id", "region_index")


@query(f"""
WITH {REGIONS_SQL}, s AS (SELECT *, (max_x - min_x) * (max_y - min_y) AS area FROM v_regions),
w AS (SELECT *, max(area) OVER p AS largest, sum(CASE WHEN label = 'paragraph_title' THEN 1 ELSE 0 END) OVER p AS titles FROM s WINDOW p AS (PARTITION BY page_id))
SELECT page_id, region_index, CASE WHEN label = 'paragraph_title' AND titles = 1 AND area > 0.3 * largest THEN 'doc_title' ELSE label END AS label FROM w""")
def layout_label_fixes(spark, d):
    return layout.fix_labels(regions(spark, d), PAGE).select("page_id", "region_index", "label")


@query(f"""
WITH {REGIONS_SQL}, u AS (SELECT page_id, region_index,
  greatest(0, least(1024, (min_x + max_x) / 2 - (max_x - min_x) * 0.6)) AS min_x, greatest(0, least(1100, (min_y + max_y) / 2 - (max_y - min_y) * 0.6)) AS min_y,
  greatest(0, least(1024, (min_x + max_x) / 2 + (max_x - min_x) * 0.6)) AS max_x, greatest(0, least(1100, (min_y + max_y) / 2 + (max_y - min_y) * 0.6)) AS max_y FROM v_regions)
SELECT page_id, region_index, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(max_x, 6) AS max_x, round(max_y, 6) AS max_y FROM u WHERE max_x > min_x AND max_y > min_y""")
def layout_unclip(spark, d):
    return _rounded(layout.unclip_regions(regions(spark, d), 1.2, WIDTH, HEIGHT).select("page_id", "region_index", "min_x", "min_y", "max_x", "max_y"), "min_x", "min_y", "max_x", "max_y")


def _sweep(source, order, more=""):
    """SQL that goes through a page's pairs in order; of two that overlap by over half of the smaller one, one is gone for the pairs that follow."""
    area = lambda k: f"((l[x.{k}].max_x - l[x.{k}].min_x) * (l[x.{k}].max_y - l[x.{k}].min_y))"
    both = "greatest(0, least(l[x.i].max_x, l[x.j].max_x) - greatest(l[x.i].min_x, l[x.j].min_x)) * greatest(0, least(l[x.i].max_y, l[x.j].max_y) - greatest(l[x.i].min_y, l[x.j].min_y))"
    return f"""sw_p AS (SELECT page_id, list({{'r': region_index, 'label': label, 'min_x': min_x, 'min_y': min_y, 'max_x': max_x, 'max_y': max_y{more}}} ORDER BY {order}) AS l FROM {source} GROUP BY page_id),
sw_q AS (SELECT page_id, l, flatten(list_transform(generate_series(1, len(l)), lambda i: list_transform(generate_series(i + 1, len(l)), lambda j: {{'i': i, 'j': j}}))) AS pairs FROM sw_p),
sw_g AS (SELECT page_id, l, list_reduce(pairs, lambda a, x: CASE WHEN list_contains(a.g, x.i) OR list_contains(a.g, x.j) OR least({area('i')}, {area('j')}) <= 0 OR {both} / least({area('i')}, {area('j')}) <= 0.5 THEN a
  ELSE {{'g': list_append(a.g, CASE WHEN (l[x.i].label = 'image') <> (l[x.j].label = 'image') THEN CASE WHEN l[x.i].label = 'image' THEN x.i ELSE x.j END WHEN {area('i')} <= {area('j')} THEN x.i ELSE x.j END)}} END, {{'g': CAST([] AS BIGINT[])}}).g AS g FROM sw_q),
swept AS (SELECT page_id, u.x AS r FROM (SELECT page_id, unnest(list_transform(list_filter(generate_series(1, len(l)), lambda i: NOT list_contains(g, i)), lambda i: {{'x': l[i]}})) AS u FROM sw_g))"""


@query(f"WITH {REGIONS_SQL}, {_sweep('v_regions', 'region_index')} SELECT page_id, r.r AS region_index FROM swept")
def layout_overlap_filter(spark, d):
    return layout.drop_overlapping(regions(spark, d), PAGE).select("page_id", "region_index")


@query(f"""
WITH {REGIONS_SQL}, f AS (SELECT * FROM v_regions WHERE score > CASE label WHEN 'paragraph_title' THEN 0.3 WHEN 'text' THEN 0.4 WHEN 'formula' THEN 0.3 ELSE 0.5 END),
n_p AS (SELECT page_id, list({{'r': region_index, 'label': label, 'score': score, 'min_x': min_x, 'min_y': min_y, 'max_x': max_x, 'max_y': max_y}} ORDER BY score DESC, region_index) AS l FROM f GROUP BY page_id),
n_k AS (SELECT page_id, list_reduce(l[2:], lambda acc, x: CASE WHEN len(list_filter(acc.kept, lambda k: {_iou('k', 'x', 1)} >= CASE WHEN k.label = x.label THEN 0.6 ELSE 0.98 END)) > 0 THEN acc ELSE {{'kept': list_append(acc.kept, x)}} END, {{'kept': [l[1]]}}).kept AS kept FROM n_p),
n AS (SELECT page_id, u.r AS region_index, u.label, u.score, u.min_x, u.min_y, u.max_x, u.max_y FROM (SELECT page_id, unnest(kept) AS u FROM n_k)),
b AS (SELECT *, label <> 'image' OR (least(1024, max_x) - greatest(0, min_x)) * (least(1100, max_y) - greatest(0, min_y)) <= 0.93 * 1024 * 1100 AS fits FROM n),
o AS (SELECT * FROM (SELECT *, bool_or(fits) OVER (PARTITION BY page_id) AS any_fits, count(*) OVER (PARTITION BY page_id) AS m FROM b) WHERE fits OR NOT any_fits OR m <= 1),
{_PAIRS.replace('v_regions', 'o')},
c AS (SELECT page_id, region_index, label, score, min_x, min_y, max_x, max_y, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, region_index) AS position FROM o r
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page_id = r.page_id AND p.i = r.region_index AND ol IN ('paragraph_title', 'image', 'formula'))),
{_sweep('c', 'position', ", 'position': position")}
SELECT page_id, r.r AS region_index, r.label, r.position FROM swept""")
def layout_post_process(spark, d):
    r = regions(spark, d).withColumn("order_index", F.lit(None).cast("int"))
    return layout.post_process(r, PAGE, WIDTH, HEIGHT).select("page_id", "region_index", "label", "position")


@query("""
WITH e AS (SELECT vec_id AS page_id, CAST(label AS INTEGER) AS class_id, list_transform(embedding[1:5], lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings)
SELECT page_id, coalesce(['text', 'title', 'table'][class_id + 1], 'other') AS label, round(abs(v[1]), 6) AS score, class_id,
       round(greatest(0, least(100, 500 * v[2])), 3) AS min_x, round(greatest(0, least(100, 500 * v[2] + 1000 * abs(v[3]))), 3) AS max_x
FROM e WHERE abs(v[1]) >= 0.05 AND greatest(0, least(100, 500 * v[2] + 1000 * abs(v[3]))) > greatest(0, least(100, 500 * v[2])) AND abs(v[4]) * 1000 > 0""")
def detection_rows(spark, d):
    e = V.read(spark, d, "embeddings")
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = e.select(F.col("vec_id").alias("page_id"), F.array(F.col("label").cast("double"), F.abs(v(0)), 500 * v(1), F.lit(0.0), 500 * v(1) + 1000 * F.abs(v(2)), 1000 * F.abs(v(3))).alias("detection"))
    out = layout.decode_detections(rows, ["text", "title", "table"], 100, 1e9, 0.05)
    return out.select("page_id", "label", F.round("score", 6).alias("score"), "class_id", F.round("min_x", 3).alias("min_x"), F.round("max_x", 3).alias("max_x"))


_LB = """lb AS (SELECT l.page_id, l.line_index, b.region_index, greatest(0, least(l.max_x, b.max_x) - greatest(l.min_x, b.min_x)) AS w, greatest(0, least(l.max_y, b.max_y) - greatest(l.min_y, b.min_y)) AS h
  FROM v_page_lines l JOIN v_regions b USING (page_id))"""


@query(f"""
WITH {PAGE_LINES_SQL}, {_LB},
m AS (SELECT page_id, line_index, max(w * h / 720.0) AS ratio, arg_max(region_index, {{'r': w * h / 720.0, 'i': -region_index}}) AS block, sum(CASE WHEN w > 3 AND h > 3 THEN 1 ELSE 0 END) AS over FROM lb GROUP BY ALL),
s AS (SELECT *, CASE WHEN ratio >= 0.9 THEN 'strong' WHEN over >= 2 THEN 'hurdle' WHEN ratio >= 0.6 THEN 'match' ELSE 'orphan' END AS status FROM m)
SELECT page_id, line_index, CASE WHEN status IN ('strong', 'match') THEN block END AS region_index, round(ratio, 6) AS ratio, status FROM s""")
def match_lines_to_blocks(spark, d):
    return _rounded(spatial.match_lines_to_blocks(page_lines(spark, d), regions(spark, d), PAGE, block_id="region_index"), "ratio")


@query(f"""
WITH {PAGE_LINES_SQL}, {_LB},
m AS (SELECT page_id, line_index, max(w * h / 720.0) AS ratio, sum(CASE WHEN w > 3 AND h > 3 THEN 1 ELSE 0 END) AS over FROM lb GROUP BY ALL)
SELECT lb.page_id, lb.line_index, lb.region_index, w, h FROM lb JOIN m USING (page_id, line_index) WHERE ratio < 0.9 AND over >= 2 AND w > 3 AND h > 3""")
def hurdle_fragments(spark, d):
    f = spatial.hurdle_fragments(page_lines(spark, d), regions(spark, d), PAGE, block_id="region_index")
    return f.select("page_id", "line_index", "region_index", G.box().width.alias("w"), G.box().height.alias("h"))


@query(f"""
WITH {REGIONS_SQL}, f AS (SELECT * FROM v_regions WHERE label = 'formula'), b AS (SELECT * FROM v_regions WHERE label <> 'formula'),
x AS (SELECT f.page_id, f.region_index AS fi, b.region_index AS bi, b.label = 'table' AS t, greatest(0, least(f.max_x, b.max_x) - greatest(f.min_x, b.min_x)) * greatest(0, least(f.max_y, b.max_y) - greatest(f.min_y, b.min_y)) / ((f.max_x - f.min_x) * (f.max_y - f.min_y)) AS r FROM f JOIN b USING (page_id)),
m AS (SELECT page_id, fi, max(r) FILTER (t) AS tr, arg_max(bi, {{'r': r, 'i': -bi}}) FILTER (t) AS tb, max(r) FILTER (NOT t) AS xr, arg_max(bi, {{'r': r, 'i': -bi}}) FILTER (NOT t) AS xb FROM x WHERE r > 0 GROUP BY ALL)
SELECT f.page_id, f.region_index AS formula_index, CASE WHEN tr >= 0.5 THEN tb WHEN xr >= 0.5 THEN xb END AS region_index, CASE WHEN tr >= 0.5 THEN 'table' WHEN xr >= 0.5 THEN 'text' ELSE 'alone' END AS target
FROM f LEFT JOIN m ON f.page_id = m.page_id AND f.region_index = m.fi""")
def attach_formulas(spark, d):
    r = regions(spark, d)
    b = r.filter("label <> 'formula'").withColumn("type", layout.block_type(F.col("label")))
    return spatial.attach_formulas(r.filter("label = 'formula'").withColumnRenamed("region_index", "formula_index"), b, PAGE, block_id="region_index")


@query(f"""
WITH {PAGE_LINES_SQL}, c AS (SELECT l.page_id, l.line_index, b.region_index, 1 - {_iou('l', 'b', 0)} AS a,
  abs(l.min_x - b.min_x) + abs(l.min_y - b.min_y) + abs(l.max_x - b.max_x) + abs(l.max_y - b.max_y) + least(abs(l.min_x - b.min_x) + abs(l.min_y - b.min_y), abs(l.max_x - b.max_x) + abs(l.max_y - b.max_y)) AS dist
  FROM v_page_lines l JOIN v_regions b USING (page_id))
SELECT page_id, line_index, arg_min(region_index, {{'a': a, 'd': dist, 'i': region_index}}) AS cell_index FROM c GROUP BY ALL""")
def match_lines_to_cells(spark, d):
    cells = regions(spark, d).withColumnRenamed("region_index", "cell_index").drop("label", "score")
    return spatial.match_lines_to_cells(page_lines(spark, d), cells, PAGE)


@query(f"""
WITH {REGIONS_SQL}, p AS (SELECT i.page_id, i.region_index, o.region_index AS oi, (o.max_x - o.min_x) * (o.max_y - o.min_y) AS area FROM v_regions i JOIN v_regions o ON i.page_id = o.page_id AND i.region_index <> o.region_index
  WHERE i.min_x >= o.min_x AND i.min_y >= o.min_y AND i.max_x <= o.max_x AND i.max_y <= o.max_y AND (o.max_x - o.min_x) * (o.max_y - o.min_y) > (i.max_x - i.min_x) * (i.max_y - i.min_y))
SELECT page_id, region_index, arg_min(oi, {{'a': area, 'i': oi}}) AS container FROM p GROUP BY ALL""")
def smallest_containers(spark, d):
    return spatial.smallest_containers(regions(spark, d), PAGE, "region_index")


def _same_region(a, b):
    both = f"greatest(0, least({a}.max_x, {b}.max_x) - greatest({a}.min_x, {b}.min_x)) * greatest(0, least({a}.max_y, {b}.max_y) - greatest({a}.min_y, {b}.min_y))"
    area = lambda k: f"({k}.max_x - {k}.min_x) * ({k}.max_y - {k}.min_y)"
    return f"({both} / least({area(a)}, {area(b)}) >= 0.7 AND {both} / greatest({area(a)}, {area(b)}) >= 0.5)"


def _covers(a, b):
    return _same_region(a, b).replace(">= 0.7", "> 0.5")


@query(f"""
WITH {PAGE_LINES_SQL}, f AS (SELECT * FROM v_regions r WHERE NOT EXISTS (SELECT 1 FROM v_page_lines l WHERE l.page_id = r.page_id AND {_covers('r', 'l')})),
p AS (SELECT page_id, list({{'r': region_index, 'min_x': min_x, 'min_y': min_y, 'max_x': max_x, 'max_y': max_y}} ORDER BY region_index) AS l FROM f GROUP BY page_id),
k AS (SELECT page_id, list_reduce(l[2:], lambda acc, x: CASE WHEN len(list_filter(acc.kept, lambda k: {_same_region('k', 'x')})) > 0 THEN acc ELSE {{'kept': list_append(acc.kept, x)}} END, {{'kept': [l[1]]}}).kept AS kept FROM p)
SELECT page_id, x.r AS region_index FROM (SELECT page_id, unnest(kept) AS x FROM k)""")
def missing_regions(spark, d):
    return spatial.missing_regions(regions(spark, d), page_lines(spark, d), PAGE).select("page_id", "region_index")


@query(f"""
WITH {PAGE_LINES_SQL}, c AS (SELECT r.page_id, r.region_index, greatest(r.min_x, n.min_x) AS x0, least(r.max_x, n.max_x) AS x1, greatest(r.min_y, n.min_y) AS y0, least(r.max_y, n.max_y) AS y1, (n.max_x - n.min_x) * (n.max_y - n.min_y) AS na FROM v_regions r JOIN v_page_lines n USING (page_id)),
k AS (SELECT * FROM c WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) / na >= 0.5),
e AS (SELECT DISTINCT page_id, region_index, unnest([x0, x1]) AS a FROM k), sl AS (SELECT *, lead(a) OVER (PARTITION BY page_id, region_index ORDER BY a) AS b FROM e),
sp AS (SELECT k.page_id, k.region_index, a, b, y0, y1, max(y1) OVER (PARTITION BY k.page_id, k.region_index, a ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k JOIN sl ON k.page_id = sl.page_id AND k.region_index = sl.region_index AND x0 <= a AND x1 >= b WHERE b IS NOT NULL),
u AS (SELECT page_id, region_index, sum((b - a) * greatest(0, y1 - greatest(y0, coalesce(before, y0)))) AS area FROM sp GROUP BY ALL)
SELECT r.page_id, r.region_index, round(coalesce(area / ((max_x - min_x) * (max_y - min_y)), 0), 6) AS covered FROM v_regions r LEFT JOIN u ON r.page_id = u.page_id AND r.region_index = u.region_index
WHERE coalesce(area / ((max_x - min_x) * (max_y - min_y)), 0) < 0.95""")
def uncovered_regions(spark, d):
    return _rounded(spatial.uncovered_regions(regions(spark, d), page_lines(spark, d), PAGE).select("page_id", "region_index", "covered"), "covered")


@query(f"""
WITH {PAGE_LINES_SQL}, l AS (SELECT *, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy FROM v_page_lines), z AS (SELECT * FROM (VALUES (0, 'left', 0, 400), (1, 'right', 400, 2000)) t(zone_ordinal, zone_name, a, b)),
p AS (SELECT DISTINCT page_id FROM l)
SELECT p.page_id, z.zone_ordinal, z.zone_name, coalesce(string_agg(l.text, chr(10) ORDER BY l.line_index), '') AS text, count(l.text) AS line_count
FROM p CROSS JOIN z LEFT JOIN l ON l.page_id = p.page_id AND cx BETWEEN a AND b AND cy BETWEEN 0 AND 2000 GROUP BY ALL""")
def zones(spark, d):
    z = spark.createDataFrame([(0, "left", 0.0, 0.0, 400.0, 2000.0), (1, "right", 400.0, 0.0, 2000.0, 2000.0)], "zone_ordinal int, zone_name string, min_x double, min_y double, max_x double, max_y double")
    return spatial.lines_in_zones(page_lines(spark, d).withColumn("confidence", F.lit(1.0)), z, PAGE)


@query(f"""
WITH {REGIONS_SQL}, g AS (SELECT *, max(max_x) OVER (PARTITION BY page_id ORDER BY min_x, region_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v_regions),
h AS (SELECT page_id, greatest(20, 1.5 * median(max_y - min_y)) AS gutter FROM v_regions GROUP BY page_id)
SELECT page_id, region_index, CAST(sum(CASE WHEN min_x - before > gutter THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY min_x, region_index) AS INTEGER) AS "column" FROM g JOIN h USING (page_id)""")
def page_columns(spark, d):
    return reading_order.columns_of_page(regions(spark, d), PAGE, "region_index").select("page_id", "region_index", "column")


@query(f"""
WITH {REGIONS_SQL}, g AS (SELECT *, max(max_y) OVER (PARTITION BY page_id ORDER BY min_y, region_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v_regions)
SELECT page_id, region_index, CAST(sum(CASE WHEN min_y - before > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY min_y, region_index) AS INTEGER) AS band FROM g""")
def page_bands(spark, d):
    return reading_order.bands(regions(spark, d), PAGE, "y", "region_index").select("page_id", "region_index", "band")


@query()
def sorted_boxes(spark, d):
    return reading_order.sorted_boxes(regions(spark, d), PAGE, "region_index").select("page_id", "region_index", "position")


@query()
def xy_cut(spark, d):
    return reading_order.xy_cut(regions(spark, d), PAGE, "region_index").select("page_id", "region_index", "position")


@query(f"""
WITH {PAGE_LINES_SQL}, p AS (SELECT page_id, list({{'i': line_index, 'a': min_y, 'b': max_y}} ORDER BY min_y, min_x, line_index) AS l FROM v_page_lines GROUP BY page_id),
k AS (SELECT page_id, list_reduce(l[2:], lambda s, x: CASE WHEN (least(s.b, x.b) - greatest(s.a, x.a)) / least(s.b - s.a, x.b - x.a) >= 0.5
  THEN {{'a': least(s.a, x.a), 'b': greatest(s.b, x.b), 'k': s.k, 'o': list_append(s.o, {{'i': x.i, 'k': s.k}})}} ELSE {{'a': x.a, 'b': x.b, 'k': s.k + 1, 'o': list_append(s.o, {{'i': x.i, 'k': s.k + 1}})}} END,
  {{'a': l[1].a, 'b': l[1].b, 'k': 0, 'o': [{{'i': l[1].i, 'k': 0}}]}}).o AS o FROM p)
SELECT page_id, u.i AS line_index, CAST(u.k AS INTEGER) AS row FROM (SELECT page_id, unnest(o) AS u FROM k)""")
def line_groups(spark, d):
    return reading_order.line_groups(page_lines(spark, d), PAGE).select("page_id", "line_index", "row")


@query()
def paragraphs(spark, d):
    return reading_order.paragraphs(V.lines(spark, d), DOC).select("doc_id", "line_index", "paragraph")


@query(f"""
WITH {V.BLOCKS_SQL} SELECT doc_id, page_number, block_index AS from_block, nxt AS to_block FROM (SELECT *, lead(block_index) OVER (PARTITION BY doc_id, page_number ORDER BY block_order, block_index) AS nxt FROM v_blocks) WHERE nxt IS NOT NULL""")
def sequence_links(spark, d):
    return reading_order.sequence_edges(V.blocks(spark, d), documents.PAGE)


@query(f"""
WITH {V.BLOCKS_SQL}, h AS (SELECT * FROM v_blocks WHERE type = 'Header' AND max_y <= 150 AND trim(text) <> '')
SELECT a.doc_id, a.page_number AS from_page, a.block_index AS from_block, b.page_number AS to_page, b.block_index AS to_block FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.page_number < b.page_number AND a.text = b.text""")
def repeated_headers(spark, d):
    return documents.repeated_headers(V.blocks(spark, d))


@query(f"""
WITH {V.BLOCKS_SQL}, s AS (SELECT *, lead(block_index) OVER (PARTITION BY doc_id, page_number ORDER BY block_order, block_index) AS nxt FROM v_blocks),
h AS (SELECT * FROM v_blocks WHERE type = 'Header' AND max_y <= 150 AND trim(text) <> ''),
p AS (SELECT i.doc_id, i.page_number, i.block_index, arg_min(o.block_index, {{'a': (o.max_x - o.min_x) * (o.max_y - o.min_y), 'i': o.block_index}}) AS c FROM v_blocks i JOIN v_blocks o ON i.doc_id = o.doc_id AND i.page_number = o.page_number AND i.block_index <> o.block_index
  WHERE i.min_x >= o.min_x AND i.min_y >= o.min_y AND i.max_x <= o.max_x AND i.max_y <= o.max_y AND (o.max_x - o.min_x) * (o.max_y - o.min_y) > (i.max_x - i.min_x) * (i.max_y - i.min_y) GROUP BY ALL)
SELECT doc_id, 'Sequence' AS kind, page_number AS from_page, block_index AS from_block, page_number AS to_page, nxt AS to_block, 'Existing page reading order' AS evidence, false AS requires_review FROM s WHERE nxt IS NOT NULL
UNION ALL SELECT doc_id, 'Contains', page_number, c, page_number, block_index, 'Strict bounding-box containment; semantic ownership unconfirmed', true FROM p
UNION ALL SELECT a.doc_id, 'RepeatedHeader', a.page_number, a.block_index, b.page_number, b.block_index, 'Header labels, identical normalized text, top 15%, horizontal edges within 3% of page width', true
  FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.page_number < b.page_number AND a.text = b.text""")
def assemble_documents(spark, d):
    return documents.assemble(V.blocks(spark, d))


@query(f"""
WITH {V.BLOCKS_SQL}, t AS (SELECT doc_id, page_number, block_index, text FROM v_blocks WHERE type = 'Table')
SELECT a.doc_id, a.page_number AS rule_ordinal, 'r' || a.page_number AS id, 'ExactText' AS kind,
       CASE WHEN b.text IS NULL THEN 'missing-reading' WHEN trim(a.text) = '' OR trim(b.text) = '' THEN 'blank-reading' WHEN a.text = b.text THEN 'agreement' ELSE 'contradiction' END AS status
FROM t a LEFT JOIN v_blocks b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND b.block_index = 1""")
def verify_rules(spark, d):
    b = V.blocks(spark, d)
    ref = lambda i: F.struct(F.col("page_number"), F.lit(i).alias("block_index"))
    rules = b.filter("type = 'Table'").select("doc_id", F.col("page_number").alias("rule_ordinal"), F.concat(F.lit("r"), "page_number").alias("id"), F.lit("ExactText").alias("kind"), F.array(ref(3)).alias("inputs"), ref(1).alias("expected"), F.lit(0).cast("decimal(38,18)").alias("tolerance"))
    return documents.check_rules(rules, b)


_CTC = ", ".join(f"p[{8 * s + 1}:{8 * s + 8}]" for s in range(8))


@query(f"""
WITH e AS (SELECT vec_id AS crop_id, list_transform(embedding, lambda v: (CAST(v AS DOUBLE) + 1) / 2) AS p FROM embeddings),
s AS (SELECT crop_id, unnest([{_CTC}]) AS q, unnest(generate_series(0, 7)) AS i FROM e),
k AS (SELECT crop_id, i, list_position(q, list_max(q)) - 1 AS k, list_max(q) AS m FROM s),
w AS (SELECT *, lag(k, 1, -1) OVER (PARTITION BY crop_id ORDER BY i) AS before FROM k)
SELECT crop_id, coalesce(string_agg(['', 'a', 'b', 'c', 'd', 'e', 'f', 'g'][k + 1], '' ORDER BY i) FILTER (k > 0 AND k <> before), '') AS text, round(coalesce(avg(m) FILTER (k > 0 AND k <> before), 0), 6) AS confidence FROM w GROUP BY crop_id""")
def ctc_decode(spark, d):
    return _rounded(ctc.greedy_decode(V.probs(spark, d), list(V.VOCABULARY)).select("crop_id", "text", "confidence"), "confidence")


@query()
def ctc_words(spark, d):
    out = ctc.greedy_decode(V.probs(spark, d), ["", "a", "b", " ", "d", "日", "f", "g"], space_threshold=0.55)
    return out.select("crop_id", F.explode(ctc.words_of_characters(F.col("characters"))).alias("w")).select("crop_id", "w.*")


def _edits(a, b):
    """SQL for the edit distance of two lists: each different item is one of the 127 ASCII characters, as levenshtein counts bytes. More raise an error."""
    names = f"list_distinct(list_concat({a}, {b}))"
    coded = lambda x: f"array_to_string(list_transform({x}, lambda t: chr(CAST(list_position({names}, t) AS INTEGER))), '')"
    shared = f"list_filter({names}, lambda t: list_contains({a}, t) AND list_contains({b}, t))"
    # items of one side alone match nothing: two characters stand for them all
    slim = lambda x, alone: f"array_to_string(list_transform({x}, lambda t: chr(CAST(coalesce(list_position({shared}, t) + 2, {alone}) AS INTEGER))), '')"
    return f"CASE WHEN len({names}) <= 127 THEN levenshtein({coded(a)}, {coded(b)}) WHEN len({shared}) <= 125 THEN levenshtein({slim(a, 1)}, {slim(b, 2)}) ELSE error('too many different items') END"


_CLEAN = lambda t: f"list_transform(string_split({t}, chr(10)), lambda s: trim(regexp_replace(s, '[\\s\\p{{Z}}]+', ' ', 'g')))"
_SCORED = f"""{V.PAIRS_SQL}, n AS (SELECT id, {_CLEAN('reference')} AS rl, {_CLEAN('prediction')} AS pl FROM v_pairs),
t AS (SELECT id, list_filter(rl, lambda x: x <> '') AS rl, list_filter(pl, lambda x: x <> '') AS pl, array_to_string(rl, chr(10)) AS r, array_to_string(pl, chr(10)) AS p FROM n),
w AS (SELECT id, rl, pl, r, p, string_split(r, '') AS rc, string_split(p, '') AS pc, list_filter(string_split_regex(r, '\\s+'), lambda x: x <> '') AS rw, list_filter(string_split_regex(p, '\\s+'), lambda x: x <> '') AS pw FROM t),
scores AS (SELECT id, {_edits('rc', 'pc')} AS char_edits, length(r) AS char_count, {_edits('rw', 'pw')} AS word_edits, len(rw) AS word_count, {_edits('rl', 'pl')} AS line_edits, len(rl) AS line_count, r = p AS exact FROM w)"""


@query(f"WITH {_SCORED} SELECT id, char_edits, char_count, round(char_edits / char_count, 6) AS cer FROM scores")
def transcription_scores(spark, d):
    return _rounded(evaluate.score_pairs(V.pairs(spark, d)).select("id", F.col("char_edits").cast("long").alias("char_edits"), F.col("char_count").cast("long").alias("char_count"), "cer"), "cer")


@query(f"WITH {_SCORED} SELECT id, word_edits, word_count, line_edits, line_count, round(word_edits / word_count, 6) AS wer, exact FROM scores")
def transcription_words(spark, d):
    s = evaluate.score_pairs(V.pairs(spark, d)).select("id", *[F.col(c).cast("long").alias(c) for c in ("word_edits", "word_count", "line_edits", "line_count")], "wer", "exact")
    return _rounded(s, "wer")


@query(f"""
WITH {_SCORED}, s AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'scan' ELSE 'photo' END AS source_kind FROM scores)
SELECT 'source_kind' AS slice, source_kind AS value, count(DISTINCT id // 2) AS documents, count(*) AS items, round(sum(char_edits) / sum(char_count), 6) AS cer, round(sum(word_edits) / sum(word_count), 6) AS wer FROM s GROUP BY source_kind""")
def transcription_slices(spark, d):
    s = evaluate.score_pairs(V.pairs(spark, d)).withColumns({"source_kind": F.when(F.col("id") % 2 == 0, "scan").otherwise("photo"), "document_id": F.floor(F.col("id") / 2)})
    return _rounded(evaluate.slices(s, ["source_kind"]), "cer", "wer")


@query(f"""
WITH RECURSIVE {V.PAIRS_SQL}, l AS (SELECT id, string_split(reference, chr(10)) AS a, string_split(prediction, chr(10)) AS b FROM v_pairs),
r AS (SELECT id, a, b, 0 AS i, list_transform(b, lambda y: 0) AS row FROM l
  UNION ALL SELECT id, a, b, i + 1, list_transform(generate_series(1, len(b)), lambda j: list_max(list_transform(generate_series(1, j), lambda k: greatest(row[k], CASE WHEN b[k] = a[i + 1] THEN 1 + CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END ELSE 0 END)))) FROM r WHERE i < len(a))
SELECT id, CAST(list_max(row) AS INTEGER) AS lcs FROM r WHERE i = len(a)""")
def exact_line_lcs(spark, d):
    return evaluate.exact_line_lcs(V.pairs(spark, d))


_BOUNDED = lambda t: f"len(regexp_extract_all(regexp_replace({t}, '([^\\p{{L}}\\p{{M}}\\p{{N}}])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}])the(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}])'))"
_RETRIES = f"""{V.PAIRS_SQL}, c AS (SELECT *, string_split(reference, '') AS rc, string_split(prediction, '') AS pc FROM v_pairs),
retries AS (SELECT id, {_edits('rc', 'pc')} AS edits_before, 0 AS edits_after, CASE WHEN prediction = reference THEN 'unchanged' ELSE 'improved' END AS outcome,
  least({_BOUNDED('prediction')}, {_BOUNDED('reference')}) AS tokens_before, {_BOUNDED('reference')} AS tokens_after FROM c)"""


def _retries(spark, d):
    p = V.pairs(spark, d).select("id", "reference", F.col("prediction").alias("before"), F.col("reference").alias("after"), F.array(F.lit("the")).alias("critical_tokens"))
    return evaluate.retry_outcomes(p)


@query(f"WITH {_RETRIES} SELECT * FROM retries")
def retry_outcomes(spark, d):
    return _retries(spark, d).select("id", "edits_before", "edits_after", "outcome", "tokens_before", "tokens_after")


@query(f"""
WITH {_RETRIES} SELECT count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'improved') AS improved, 0 AS worsened, 0 AS neutral,
  CAST(sum(edits_before) AS BIGINT) AS edits_before, 0 AS edits_after, CAST(sum(tokens_before) AS BIGINT) AS tokens_before, CAST(sum(tokens_after) AS BIGINT) AS tokens_after FROM retries""")
def retry_summary(spark, d):
    return evaluate.retry_summary(_retries(spark, d))


@query(f"""
WITH {V.CALIBRATION_SQL}, m AS (SELECT document_id AS id, split FROM v_calib), p AS (SELECT document_id + 5 AS id FROM v_calib)
SELECT 'missing' AS problem, CAST(id AS VARCHAR) AS key FROM m WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT 'extra', CAST(id AS VARCHAR) FROM p WHERE id NOT IN (SELECT id FROM m)""")
def manifest_problems(spark, d):
    c = V.calibration(spark, d)
    return evaluate.check_manifest(c.select(F.col("document_id").alias("id"), "document_id", "split"), c.select((F.col("document_id") + 5).alias("id")))


@query()
def paired_bootstrap(spark, d):
    s = evaluate.score_pairs(V.pairs(spark, d)).select(F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("subgroup"), F.col("id").alias("document_id"), F.col("cer").alias("baseline_error"), (F.col("cer") * 0.9).alias("candidate_error"))
    return evaluate.paired_bootstrap(s)


_LETTERS = {"Latin": "a", "Cyrillic": "ж", "Greek": "λ", "Arabic": "ب", "Devanagari": "अ", "Thai": "ก", "Hangul": "한", "Kana": "か", "Han": "日", "Tamil": "அ", "Telugu": "అ"}
_SCRIPT_COUNTS = ", ".join(f"{{'n': len(regexp_extract_all(t, '[{r}]')), 'o': {-i}, 's': '{name}'}}" for i, (name, r) in enumerate(X.SCRIPTS.items()))


@query(f"""
WITH {V.LINES_SQL}, t AS (SELECT doc_id, line_index, text || repeat([{', '.join(f"'{c}'" for c in _LETTERS.values())}][(doc_id + line_index) % 11 + 1], CAST(doc_id * 7 % 60 AS INTEGER)) AS t FROM v_lines),
b AS (SELECT doc_id, line_index, list_max([{_SCRIPT_COUNTS}]) AS b FROM t)
SELECT doc_id, line_index, CASE WHEN b.n > 0 THEN b.s END AS script FROM b""")
def dominant_script(spark, d):
    """Of lines with some letters of another script at their end."""
    letter = F.element_at(F.array(*map(F.lit, _LETTERS.values())), ((F.col("doc_id") + F.col("line_index")) % 11 + 1).cast("int"))
    return V.lines(spark, d).select("doc_id", "line_index", X.dominant_script(F.concat("text", F.repeat(letter, (F.col("doc_id") * 7 % 60).cast("int")))).alias("script"))


@query(f"WITH {V.LINES_SQL} SELECT doc_id, line_index, length(text) AS width, length(regexp_replace(text, '\\s', '', 'g')) AS characters FROM v_lines")
def display_width(spark, d):
    return V.lines(spark, d).select("doc_id", "line_index", X.display_width(F.col("text")).alias("width"), X.count_characters(F.col("text")).alias("characters"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, nfc_normalize(text) AS nfc FROM documents")
def text_normalisation(spark, d):
    t = V.read(spark, d, "documents")
    return t.select("doc_id", X.collapse_space(F.col("text")).alias("text"), X.nfc(F.col("text")).alias("nfc"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(spark, d):
    return V.read(spark, d, "pages").select("page_id", X.escape_html(F.col("html")).alias("escaped"))


@query("""
WITH c AS (SELECT c_custkey, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS t FROM customer)
SELECT c_custkey, CAST(list_sum(list_transform(generate_series(1, length(t)), lambda i: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', t[i]) - 1) * [7, 3, 1][(i - 1) % 3 + 1])) % 10 AS INTEGER) AS digit FROM c""")
def mrz_check_digits(spark, d):
    return V.read(spark, d, "customer").select("c_custkey", N.mrz_check_digit(F.upper(F.regexp_replace("c_name", "[^A-Za-z0-9]", ""))).alias("digit"))


@query("""
SELECT c_custkey, CAST(CAST('1314' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') || '131410' AS HUGEINT) % 97 AS INTEGER) AS remainder FROM customer""")
def iban_remainders(spark, d):
    return V.read(spark, d, "customer").select("c_custkey", N.iban_remainder(F.concat(F.lit("DE10"), F.lit("1314"), F.lpad(F.col("c_custkey").cast("string"), 14, "0"))).alias("remainder"))


@query("SELECT c_custkey, round_even(least(1, greatest(0, c_acctbal / 10000)) * 100, 0)::INTEGER AS percent FROM customer")
def percents(spark, d):
    return V.read(spark, d, "customer").select("c_custkey", N.percent(F.col("c_acctbal") / 10000).alias("percent"))


@query()
def find_matches(spark, d):
    return _rounded(patterns.find_matches(V.lines(spark, d)), "min_x", "max_x")


_KIE = """k AS (SELECT * FROM (VALUES (0, 'The', 'the'), (1, 'token', 'token'), (2, 'Of:', 'of')) t(key_ordinal, key, k)),
b AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM v_lines),
near AS (SELECT * FROM b JOIN k ON starts_with(n, k)),
i AS (SELECT doc_id, key_ordinal, arg_min(v, line_index) AS v FROM (SELECT *, trim(regexp_extract(substr(c, length(k) + 1), '^(?:\\s*[:\\-]\\s*|\\s+)(.*)$', 1)) AS v FROM near WHERE regexp_matches(substr(n, length(k) + 1), '^[:\\-\\s]')) WHERE v <> '' GROUP BY ALL),
p AS (SELECT l.doc_id, l.key_ordinal, l.line_index AS li, b.line_index AS ci, trim(b.text) AS v,
  CASE WHEN b.min_x > l.max_x AND least(l.max_y, b.max_y) - greatest(l.min_y, b.min_y) >= 0.5 * greatest(l.max_y - l.min_y, 1) THEN b.min_x - l.max_x END AS r,
  CASE WHEN b.min_y > l.max_y AND least(l.max_x, b.max_x) - greatest(l.min_x, b.min_x) >= 0.5 * greatest(l.max_x - l.min_x, 1) THEN b.min_y - l.max_y END AS d
  FROM near l JOIN b ON l.doc_id = b.doc_id AND l.line_index <> b.line_index WHERE l.n = l.k AND b.text <> ''),
r AS (SELECT doc_id, key_ordinal, arg_min(v, {'g': r, 'l': li, 'c': ci}) AS v FROM p WHERE r IS NOT NULL GROUP BY ALL),
d AS (SELECT doc_id, key_ordinal, arg_min(v, {'g': d, 'l': li, 'c': ci}) AS v FROM p WHERE d IS NOT NULL GROUP BY ALL)"""


@query(f"""
WITH {V.LINES_SQL}, {_KIE}
SELECT q.doc_id, k.key_ordinal, k.key, coalesce(i.v, nullif(r.v, ''), nullif(d.v, '')) AS value FROM (SELECT DISTINCT doc_id FROM v_lines) q CROSS JOIN k
LEFT JOIN i ON i.doc_id = q.doc_id AND i.key_ordinal = k.key_ordinal LEFT JOIN r ON r.doc_id = q.doc_id AND r.key_ordinal = k.key_ordinal LEFT JOIN d ON d.doc_id = q.doc_id AND d.key_ordinal = k.key_ordinal""")
def key_information(spark, d):
    return key_values.extract_fields(V.lines(spark, d), ["The", "token", "Of:"], DOC)


@query(f"""
WITH {V.LINES_SQL}, s AS (SELECT doc_id, line_index, confidence, min_x, min_y, max_x, max_y, string_split_regex(trim(text), '\\s+') AS w FROM v_lines WHERE trim(text) <> ''),
n AS (SELECT *, list_sum(list_transform(w, lambda x: length(x))) AS t FROM s), u AS (SELECT *, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM n),
b AS (SELECT *, coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS before FROM u),
x AS (SELECT *, min_x + before * ((max_x - min_x) / t) AS l, CASE WHEN len(w) = 1 THEN max_x ELSE min_x + (before + length(word)) * ((max_x - min_x) / t) END AS r FROM b)
SELECT doc_id, 5 AS level, 1 AS page_num, 1 AS block_num, 1 AS par_num, CAST(line_index + 1 AS INTEGER) AS line_num, CAST(i AS INTEGER) AS word_num, CAST(round_even(l, 0) AS INTEGER) AS "left", CAST(round_even(min_y, 0) AS INTEGER) AS top,
  CAST(round_even(r - l, 0) AS INTEGER) AS width, CAST(round_even(max_y - min_y, 0) AS INTEGER) AS height, CAST(round_even(least(1, greatest(0, confidence)) * 100, 0) AS INTEGER) AS conf, word AS text FROM x""")
def export_tsv(spark, d):
    return formats.tsv(V.lines(spark, d), DOC)


_WORDS = f"""
{V.LINES_SQL}, s AS (SELECT *, string_split_regex(trim(text), '\\s+') AS w FROM v_lines WHERE trim(text) <> ''),
n AS (SELECT *, list_sum(list_transform(w, lambda x: length(x))) AS t FROM s), u AS (SELECT *, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM n),
b AS (SELECT *, coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS before FROM u),
x AS (SELECT *, min_x + before * ((max_x - min_x) / t) AS l, CASE WHEN len(w) = 1 THEN max_x ELSE min_x + (before + length(word)) * ((max_x - min_x) / t) END AS r FROM b),
z AS (SELECT doc_id, CAST(ceil(greatest(0, max(max_x))) AS INTEGER) AS pw, CAST(ceil(greatest(0, max(max_y))) AS INTEGER) AS ph FROM v_lines GROUP BY doc_id)"""


def _quoted(text):
    """A constant in SQL."""
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n"))


def _int(x):
    return f"CAST(round_even({x}, 0) AS INTEGER)"


_XML = "replace(replace(replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&apos;')"
_BBOX = lambda a, b, c, d: " || ' ' || ".join(["'bbox'", *map(_int, (a, b, c, d))])
_Q = "chr(39)"


@query(f"""
WITH {_WORDS}, q AS (SELECT doc_id, line_index, string_agg('      <span class=' || {_Q} || 'ocrx_word' || {_Q} || ' id=' || {_Q} || 'word_' || (line_index + 1) || '_' || i || {_Q} || ' title=' || {_Q} || {_BBOX('l', 'min_y', 'r', 'max_y')} || '; x_wconf ' || {_int('least(1, greatest(0, confidence)) * 100')} || {_Q} || '>' || {_XML} || '</span>' || chr(10), '' ORDER BY i) AS ws FROM x GROUP BY ALL),
p AS (SELECT v.doc_id, string_agg('    <span class=' || {_Q} || 'ocr_line' || {_Q} || ' id=' || {_Q} || 'line_' || (v.line_index + 1) || {_Q} || ' title=' || {_Q} || {_BBOX('min_x', 'min_y', 'max_x', 'max_y')} || {_Q} || '>' || chr(10) || coalesce(ws, '') || '    </span>' || chr(10), '' ORDER BY v.line_index) AS body FROM v_lines v LEFT JOIN q ON v.doc_id = q.doc_id AND v.line_index = q.line_index GROUP BY v.doc_id)
SELECT doc_id, {_quoted(formats.HOCR_HEAD)} || h AS hocr FROM (SELECT p.doc_id, '  <div class=' || {_Q} || 'ocr_page' || {_Q} || ' id=' || {_Q} || 'page_1' || {_Q} || ' title=' || {_Q} || 'image \"\"; bbox 0 0 ' || pw || ' ' || ph || {_Q} || '>' || chr(10) || body || '  </div>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS h FROM p JOIN z USING (doc_id))""")
def export_hocr(spark, d):
    return formats.hocr(V.lines(spark, d), DOC)


_ALTO_BOX = lambda a, b, c, d: f"'HPOS=\"' || {_int(a)} || '\" VPOS=\"' || {_int(b)} || '\" WIDTH=\"' || {_int(f'{c} - {a}')} || '\" HEIGHT=\"' || {_int(f'{d} - {b}')} || '\"'"


@query(f"""
WITH {_WORDS}, q AS (SELECT doc_id, line_index, string_agg('            <String ID="string_' || (line_index + 1) || '_' || i || '" ' || {_ALTO_BOX('l', 'min_y', 'r', 'max_y')} || ' WC="' || rtrim(rtrim(printf('%.3f', confidence), '0'), '.') || '" CONTENT="' || {_XML} || '"/>' || chr(10), '' ORDER BY i) AS ws FROM x GROUP BY ALL),
p AS (SELECT v.doc_id, string_agg('          <TextLine ID="line_' || (v.line_index + 1) || '" ' || {_ALTO_BOX('min_x', 'min_y', 'max_x', 'max_y')} || '>' || chr(10) || coalesce(ws, '') || '          </TextLine>' || chr(10), '' ORDER BY v.line_index) AS body FROM v_lines v LEFT JOIN q ON v.doc_id = q.doc_id AND v.line_index = q.line_index GROUP BY v.doc_id)
SELECT p.doc_id, {_quoted(formats.ALTO_HEAD)} || '    <Page ID="page_1" PHYSICAL_IMG_NR="1" WIDTH="' || pw || '" HEIGHT="' || ph || '">' || chr(10) || '      <PrintSpace HPOS="0" VPOS="0" WIDTH="' || pw || '" HEIGHT="' || ph || '">' || chr(10) || '        <TextBlock ID="block_1">' || chr(10) || body || {_quoted("        </TextBlock>\n      </PrintSpace>\n    </Page>\n  </Layout>\n</alto>\n")} AS alto FROM p JOIN z USING (doc_id)""")
def export_alto(spark, d):
    return formats.alto(V.lines(spark, d), DOC)


@query(f"""
WITH {V.LINES_SQL}, o AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_index) AS t, list({{'line_index': line_index, 'text': text, 'confidence': confidence, 'box': {{'min_x': min_x, 'min_y': min_y, 'max_x': max_x, 'max_y': max_y}}}} ORDER BY line_index) AS l FROM v_lines GROUP BY doc_id)
SELECT doc_id, CAST(to_json({{'text': t, 'lines': l}}) AS VARCHAR) AS json FROM o""")
def export_json(spark, d):
    return formats.page_json(V.lines(spark, d), DOC)


@query()
def export_markdown(spark, d):
    return markdown.markdown(V.blocks(spark, d).withColumns({"table_html": F.lit(None).cast("string"), "latex": F.lit(None).cast("string")}))


@query()
def xy_cut_enhanced(spark, d):
    return enhanced_order.xy_cut_enhanced(regions(spark, d), PAGE, WIDTH, HEIGHT, "region_index").select("page_id", "region_index", "position")


@query(f"""
WITH {REGIONS_SQL}, o AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN 100 - region_index END AS order_index FROM v_regions)
SELECT page_id, region_index, CAST(row_number() OVER (PARTITION BY page_id ORDER BY coalesce(order_index, region_index), region_index) - 1 AS INTEGER) AS position FROM o""")
def model_order(spark, d):
    r = regions(spark, d).withColumn("order_index", F.when(F.col("page_id") % 2 == 0, 100 - F.col("region_index")).cast("int"))
    return layout.model_order(r, PAGE).select("page_id", "region_index", "position")


@query("""
WITH c AS (SELECT item_id AS page, unnest(string_split(text, '')) AS v FROM benchmark),
n AS (SELECT page, count(*) FILTER (NOT regexp_matches(v, '^\\s$')) AS characters, CAST(0 AS BIGINT) AS invalid, count(*) FILTER (regexp_matches(v, '[\\p{L}\\p{Nd}]')) AS letters FROM c GROUP BY page)
SELECT *, characters >= 20 AND invalid < characters * 0.05 AND letters >= characters * 0.6 AS passes FROM n""")
def embedded_text_gate(spark, d):
    return pdf_text.quality_gate(V.glyphs(spark, d), ["page"])


@query()
def layout_text(spark, d):
    return render.layout_text(V.lines(spark, d), DOC)


@query()
def block_text(spark, d):
    return render.assemble_blocks(V.lines(spark, d), DOC)


@query("SELECT page_id, html AS shown FROM pages")
def display_order(spark, d):
    return V.read(spark, d, "pages").select("page_id", render.display_ordered(F.col("html")).alias("shown"))


def _tables(spark, d):
    """Tables of three columns from orders, five rows each."""
    o = V.read(spark, d, "orders").withColumn("t", F.floor(F.col("o_orderkey") / 5))
    row = F.concat(F.lit("<tr><td>"), "o_orderkey", F.lit("</td><td>"), "o_orderpriority", F.lit("</td><td>"), "o_orderstatus", F.lit("</td></tr>"))
    g = o.groupBy("t").agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r"))))["r"], "").alias("rows"))
    return g.select(F.col("t").alias("table_id"), F.concat(F.lit("<table>"), "rows", F.lit("</table>")).alias("table_html"))


@query("""
WITH o AS (SELECT o_orderkey // 5 AS table_id, row_number() OVER (PARTITION BY o_orderkey // 5 ORDER BY o_orderkey) - 1 AS r, [CAST(o_orderkey AS VARCHAR), o_orderpriority, o_orderstatus] AS c FROM orders)
SELECT table_id, CAST(r AS INTEGER) AS row, CAST(i - 1 AS INTEGER) AS col, 1 AS row_span, 1 AS col_span, c[i] AS text, false AS header FROM o, generate_series(1, 3) g(i)""")
def table_cells(spark, d):
    return tables.table_cells(_tables(spark, d), ["table_id"])


@query()
def export_html(spark, d):
    b = V.blocks(spark, d).withColumns({"table_html": F.lit(None).cast("string"), "latex": F.lit(None).cast("string")})
    return html.page_html(b, ["doc_id", "page_number"])


@query()
def export_docx(spark, d):
    return office.docx(V.blocks(spark, d)).select("doc_id", F.length("docx").alias("bytes"), F.sha2("docx", 256).alias("sha256"))


@query()
def export_xlsx(spark, d):
    return office.xlsx(V.blocks(spark, d)).select("doc_id", F.length("xlsx").alias("bytes"), F.sha2("xlsx", 256).alias("sha256"))


@query("""
SELECT c_custkey, CAST(least(i * 3616, greatest(w - 4000, 0)) AS INTEGER) AS start, least(w, 4000) AS length
FROM (SELECT c_custkey, CAST(1000 + c_custkey * 13 AS INTEGER) AS w FROM customer), generate_series(0, 20) g(i) WHERE i <= greatest(0, ceil((w - 4000) / 3616.0))""")
def tile_plan(spark, d):
    c = V.read(spark, d, "customer")
    return c.select("c_custkey", F.explode(detection.tile_plan((1000 + F.col("c_custkey") * 13).cast("int"), F.lit(4000))).alias("t")).select("c_custkey", "t.*")


@query()
def detect_boxes(spark, d):
    """Boxes of maps of 8 x 8 that the embeddings make."""
    m = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("page_id"), F.transform("embedding", lambda v: F.abs(v) * 5).alias("prob"), F.lit(8).alias("width"))
    return detection.detect_boxes(m, min_size=1, box=0.3)


@query(f"""
WITH {V.LINES_SQL}, r AS (SELECT doc_id, ['latin','chinese','greek'][line_index % 3 + 1] AS pack, line_index % 3 AS pack_order, avg(confidence) AS confidence FROM v_lines GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pack_order) AS rk FROM r),
f AS (SELECT doc_id, max(CASE WHEN rk = 1 AND pack IN ('latin','chinese') AND confidence >= 0.5 THEN confidence END) AS fast, arg_max(pack, {{'c': confidence, 'o': -pack_order}}) AS best, max(confidence) AS top, arg_min(pack, pack_order) AS first FROM k GROUP BY doc_id)
SELECT doc_id, CASE WHEN fast IS NOT NULL THEN first ELSE best END AS pack, round(coalesce(fast, top), 6) AS confidence, fast IS NOT NULL AS fast_path FROM f""")
def route_language(spark, d):
    i = F.col("line_index") % 3
    r = V.lines(spark, d).groupBy("doc_id", F.element_at(F.array(F.lit("latin"), F.lit("chinese"), F.lit("greek")), (i + 1).cast("int")).alias("pack"), i.alias("pack_order")).agg(F.avg("confidence").alias("confidence"))
    return _rounded(evaluate.route_language(r, DOC, fast=0.5), "confidence")


@query("""
SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_events(spark, d):
    e = incremental.windowed_counts(V.read(spark, d, "events"))
    return e.withColumn("total", F.round("total", 4))


@query(f"""
WITH {V.LINES_SQL}, h AS (SELECT doc_id, median(max_y - min_y) AS h, count(*) AS n, sum(CASE WHEN confidence < 0.85 THEN 1 ELSE 0 END) AS low, sum(confidence * greatest(1, {_COUNT})) / sum(greatest(1, {_COUNT})) AS w FROM v_lines GROUP BY doc_id)
SELECT doc_id, list_sort(list_filter([CASE WHEN low > 0 THEN 'low-confidence-lines' END, CASE WHEN w < 0.85 THEN 'low-confidence-page' END], lambda x: x IS NOT NULL)) AS reasons FROM h""")
def review_reasons(spark, d):
    lines = V.lines(spark, d)
    return quality.review_reasons(lines.select("doc_id").distinct(), lines, DOC)


@query()
def searchable_pdf(spark, d):
    """A file for each benchmark text's page."""
    lines = pdf_text.glyphs_to_lines(V.glyphs(spark, d), ["page"]).withColumn("page_number", F.lit(1))
    return pdf.searchable_pdf(lines, "page", "page_number", "line_index", 400.0, 1000.0).select("page", F.length("pdf").alias("bytes"), F.sha2("pdf", 256).alias("sha256"))


@query()
def page_structure(spark, d):
    """Regions and lines of a page as blocks in reading order."""
    r = regions(spark, d).withColumn("order_index", F.lit(None).cast("int"))
    lines = page_lines(spark, d).withColumn("confidence", F.lit(0.9))
    return structure.page_blocks(r, lines, PAGE, WIDTH, HEIGHT).select("page_id", "block_index", "type", "block_order", "text", "orphan")


from papyra.plans import function_queries  # noqa: E402, F401  # its queries are registered, too

__all__ = ["ORACLE_SQL", "QUERIES"]
