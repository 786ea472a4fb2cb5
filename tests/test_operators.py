import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from papyra.export import formats, html, markdown
from papyra.functions import geometry as G
from papyra.operators import ctc, documents, enhanced_order, evaluate, key_values, layout, mrz, pdf_text, quality, reading_order, spatial

BOX = "min_x double, min_y double, max_x double, max_y double"


def lines(spark, *rows):
    """(text, confidence, box) as lines of page 1."""
    return spark.createDataFrame([(1, i, t, float(c), *map(float, b)) for i, (t, c, b) in enumerate(rows)], f"doc_id long, line_index long, text string, confidence double, {BOX}")


def regions(spark, *rows):
    """(label, score, box) as regions of page 1."""
    return spark.createDataFrame([(1, i, t, float(s), *map(float, b)) for i, (t, s, b) in enumerate(rows)], f"page_id long, region_index long, label string, score double, {BOX}")


def kept(df):
    return sorted(r.region_index for r in df.collect())


def test_quality(spark):
    df = lines(spark, ("abcdefghij", 0.9, (0, 0, 1, 1)), ("ab c", 0.5, (0, 0, 1, 1)), ("😀 é", 0.85, (0, 0, 1, 1)))
    pages = spark.createDataFrame([(1,), (2,)], "doc_id long")
    a, b = quality.quality_summary(df, ["doc_id"], pages=pages).orderBy("doc_id").collect()
    assert (a.line_count, a.character_count, round(a.mean_confidence, 6), a.min_confidence, a.low_count) == (3, 15, 0.75, 0.5, 1)
    assert abs(a.weighted_confidence - (9 + 1.5 + 1.7) / 15) < 1e-9
    assert (b.line_count, b.mean_confidence, b.low_ratio) == (0, 0, 0)
    assert [r.text for r in quality.lines_for_review(df).collect()] == ["ab c"]


def test_calibration(spark):
    rows = [("p", 0.2, True), ("p", 0.5, False), ("p", 0.5, False), ("p", 0.9, True)]
    df = spark.createDataFrame(rows, "pack string, raw_confidence double, correct boolean")
    curve = quality.isotonic_curves(df).first()
    assert curve.raw == [0.0, 0.2, 0.5, 0.9, 1.0] and [round(y, 6) for y in curve.correctness] == [round(1 / 3, 6)] * 3 + [1.0, 1.0]
    s = df.withColumnRenamed("raw_confidence", "confidence")
    assert [(round(r.coverage, 2), round(r.risk, 4)) for r in quality.risk_coverage(s, ["pack"]).orderBy("coverage").collect()] == [(0.25, 0), (0.75, 0.6667), (1.0, 0.5)]
    e = quality.calibration_errors(s, []).first()
    assert abs(e.ece - (0.8 / 4 + 0.5 / 2 + 0.1 / 4)) < 1e-9 and e.n == 4


def test_votes_and_skew(spark):
    quads = spark.createDataFrame([(1, a, 100.0, 10.0) for a in (2.0, 2.1, 1.9, 2.0, 2.2)] + [(2, 5.0, 100.0, 10.0)], "page_id long, angle double, width double, height double")
    assert {r.page_id: r.skew for r in quality.skew(quads, ["page_id"]).collect()} == {1: 2.0, 2: 0.0}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(quality.choose_reading(lit("a"), lit(0.5), lit("b"), lit(0.6))) and not one(quality.choose_reading(lit("a"), lit(0.5), lit(" "), lit(0.9)))
    assert one(quality.accept_retry(lit("abcd"), lit(0.5), lit("abce"), lit(0.6))) and not one(quality.accept_retry(lit("abcd"), lit(0.5), lit("wxyz"), lit(0.9)))


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 20.0)], BOX)
    b = G.box()
    for degrees in (0, 90, 180, 270):
        back = G.rotate_back(G.rotate(b, degrees, F.lit(100.0), F.lit(50.0)), degrees, F.lit(100.0), F.lit(50.0))
        assert tuple(df.select(*back.columns()).first()) == (0.0, 0.0, 10.0, 20.0)
    assert tuple(df.select(*G.rotate(b, 90, F.lit(100.0), F.lit(50.0)).columns()).first()) == (30.0, 0.0, 50.0, 10.0)
    assert df.select(G.iou(b, G.translate(b, 5, 0)).alias("x")).first().x == pytest.approx(1 / 3)
    roi = G.region_of_interest(F.lit(0.005), F.lit(0.25), F.lit(0.5), F.lit(2.0), F.lit(True), F.lit(100.0), F.lit(50.0))
    assert tuple(df.select(*roi.columns()).first()) == (0.0, 12.0, 50.0, 50.0)
    pts = spark.createDataFrame([([(0.0, 0.0), (5.0, 0.0), (5.0, 5.0)],), ([(0.0, 0.0), (5.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    assert [r.v for r in pts.select(G.valid_polygon(F.col("p"), 10.0, 10.0).alias("v")).collect()] == [True, False]


def test_layout(spark):
    r = regions(spark, ("text", 0.41, (0, 0, 10, 10)), ("text", 0.4, (0, 0, 10, 10)), ("table", 0.45, (0, 0, 10, 10)), ("seal", 0.46, (0, 0, 1, 1)))
    assert kept(layout.threshold(r)) == [0, 3] and layout.score_floor() == 0.3
    r = regions(spark, ("text", 0.9, (0, 0, 100, 100)), ("text", 0.8, (0, 0, 100, 90)), ("image", 0.7, (0, 0, 100, 90)), ("text", 0.6, (0, 200, 10, 210)))
    assert kept(layout.suppress_by_score(r, ["page_id"])) == [0, 2, 3]
    assert kept(layout.drop_overlapping(r, ["page_id"])) == [0, 3]
    big = regions(spark, ("image", 0.9, (0, 0, 1000, 1380)), ("text", 0.9, (0, 0, 10, 10)))
    assert kept(layout.drop_oversized_images(big, ["page_id"], 1000, 1400)) == [1]
    assert kept(layout.drop_oversized_images(big.filter("region_index = 0"), ["page_id"], 1000, 1400)) == [0]
    inner = regions(spark, ("image", 0.9, (0, 0, 100, 100)), ("text", 0.9, (10, 10, 20, 20)), ("formula", 0.9, (30, 30, 40, 40)), ("text", 0.9, (200, 0, 300, 100)), ("text", 0.9, (210, 10, 220, 20)))
    assert kept(layout.merge_contained(inner, ["page_id"])) == [0, 2, 3, 4]
    assert kept(layout.merge_contained(inner, ["page_id"], "large")) == [0, 2, 3]
    assert kept(layout.merge_contained(inner, ["page_id"], "small")) == [1, 2, 4]
    fixes = regions(spark, ("footnote", 1, (0, 0, 10, 10)), ("text", 1, (0, 50, 100, 60)), ("paragraph_title", 1, (0, 0, 100, 8)))
    assert [x.label for x in layout.fix_labels(fixes, ["page_id"]).orderBy("region_index").collect()] == ["text", "text", "doc_title"]
    ordered = layout.post_process(fixes.withColumn("order_index", (5 - F.col("region_index")).cast("int")), ["page_id"], 1000, 1400)
    assert {x.region_index: x.position for x in ordered.collect()} == {1: 4, 2: 3}  # the title covers the footnote


def test_suppression_invariant(spark):
    rnd = random.Random(0)
    rows = [("text", rnd.random(), (x := rnd.randrange(100), y := rnd.randrange(100), x + rnd.randrange(5, 60), y + rnd.randrange(5, 60))) for _ in range(80)]
    got = kept(layout.suppress_by_area(regions(spark, *rows), ["page_id"], 0.3))

    def iou(a, b):
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    want = []
    for i in sorted(range(80), key=lambda i: (-area(rows[i][2]), i)):
        if all(iou(rows[i][2], rows[j][2]) <= 0.3 for j in want):
            want.append(i)
    assert got == sorted(want)
    assert len(kept(layout.suppress_by_area(regions(spark, *rows), ["page_id"], 0))) == 80


def test_spatial_joins(spark):
    blocks = regions(spark, ("text", 1, (0, 0, 100, 100)), ("text", 1, (100, 0, 200, 100)), ("table", 1, (0, 200, 100, 300)))
    ls = lines(spark, ("in", 1, (10, 10, 50, 20)), ("across", 1, (50, 10, 150, 20)), ("most", 1, (60, 30, 102, 40)), ("out", 1, (500, 500, 510, 510)), ("flat", 1, (10, 10, 10, 20)), ("part", 1, (70, 50, 100, 130))).withColumnRenamed("doc_id", "page_id")
    got = {r.line_index: (r.region_index, r.status) for r in spatial.match_lines_to_blocks(ls, blocks, ["page_id"], block_id="region_index").collect()}
    assert got == {0: (0, "strong"), 1: (None, "hurdle"), 2: (0, "strong"), 3: (None, "orphan"), 4: (None, "orphan"), 5: (0, "match")}
    parts = spatial.hurdle_fragments(ls, blocks, ["page_id"], block_id="region_index").orderBy("region_index").collect()
    assert [(p.region_index, p.min_x, p.max_x) for p in parts] == [(0, 50, 100), (1, 100, 150)]
    cells = spark.createDataFrame([(1, i, float(x), float(y), x + 100.0, y + 100.0) for i, (x, y) in enumerate([(0, 0), (100, 0), (0, 100), (100, 100)])], f"page_id long, cell_index long, {BOX}")
    assert {r.line_index: r.cell_index for r in spatial.match_lines_to_cells(ls, cells, ["page_id"]).collect()}[3] == 3
    holes = spark.createDataFrame([(1, 0, 10, 0, 10), (1, 5, 15, 5, 15), (1, 20, 30, 0, 10)], "k long, x0 int, x1 int, y0 int, y1 int")
    assert spatial.union_area(holes, ["k"]).first().union_area == 100 + 75 + 100
    natives = regions(spark, ("t", 1, (0, 0, 100, 97)))
    assert kept(spatial.uncovered_regions(blocks.drop("label", "score"), natives, ["page_id"])) == [1, 2]
    assert kept(spatial.missing_regions(blocks.drop("label", "score"), natives, ["page_id"])) == [1, 2]
    nest = regions(spark, ("a", 1, (0, 0, 100, 100)), ("b", 1, (10, 10, 50, 50)), ("c", 1, (20, 20, 30, 30)))
    assert {r.region_index: r.container for r in spatial.smallest_containers(nest, ["page_id"], "region_index").collect()} == {1: 0, 2: 1}
    f = spark.createDataFrame([(1, 0, "formula", 10.0, 210.0, 20.0, 220.0), (1, 1, "inline_formula", 95.0, 110.0, 105.0, 120.0), (1, 2, "inline_formula", 95.0, 95.0, 105.0, 115.0), (1, 3, "formula", 400.0, 400.0, 410.0, 410.0)], f"page_id long, formula_index long, label string, {BOX}")
    typed = blocks.withColumn("type", layout.block_type(F.col("label")))
    assert {r.formula_index: (r.region_index, r.target) for r in spatial.attach_formulas(f, typed, ["page_id"], block_id="region_index").collect()} == {0: (2, "table"), 1: (None, "alone"), 2: (0, "text"), 3: (None, "alone")}


def test_reading_order(spark):
    ls = lines(spark, ("right", 1, (300, 0, 400, 10)), ("b", 1, (60, 2, 100, 12)), ("a", 1, (0, 0, 50, 10)), ("c", 1, (0, 20, 50, 30)))
    got = [r.text for r in reading_order.reading_order(ls, ["doc_id"]).orderBy("position").collect()]
    assert got == ["a", "b", "c", "right"]
    assert [r.text for r in reading_order.sorted_boxes(ls, ["doc_id"]).orderBy("position").collect()] == ["a", "b", "right", "c"]
    boxes = [(0, 0, 100, 10), (0, 20, 40, 100), (60, 20, 100, 60), (60, 70, 100, 100), (60, 62, 70, 65)]
    assert reading_order.xy_cut_order(boxes) == [0, 1, 2, 4, 3] and reading_order.xy_cut_order([]) == []
    rnd = random.Random(1)
    for _ in range(100):
        some = [(x := rnd.randrange(90), y := rnd.randrange(90), x + rnd.randrange(1, 30), y + rnd.randrange(1, 30)) for _ in range(rnd.randrange(1, 20))]
        assert sorted(reading_order.xy_cut_order(some)) == list(range(len(some)))
    assert [r.row for r in reading_order.line_groups(ls, ["doc_id"]).orderBy("line_index").collect()] == [0, 0, 0, 1]
    p = reading_order.merge_paragraphs(lines(spark, ("one", 0.8, (0, 0, 100, 10)), ("two", 0.6, (0, 12, 90, 22)), ("far", 1, (0, 60, 50, 70))), ["doc_id"]).orderBy("paragraph").collect()
    assert [(r.text, round(r.confidence, 6)) for r in p] == [("one\ntwo", 0.7), ("far", 1.0)]
    tilted = lines(spark, ("a", 1, (0, 0, 50, 10)), ("b", 1, (200, 12, 250, 22)), ("c", 1, (0, 14, 50, 24))).withColumn("skew", F.lit(3.43))
    assert [r.text for r in reading_order.skewed_reading_order(tilted, ["doc_id"]).orderBy("column", "row", "position").collect()][0] == "a"


def test_enhanced_order():
    row = lambda label, *b: {"label": label, "min_x": b[0], "min_y": b[1], "max_x": b[2], "max_y": b[3]}
    page = [row("text", 520, 200, 980, 600), row("text", 20, 200, 480, 600), row("doc_title", 200, 50, 800, 100), row("header", 0, 0, 1000, 30), row("footer", 0, 950, 1000, 990), row("number", 480, 990, 520, 1000)]
    got = enhanced_order.enhanced_order(page, 1000, 1000)
    assert got == [3, 2, 1, 0, 4, 5]
    figure = [row("text", 20, 100, 480, 400), row("image", 20, 420, 480, 700), row("text", 20, 760, 480, 900), row("figure_title", 20, 710, 480, 730)]
    assert enhanced_order.enhanced_order(figure, 1000, 1000) == [0, 1, 3, 2]
    rnd = random.Random(2)
    for _ in range(60):
        some = [row(rnd.choice(["text", "image", "paragraph_title", "doc_title", "figure_title", "header", "seal", "reference", "abstract", "region"]), x := rnd.randrange(900), y := rnd.randrange(900), x + rnd.randrange(5, 400), y + rnd.randrange(5, 200)) for _ in range(rnd.randrange(0, 20))]
        assert sorted(enhanced_order.enhanced_order(some, 1000, 1000)) == list(range(len(some)))


def test_key_information(spark):
    ls = lines(spark, ("Invoice No: 42", 1, (0, 0, 100, 10)), ("Total", 1, (0, 20, 50, 30)), ("99.50", 1, (200, 21, 250, 31)), ("near", 1, (80, 20, 120, 30)), ("Date", 1, (0, 50, 50, 60)), ("2024", 1, (0, 65, 50, 75)), ("Total:", 1, (0, 90, 50, 100)), ("Totally other", 1, (0, 110, 50, 120)))
    got = {r.key: r.value for r in key_values.extract_fields(ls, ["invoice no:", "Total", "Date", "Missing"], ["doc_id"]).collect()}
    assert got == {"invoice no:": "42", "Total": "near", "Date": "2024", "Missing": None}


def test_documents(spark):
    blocks = spark.createDataFrame([
        (1, 1, 0, "Header", 0, 100.0, 10.0, 900.0, 60.0, "Report  A"), (1, 2, 0, "Header", 0, 110.0, 10.0, 900.0, 60.0, "Report A"), (1, 3, 0, "Header", 0, 300.0, 10.0, 900.0, 60.0, "Report A"),
        (1, 1, 1, "Table", 1, 100.0, 700.0, 900.0, 900.0, "10.25"), (1, 2, 1, "Table", 1, 100.0, 100.0, 900.0, 300.0, "20.50"), (1, 2, 2, "Text", 2, 100.0, 400.0, 900.0, 500.0, "99.99"),
    ], f"doc_id long, page_number int, block_index int, type string, block_order int, {BOX}, text string")
    assert [(r.from_page, r.to_page) for r in documents.repeated_headers(blocks).collect()] == [(1, 2)]
    cols = blocks.withColumns({"column_count": F.lit(2), "first_row": F.array(F.lit("a"), F.lit("b"))})
    t = documents.table_continuations(cols).collect()
    assert [(r.from_page, r.from_block, r.to_page, r.to_block) for r in t] == [(1, 1, 2, 1)] and t[0].evidence.endswith("2 columns; identical first-row text")
    ref = "struct<page_number:int,block_index:int>"
    D = Decimal
    rules = spark.createDataFrame([
        (1, 0, "sum", "DecimalSum", [(1, 1), (2, 1)], (2, 2), D("0.01")), (1, 1, "missing", "ExactText", [(9, 9)], (2, 2), D(0)), (1, 2, "same", "ExactText", [(2, 2)], (2, 2), D(0)), (1, 3, "text", "DecimalSum", [(1, 0)], (2, 2), D(0)), (1, 4, "near", "DecimalSum", [(2, 2)], (2, 2), D(0)),
    ], f"doc_id long, rule_ordinal int, id string, kind string, inputs array<{ref}>, expected {ref}, tolerance decimal(38,18)")
    checks = documents.check_rules(rules, blocks)
    assert {r.id: r.status for r in checks.collect()} == {"sum": "contradiction", "missing": "missing-reading", "same": "agreement", "text": "not-a-decimal", "near": "agreement"}
    asked = documents.reread_requests(rules, checks, blocks, 1000, 1000).collect()
    assert len(asked) == 3 and {r.rule_ordinal for r in asked} == {0}
    assert documents.reread_requests(rules, checks, blocks, 1000, 1000, most_rereads=1).count() == 1
    links = spark.createDataFrame([(1, 1, 1, 2, 1), (1, 2, 1, 3, 0)], "doc_id long, from_page int, from_block int, to_page int, to_block int")
    chain = documents.approved_chains(links)
    assert sorted((r.position, r.page, r.block) for r in chain.collect()) == [(0, 1, 1), (1, 2, 1), (2, 3, 0)]
    cells = spark.createDataFrame([(1, p, b, r, c, 1, 1, f"h{c}" if r == 0 else f"{p}.{r}.{c}") for p, b in ((1, 1), (2, 1), (3, 0)) for r in range(2) for c in range(2)], "doc_id long, page int, block int, row int, col int, row_span int, col_span int, text string")
    assert [r.text for r in documents.join_tables(cells, chain).orderBy("row", "col").collect()] == ["h0", "h1", "1.1.0", "1.1.1", "2.1.0", "2.1.1", "3.1.0", "3.1.1"]
    assert [(r.page, r.text) for r in documents.omitted_headers(cells, chain).orderBy("page", "col").collect()] == [(2, "h0"), (2, "h1"), (3, "h0"), (3, "h1")]
    for other, said in (((1, 1, 1, 2, 0), "ambiguous"), ((1, 1, 0, 2, 1), "ambiguous"), ((1, 1, 1, 2, 1), "ambiguous"), ((1, 5, 0, 7, 0), "next page")):
        with pytest.raises(Exception, match=said):
            documents.approved_chains(links.union(spark.createDataFrame([other], links.schema))).collect()
    long = spark.range(300).selectExpr("2L as doc_id", "cast(id as int) as from_page", "0 as from_block", "cast(id + 1 as int) as to_page", "0 as to_block")
    assert documents.approved_chains(long).agg(F.max("position")).first()[0] == 300
    for wrong in (F.when((F.col("page") == 2) & (F.col("row") == 0), "other").otherwise(F.col("text")),):
        with pytest.raises(Exception, match="same first row"):
            documents.join_tables(cells.withColumn("text", wrong), chain).collect()
    with pytest.raises(Exception, match="same first row"):
        documents.join_tables(cells.filter("page <> 3 or col = 0"), chain).collect()
    with pytest.raises(Exception, match="same first row"):
        documents.join_tables(cells.withColumn("row_span", F.when((F.col("page") == 3) & (F.col("row") == 0), 2).otherwise(1)), chain).collect()


def test_ctc(spark):
    tokens = ["", "a", "b", " "]
    step = lambda k, p=0.7: [p if i == k else (1 - p) / 3 for i in range(4)]
    rows = [(1, [step(1), step(1), step(0), step(1), step(2), step(9 % 4)]), (2, [step(0)]), (3, [])]
    df = spark.createDataFrame(rows, "crop_id long, probs array<array<double>>")
    got = {r.crop_id: r for r in ctc.greedy_decode(df, tokens).collect()}
    assert got[1].text == "aaba" and abs(got[1].confidence - 0.7) < 1e-9 and got[2].text == "" and got[3].confidence == 0
    assert [(c.token, c.first_step, c.last_step) for c in got[1].characters][0] == ("a", 0, 1)
    masked = ctc.greedy_decode(df, tokens, mask=ctc.class_mask(tokens, "b"))
    assert set(masked.filter("crop_id = 1").first().text) <= {"b", " "}
    spaced = spark.createDataFrame([(1, [step(1), [0.6, 0.0, 0.0, 0.4], step(2)])], df.schema)
    assert ctc.greedy_decode(spaced, tokens, space_threshold=0.3).first().text == "a b" and ctc.greedy_decode(spaced, tokens).first().text == "ab"
    words = ctc.greedy_decode(spaced, tokens, space_threshold=0.3).select(ctc.words_of_characters(F.col("characters")).alias("w")).first().w
    assert [w.text for w in words] == ["a", "b"]
    assert ctc.vocabulary(["a", "b"], 4) == ["", "a", "b", " "] and ctc.vocabulary(["a", "b"], 3) == ["", "a", "b"] and ctc.vocabulary(["", "b"], 3) == ["", "b", " "] and ctc.vocabulary(["a"], 1) == ["a"] and len(ctc.vocabulary(["a"], 9)) == 9
    assert ctc.class_mask(tokens, "a") == [True, True, False, True] and ctc.class_mask(tokens, None, "a ") == [True, False, True, False]
    plan = spark.range(1).select(ctc.window_plan(F.lit(250), 100).alias("p")).first().p
    assert plan == [0, 80, 150]


def test_mrz(spark):
    td3 = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
    found = mrz.best_zone(td3, 2024)
    assert found["score"] == 100 and found["surname"] == "ERIKSSON" and str(found["birth_date"]) == "1974-08-12"
    noisy = [td3[0].replace("<<<<<<<<<<<<<<<<<<<", "KKKKKKKKKKKKKKKKKKK"), td3[1].replace("740812", "74O8I2")]
    assert mrz.best_zone(noisy, 2024)["score"] == 100
    visa = ["V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L8988901C4XXX4009078F96121096ZE184226B<<<<<<"]
    assert mrz.best_zone(visa, 2024)["check_composite"] is None and mrz.best_zone(visa, 2024)["score"] == 100
    broken = [td3[0], td3[1].replace("L898902C3", "L898902C4")]
    assert 0 < mrz.best_zone(broken, 2024)["score"] < 100 and mrz.best_zone(["hello"], 2024) is None
    assert mrz.fit("AB<<<<", 4) == "AB<<" and mrz.fit("AB<", 5) == "AB<<<" and mrz.fit("ABC", 2) is None and mrz.normalise("a b«k") == "AB«K"
    df = lines(spark, (td3[0], 1, (0, 0, 400, 10)), (td3[1], 1, (0, 20, 400, 30)), ("other text", 1, (0, 40, 50, 50)))
    assert mrz.find_mrz(df, ["doc_id"], 2024).first().document_number == "L898902C3"


def test_evaluation(spark):
    pairs = spark.createDataFrame([(1, "a b c\nd", "a x c\nd"), (2, "", "x"), (3, "same\r\nline ", "same\nline"), (4, "😀a", "a")], "id long, reference string, prediction string")
    got = {r.id: r for r in evaluate.score_pairs(pairs).collect()}
    assert (got[1].char_edits, got[1].word_edits, got[1].line_edits, got[1].word_count) == (1, 1, 1, 4) and got[2].cer is None and got[3].exact and got[4].char_edits == 1
    assert {r.id: r.lcs for r in evaluate.exact_line_lcs(pairs).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    cases = spark.createDataFrame([("1", "abc 12", "abd 12", "abc 12", ["12"]), ("2", "abc", "abc", "abc", []), ("3", "abc", "abc", "xbc", []), ("4", "abc", "xbc", "axc", [])], "id string, reference string, before string, after string, critical_tokens array<string>")
    o = evaluate.retry_outcomes(cases)
    assert {r.id: r.outcome for r in o.collect()} == {"1": "improved", "2": "unchanged", "3": "worsened", "4": "neutral"}
    assert evaluate.retry_summary(o).first().improved == 1
    m = spark.createDataFrame([(1, "d", "test"), (2, "d", "train"), (2, "e", "test")], "id long, document_id string, split string")
    problems = {(r.problem, r.key) for r in evaluate.check_manifest(m, spark.createDataFrame([(1,), (5,)], "id long")).collect()}
    assert problems == {("missing", "2"), ("extra", "5"), ("repeated-item", "2"), ("document_id-in-splits", "d")}
    s = spark.createDataFrame([("g", i, 0.5, 0.3) for i in range(10)] + [("one", 1, 0.5, 0.3)], "subgroup string, document_id long, baseline_error double, candidate_error double")
    assert {r.subgroup: r.gate for r in evaluate.paired_bootstrap(s).collect()} == {"g": "improved", "one": "insufficient"}


def test_pdf_text(spark):
    chars = [(1, i, c, 10.0 * i + (30 if i > 4 else 0), 0.0, 10.0 * i + 9 + (30 if i > 4 else 0), 20.0, 20.0) for i, c in enumerate("HelloWorld")]
    chars += [(1, 20 + i, c, 10.0 * i, 40.0, 10.0 * i + 9, 60.0, 20.0) for i, c in enumerate("a b")]
    df = spark.createDataFrame(chars, "page long, seq long, value string, left double, top double, right double, bottom double, em double")
    ls = pdf_text.glyphs_to_lines(df, ["page"])
    assert [r.text for r in ls.orderBy("line_index").collect()] == ["Hello World", "a b"]
    assert not pdf_text.quality_gate(df, ["page"]).first().passes and pdf_text.select_lines(df, ["page"], "Prefer", 100, 100).count() == 0
    assert pdf_text.select_lines(df, ["page"], "Hybrid", 500, 500).count() == 2 and pdf_text.select_lines(df, ["page"], "Ignore", 500, 500).count() == 0
    visual = ls.withColumns({"text": F.when(F.col("line_index") == 0, "Hello Wor1d").otherwise(F.col("text"))}).union(ls.limit(1).withColumns({"text": F.lit("new"), "min_y": F.lit(200.0), "max_y": F.lit(220.0)}))
    fused = pdf_text.fuse(ls, visual, ["page"], 500, 500).orderBy("line_index").collect()
    assert [(r.text, r.source, r.alternatives, r.has_conflict) for r in fused] == [("Hello World", "EmbeddedText", ["Hello Wor1d"], True), ("a b", "EmbeddedText", ["a b"], False), ("new", "Ocr", [], False)]
    assert "Tj" in pdf_text.searchable_content(ls, ["page"], 500).first().content


def test_exports(spark):
    import xml.etree.ElementTree as ET

    ls = lines(spark, ("a <b>", 0.875, (0, 0, 40, 10)), (" ", 0.5, (0, 20, 10, 30)), ("x\ty", 2.0, (0, 40, 30, 50.5)))
    words = [(r.line_num, r.word_num, r.text, r.left, r.width, r.conf) for r in formats.tsv(ls, ["doc_id"]).orderBy("line_num", "word_num").collect()]
    assert words == [(1, 1, "a", 0, 10, 88), (1, 2, "<b>", 10, 30, 88), (3, 1, "x", 0, 15, 100), (3, 2, "y", 15, 15, 100)]
    hocr = formats.hocr(ls, ["doc_id"]).first().hocr
    root = ET.fromstring(hocr.split("\n", 2)[2])
    assert [e.text for e in root.iter() if e.get("class") == "ocrx_word"] == ["a", "<b>", "x", "y"] and "bbox 0 0 40 51" in hocr
    alto = ET.fromstring(formats.alto(ls, ["doc_id"]).first().alto)
    assert [e.get("WC") for e in alto.iter() if e.tag.endswith("String")] == ["0.875", "0.875", "2", "2"]
    assert '"text":"a <b>\\n' in formats.page_json(ls, ["doc_id"]).first().json
    assert markdown.heading("2.1. Scope.") == "#### 2.1. Scope" and markdown.heading("Intro") == "## Intro"
    line = lambda a, b: {"min_x": float(a), "max_x": float(b)}
    block = lambda kind, text, **k: {"type": kind, "text": text, "min_x": 0.0, "min_y": 0.0, "max_x": 100.0, "max_y": 10.0, **k}
    page = [block("DocTitle", "T"), block("Header", "skip"), block("Text", "one\ntwo", lines=[line(0, 100), line(0, 100)]), block("Text", "three", lines=[line(0, 50), line(0, 40)]), block("Formula", None, latex="x"), block("Table", None, table_html="<html><table><tr></tr></table></html>"), block("Figure", "cap"), block("Abstract", "Abstract text")]
    text, begins, _ = markdown.render_page(page)
    assert text == '# T\n\none\n\ntwothree\n\n$$x$$\n\n<table border="1"><tr></tr></table>\n\n![Figure]()\n\ncap\n\n## Abstract\n text'
    assert markdown.splice([("a", True, False), ("b", False, True), ("c", True, True)]) == "a b\n\nc" and markdown.splice([("日", True, False), ("本", False, True)]) == "日本" and markdown.splice([("a", True, True), ("", True, True), ("b", True, True)], "\n---\n") == "a\n---\nb"
    b = spark.createDataFrame([(1, 0, "DocTitle", "A & B", None, None), (1, 1, "Table", "fallback", "<table><tr>", None), (1, 2, "Formula", None, None, "a<b"), (1, 3, "Seal", None, None, None)], "doc_id long, block_order int, type string, text string, table_html string, latex string").withColumns({c: F.lit(1.5) for c in ("min_x", "min_y", "max_x", "max_y")})
    out = html.page_html(b, ["doc_id"]).first().html
    assert "<title>A &amp; B</title>" in out and "<p>fallback</p>" in out and 'data-latex="a&lt;b"' in out and 'data-bbox="1.5 1.5 1.5 1.5"' in out


def test_rounding_as_in_sql(spark):
    from papyra.plans.queries import _round6

    rows = [0.6615624999999999, 0.5046875, -0.6615624999999999, 0.0, 1e300, None]
    assert [r.x for r in spark.createDataFrame([(x,) for x in rows], "x double").select(_round6("x").alias("x")).collect()] == [0.661563, 0.504687, -0.661563, 0.0, 1e300, None]


def test_votes_on_ties(spark):
    """0.1 + 0.2 is 0.3: sums that are equal but for their last bits are ties, as in SQL."""
    crops = [(1, i, p, o, c) for i, (p, o, c) in enumerate([("latin", 1, 0.3), ("greek", 2, 0.1), ("greek", 2, 0.2)])]
    got = quality.pack_vote(spark.createDataFrame(crops, "page_id long, crop_id long, pack string, pack_order long, confidence double"), ["page_id"]).collect()
    assert {r.pack: r.rank for r in got} == {"latin": 1, "greek": 2}
    turned = [(1, 0, "ab", 0.15), (1, 90, "a", 0.1), (1, 90, "a", 0.2)]
    assert quality.orientation_vote(spark.createDataFrame(turned, "doc_id long, rotation long, text string, confidence double"), ["doc_id"]).first().rotation == 0
