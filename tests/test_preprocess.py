import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra import options as O
from papyra.operators import preprocess as R
from papyra.operators import structure
from papyra.operators.patterns import register_find_matches


def test_alpha():
    dark = np.zeros((2, 2, 4), np.uint8)
    dark[0] = [10, 20, 30, 255]
    assert R.flatten_alpha(dark)[1].tolist() == [[255] * 3] * 2 and R.flatten_alpha(dark)[0].tolist() == [[10, 20, 30]] * 2
    light = np.full((2, 2, 4), 250, np.uint8)
    light[1, :, 3] = 0
    assert R.flatten_alpha(light)[1].tolist() == [[0] * 3] * 2
    assert R.flatten_alpha(np.zeros((1, 1, 4), np.uint8)).tolist() == [[[255] * 3]] and R.flatten_alpha(dark[..., :3]) is not None


def test_scale_and_resize():
    assert R.square_scale(204, 98) == (1.0, 204 / 98) and R.square_scale(72, 75) == (1.0, 1.0) and R.square_scale(0, 98) == R.square_scale(float("inf"), 1) == (1.0, 1.0)
    a = np.array([[0, 100], [200, 100]], np.uint8)
    assert R.resize(a, 2, 2).tolist() == a.tolist() and R.resize(a, 4, 2)[0].tolist() == [0, 25, 75, 100] and R.resize(a, 1, 1).tolist() == [[100]]


def slow_mean(a, y, x, half):
    part = a[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1]
    return part.mean()


def test_threshold_and_blur():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (20, 40)).astype(np.uint8)
    want = [[255 if a[y, x] >= 0.85 * slow_mean(a.astype(float), y, x, 2) else 0 for x in range(40)] for y in range(20)]
    assert R.binarize(a).tolist() == want
    flat = np.full((5, 6, 3), 77, np.uint8)
    assert (R.blur(flat) == 77).all()
    point = np.zeros((9, 9), np.uint8)
    point[4, 4] = 255
    b = R.blur(point).astype(int)
    assert b[4, 4] == b.max() < 255 and b[4, 3] == b[4, 5] == b[3, 4] > 0 and abs(b.sum() - 255) < 12


def test_skew():
    page = np.full((200, 300), 255, np.uint8)
    for y in range(20, 190, 20):
        page[y : y + 4, 30:270] = 0
    for degrees in (-7.0, -2.5, 0.0, 3.0, 12.0):
        turned = R.rotate(page, degrees)
        assert abs(R.estimate_skew(turned) + degrees) < 0.3
    assert R.rotate(page, 90.0).shape == (300, 200) and (R.rotate(page, 90.0) == np.rot90(page, -1)).mean() > 0.99
    assert R.estimate_skew(np.full((9, 9), 255, np.uint8)) == 0.0
    out, degrees = R.prepare(R.rotate(page, 5.0), O.PreprocessingOptions(deskew=True, denoise=True, binarize=True))
    assert abs(degrees + 5) < 0.3 and set(np.unique(out)) == {0, 255}


def test_lines():
    assert R.polyline([(0, 0), (3, 0), (3, 2)])[:4] == [(0, 0), (1, 0), (2, 0), (3, 0)]
    for points in ([(0, 0), (7, 3), (2, 9)], [(5, 5)], [(0, 0), (0, 0)]):
        seen = R.polyline(points)
        assert set(points) <= set(seen) and all(max(abs(a - c), abs(b - d)) <= 1 for (a, b), (c, d) in zip(seen, seen[1:]))
    image = np.zeros((4, 5, 3), np.uint8)
    out = R.draw(image, [[(0, 0), (9, 0), (9, 9), (0, 9)]], (1, 2, 3))
    assert (out[0] == [1, 2, 3]).all() and (out[:, 0] == [1, 2, 3]).all() and (out[1:, 1:] == 0).all() and (image == 0).all()


def test_in_spark(spark):
    rows = [(1, 2, 1, 4, bytes([9, 9, 9, 255, 0, 0, 0, 0]), 100.0, 200.0), (2, 2, 2, 3, b"short", None, None), (3, 1, 1, 1, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, width int, height int, channels int, pixels binary, x_resolution double, y_resolution double")
    got = {r.page_id: r for r in R.preprocess(df).collect()}
    assert (got[1].width, got[1].height, got[1].channels, got[1].error) == (4, 1, 3, None) and bytes(got[1].pixels)[:3] == b"\t\t\t" and bytes(got[1].pixels)[-3:] == b"\xff" * 3
    assert got[2].error == "pixels don't fill the image" and got[3].error == "no pixels" and got[3].pixels is None
    drawn = R.draw_regions(df.withColumn("polygons", F.expr("array(array(struct(0d as x, 0d as y)))"))).filter("page_id = 1").first()
    assert bytes(drawn.pixels)[:3] == b"\xff\x00\x00"
    assert R.preprocess(df.limit(0)).count() == 0


def test_options():
    assert (O.RecognitionOptions().batch_size, O.DetectionOptions().unclip_ratio, O.PdfOptions().text_layer, O.ProcessingPolicy().extra_passes, O.ProcessingPolicy(profile="Fast").extra_passes, O.VerificationPolicy().most_rules) == (6, 1.5, "Ignore", 1, 0, 64)
    assert O.PreprocessingOptions() == O.PreprocessingOptions(False, False, False, False, True) and not any(vars(O.TextNormalization()).values())
    bad = (
        (O.RecognitionOptions, {"batch_size": 0}), (O.RecognitionOptions, {"drop_score": 2}), (O.DetectionOptions, {"least_side": 0}), (O.DetectionOptions, {"box_threshold": -1}), (O.StructureOptions, {"merge_mode": "other"}),
        (O.LayoutTextOptions, {"row_overlap": 0}), (O.PdfOptions, {"dpi": 0}), (O.PdfOptions, {"text_layer": "x"}), (O.ProcessingPolicy, {"profile": "x"}), (O.ProcessingPolicy, {"most_extra_passes": -1}), (O.VerificationPolicy, {"most_rules": -1}),
        (O.RoutingOptions, {"curves": {"latin": [(0.5, 0.1)]}}), (O.RoutingOptions, {"most_packs": -1}),
    )
    for kind, values in bad:
        with pytest.raises(ValueError):
            kind(**values)


def test_structure(spark):
    box = "min_x double, min_y double, max_x double, max_y double"
    regions = spark.createDataFrame([(1, 1, 0, "doc_title", 0.9, None, 50.0, 10.0, 400.0, 40.0), (1, 1, 1, "text", 0.9, None, 50.0, 60.0, 400.0, 200.0), (1, 1, 2, "image", 0.9, None, 50.0, 220.0, 400.0, 400.0)], f"doc_id long, page long, region_index long, label string, score double, order_index int, {box}")
    lines = spark.createDataFrame([
        (1, 1, 0, "A title", 0.9, 60.0, 15.0, 300.0, 35.0), (1, 1, 1, "first line", 0.9, 55.0, 65.0, 395.0, 85.0), (1, 1, 2, "second line", 0.9, 55.0, 90.0, 300.0, 110.0), (1, 1, 3, "in the picture", 0.9, 60.0, 300.0, 300.0, 320.0), (1, 1, 4, "alone", 0.9, 60.0, 450.0, 200.0, 470.0),
    ], f"doc_id long, page long, line_index long, text string, confidence double, {box}")
    blocks, text = structure.analyse_documents(regions, lines, "doc_id", "page", 500.0, 600.0)
    got = blocks.orderBy("block_order").collect()
    assert [(r.type, r.text) for r in got if r.text] == [("DocTitle", "A title"), ("Text", "first line second line"), ("Text", "in the picture"), ("Text", "alone")]
    assert [r.orphan for r in got].count(True) == 2
    md = text.first().markdown
    assert md.startswith("# A title") and "first line second line" in md and md.index("second") < md.index("alone")
    seal = spark.createDataFrame([("Seal",), ("Formula",), ("Table",), ("Figure",)], "t string")
    want = lambda o: [r.x for r in seal.select(structure.text_matchable(F.col("t"), o).alias("x")).collect()]
    assert want(O.StructureOptions()) == [False, False, True, False] and want(O.StructureOptions(recognize_seals=False, recognize_formulas=False)) == [True, True, True, False]


def test_table_function(spark):
    register_find_matches(spark, "matches_in")
    spark.createDataFrame([(1, "mail a@b.org, 5 %"), (2, None)], "id long, text string").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT id, m.kind, m.start, m.value FROM some_texts, LATERAL matches_in(text) m").collect()
    assert [tuple(r) for r in got] == [(1, "Email", 5, "a@b.org"), (1, "Percentage", 14, "5 %")]


def test_straight_parts(spark):
    image = np.arange(48, dtype=np.uint8).reshape(6, 8) * 5
    whole = np.array([[0, 0], [8, 0], [8, 6], [0, 6]], float)
    assert (R.rectify_quad(image, whole) == image).all()
    part = np.array([[2, 1], [7, 1], [7, 4], [2, 4]], float)
    assert (R.rectify_quad(image, part) == image[1:4, 2:7]).all()
    high = np.array([[1, 0], [3, 0], [3, 6], [1, 6]], float)
    assert (R.rectify_quad(image, high) == np.rot90(image[:, 1:3])).all()
    assert (R.rectify_ribbon(image, np.array([[0, 0], [4, 0], [8, 0], [8, 6], [4, 6], [0, 6]], float)) == image).all()
    ring = np.full((120, 120), 255, np.uint8)
    y, x = np.mgrid[:120, :120] + 0.5
    r = np.hypot(x - 60, y - 60)
    ring[(r > 38) & (r < 42)] = 0
    angles = np.linspace(np.pi, 2 * np.pi, 19)
    arc = lambda k: np.c_[60 + k * np.cos(angles), 60 + k * np.sin(angles)]
    strip = R.rectify_ribbon(ring, np.concatenate([arc(50), arc(30)[::-1]]))
    assert strip.shape[0] == 20 and abs(strip.shape[1] - np.pi * 40) < 3 and (strip[9:11] < 60).all() and (strip[[0, 1, -2, -1]] > 250).all()
    rows = [(1, 8, 6, 1, image.tobytes(), [[(2.0, 1.0), (7.0, 1.0), (7.0, 4.0), (2.0, 4.0)], [(0.0, 0.0)], [(1.0, 1.0)] * 4]), (2, 8, 6, 1, None, None), (3, 8, 6, 1, image.tobytes(), None)]
    df = spark.createDataFrame(rows, "page_id long, width int, height int, channels int, pixels binary, polygons array<array<struct<x:double,y:double>>>")
    got = R.crop_regions(df).collect()
    assert [(r.page_id, r.region_index, r.error is None) for r in got] == [(1, 0, True), (1, None, False), (2, None, False)]
    assert (got[0].width, got[0].height) == (5, 3) and bytes(got[0].pixels) == image[1:4, 2:7].tobytes()

    def make():
        class Turned:
            def run(self, batch):
                return [(90, 0.95) if x[0, 0, 0] == 0 else (180, 0.5) for x in batch]

        return Turned()

    turned = {r.page_id: r for r in R.orient_pages(df.drop("polygons"), make).collect()}
    assert (turned[1].width, turned[1].height, turned[1].orientation) == (6, 8, 90) and bytes(turned[1].pixels) == np.rot90(image).tobytes() and turned[2].error == "no pixels"
