import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.functions.render import block_text, display_order, group_rows, joined_rows, layout_lines
from papyra import options as O
from papyra.operators import detection as D
from papyra.operators import rendering
from papyra.operators.inference import FakeRecognizer, ask, explode_lines, extract_with_model, fields_of_reply, first_json_object, parse_charts, recognize, recognize_regions
from papyra.sources import inputs as I
from papyra.streaming.incremental import BatchOptions, file_stream, progress, recognise_files, running_totals, windowed_counts, write_pages


def echo():
    """A maker of a chat model that workers get by value, as they can't import tests."""

    def make():
        class Echo:
            supports_vision = True

            def complete(self, messages):
                if "fail" in str(messages):
                    raise OSError("down")
                return '```json\n{"Total": 12.50, "Name": "A}b", "x": {"y": true}, "type": "bar", "data": "|a|"}\n``` ok', 3, None

        return Echo()

    return make


def test_components_and_rectangles():
    bitmap = np.zeros((8, 10), bool)
    bitmap[1:3, 1:4] = bitmap[3, 4] = bitmap[6, 0:3] = True
    labels, n = D.components(bitmap)
    assert n == 2 and labels[1, 1] == labels[3, 4] == 1 and labels[6, 0] == 2 and (labels > 0).sum() == bitmap.sum()
    rng = np.random.default_rng(0)
    for _ in range(20):  # against a slow flood fill
        b = rng.random((12, 15)) < 0.4
        labels, n = D.components(b)
        seen, count = np.zeros_like(b), 0
        for y, x in zip(*np.nonzero(b)):
            if not seen[y, x]:
                count, work = count + 1, [(y, x)]
                while work:
                    i, j = work.pop()
                    if 0 <= i < 12 and 0 <= j < 15 and b[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        assert labels[i, j] == labels[y, x]
                        work += [(i + a, j + c) for a in (-1, 0, 1) for c in (-1, 0, 1)]
        assert count == n
    quad, side = D.min_area_rect(np.array([[0, 0], [4, 4], [2, 6], [-2, 2]]))
    assert abs(side - 2 * 2**0.5) < 1e-6 and np.allclose(sorted(quad.tolist()), [[-2, 2], [0, 0], [2, 6], [4, 4]])
    assert np.allclose(D.unclip_quad(np.array([[0, 0], [10, 0], [10, 10], [0, 10.0]]), 2), [[-5, -5], [15, -5], [15, 15], [-5, 15]])
    assert D.dilate(np.array([[1, 0, 0], [0, 0, 0]], bool)).tolist() == [[True, True, False], [True, True, False]]
    h = D.homography(np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), np.array([[0, 0], [2, 0], [2, 2], [0, 2]]))
    assert np.allclose(h, np.diag([2, 2, 1]))
    assert D.simplify(np.array([[0, 0], [1, 0.01], [2, 0], [2, 2]]), 0.1).tolist() == [[0, 0], [2, 0], [2, 2]]


def test_boxes_of_map(spark):
    prob = np.zeros((40, 60), np.float32)
    prob[10:20, 5:45] = 0.9
    prob[30:32, 50:52] = 0.9
    prob[25:35, 2:30] = 0.4
    rows = spark.createDataFrame([(1, prob.ravel().tolist(), 60), (2, None, 60)], "page_id long, prob array<float>, width int")
    got = D.detect_boxes(rows).collect()
    assert len(got) == 1 and got[0].score > 0.85
    xs, ys = [p.x for p in got[0].polygon], [p.y for p in got[0].polygon]
    assert min(xs) < 5 < 44 < max(xs) and min(ys) < 10 < 19 < max(ys)


def test_polygons_of_map(spark):
    square = np.zeros((6, 7), bool)
    square[1:5, 2:6] = True
    ring = D.outer_contour(square)
    assert ring[0] == (2, 1) and len(ring) == 12 and set(ring) == {(x, y) for y in range(1, 5) for x in range(2, 6) if x in (2, 5) or y in (1, 4)}
    assert D.outer_contour(np.eye(1, dtype=bool)) == [(0, 0)] and D.outer_contour(np.ones((1, 3), bool)) == [(0, 0), (1, 0), (2, 0), (1, 0)]
    rng = np.random.default_rng(3)
    for _ in range(30):  # a contour has the part's pixels that one can see from outside, and steps to neighbours
        labels, n = D.components(rng.random((12, 14)) < 0.45)
        part = labels == 1 + int(rng.integers(n))
        pad = np.pad(part, 1)
        out, work = np.zeros_like(pad), [(0, 0)]
        while work:
            y, x = work.pop()
            if 0 <= y < pad.shape[0] and 0 <= x < pad.shape[1] and not pad[y, x] and not out[y, x]:
                out[y, x] = True
                work += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        seen = {(x, y) for y, x in zip(*np.nonzero(part)) if any(out[y + 1 + a, x + 1 + b] for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
        c = D.outer_contour(part)
        assert set(c) == seen and all(max(abs(a - e), abs(b - f)) <= 1 for (a, b), (e, f) in zip(c, c[1:] + c[:1]))
    box = np.array([[0, 0], [10, 0], [10, 6], [0, 6]], float)
    grown = D.offset_polygon(box, 2, 0.001)
    assert np.allclose([grown.min(0), grown.max(0)], [[-2, -2], [12, 8]]) and abs(abs(D._ring_area(grown)) - (60 + 2 * 32 + np.pi * 4)) < 0.05
    bent = np.array([[0, 0], [20, 0], [20, 20], [14, 20], [14, 6], [0, 6]], float)
    out = D.offset_polygon(bent, 2, 0.001)
    far = lambda q: min(np.hypot(*(q - (a + (b - a) * np.clip(((q - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1)))) for a, b in zip(bent, np.roll(bent, -1, axis=0)))
    assert min(far(q) for q in out) > 1.99 and abs(abs(D._ring_area(out)) - (20 * 6 + 14 * 6 + 2 * 80 + 5 * np.pi - 2 * 2)) < 0.05  # five corners point out, one in
    prob = np.zeros((60, 80), np.float32)
    prob[10:18, 5:60] = prob[10:50, 52:60] = 0.9
    ((poly, score),) = D.polygons_of_map(prob)
    assert score > 0.89 and len(poly) > 6 and not D.inside_polygon(np.array(poly), np.array([20.0]), np.array([40.0]))[0] and D.inside_polygon(np.array(poly), np.array([3.5]), np.array([14.0]))[0]
    rows = spark.createDataFrame([(1, prob.ravel().tolist(), 80)], "page_id long, prob array<float>, width int")
    assert [len(r.polygon) for r in D.detect_boxes(rows, polygons=True).collect()] == [len(poly)]


def test_tiles_and_batches(spark):
    t = spark.createDataFrame([(9600, 800), (3000, 2000)], "w int, h int").select("w", D.should_tile(F.col("w"), F.col("h")).alias("t")).collect()
    assert [r.t for r in t] == [4000, 0]
    plan = spark.range(1).select(D.tile_plan(F.lit(9600), F.lit(4000)).alias("p")).first().p
    assert [(x.start, x.length) for x in plan] == [(0, 4000), (3616, 4000), (5600, 4000)]
    assert D.plan_batches([1, 2, 3, 10], 3, 48) == [(0, 3), (3, 4)]
    with pytest.raises(ValueError):
        D.plan_batches([100], 3, 48, 10)
    ch = lambda t, s: {"token": t, "probability": 1.0, "first_step": s, "last_step": s}
    assert D.stitch([(0, 10), (6, 10)], [[ch("a", 1), ch("b", 7)], [ch("b", 1), ch("c", 3), ch("d", 8)]], 1.0, 16)[0] == "abcd"


def test_text_of_pages():
    row = lambda t, x, y, w=None: {"text": t, "confidence": 1.0, "min_x": float(x), "min_y": float(y), "max_x": float(x + 10 * len(t) if w is None else x + w), "max_y": float(y + 10)}
    page = [row("Name", 0, 0), row("Total", 200, 1), row("x", 0, 60)]
    assert layout_lines(page) == "Name                Total\n\nx"
    assert joined_rows(page) == "Name Total\nx" and layout_lines([]) == "" and joined_rows([row(" ", 0, 0)]) == ""
    assert group_rows([(0, 0, 10, 10), (20, 1, 30, 11), (0, 8, 10, 18)]) == [[0, 1], [2]]
    block = [row("exam-", 0, 0, 100), row("ple text", 0, 12, 100), row("ends", 0, 24, 40), row("new", 0, 36, 100)]
    assert block_text(block) == "example text ends\nnew"
    assert block_text([row("日本", 0, 0, 100), row("語", 0, 12, 100)]) == "日本語" and block_text([]) == ""
    assert display_order("abc") == "abc" and display_order("שלום (1)") == "1) םולש"[::1].replace("1) ", "(1) ") and display_order(None) is None


def test_recogniser_and_chat(spark):
    images = spark.createDataFrame([("a", b"one\ntwo"), ("b", b"\xff"), ("c", None)], "path string, content binary")
    pages = recognize(images, FakeRecognizer)
    assert {r.path: r.error for r in pages.collect()} == {"a": None, "b": "not readable", "c": "no content"}
    assert [(r.path, r.line_index, r.text) for r in explode_lines(pages).collect()] == [("a", 0, "one"), ("a", 1, "two")]
    with pytest.raises(Exception, match="not readable|no content"):
        recognize(images, FakeRecognizer, stop_at_error=True).collect()
    makers = [(lambda n: lambda: type("M", (), {"recognize": lambda self, c: [{"text": n, "confidence": 1.0}] if c else 1 / 0})())(n) for n in "ab"]
    assert [{r.lines[0].text if r.lines else r.error for r in recognize(images.limit(1).coalesce(1), m).collect()} for m in makers] == [{"a"}, {"b"}]
    none = spark.createDataFrame([("d", b"")], "path string, content binary")
    assert recognize(none, makers[0]).first().error == "ZeroDivisionError: division by zero"
    given = images.withColumn("polygons", F.expr("array(array(struct(0d as x, 22d as y), struct(9d as x, 22d as y), struct(9d as x, 36d as y)), array(struct(0d as x, 0d as y)), array(struct(0d as x, 90d as y), struct(1d as x, 90d as y), struct(1d as x, 91d as y)))"))
    read = {r.path: r for r in recognize_regions(given, FakeRecognizer).collect()}
    assert [(x.region_index, x.text, x.min_y, x.max_y) for x in read["a"].lines] == [(0, "two", 22.0, 36.0)] and read["b"].error == "not readable" and read["c"].error == "no content"
    docs = spark.createDataFrame([(1, "text"), (2, "fail")], "doc_id long, markdown string")
    rows = extract_with_model(docs, ["Name", "Total", "none"], echo()).orderBy("doc_id", "key_ordinal").collect()
    assert [(r.key, r.value, r.prompt_tokens) for r in rows[:3]] == [("Name", "A}b", 3), ("Total", "12.50", 3), ("none", None, 3)] and rows[3].error == "down"
    assert ask(docs, "why?", echo()).filter("error is null").count() == 1
    chart = parse_charts(images.limit(1), echo()).first()
    assert (chart.type, chart.title, chart.data) == ("bar", None, "|a|")
    assert first_json_object('x {"a": "}\\"", "b": {}} y') == '{"a": "}\\"", "b": {}}' and first_json_object("{a") == "{a" and first_json_object("none") is None
    assert fields_of_reply("[1]", ["a"]) == [None] and fields_of_reply('{"a": null, "b": true}', ["a", "b"]) == [None, "true"]


def test_inputs(spark):
    assert I.parse_page_range("1-3, 5,7-") == [(1, 3), (5, 5), (7, None)] and I.parse_page_range(" ") == [] and I.parse_page_range("-2") == [(1, 2)]
    for bad in ("1,,2", "-", "1-2-3", "3-1", "0", "a", ","):
        with pytest.raises(ValueError):
            I.parse_page_range(bad)
    pages = spark.range(1, 9).selectExpr("1 as doc_id", "cast(id as int) as page_number")
    assert [r.page_number for r in I.select_pages(pages, "2-3,3,7-").orderBy("page_number").collect()] == [2, 3, 7, 8]
    for wanted in ("20-", "1-5"):
        with pytest.raises(Exception, match="page"):
            I.select_pages(pages, wanted, most=3).collect()
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    images = spark.createDataFrame([("p", png, None), ("x", b"abc", None)], "path string, content binary, error string")
    assert {r.path: r.s for r in images.select("path", I.image_size(F.col("content")).alias("s")).collect()}["p"] == (640, 480)
    assert {r.path: r.error for r in I.guard_pixels(images, 1000).collect()} == {"p": "too many pixels", "x": "no image of a known size"}
    le, be = lambda v, n: v.to_bytes(n, "little"), lambda v, n: v.to_bytes(n, "big")
    webp = lambda form, body: b"RIFF" + le(99, 4) + b"WEBP" + form + le(10, 4) + body + b"\0" * 8
    tiff = lambda order, o: order + o(42, 2) + o(8, 4) + o(3, 2) + b"".join(o(t, 2) + o(k, 2) + o(1, 4) + (o(v, 2) + b"\0\0" if k == 3 else o(v, 4)) for t, k, v in ((254, 4, 0), (256, 3, 700), (257, 4, 300)))
    jpeg = b"\xff\xd8\xff\xe1" + be(70_000 % 65536, 2) + b"x" * (70_000 % 65536 - 2) + b"\xff\xff\xc2" + be(11, 2) + b"\x08" + be(300, 2) + be(700, 2) + b"\0" * 9
    forms = {
        "gif": b"GIF89a" + le(700, 2) + le(300, 2), "bmp": b"BM" + b"\0" * 16 + le(700, 4) + (-300).to_bytes(4, "little", signed=True), "jpeg": jpeg, "tiff": tiff(b"II", le), "motorola": tiff(b"MM", be),
        "vp8x": webp(b"VP8X", b"\0" * 4 + le(699, 3) + le(299, 3)), "vp8l": webp(b"VP8L", b"\x2f" + le(699 | 299 << 14, 4)), "vp8": webp(b"VP8 ", b"\0" * 6 + le(700, 2) + le(300, 2)),
    }
    files = spark.createDataFrame([(k, v, None) for k, v in forms.items()] + [("cut", jpeg[:40], None), ("none", None, None)], "path string, content binary, error string")
    assert {r.path: r.s for r in files.select("path", I.image_size(F.col("content")).alias("s")).collect()} == {k: (700, 300) for k in forms} | {"cut": None, "none": None}
    assert {r.error for r in I.guard_pixels(files.filter("path <> 'none'"), 209_999).collect()} == {"too many pixels", "no image of a known size"}
    assert {r.error for r in I.guard_pixels(files.filter("path <> 'cut'"), 210_000).collect()} == {None}
    assert I.parse_label_map("a: 1\nlabel_list:\n- text\n- 'doc_title'\nnext: 2") == [(0, "text"), (1, "doc_title")] and I.parse_label_map("x\n\ny") == [(0, "x"), (1, "y")]
    assert [r.type for r in I.label_map(spark, "text\nimage\nodd").orderBy("class_id").collect()] == ["Text", "Figure", "Unknown"]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(I.language_code(F.lit(" ENG "))) == "en" and one(I.language_code(F.lit("xx"))) is None
    assert one(I.normalise_languages(F.array(F.lit(" En"), F.lit("en"), F.lit("")))) == ["en"] and one(I.allow_list(F.lit("aab"))) == ["a", "b"]


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.txt").write_bytes(b"\xff" if i == 3 else f"page {i}".encode())
    options = BatchOptions(window=2)
    for _ in range(2):  # a restart reads nothing twice
        q = write_pages(recognise_files(file_stream(spark, str(folder), "*.txt", options), FakeRecognizer, options), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(120)
    pages = spark.read.parquet(str(tmp_path / "out"))
    assert tuple(progress(pages).first()) == (4, 1, 5)
    with pytest.raises(ValueError):
        BatchOptions(window=0)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_frames_and_pages(spark):
    def decoder():
        class Decoder:
            def frames(self, content):
                for i, part in enumerate(content.split(b"|")):
                    if part == b"bad":
                        raise RuntimeError("broken frame")
                    yield len(part), i + 1, part

        return Decoder()

    images = spark.createDataFrame([("a", b"one|three"), ("b", b"x|bad|y"), ("c", None), ("d", b"1|2|3|4")], "path string, content binary")
    got = [(r.path, r.frame_index, r.pixels and bytes(r.pixels), r.error) for r in rendering.read_frames(images, decoder, most_frames=3).collect()]
    assert got == [("a", 0, b"one", None), ("a", 1, b"three", None), ("b", 0, b"x", None), ("b", None, None, "RuntimeError: broken frame"), ("c", None, None, "no content"), ("d", 0, b"1", None), ("d", 1, b"2", None), ("d", 2, b"3", None), ("d", None, None, "more than 3 frames")]
    assert [r.error for r in rendering.read_frames(images.limit(1), decoder, most_pixels=5).collect()] == [None, "too many pixels"]

    def renderer():
        class Renderer:
            def sizes(self, content):
                return [(72.0 * (i + 1), 36.0) for i in range(len(content))]

            def render(self, content, page, dpi):
                return page * dpi, dpi // 2, content[page - 1 : page]

        return Renderer()

    files = spark.createDataFrame([("a", b"xyz"), ("b", b"")], "path string, content binary")
    pages = rendering.render_pages(files, renderer, "2-", O.PdfOptions(dpi=100)).collect()
    assert [(r.path, r.page_number, r.width, r.height, r.pixels and bytes(r.pixels)) for r in pages] == [("a", 2, 200, 50, b"y"), ("a", 3, 300, 50, b"z"), ("b", None, None, None, None)] and pages[2].error == "the page range selects no page"
    assert [r.width for r in rendering.render_pages(files, renderer, "1", auto_dpi=True).filter("error is null").collect()] == [400]
    assert {r.error for r in rendering.render_pages(files.limit(1), renderer, None, O.PdfOptions(most_pages=2)).collect()} == {"more than 2 pages"}
    assert [r.error for r in rendering.render_pages(files.limit(1), renderer, None, O.PdfOptions(dpi=72, most_pixels=72 * 36)).collect()] == [None, "page 2 has too many pixels"]


def test_keyed_state(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    parts = tmp_path / "in"
    for i in range(3):
        events.filter(F.pmod(F.col("event_id"), F.lit(3)) == i).write.mode("append").parquet(str(parts))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(parts))
    q = running_totals(stream).writeStream.format("memory").queryName("totals_so_far").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r.user_id: (r.n, round(r.total, 4)) for r in spark.sql("SELECT user_id, max(n) AS n, max_by(total, n) AS total FROM totals_so_far GROUP BY user_id").collect()}
    want = {r.user_id: (r.n, round(r.total, 4)) for r in events.filter("value is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()}
    assert got == want
