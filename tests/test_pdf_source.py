import zlib

import pytest
from pyspark.sql import functions as F

from papyra.export.pdf import pdf_bytes
from papyra.sources import pdf as P


def line(text, x, y, w=100.0):
    return {"text": text, "confidence": 1.0, "min_x": x, "min_y": y, "max_x": x + w, "max_y": y + 20.0}


def build(objects, trailer="/Root 1 0 R"):
    """A file of numbered objects without a cross-reference."""
    body = b"".join(b"%d 0 obj\n" % n + (o if isinstance(o, bytes) else o.encode("latin-1")) + b"\nendobj\n" for n, o in objects.items())
    return b"%PDF-1.4\n" + body + f"trailer << {trailer} >>\n".encode()


def stream(data, head=""):
    return f"<< /Length {len(data)} {head} >>\nstream\n".encode() + data + b"\nendstream"


def text_of(data):
    return ["".join(g["value"] for g in glyphs) for _, _, glyphs, _ in P.read_pages(data)]


def test_objects():
    r = P.Reader(b"<< /A#42 [1 -2.5 (a\\(b\\)\\051\\n(c)) <414> true null 7 0 R] % note\n /B /C >>")
    x = r.next()
    assert x == {"AB": [1, -2.5, b"a(b))\n(c)", b"A@", True, None, P.Ref(7)], "B": "C"} and isinstance(x["AB"][6], P.Ref)
    with pytest.raises(EOFError):
        r.next()


def test_simple_fonts_forms_and_rotation():
    font = "<< /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [500 500 500] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [66 /eacute /uni65E5 /fi] >> >>"
    content = b"q 1 0 0 1 10 20 cm BT /F1 10 Tf 12 TL 100 700 Td (AB) Tj T* [(C) -500 (D)] TJ ET Q /X1 Do BI /W 1 ID \x00(no) EI BT /F1 5 Tf 1 0 0 1 5 5 Tm (A) ' ET"
    objects = {
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R 9 0 R] /MediaBox [0 0 200 800] /Resources << /Font << /F1 4 0 R >> /XObject << /X1 6 0 R >> >> >>",
        3: "<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>", 4: font, 5: stream(zlib.compress(content), "/Filter /FlateDecode"), 6: stream(b"BT /F1 10 Tf (A) Tj ET", "/Subtype /Form /Matrix [1 0 0 1 50 60]"),
        9: "<< /Type /Page /Parent 2 0 R /Contents 10 0 R /Rotate 90 >>", 10: stream(b"BT /F1 10 Tf 20 700 Td (A) Tj ET"),
    }
    data = build(objects)
    pages = list(P.read_pages(data))
    assert text_of(data) == ["Aé日fiAA", "A"]
    g = pages[0][2]
    assert (round(g[0]["left"]), round(g[0]["bottom"] - 2.5), g[0]["em"]) == (110, 80, 10) and round(g[2]["left"]) == 110 and round(g[2]["bottom"] - g[0]["bottom"]) == 12
    assert round(g[3]["left"] - g[2]["right"], 3) == 5.0 and [round(x["left"]) for x in g[5:7]] == [50, 5]
    turned = pages[1][1], pages[1][2][0]
    assert (turned[0].width, turned[0].height) == (800, 200) and abs(turned[1]["left"] - 697.5) < 1e-6 and abs(turned[1]["top"] - 20) < 1e-6


def test_packed_objects_and_maps():
    inner = b"1 0 2 40 << /Type /Catalog /Pages 2 0 R >>          << /Type /Pages /Kids [3 0 R] >>"
    cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfchar <01> <00480069> endbfchar 2 beginbfrange <02> <03> <0041> <04> <05> [<0062> <0063>] endbfrange"
    objects = {
        3: "<< /Type /Page /MediaBox [0 0 100 100] /Contents 5 0 R /Resources << /Font << /F 4 0 R >> >> >>", 4: "<< /Subtype /Type0 /ToUnicode 6 0 R /DescendantFonts [<< /DW 1000 /W [1 [500] 2 3 250] >>] >>",
        5: stream(b"BT /F 10 Tf 0 50 Td <0102030405> Tj ET"), 6: stream(cmap), 7: stream(zlib.compress(inner), "/Type /ObjStm /N 2 /First 9 /Filter /FlateDecode"),
    }
    data = build(objects)
    ((_, _, glyphs, error),) = P.read_pages(data)
    assert error is None and "".join(g["value"] for g in glyphs) == "HiABbc"
    assert [round(g["right"] - g["left"], 6) for g in glyphs] == [5, 5, 2.5, 2.5, 10, 10]
    rows = b"\x02\x01\x02\x03\x01\x01\x01\x01\x03\x02\x04\x06\x04\x01\x01\x01"
    assert P._unpredict(rows, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 1, 2, 3, 2, 6, 10, 3, 7, 11])


def test_bounds_and_broken_files():
    good = pdf_bytes([([line("Hello wörld", 10, 10)], 200, 100, None), ([line("two", 10, 10)], 200, 100, None)])
    assert text_of(good) == ["Hello wörld", "two"]
    assert text_of(good[: good.index(b"xref")]) == ["Hello wörld", "two"]  # no table, no trailer
    for bad, limits, said in ((b"", P.Limits(), "no PDF"), (good, P.Limits(file_bytes=9), "too large"), (good, P.Limits(pages=1), "more than 1"), (good.replace(b"/Root", b"/Encrypt 9 0 R /Root"), P.Limits(), "encrypted")):
        with pytest.raises(ValueError, match=said):
            list(P.read_pages(bad, limits))
    assert [e for *_, e in P.read_pages(good, P.Limits(expanded_bytes=50))][0] == "file too large when unpacked"
    loop = build({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Kids [2 0 R 3 0 R] >>", 3: "<< /Type /Page /Contents 4 0 R /Resources << /XObject << /X 4 0 R >> >> >>", 4: stream(b"/X Do", "/Subtype /Form")})
    assert [e for *_, e in P.read_pages(loop)] == ["forms too deep in each other"]
    for i in range(0, len(good), 97):  # whatever is cut off
        try:
            list(P.read_pages(good[:i]))
        except ValueError:
            pass


def test_glyph_names():
    assert [P.glyph_character(n) for n in ("A", "eacute", "Scaron", "uni00E9", "u1F600", "germandbls", "nonsense", "qacute")] == ["A", "é", "Š", "é", "😀", "ß", None, None]


def test_in_spark(spark, tmp_path):
    words = "Words enough for the gate of quality"
    (tmp_path / "a.pdf").write_bytes(pdf_bytes([([line(words, 10, 10, 180)], 200, 100, None), ([line("x", 10, 10)], 200, 100, None)], 72.0))
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    files = P.read_pdf_files(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert sorted((r.path, r.page_number, r.width, r.error) for r in P.pdf_pages(files).collect() if r.path == "a.pdf") == [("a.pdf", 1, 200.0, None), ("a.pdf", 2, 200.0, None)]
    assert [r.error for r in P.pdf_pages(files).filter("path = 'b.pdf'").collect()] == ["no PDF file"]
    seen = spark.createDataFrame([("a.pdf", p, 0, f"read {p}", 0.9, 10.0, 10.0, 190.0, 30.0) for p in (1, 2)], "path string, page_number int, line_index int, text string, confidence double, min_x double, min_y double, max_x double, max_y double")
    lines = lambda mode: sorted((r.page_number, r.text, r.source) for r in P.pdf_lines(files, mode, recognised=seen).collect())
    assert lines("Prefer") == lines("Auto") == [(1, words, "EmbeddedText"), (2, "read 2", "Ocr")]
    assert lines("Ignore") == [(1, "read 1", "Ocr"), (2, "read 2", "Ocr")]
    assert (1, words, "EmbeddedText") in lines("Hybrid") and (1, "read 1", "Ocr") not in lines("Hybrid")
    with pytest.raises(ValueError):
        P.pdf_lines(files, "Other")
    assert P.pdf_glyphs(files.limit(0)).count() == 0


def test_text_layer_has_lines_of_marks_alone(spark, tmp_path):
    from papyra.plans.queries import QUERIES

    spark.createDataFrame([(1, "a" * 40 + "."), (2, "?")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.path, r.line_index, r.text) for r in QUERIES["pdf_text_layer"](spark, str(tmp_path)).collect())
    assert got == [("1", 0, "a" * 40), ("1", 1, "."), ("2", 0, "?")]
