import re
import zlib

from papyra.export.pdf import aligned_words, pdf_bytes, searchable_pdf


def texts(data):
    """Texts of a file, read back through its own character map."""
    streams = [zlib.decompress(m[2]).decode("latin-1") for m in re.finditer(rb"<< /Length (\d+) /Filter /FlateDecode >>\nstream\n(.*?)\nendstream", data, re.S)]
    chars = {a: bytes.fromhex(b).decode("utf-16-be") for s in streams for a, b in re.findall(r"<([0-9A-F]{4})> <([0-9A-F]{4,8})>\n", s + "\n") if "beginbfchar" in s}
    return ["".join(chars[x[i : i + 4]] for i in range(0, len(x), 4)) for s in streams for x in re.findall(r"<([0-9A-F]+)> Tj", s)]


LINE = {"text": "Añ 😀 b", "min_x": 10.0, "min_y": 10.0, "max_x": 110.0, "max_y": 30.0}


def test_text_comes_back():
    data = pdf_bytes([([LINE, LINE | {"text": " "}], 200, 100, None), ([LINE | {"text": "two"}], 200, 100, b"\xff\xd8jpeg")])
    assert texts(data) == ["Añ 😀 b", "two"] and b"/Count 2" in data and b"/DCTDecode" in data
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[start : start + 4] == b"xref"
    for i, place in enumerate(re.findall(rb"(\d{10}) 00000 n", data), 1):
        assert data[int(place) :].startswith(f"{i} 0 obj".encode())
    assert texts(pdf_bytes([])) == []


def test_words():
    word = lambda t, x: LINE | {"text": t, "min_x": float(x), "max_x": x + 10.0}
    assert [t for t, _ in aligned_words(LINE | {"text": "a b", "words": [word("a", 0), word("b", 20)]})] == ["a ", "b"]
    rtl = LINE | {"text": "\u05e9\u05dc \u05d0", "words": [word("\u05e9\u05dc", 20), word("\u05d0", 0)]}
    assert [t for t, _ in aligned_words(rtl)] == ["\u05e9\u05dc ", "\u05d0"]
    assert [t for t, _ in aligned_words(LINE | {"text": "a b", "words": [word("x", 0)]})] == ["a b"]


def test_files(spark):
    rows = [(d, p, i, f"doc {d} page {p}", 0.0, 20.0 * i, 100.0, 20.0 * i + 10) for d in (1, 2) for p in (1, 2) for i in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, line_index int, text string, min_x double, min_y double, max_x double, max_y double")
    got = {r.doc_id: texts(bytes(r.pdf)) for r in searchable_pdf(df, "doc_id", "page_number", "line_index", 200, 100).collect()}
    assert got[2] == ["doc 2 page 1"] * 2 + ["doc 2 page 2"] * 2
