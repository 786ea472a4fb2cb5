import io
import zipfile

import pytest
from pyspark.sql import functions as F

from papyra.export.latex import to_omml
from papyra.export.office import docx, docx_bytes, save_files, sheet_names, xlsx, xlsx_bytes
from papyra.operators.tables import lenient_grid, strict_grid, table_html, decode_tokens
from papyra.sources.office import Limits, address, cell_address, office_blocks, read_office, read_office_files

TABLE = "<table><tr><td rowspan='2'>a</td><td colspan='2'>b&amp;c</td></tr><tr><td>d</td><td>e</td></tr></table>"
BLOCKS = [{"type": "DocTitle", "text": "Häding"}, {"type": "Text", "text": "one\ntwo"}, {"type": "Table", "text": None, "table_html": TABLE}, {"type": "Formula", "text": None, "latex": r"\frac{a}{b_1^2}+\sqrt[3]{x}"}]


def test_docx_round_trip():
    rows = read_office(docx_bytes(BLOCKS))
    assert [(r["kind"], r["text"]) for r in rows[:2]] == [("paragraph", "Häding"), ("paragraph", "one\ntwo")]
    cells = [(r["row"], r["col"], r["row_span"], r["col_span"], r["text"]) for r in rows if r["kind"] == "cell"]
    assert cells == [(0, 0, 2, 1, "a"), (0, 1, 1, 2, "b&c"), (1, 1, 1, 1, "d"), (1, 2, 1, 1, "e")]
    assert docx_bytes(BLOCKS) == docx_bytes(BLOCKS)


def test_xlsx_round_trip():
    rows = read_office(xlsx_bytes(BLOCKS))
    assert [(r["section_name"], r["row"], r["col"], r["row_span"], r["col_span"], r["text"]) for r in rows] == [("Häding", 0, 0, 2, 1, "a"), ("Häding", 0, 1, 1, 2, "b&c"), ("Häding", 1, 1, 1, 1, "d"), ("Häding", 1, 2, 1, 1, "e")]
    assert [r["text"] for r in read_office(xlsx_bytes(BLOCKS[:2]))] == ["Häding", "one\ntwo"]
    assert sheet_names(["a/b", "A b", "", "x" * 40, "x" * 40]) == ["a b", "A b (2)", "Sheet3", "x" * 31, "x" * 27 + " (2)"]
    assert [cell_address(address(r, c)) for r, c in ((0, 0), (9, 25), (3, 26), (5, 701), (1, 702))] == [(0, 0), (9, 25), (3, 26), (5, 701), (1, 702)]
    with pytest.raises(ValueError):
        cell_address("A0")


def test_bounds_and_broken_files():
    data = docx_bytes(BLOCKS)
    for bad, limits in ((b"", Limits()), (b"nonsense", Limits()), (data, Limits(file_bytes=10)), (data, Limits(entries=1)), (data, Limits(part_bytes=50)), (data, Limits(blocks=1)), (data[:-30], Limits())):
        with pytest.raises(ValueError):
            read_office(bad, limits)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<!DOCTYPE x [<!ENTITY a "b">]><Types/>')
    with pytest.raises(ValueError):
        read_office(out.getvalue())


def test_files_in_spark(spark, tmp_path):
    rows = [(d, 1, i, b["type"], b.get("text"), b.get("table_html"), b.get("latex")) for d in (1, 2) for i, b in enumerate(BLOCKS)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, block_order int, type string, text string, table_html string, latex string")
    made = docx(df).withColumnRenamed("docx", "file")
    paths = save_files(made, "file", str(tmp_path), F.concat("doc_id", F.lit(".docx"))).collect()
    assert len(paths) == 2
    save_files(xlsx(df), "xlsx", str(tmp_path), F.concat("doc_id", F.lit(".xlsx"))).collect()
    (tmp_path / "bad.docx").write_bytes(b"x")
    found = read_office_files(spark, str(tmp_path))
    assert found.filter("error is not null").count() == 1
    assert found.filter("kind = 'cell'").count() == 16


def test_formulas():
    assert to_omml("x_1^{2}") == '<m:oMath><m:sSubSup><m:e><m:r><m:t xml:space="preserve">x</m:t></m:r></m:e><m:sub><m:r><m:t xml:space="preserve">1</m:t></m:r></m:sub><m:sup><m:r><m:t xml:space="preserve">2</m:t></m:r></m:sup></m:sSubSup></m:oMath>'
    for latex in (r"\sum_{i=1}^n i", r"\left( \frac{1}{2} \right]", r"\begin{pmatrix} a & b \\ c & d \end{pmatrix}", r"\hat{x} \in \mathrm{sin} \alpha < 3", r"\unknown{}", "{", "}", "^", r"\frac{a", "x'"):
        import xml.etree.ElementTree as ET

        ET.fromstring(to_omml(latex).replace("<m:oMath>", '<m:oMath xmlns:m="m">', 1))
    assert "α" in to_omml(r"\alpha") and 'm:val="∑"' in to_omml(r"\sum_i x")


def test_tables():
    import numpy as np

    assert [(c["row"], c["col"], c["row_span"], c["col_span"], c["text"]) for c in lenient_grid(TABLE)] == [(0, 0, 2, 1, "a"), (0, 1, 1, 2, "b&c"), (1, 1, 1, 1, "d"), (1, 2, 1, 1, "e")]
    assert lenient_grid("<tr><td>a<br>b") [0]["text"] == "a\nb" and lenient_grid("plain") is None and lenient_grid(None) is None
    assert len(strict_grid(TABLE)) == 4
    for bad in ("<table><tr><td>a</tr></table>", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "<x/>", "<table><tr><td rowspan='0'>a</td></tr></table>", "<!DOCTYPE x><table/>", "<table><tr><td rowspan='3'>a</td></tr></table>"):
        with pytest.raises(ValueError):
            strict_grid(bad)
    line = lambda t, x, y: {"text": t, "min_x": x, "min_y": y, "max_x": x + 10, "max_y": y + 10}
    got = table_html(["<tr>", "<td></td>", "<td", ' colspan="2"', ">", "</td>", "</tr>"], {0: [line("b", 20, 1), line("a<", 0, 0), line("c", 0, 30)], 1: [line("d", 0, 0)]})
    assert got == '<html><body><table><tr><td>a&lt; b<br>c</td><td colspan="2">d</td></tr></table></body></html>'
    probs, boxes = np.eye(4)[[0, 1, 2, 3, 1]], np.tile([0.1, 0.2, 0.5, 0.2, 0.5, 0.9, 0.1, 0.9], (5, 1))
    tokens, cells = decode_tokens(probs, boxes, ["sos", "<tr>", "<td></td>", "eos"], 0, 3, 100, 100, 40, 100)
    assert tokens == ["<tr>", "<td></td>"] and np.allclose(cells, [[10, 20, 40, 90]], atol=1e-4)
