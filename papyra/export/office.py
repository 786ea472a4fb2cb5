"""Documents as DOCX and tables as XLSX, one file's bytes for each document."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.export.latex import to_omml
from papyra.functions.paging import by_page
from papyra.operators.tables import lenient_grid
from papyra.sources.office import address

_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_CT = "http://schemas.openxmlformats.org/package/2006/content-types"
_PR = "http://schemas.openxmlformats.org/package/2006/relationships"
_OR = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _clean(text: str | None) -> str:
    return escape(_BAD.sub("", text or ""))


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _XML + body)  # the same bytes for the same rows
    return out.getvalue()


def _paragraph(text: str, style: str | None = None) -> str:
    look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    lines = "<w:br/>".join(f'<w:t xml:space="preserve">{_clean(x)}</w:t>' for x in text.split("\n"))
    return f"<w:p>{look}<w:r>{lines}</w:r></w:p>"


def docx_table(html: str | None, text: str | None) -> str:
    """A table with spans: columns as gridSpan, rows as vMerge; what has no grid is one cell of text."""
    cells = lenient_grid(html) or [{"row": 0, "col": 0, "row_span": 1, "col_span": 1, "text": (text or "").strip()}]
    width, height = max(c["col"] + c["col_span"] for c in cells), max(c["row"] + c["row_span"] for c in cells)
    at = {(c["row"] + i, c["col"]): (c, i) for c in cells for i in range(c["row_span"])}
    rows = []
    for r in range(height):
        col, out = 0, []
        while col < width:
            cell, i = at.get((r, col), (None, 0))
            span = cell["col_span"] if cell else 1
            props = f'<w:gridSpan w:val="{span}"/>' * (span > 1)
            if cell and cell["row_span"] > 1:
                props += '<w:vMerge w:val="restart"/>' if i == 0 else "<w:vMerge/>"
            out.append(f"<w:tc><w:tcPr>{props}</w:tcPr>{_paragraph(cell['text'] if cell and i == 0 else '')}</w:tc>")
            col += span
        rows.append(f"<w:tr>{''.join(out)}</w:tr>")
    grid = "<w:gridCol/>" * width
    return f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr><w:tblGrid>{grid}</w:tblGrid>{"".join(rows)}</w:tbl><w:p/>'


def docx_bytes(blocks: list[dict]) -> bytes:
    body = []
    for b in blocks:
        kind, text = b["type"], (b.get("text") or "").strip()
        if kind == "Table":
            body.append(docx_table(b.get("table_html"), text))
        elif kind == "Formula" and (b.get("latex") or "").strip():
            body.append(f"<w:p><m:oMathPara>{to_omml(_BAD.sub('', b['latex']))}</m:oMathPara></w:p>")
        elif kind in ("Figure", "Chart", "Seal"):
            body.append(_paragraph(f"[{kind}] {text}".strip()))
        elif text:
            body.append(_paragraph(text, {"DocTitle": "Title", "Title": "Heading1", "Abstract": "Heading2"}.get(kind)))
    style = lambda i, name, size: f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{name}"/><w:rPr><w:b/><w:sz w:val="{size}"/></w:rPr></w:style>'
    borders = "".join(f'<w:{s} w:val="single" w:sz="4"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
    return _zip({
        "[Content_Types].xml": f'<Types xmlns="{_CT}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PR}"><Relationship Id="rId1" Type="{_OR}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{_PR}"><Relationship Id="rId1" Type="{_OR}/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f'<w:styles {_W}>{style("Title", "Title", 40)}{style("Heading1", "heading 1", 32)}{style("Heading2", "heading 2", 28)}<w:style w:type="table" w:styleId="TableGrid"><w:name w:val="Table Grid"/><w:tblPr><w:tblBorders>{borders}</w:tblBorders></w:tblPr></w:style></w:styles>',
        "word/document.xml": f"<w:document {_W}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>",
    })


def sheet_names(wanted: list[str]) -> list[str]:
    """Names without forbidden characters, at most 31 long, none twice whatever the letter case."""
    out, seen = [], set()
    for i, name in enumerate(wanted, 1):
        name = re.sub(r"[\[\]:*?/\\\x00-\x1f]", " ", name or "").strip().strip("'")[:31].strip() or f"Sheet{i}"
        base, k = name, 2
        while name.lower() in seen:
            end = f" ({k})"
            name, k = base[: 31 - len(end)] + end, k + 1
        seen.add(name.lower())
        out.append(name)
    return out


def _sheet(cells: list[dict]) -> str:
    rows: dict[int, list[dict]] = {}
    for c in sorted(cells, key=lambda c: (c["row"], c["col"])):
        rows.setdefault(c["row"], []).append(c)
    one = lambda c: f'<c r="{address(c["row"], c["col"])}" t="inlineStr"><is><t xml:space="preserve">{_clean(c["text"])}</t></is></c>'
    data = "".join(f'<row r="{r + 1}">{"".join(map(one, cs))}</row>' for r, cs in rows.items())
    spans = [f"{address(c['row'], c['col'])}:{address(c['row'] + c['row_span'] - 1, c['col'] + c['col_span'] - 1)}" for c in cells if c["row_span"] > 1 or c["col_span"] > 1]
    merges = f'<mergeCells count="{len(spans)}">{"".join(f"<mergeCell ref={quoteattr(s)}/>" for s in spans)}</mergeCells>' if spans else ""
    return f"<worksheet {_S}><sheetData>{data}</sheetData>{merges}</worksheet>"


def xlsx_bytes(blocks: list[dict]) -> bytes:
    """A sheet for each table, named after the last title before it; without tables one sheet of the blocks' texts."""
    sheets, title = [], ""
    for b in blocks:
        if b["type"] in ("DocTitle", "Title", "TableCaption"):
            title = b.get("text") or ""
        cells = lenient_grid(b.get("table_html")) if b["type"] == "Table" else None
        if cells:
            sheets.append((title or f"Table {len(sheets) + 1}", cells))
    if not sheets:
        texts = [t for t in ((b.get("text") or "").strip() for b in blocks) if t]
        sheets = [("Text", [{"row": i, "col": 0, "row_span": 1, "col_span": 1, "text": t} for i, t in enumerate(texts)])]
    names = sheet_names([t for t, _ in sheets])
    n = range(1, len(sheets) + 1)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
    return _zip({
        "[Content_Types].xml": f'<Types xmlns="{_CT}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PR}"><Relationship Id="rId1" Type="{_OR}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PR}">' + "".join(f'<Relationship Id="rId{i}" Type="{_OR}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>",
        "xl/workbook.xml": f'<workbook {_S} xmlns:r="{_OR}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, names)) + "</sheets></workbook>",
    } | {f"xl/worksheets/sheet{i}.xml": _sheet(cells) for i, (_, cells) in zip(n, sheets)})


def _files(blocks: DataFrame, document: str, order: list[str], make, name: str) -> DataFrame:
    def run(rows: list[dict]):
        yield {document: rows[0][document], name: make(rows)}

    keep = [document, *order, "type", "text", *[c for c in ("table_html", "latex") if c in blocks.columns]]
    return by_page(blocks.select(*keep), [document], order, run, f"{document} {dict(blocks.dtypes)[document]}, {name} binary")


def docx(blocks: DataFrame, document: str = "doc_id", order: tuple[str, ...] = ("page_number", "block_order")) -> DataFrame:
    return _files(blocks, document, list(order), docx_bytes, "docx")


def xlsx(blocks: DataFrame, document: str = "doc_id", order: tuple[str, ...] = ("page_number", "block_order")) -> DataFrame:
    return _files(blocks, document, list(order), xlsx_bytes, "xlsx")


def save_files(files: DataFrame, column: str, folder: str, name: F.Column) -> DataFrame:
    """Writes each row's bytes to folder/name, first under another name: a file is whole or not there. Returns the paths."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{base}/.{n}.part") as f:
                    f.write(data)
                store.move(f"{base}/.{n}.part", f"{base}/{n}")
                paths.append(f"{base}/{n}")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return files.select(name.alias("n"), column).mapInArrow(run, "path string")
