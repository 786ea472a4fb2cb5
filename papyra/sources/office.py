"""Office files as rows: sections, blocks, table cells and sheet cells of DOCX, PPTX and XLSX, read with bounds from bytes."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from papyra.schemas import OFFICE_BLOCKS

_MAIN = {"wordprocessingml.document.main": "docx", "presentationml.presentation.main": "pptx", "spreadsheetml.sheet.main": "xlsx"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_HEADERS = ("header", "footer")


@dataclass(frozen=True)
class Limits:
    """What a file may have; beyond it, it is an error row. Bytes expanded count each time a part is read, images and texts each time they occur."""

    # fixed values
    file_bytes: int = 64 << 20
    expanded_bytes: int = 256 << 20
    part_bytes: int = 32 << 20
    entries: int = 10_000
    sections: int = 1_000
    blocks: int = 100_000
    images: int = 100
    xml_characters: int = 16 << 20
    text_characters: int = 32 << 20

    def __post_init__(self):
        if min(vars(self).values()) < 1:
            raise ValueError("limits must be 1 or more")


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class Package:
    def __init__(self, data: bytes, limits: Limits):
        if len(data) > limits.file_bytes:
            raise ValueError("file too large")
        self.limits, self.zip = limits, zipfile.ZipFile(io.BytesIO(data))
        infos = self.zip.infolist()
        if len(infos) > limits.entries or sum(i.file_size for i in infos) > limits.expanded_bytes:
            raise ValueError("package too large")
        self.names = {i.filename.lstrip("/") for i in infos}
        self.expanded = 0

    def read(self, name: str) -> bytes:
        with self.zip.open(name) as f:
            data = f.read(self.limits.part_bytes + 1)
        if len(data) > self.limits.part_bytes:
            raise ValueError(f"part too large: {name}")
        self.expanded += len(data)
        if self.expanded > self.limits.expanded_bytes:
            raise ValueError("package too large")
        return data

    def xml(self, name: str) -> ET.Element:
        data = self.read(name)
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise ValueError(f"declarations are not allowed: {name}")
        if len(data) > self.limits.xml_characters and len(data.decode("utf-8", "replace")) > self.limits.xml_characters:
            raise ValueError(f"part with too many characters: {name}")
        return ET.fromstring(data)

    def main(self) -> tuple[str, str]:
        """(format, name of the main part) by the package's content types."""
        for x in self.xml("[Content_Types].xml"):
            for mark, kind in _MAIN.items():
                if mark in x.get("ContentType", "") and x.get("PartName"):
                    return kind, x.get("PartName").lstrip("/")
        raise ValueError("no main part of a known format")

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id: (type, part) of internal links; external ones are never followed."""
        folder, base = posixpath.split(part)
        name = posixpath.join(folder, "_rels", base + ".rels")
        if name not in self.names:
            return {}
        out = {}
        for x in self.xml(name):
            if x.get("TargetMode") != "External":
                target = x.get("Target", "")
                out[x.get("Id")] = x.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
        return out


def paragraph_text(p: ET.Element) -> str:
    """Text of runs: tabs and breaks as characters, deletions left out."""
    out = []

    def walk(x: ET.Element):
        name = local(x.tag)
        if name in ("del", "moveFrom", "txbxContent"):
            return
        if name == "t":
            out.append(x.text or "")
        elif name in ("tab", "br", "cr", "noBreakHyphen", "softHyphen"):
            out.append({"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "‑", "softHyphen": "­"}[name])
        if name != "pPr":
            for c in x:
                walk(c)

    walk(p)
    return "".join(out)


def _child(x: ET.Element, *path: str) -> ET.Element | None:
    for name in path:
        x = next((c for c in x if local(c.tag) == name), None) if x is not None else None
    return x


def _attr(x: ET.Element | None, name: str, otherwise: str | None = None) -> str | None:
    return otherwise if x is None else next((v for k, v in x.attrib.items() if local(k) == name), otherwise)


def word_table(tbl: ET.Element) -> list[tuple[int, int, int, int, str]]:
    """(row, column, rows, columns, text) of a table; vertical merges become spans, nested tables are text of their cell."""
    cells: list[list] = []
    above: dict[int, list] = {}
    for i, tr in enumerate(x for x in tbl if local(x.tag) == "tr"):
        col, now = 0, {}
        for tc in (x for x in tr if local(x.tag) == "tc"):
            props = _child(tc, "tcPr")
            wide = int(_attr(_child(props, "gridSpan") if props is not None else None, "val", "1"))
            merge = _child(props, "vMerge") if props is not None else None
            if merge is not None and _attr(merge, "val", "continue") == "continue" and col in above:
                cell = above[col]
                cell[2] += 1
            else:
                cell = [i, col, 1, wide, "\n".join(t for t in (paragraph_text(p) for p in tc.iter() if local(p.tag) == "p") if t)]
                cells.append(cell)
            if merge is not None:
                now[col] = cell
            col += wide
        above = now
    return [tuple(c) for c in cells]


def read_docx(pkg: Package, part: str) -> Iterator[dict]:
    def blocks(parent: ET.Element) -> Iterator[dict]:
        for x in parent:
            name = local(x.tag)
            if name == "p":
                yield {"kind": "paragraph", "text": paragraph_text(x)}
                for blip in (b for b in x.iter() if local(b.tag) == "blip"):
                    yield {"kind": "image", "text": blip.get(f"{_REL}embed")}
            elif name == "tbl":
                for r, c, rs, cs, text in word_table(x):
                    yield {"kind": "cell", "text": text, "row": r, "col": c, "row_span": rs, "col_span": cs}
            elif name in ("sdt", "sdtContent", "ins", "moveTo", "body", "hdr", "ftr"):
                yield from blocks(x)

    yield from ({"section": 0, "section_name": "body"} | b for b in blocks(pkg.xml(part)))
    extra = sorted((kind, name) for kind, name in pkg.relations(part).values() if kind in _HEADERS and name in pkg.names)
    for i, (kind, name) in enumerate(extra, 1):
        yield from ({"section": i, "section_name": kind} | b for b in blocks(pkg.xml(name)))


def read_pptx(pkg: Package, part: str) -> Iterator[dict]:
    links = pkg.relations(part)
    order = [x.get(f"{_REL}id") for x in pkg.xml(part).iter() if local(x.tag) == "sldId"]

    def shapes(parent: ET.Element) -> Iterator[dict]:
        for x in parent:
            name = local(x.tag)
            if name in ("grpSp", "spTree"):
                yield from shapes(x)
            elif name == "sp":
                text = "\n".join(paragraph_text(p) for p in x.iter() if local(p.tag) == "p")
                if text.strip():
                    yield {"kind": "paragraph", "text": text}
            elif name == "pic":
                blip = next((b for b in x.iter() if local(b.tag) == "blip"), None)
                yield {"kind": "image", "text": None if blip is None else blip.get(f"{_REL}embed")}
            elif name == "graphicFrame":
                for i, tr in enumerate(r for r in x.iter() if local(r.tag) == "tr"):
                    for j, tc in enumerate(c for c in tr if local(c.tag) == "tc"):
                        if tc.get("hMerge") != "1" and tc.get("vMerge") != "1":
                            yield {"kind": "cell", "text": "\n".join(paragraph_text(p) for p in tc.iter() if local(p.tag) == "p"), "row": i, "col": j, "row_span": int(tc.get("rowSpan", 1)), "col_span": int(tc.get("gridSpan", 1))}

    for i, rel in enumerate(order):
        name = links[rel][1]
        tree = next((x for x in pkg.xml(name).iter() if local(x.tag) == "spTree"), None)
        yield from ({"section": i, "section_name": posixpath.basename(name)} | b for b in shapes(tree if tree is not None else ()))


def cell_address(text: str) -> tuple[int, int]:
    """(row, column) from 0 on of an address like `AB12`."""
    m = re.fullmatch(r"([A-Z]{1,3})([1-9][0-9]{0,6})", text or "")
    if not m:
        raise ValueError(f"no cell address: {text}")
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    if col > 16384 or int(m[2]) > 1048576:
        raise ValueError(f"address beyond the sheet: {text}")
    return int(m[2]) - 1, col - 1


def address(row: int, col: int) -> str:
    letters, col = "", col + 1
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row + 1}"


def read_xlsx(pkg: Package, part: str) -> Iterator[dict]:
    """Cells of the sheets: shared and inline strings as text, other values as they are stored, formulas as text."""
    links = pkg.relations(part)
    shared = []
    for kind, name in links.values():
        if kind == "sharedStrings" and name in pkg.names:
            shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in pkg.xml(name) if local(si.tag) == "si"]
    sheets = [(x.get("name"), links[x.get(f"{_REL}id")][1]) for x in pkg.xml(part).iter() if local(x.tag) == "sheet"]
    for i, (title, name) in enumerate(sheets):
        root = pkg.xml(name)
        merges = {}
        for m in (x for x in root.iter() if local(x.tag) == "mergeCell"):
            a, _, b = m.get("ref").partition(":")
            (r0, c0), (r1, c1) = cell_address(a), cell_address(b or a)
            merges[r0, c0] = r1 - r0 + 1, c1 - c0 + 1
        seen = set()
        for c in (x for x in root.iter() if local(x.tag) == "c"):
            at = cell_address(c.get("r"))
            if at in seen:
                raise ValueError(f"repeated cell {c.get('r')} in {title}")
            seen.add(at)
            kind, value, formula = c.get("t"), _child(c, "v"), _child(c, "f")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter() if local(t.tag) == "t")
            elif kind == "s":
                text = shared[int(value.text)]
            else:
                text = None if value is None else value.text
            rows, cols = merges.get(at, (1, 1))
            yield {"section": i, "section_name": title, "kind": "cell", "text": text, "row": at[0], "col": at[1], "row_span": rows, "col_span": cols, "formula": None if formula is None else formula.text}


def read_office(data: bytes, limits: Limits = Limits()) -> list[dict]:
    """Rows of a file; ValueError says what is wrong with it."""
    try:
        pkg = Package(data, limits)
        kind, part = pkg.main()
        rows, sections, images, characters = [], set(), 0, 0
        for row in {"docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx}[kind](pkg, part):
            rows.append(row | {"block": len(rows)})
            sections.add(row.get("section"))
            images += row["kind"] == "image"
            characters += 0 if row["kind"] == "image" else len(row.get("text") or "")
            for n, most, what in ((len(rows), limits.blocks, "blocks"), (len(sections), limits.sections, "sections"), (images, limits.images, "images"), (characters, limits.text_characters, "characters")):
                if n > most:
                    raise ValueError(f"too many {what}")
        return rows
    except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError, AttributeError, NotImplementedError) as e:
        raise ValueError(f"broken file: {type(e).__name__}: {e}") from None


def office_blocks(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of schemas.OFFICE_BLOCKS for files (path, content); a file that can't be read is one row with an error."""
    schema = StructType.fromDDL(OFFICE_BLOCKS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = read_office(content or b"", limits)
                except ValueError as e:
                    rows = [{"error": str(e)}]
                if rows:
                    yield pa.RecordBatch.from_pylist([r | {"path": path} for r in rows], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read_office_files(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """All DOCX, PPTX and XLSX files below a path; each file is read whole by one task, as the package's directory is at its end."""
    return office_blocks(spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,pptx,xlsx}").option("recursiveFileLookup", "true").load(path), limits)


def with_recognised_images(blocks: DataFrame, recognised: DataFrame) -> DataFrame:
    """Blocks with each image's text (path, block, text) in place of its link."""
    from pyspark.sql import functions as F

    r = recognised.select("path", "block", F.col("text").alias("_t"))
    return blocks.join(r, ["path", "block"], "left").withColumn("text", F.when(F.col("kind") == "image", F.col("_t")).otherwise(F.col("text"))).drop("_t").select(*blocks.columns)
