"""Searchable PDF files: each page's picture, where there is one, under its text in invisible glyphs, line by line."""

from __future__ import annotations

import zlib
from itertools import groupby

from pyspark.sql import DataFrame

from papyra.functions.paging import by_page
from papyra.functions.render import is_rtl


class GlyphMap:
    """Numbers for a document's characters from 1 on, and the map back to Unicode for readers."""

    def __init__(self):
        self.cids: dict[str, int] = {}

    def encode(self, text: str) -> str:
        return "".join(f"{self.cids.setdefault(c, len(self.cids) + 1):04X}" for c in text)

    def to_unicode(self) -> bytes:
        rows = [f"<{n:04X}> <{c.encode('utf-16-be').hex().upper()}>" for c, n in self.cids.items()]
        parts = [rows[i : i + 100] for i in range(0, len(rows), 100)]
        body = "\n".join(f"{len(p)} beginbfchar\n" + "\n".join(p) + "\nendbfchar" for p in parts)
        return f"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /Own def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n{body}\nendcmap\nend\nend".encode()


def aligned_words(line: dict) -> list[tuple[str, dict]]:
    """(text, box) to draw: the line's words, each but the last with a space, from the right in right-to-left lines; the whole line if its words don't make it up."""
    words = [w for w in line.get("words") or [] if w["text"].strip()]
    text = line["text"].strip()
    if not words or "".join("".join(w["text"].split()) for w in words) != "".join(text.split()):
        return [(text, line)]
    if is_rtl(text):
        words = sorted(words, key=lambda w: -w["max_x"])
    return [(w["text"] + " " * (i < len(words) - 1), w) for i, w in enumerate(words)]


def page_content(lines: list[dict], width: float, height: float, scale: float, glyphs: GlyphMap, picture: bool) -> str:
    """A page's drawing operators; text is scaled to its box: glyphs are as wide as half their height before."""
    out = [f"q {width * scale:.2f} 0 0 {height * scale:.2f} 0 0 cm /Im0 Do Q"] if picture else []
    for line in lines:
        for text, b in aligned_words(line):
            w, h = (b["max_x"] - b["min_x"]) * scale, (b["max_y"] - b["min_y"]) * scale
            if text.strip() and w > 0 and h > 0:
                stretch = 100 * w / (0.5 * h * len(text))
                out.append(f"BT 3 Tr /F0 {h:.2f} Tf {stretch:.2f} Tz 1 0 0 1 {b['min_x'] * scale:.2f} {(height - b['max_y']) * scale:.2f} Tm <{glyphs.encode(text)}> Tj ET")
    return "\n".join(out)


def pdf_bytes(pages: list[tuple[list[dict], float, float, bytes | None]], dpi: float = 200.0) -> bytes:
    """A file of pages: (lines, width, height in pixels, JPEG bytes or None)."""
    glyphs, objects = GlyphMap(), []

    def add(body: bytes | str) -> int:
        objects.append(body.encode("latin-1") if isinstance(body, str) else body)
        return len(objects)

    def stream(data: bytes, head: str = "/Filter /FlateDecode", pack: bool = True) -> int:
        data = zlib.compress(data) if pack else data
        return add(f"<< /Length {len(data)} {head} >>\nstream\n".encode() + data + b"\nendstream")

    for _ in range(3):
        add("")  # the catalogue, the page tree and the font, known at the end
    kids, scale = [], 72.0 / dpi
    for lines, width, height, jpeg in pages:
        content = stream(page_content(lines, width, height, scale, glyphs, jpeg is not None).encode("latin-1"))
        image = ""
        if jpeg is not None:
            number = stream(jpeg, f"/Type /XObject /Subtype /Image /Width {int(width)} /Height {int(height)} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode", pack=False)
            image = f" /XObject << /Im0 {number} 0 R >>"
        kids.append(add(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width * scale:.2f} {height * scale:.2f}] /Contents {content} 0 R /Resources << /Font << /F0 3 0 R >>{image} >> >>"))
    names = stream(glyphs.to_unicode())
    shape = add("<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Invisible /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 /CIDToGIDMap /Identity /FontDescriptor " + str(len(objects) + 2) + " 0 R >>")
    add("<< /Type /FontDescriptor /FontName /Invisible /Flags 4 /FontBBox [0 0 500 1000] /ItalicAngle 0 /Ascent 1000 /Descent 0 /CapHeight 1000 /StemV 80 >>")
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    objects[2] = f"<< /Type /Font /Subtype /Type0 /BaseFont /Invisible /Encoding /Identity-H /DescendantFonts [{shape} 0 R] /ToUnicode {names} 0 R >>".encode()
    out, places = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def searchable_pdf(lines: DataFrame, document: str, page: str, line: str, width: float, height: float, pictures: DataFrame | None = None, dpi: float = 200.0) -> DataFrame:
    """document, pdf: a file for each document, its pages in order. pictures: document, page, jpeg. A document is what a task holds."""
    rows = lines
    if pictures is not None:
        rows = rows.join(pictures.select(document, page, "jpeg"), [document, page], "left")

    def make(rows: list[dict]):
        pages = []
        for _, group in groupby(rows, lambda r: r[page]):
            group = list(group)
            pages.append((group, width, height, group[0].get("jpeg")))
        yield {document: rows[0][document], "pdf": pdf_bytes(pages, dpi)}

    return by_page(rows, [document], [page, line], make, f"{document} {dict(lines.dtypes)[document]}, pdf binary")
