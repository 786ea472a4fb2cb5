"""Inputs around pages: page ranges, image files, character dictionaries, label maps, languages and manifests."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.operators.layout import block_type

# fixed values: languages of the recogniser packs, their codes and other names
LANGUAGES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "dutch": "nl", "chinese": "ch", "japanese": "japan", "korean": "korean", "russian": "ru", "arabic": "ar", "hindi": "hi", "greek": "el", "thai": "th", "telugu": "te", "tamil": "ta"}
ALIASES = {"eng": "en", "ger": "de", "deu": "de", "fra": "fr", "fre": "fr", "spa": "es", "zh": "ch", "zh-cn": "ch", "ja": "japan", "jpn": "japan", "ko": "korean", "kor": "korean", "rus": "ru", "ara": "ar", "hin": "hi"}


def parse_page_range(text: str | None) -> list[tuple[int, int | None]]:
    """`1-3,5,7-` as (first, last) with an open last; empty means all pages. ValueError for empty terms, bare or repeated dashes, reversed ranges, page 0."""
    if not text or not text.strip():
        return []
    out = []
    for term in text.split(","):
        m = re.fullmatch(r"\s*(?:(\d+)|(\d*)\s*-\s*(\d*))\s*", term)
        if not m or not term.strip(" -"):
            raise ValueError(f"invalid page range {text!r}: {term!r}")
        first, last = (int(m[1]), int(m[1])) if m[1] else (int(m[2] or 1), int(m[3]) if m[3] else None)
        if first < 1 or last is not None and last < first:
            raise ValueError(f"invalid page range {text!r}: {term!r}")
        out.append((first, last))
    return out


def select_pages(pages: DataFrame, page_range: str | None, page: str = "page_number", most: int | None = None, document: str = "doc_id") -> DataFrame:
    """Pages in the range, each once. A document of which it selects none, or more than `most`, is an error when the rows are read."""
    terms = parse_page_range(page_range)
    here = F.lit(not terms)
    for first, last in terms:
        here = here | (F.col(page) >= first) & (F.lit(True) if last is None else F.col(page) <= last)
    if most is None:
        return pages.filter(here)
    from pyspark.sql import Window

    n = F.sum(here.cast("int")).over(Window.partitionBy(document))
    checked = pages.withColumn("_n", n).withColumn("_here", here)
    wrong = F.when(F.col("_n") == 0, F.lit("the page range selects no page")).when(F.col("_n") > most, F.lit(f"more than {most} pages"))
    return checked.filter(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.col("_here"))).drop("_n", "_here")


def read_images(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,bmp,tif,tiff,webp,gif}", most_bytes: int = 100_000_000) -> DataFrame:
    """path, content, error of image files; a larger one has no content and an error."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > most_bytes
    return f.select("path", "length", F.when(~large, F.col("content")).alias("content"), F.when(large, F.lit("file too large")).alias("error"))


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of the first frame header; segments before it are skipped by their lengths."""
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:  # fill
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        elif kind in (0xD9, 0xDA):
            return None
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def _tiff_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of the first directory, of classic and large files."""
    order = "little" if data[:2] == b"II" else "big"
    number = lambda at, n: int.from_bytes(data[at : at + n], order)
    wide = number(2, 2) == 43
    first, n_count, entry = (number(8, 8), 8, 20) if wide else (number(4, 4), 2, 12)
    found = {}
    for i in range(min(number(first, n_count), 4096)):
        at = first + n_count + i * entry
        tag, kind = number(at, 2), number(at + 2, 2)
        if tag in (256, 257) and kind in (3, 4, 16):
            found[tag] = number(at + (12 if wide else 8), {3: 2, 4: 4, 16: 8}[kind])
    return (found[256], found[257]) if len(found) == 2 else None


_SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


@F.pandas_udf(_SIZE)
def _walked_size(content: pd.Series) -> pd.DataFrame:
    sizes = [None if c is None else _jpeg_size(c) if c[:2] == b"\xff\xd8" else _tiff_size(c) for c in content]
    return pd.DataFrame([(None, None) if s is None else s for s in sizes], columns=["width", "height"]).astype("Int64")


def image_size(content: Column) -> Column:
    """struct<width,height> from the header of PNG, GIF, BMP, WebP, JPEG and TIFF bytes, without decoding; null for others and broken headers.

    Only JPEG and TIFF, whose sizes have no fixed place, go to Python.
    """
    b = lambda i, n: F.hex(F.substring(content, i, n))
    big = lambda i, n: F.conv(b(i, n), 16, 10).cast("long")
    little = lambda i, n: F.conv(F.concat(*[b(i + k, 1) for k in reversed(range(n))]), 16, 10).cast("long")
    size = lambda w, h: F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))
    low = lambda v, n: v.bitwiseAND(F.lit((1 << n) - 1))
    jpeg, tiff, webp = b(1, 3) == "FFD8FF", b(1, 4).isin("49492A00", "4D4D002A", "49492B00", "4D4D002B"), (b(1, 4) == "52494646") & (b(9, 4) == "57454250")
    walked = _walked_size(F.when(jpeg | tiff, content))
    known = (
        F.when(b(1, 8) == "89504E470D0A1A0A", size(big(17, 4), big(21, 4))).when(b(1, 4) == "47494638", size(little(7, 2), little(9, 2))).when(b(1, 2) == "424D", size(little(19, 4), F.when(little(23, 4) >= 1 << 31, (1 << 32) - little(23, 4)).otherwise(little(23, 4))))
        .when(webp & (b(13, 4) == "56503858"), size(little(25, 3) + 1, little(28, 3) + 1)).when(webp & (b(13, 4) == "5650384C"), size(low(little(22, 4), 14) + 1, low(F.shiftright(little(22, 4), 14), 14) + 1))
        .when(webp & (b(13, 4) == "56503820"), size(low(little(27, 2), 14), low(little(29, 2), 14))).when(jpeg | tiff, F.struct(walked["width"].alias("width"), walked["height"].alias("height")))
    )
    return F.when((known["width"] > 0) & (known["height"] > 0), known)


def guard_pixels(images: DataFrame, most_pixels: int = 178_956_970) -> DataFrame:
    """images with an error, and no content, where the header promises more pixels or tells no size."""
    s = image_size(F.col("content"))
    wrong = F.when(F.col("content").isNull(), F.lit(None)).when(s.isNull(), F.lit("no image of a known size")).when(s["width"] * s["height"] > most_pixels, F.lit("too many pixels"))
    return images.withColumn("error", F.coalesce("error", wrong)).withColumn("content", F.when(F.col("error").isNull(), F.col("content")))


def explode_frames(images: DataFrame, frames: str = "frames") -> DataFrame:
    """One row for each frame of a multi-frame image that a decoder gave as an array."""
    keep = [c for c in images.columns if c != frames]
    return images.select(*keep, F.posexplode(frames).alias("frame_index", "frame"))


def read_dictionary(spark: SparkSession, path: str) -> list[str]:
    """A recogniser's dictionary: a character on each line, in order; one file, read whole."""
    text = spark.read.text(path, wholetext=True).first()
    return [] if text is None else re.sub(r"\r?\n\Z", "", text[0]).split("\n")


def parse_label_map(text: str) -> list[tuple[int, str]]:
    """(id, label) of a `label_list:` section with `- label` items, or of one label on each line."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    at = next((i for i, x in enumerate(lines) if re.fullmatch(r"\s*label_list\s*:\s*", x)), None)
    if at is None:
        names = [x.strip() for x in lines if x.strip() and not x.lstrip().startswith("#")]
    else:
        names = []
        for x in lines[at + 1 :]:
            m = re.fullmatch(r"\s*-\s*(.+?)\s*", x)
            if not m and x.strip():
                break
            if m:
                names.append(m[1].strip("'\""))
    return list(enumerate(names))


def label_map(spark: SparkSession, text: str) -> DataFrame:
    """class_id, label, type."""
    rows = spark.createDataFrame(parse_label_map(text), "class_id int, label string")
    return rows.withColumn("type", block_type(F.col("label")))


def language_code(name: Column) -> Column:
    """A language's code from its name, code or an alias in any letter case; null if it is unknown."""
    known = LANGUAGES | ALIASES | {c: c for c in LANGUAGES.values()}
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(F.trim(name)))


def normalise_languages(codes: Column) -> Column:
    """Trimmed, lower case, without empty ones, each once, in order."""
    return F.array_distinct(F.filter(F.transform(codes, lambda c: F.lower(F.trim(c))), lambda c: c != ""))


def allow_list(text: Column) -> Column:
    """The characters of a text, each once."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Items of an evaluation manifest, a JSON object on each line or an array."""
    schema = "id string, document_id string, origin_group string, source_kind string, split string, category string, reference string, sensitive_tokens map<string,string>"
    return spark.read.schema(schema).option("multiLine", "true").json(path)
