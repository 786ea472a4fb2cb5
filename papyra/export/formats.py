"""Pages as JSON, TSV, hOCR and ALTO, built inside the JVM from lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.geometry import Box, box
from papyra.functions.numbers import percent
from papyra.functions.text import count_characters, escape_xml, words

PRODUCER = "papyra"


def _int(value: Column) -> Column:
    """Halves to even, as rint has it; far cheaper than by decimals."""
    return F.rint(value).cast("int")


def _words(lines: DataFrame, keys: list[str], line_id: str) -> DataFrame:
    """lines with line_num from 1 on, and a row for each word: _i from 0 on, word, its box in `_w`; a line without words has one row and no word.

    A line's width is dealt in proportion to characters. All is in generated code: one shuffle by page, and sums that run along a line.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(line_id))
    found = words(F.coalesce("text", F.lit("")))
    base = lines.select(*keys, "confidence", "min_x", "min_y", "max_x", "max_y", number.alias("line_num"), F.size(found).alias("_n"), count_characters(F.col("text")).alias("_t"), found.alias("_words"))
    out = base.select(*[c for c in base.columns if c != "_words"], F.posexplode_outer("_words").alias("_i", "word"))
    along = Window.partitionBy(*keys, "line_num").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("word")).over(along), F.lit(0))
    unit = (F.col("max_x") - F.col("min_x")) / F.nullif(F.col("_t"), F.lit(0))  # a line without words has no unit
    right = F.when(F.col("_n") == 1, F.col("max_x")).otherwise(F.col("min_x") + (F.col("_before") + F.length("word")) * unit)
    return out.withColumn("_before", before).withColumns({"_left": F.col("min_x") + F.col("_before") * unit, "_right": right})


def word_rows(lines: DataFrame, keys: list[str], line_id: str = "line_index") -> DataFrame:
    """keys, line number and word number from 1 on, word, box, confidence."""
    w = _words(lines, keys, line_id).filter("word is not null")
    return w.select(*keys, "line_num", (F.col("_i") + 1).alias("word_num"), "word", F.col("_left").alias("min_x"), "min_y", F.col("_right").alias("max_x"), "max_y", "confidence")


def tsv(lines: DataFrame, keys: list[str], line_id: str = "line_index") -> DataFrame:
    """One row for each word with the twelve columns of the tabular format; write with sep tab."""
    w = word_rows(lines, keys, line_id)
    one = lambda name: F.lit(1).alias(name)
    return w.select(
        *keys, F.lit(5).alias("level"), one("page_num"), one("block_num"), one("par_num"), "line_num", "word_num", _int(F.col("min_x")).alias("left"), _int(F.col("min_y")).alias("top"),
        _int(F.col("max_x") - F.col("min_x")).alias("width"), _int(F.col("max_y") - F.col("min_y")).alias("height"), percent(F.col("confidence")).alias("conf"), F.translate("word", "\t", " ").alias("text"),
    )


def _pages(lines: DataFrame, keys: list[str], line_id: str, line: Column, word: Callable[[Box], Column], line_end: str, width: int, height: int) -> DataFrame:
    """keys, body, w, h: lines and their words as text, in order. A line's first word brings its head, the last its end."""
    w = _words(lines, keys, line_id)
    place = Box(F.col("_left"), F.col("min_y"), F.col("_right"), F.col("max_y"))
    none = F.col("word").isNull()
    t = F.concat(F.when(none | (F.col("_i") == 0), line).otherwise(""), F.when(none, "").otherwise(word(place)), F.when(none | (F.col("_i") == F.col("_n") - 1), line_end).otherwise(""))
    size = lambda given, edge: F.lit(given) if given > 0 else F.ceil(F.greatest(F.lit(0.0), F.max(edge))).cast("int")
    g = w.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_num", "_i", t.alias("t")))).alias("l"), size(width, "max_x").alias("w"), size(height, "max_y").alias("h"))
    return g.select(*keys, F.array_join(F.col("l.t"), "").alias("body"), "w", "h")


def _bbox(b: Box) -> Column:
    return F.concat_ws(" ", F.lit("bbox"), *map(_int, (b.min_x, b.min_y, b.max_x, b.max_y)))


# fixed values: the heads that the formats demand
HOCR_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en">\n<head>\n'
    f"  <meta http-equiv=\"Content-Type\" content=\"text/html;charset=utf-8\"/>\n  <meta name='ocr-system' content='{PRODUCER}'/>\n  <meta name='ocr-capabilities' content='ocr_page ocr_line ocrx_word'/>\n</head>\n<body>\n"
)
ALTO_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#">\n  <Description>\n    <MeasurementUnit>pixel</MeasurementUnit>\n    <sourceImageInformation><fileName></fileName></sourceImageInformation>\n'
    f'    <OCRProcessing ID="ocr_1"><ocrProcessingStep><processingSoftware><softwareName>{PRODUCER}</softwareName></processingSoftware></ocrProcessingStep></OCRProcessing>\n  </Description>\n  <Layout>\n'
)


def hocr(lines: DataFrame, keys: list[str], line_id: str = "line_index", width: int = 0, height: int = 0, image: Column | None = None) -> DataFrame:
    """keys, hocr: a page's lines and words with boxes and confidences."""
    line = F.concat(F.lit("    <span class='ocr_line' id='line_"), F.col("line_num"), F.lit("' title='"), _bbox(box()), F.lit("'>\n"))
    number = F.concat(F.col("line_num"), F.lit("_"), F.col("_i") + 1)
    word = lambda b: F.concat(F.lit("      <span class='ocrx_word' id='word_"), number, F.lit("' title='"), _bbox(b), F.lit("; x_wconf "), percent(F.col("confidence")), F.lit("'>"), escape_xml(F.col("word")), F.lit("</span>\n"))
    p = _pages(lines, keys, line_id, line, word, "    </span>\n", width, height)
    name = escape_xml(F.lit("") if image is None else image)
    page = F.concat(F.lit("  <div class='ocr_page' id='page_1' title='image \""), name, F.lit('"; bbox 0 0 '), F.col("w"), F.lit(" "), F.col("h"), F.lit("'>\n"))
    return p.select(*keys, F.concat(F.lit(HOCR_HEAD), page, F.col("body"), F.lit("  </div>\n</body>\n</html>\n")).alias("hocr"))


def _alto_box(b: Box) -> Column:
    attr = lambda name, v: F.concat(F.lit(f'{name}="'), _int(v), F.lit('"'))
    return F.concat_ws(" ", attr("HPOS", b.min_x), attr("VPOS", b.min_y), attr("WIDTH", b.width), attr("HEIGHT", b.height))


def three_decimals(value: Column) -> Column:
    """At most three decimals, none that are zero at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", F.coalesce(value, F.lit(0.0))), "0+$", ""), r"\.$", "")


def alto(lines: DataFrame, keys: list[str], line_id: str = "line_index", width: int = 0, height: int = 0) -> DataFrame:
    """keys, alto: version 4 of the schema."""
    line = F.concat(F.lit('          <TextLine ID="line_'), F.col("line_num"), F.lit('" '), _alto_box(box()), F.lit(">\n"))
    number = F.concat(F.col("line_num"), F.lit("_"), F.col("_i") + 1)
    word = lambda b: F.concat(F.lit('            <String ID="string_'), number, F.lit('" '), _alto_box(b), F.lit(' WC="'), three_decimals(F.col("confidence")), F.lit('" CONTENT="'), escape_xml(F.col("word")), F.lit('"/>\n'))
    p = _pages(lines, keys, line_id, line, word, "          </TextLine>\n", width, height)
    size = F.concat(F.lit('WIDTH="'), F.col("w"), F.lit('" HEIGHT="'), F.col("h"), F.lit('">\n'))
    page = F.concat(F.lit('    <Page ID="page_1" PHYSICAL_IMG_NR="1" '), size, F.lit('      <PrintSpace HPOS="0" VPOS="0" '), size, F.lit('        <TextBlock ID="block_1">\n'))
    return p.select(*keys, F.concat(F.lit(ALTO_HEAD), page, F.col("body"), F.lit("        </TextBlock>\n      </PrintSpace>\n    </Page>\n  </Layout>\n</alto>\n")).alias("alto"))


def page_json(lines: DataFrame, keys: list[str], line_id: str = "line_index") -> DataFrame:
    """keys, json: {"text", "lines": [...]} with lines in order; null fields are left out."""
    item = F.struct(line_id, F.col("text"), F.col("confidence"), F.struct("min_x", "min_y", "max_x", "max_y").alias("box"))
    g = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return g.select(*keys, F.to_json(F.struct(F.array_join(F.col("l.text"), "\n").alias("text"), F.col("l").alias("lines"))).alias("json"))


def table_of(rows: DataFrame) -> DataFrame:
    """Any rows as one JSON object each, nulls left out: structures, checks, table views."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def normalised_html(text: Column) -> Column:
    """A normalised text as preformatted HTML, escaped."""
    return F.concat(F.lit("<pre>"), escape_xml(text), F.lit("</pre>"))
