"""A page's structure in one call: regions cleaned, lines put into blocks, blocks in order, Markdown of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.export.markdown import markdown
from papyra.functions.render import assemble_blocks
from papyra.operators import enhanced_order, layout, spatial
from papyra.options import MarkdownOptions, StructureOptions


def text_matchable(kind: Column, options: StructureOptions = StructureOptions()) -> Column:
    """Whether lines of the page may belong to a block of this type: not to pictures, nor to what has a model of its own."""
    own = ["Figure", "Chart"] + ["Seal"] * options.recognize_seals + ["Formula", "FormulaNumber"] * options.recognize_formulas
    return ~kind.isin(own)


def page_blocks(regions: DataFrame, lines: DataFrame, keys: list[str], width: float, height: float, options: StructureOptions = StructureOptions()) -> DataFrame:
    """keys, block_index, type, block_order, score, box, text, orphan of each page's blocks and of the lines outside of them.

    regions: keys, region_index, label, score, order_index, box. lines: keys, line_index, text, confidence, box.
    Regions are cleaned first; a line goes to the block that has most of it, if such a block may have text; lines
    between blocks and those in none are blocks of their own, after the regions'. Blocks are numbered from 0 on in
    reading order.
    """
    found = layout.post_process(regions, keys, width, height) if options.layout_nms else layout.threshold(regions)
    found = found.withColumn("type", layout.block_type(F.col("label"))).select(*keys, "region_index", "label", "type", "score", "order_index", "min_x", "min_y", "max_x", "max_y")
    home = spatial.match_lines_to_blocks(lines, found.filter(text_matchable(F.col("type"), options)), keys, block_id="region_index").select(*keys, "line_index", "region_index")
    placed = lines.join(home, [*keys, "line_index"], "left")
    texts = assemble_blocks(placed.filter("region_index is not null"), [*keys, "region_index"])
    blocks = found.join(texts, [*keys, "region_index"], "left").withColumn("orphan", F.lit(False))
    edges = ["min_x", "min_y", "max_x", "max_y"]
    first = F.lit(1 << 32)  # after all regions
    alone = placed.filter("region_index is null").select(*keys, (first + F.col("line_index")).alias("region_index"), F.lit("text").alias("label"), F.lit("Text").alias("type"), F.col("confidence").cast("double").alias("score"), F.lit(None).cast("int").alias("order_index"), *edges, "text", F.lit(True).alias("orphan"))
    every = blocks.select(*keys, F.col("region_index").cast("long").alias("region_index"), "label", "type", F.col("score").cast("double").alias("score"), F.col("order_index").cast("int").alias("order_index"), *edges, "text", "orphan").unionByName(alone)
    ordered = enhanced_order.reading_strategy(every, keys, options.reading_order, width, height, "region_index")
    return ordered.select(*keys, F.col("region_index").alias("block_index"), "type", F.col("position").alias("block_order"), "score", *edges, "text", "orphan")


def analyse_documents(regions: DataFrame, lines: DataFrame, document: str, page: str, width: float, height: float, options: StructureOptions = StructureOptions(), style: MarkdownOptions = MarkdownOptions()) -> tuple[DataFrame, DataFrame]:
    """(blocks of all pages, Markdown of each document)."""
    blocks = page_blocks(regions, lines, [document, page], width, height, options)
    ready = blocks.withColumns({"table_html": F.lit(None).cast("string"), "latex": F.lit(None).cast("string")})
    return blocks, markdown(ready, document, page, "block_order", style.page_separator, style.ignored, style.pretty_tables)
