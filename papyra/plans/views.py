"""Document tables derived from the driver's tables, once for Spark and once, identically, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered(*keys: str, by: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([by] if isinstance(by, str) else by))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines in two columns of a page, with a confidence."""
    t = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "text"))
    t = t.withColumn("line_index", F.col("line_index").cast("long"))
    right = F.col("line_index") % 2
    x = F.lit(20.0) + 400 * right
    y = 24.0 * ((F.col("line_index") - right) / 2)
    return t.select(
        "doc_id", "line_index", "text", (((F.col("doc_id") * 31 + F.col("line_index") * 17) % 101).cast("double") / 100).alias("confidence"),
        x.cast("double").alias("min_x"), y.cast("double").alias("min_y"), (x + 8 * F.least(F.length("text"), F.lit(45))).cast("double").alias("max_x"), (y + 20).cast("double").alias("max_y"),
    )


LINES_SQL = """
v_lines AS (
  SELECT doc_id, line_index, text, CAST(((doc_id*31 + line_index*17) % 101) AS DOUBLE)/100 AS confidence,
         CAST(20 + 400*(line_index % 2) AS DOUBLE) AS min_x, CAST(24*(line_index - line_index % 2)/2 AS DOUBLE) AS min_y,
         CAST(20 + 400*(line_index % 2) + 8*least(length(text),45) AS DOUBLE) AS max_x,
         CAST(24*(line_index - line_index % 2)/2 + 20 AS DOUBLE) AS max_y
  FROM (SELECT doc_id, CAST(i-1 AS BIGINT) line_index, p[i] text FROM
         (SELECT doc_id, string_split(text,chr(10)) p, unnest(generate_series(1,len(string_split(text,chr(10))))) i FROM documents))
)"""

LABELS = ("text", "paragraph_title", "image", "table", "formula")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout regions of a page of 1024 x 1100 for each order. box_index counts a page's rows, as line numbers may repeat."""
    t = read(spark, sf_dir, "lineitem")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_partkey") % 5 + 1).cast("int"))
    x = (F.col("l_partkey") * 37) % 800
    y = (F.col("l_suppkey") * 53 + F.col("l_linenumber") * 29) % 1000
    return t.select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("int").alias("box_index"), "l_partkey", "l_suppkey", label.alias("label"),
        (((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 70) / 100 + 0.30).alias("score"),
        x.cast("double").alias("min_x"), y.cast("double").alias("min_y"), (x + 20 + F.col("l_quantity").cast("int") * 4).cast("double").alias("max_x"), (y + 10 + F.col("l_partkey") % 40).cast("double").alias("max_y"),
    )


BOXES_SQL = """
v_boxes AS (
  SELECT l_orderkey AS page_id, CAST(l_linenumber AS INTEGER) AS box_index, l_partkey, l_suppkey,
         ['text','paragraph_title','image','table','formula'][CAST(l_partkey % 5 AS INTEGER) + 1] AS label,
         CAST((l_partkey*7 + l_linenumber*13) % 70 AS DOUBLE)/100 + 0.30 AS score,
         CAST((l_partkey*37) % 800 AS DOUBLE) AS min_x, CAST((l_suppkey*53 + l_linenumber*29) % 1000 AS DOUBLE) AS min_y,
         CAST((l_partkey*37) % 800 + 20 + CAST(l_quantity AS INTEGER)*4 AS DOUBLE) AS max_x,
         CAST((l_suppkey*53 + l_linenumber*29) % 1000 + 10 + l_partkey % 40 AS DOUBLE) AS max_y
  FROM lineitem
)"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines on the pages of `boxes`: one for each box, moved by a few points."""
    b = boxes(spark, sf_dir)
    dx, dy = F.col("l_suppkey") % 7 * 6 - 12, F.col("l_partkey") % 5 * 4 - 8
    return b.select(
        "page_id", F.col("box_index").alias("line_index"), "l_partkey", F.concat(F.lit("line "), F.col("l_partkey")).alias("text"),
        (F.col("min_x") + dx).cast("double").alias("min_x"), (F.col("min_y") + dy).cast("double").alias("min_y"), (F.col("min_x") + dx + 60).cast("double").alias("max_x"), (F.col("min_y") + dy + 12).cast("double").alias("max_y"),
    )


PAGE_LINES_SQL = (
    BOXES_SQL
    + """, v_page_lines AS (
  SELECT page_id, box_index AS line_index, l_partkey, 'line ' || l_partkey AS text,
         min_x + (l_suppkey % 7 * 6 - 12) AS min_x, min_y + (l_partkey % 5 * 4 - 8) AS min_y,
         min_x + (l_suppkey % 7 * 6 - 12) + 60 AS max_x, min_y + (l_partkey % 5 * 4 - 8) + 12 AS max_y FROM v_boxes
)"""
)


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition matrices of 8 steps by 8 classes from the embeddings."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("crop_id"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.transform(F.slice("embedding", s * 8 + 1, F.lit(8)), lambda v: (v.cast("double") + 1) / 2)).alias("probs"),
    )


VOCABULARY = ("", "a", "b", "c", "d", "e", "f", "g")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("document_id"), F.lit("latin").alias("pack"), F.when(F.col("doc_id") % 2 == 0, "calibration").otherwise("test").alias("split"),
        (((F.col("doc_id") * 37) % 101).cast("double") / 100).alias("raw_confidence"), (F.col("quality") == 1).alias("correct"),
    )


CALIBRATION_SQL = """
v_calib AS (
  SELECT doc_id AS document_id, 'latin' AS pack, CASE WHEN doc_id % 2 = 0 THEN 'calibration' ELSE 'test' END AS split,
         CAST((doc_id*37) % 101 AS DOUBLE)/100 AS raw_confidence, quality = 1 AS correct FROM labels
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcriptions and their references."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("reference"), F.replace(F.replace("text", F.lit("th"), F.lit("t")), F.lit("on"), F.lit("om")).alias("prediction"))


PAIRS_SQL = """
v_pairs AS (
  SELECT item_id AS id, text AS reference, replace(replace(text,'th','t'),'on','om') AS prediction FROM benchmark
)"""

BLOCK_TYPES = ("Text", "Title", "Header", "Table", "Figure", "Footer")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents of several pages: a conversation is a document, four turns are a page of 1000 x 1000."""
    t = read(spark, sf_dir, "conversations")
    i = F.col("turn") % 4
    kind = F.when(i == 0, "Header").when(i == 3, "Table").otherwise(F.element_at(F.array(*map(F.lit, BLOCK_TYPES)), (F.length("text") % 2 + 1).cast("int")))
    top = F.when(i == 0, 20.0).when(i == 3, 870.0).otherwise(200.0 * i)
    return t.select(
        F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 4).cast("int").alias("page_number"), i.cast("int").alias("block_index"), kind.alias("type"), i.cast("int").alias("block_order"),
        F.lit(100.0).alias("min_x"), top.alias("min_y"), F.lit(900.0).alias("max_x"), (top + 90).alias("max_y"), F.when(i == 0, F.col("role")).otherwise(F.col("text")).alias("text"),
    )


BLOCKS_SQL = """
v_blocks AS (
  SELECT conv_id AS doc_id, CAST(turn // 4 AS INTEGER) AS page_number, CAST(turn % 4 AS INTEGER) AS block_index,
         CASE WHEN turn % 4 = 0 THEN 'Header' WHEN turn % 4 = 3 THEN 'Table' WHEN length(text) % 2 = 0 THEN 'Text' ELSE 'Title' END AS type,
         CAST(turn % 4 AS INTEGER) AS block_order, 100.0::DOUBLE AS min_x,
         CASE WHEN turn % 4 = 0 THEN 20.0 WHEN turn % 4 = 3 THEN 870.0 ELSE 200.0 * (turn % 4) END::DOUBLE AS min_y, 900.0::DOUBLE AS max_x,
         CASE WHEN turn % 4 = 0 THEN 20.0 WHEN turn % 4 = 3 THEN 870.0 ELSE 200.0 * (turn % 4) END::DOUBLE + 90 AS max_y,
         CASE WHEN turn % 4 = 0 THEN role ELSE text END AS text FROM conversations
)"""


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the benchmark's texts as glyphs, 40 to a line of a page, 10 points wide."""
    t = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), F.posexplode(F.split("text", "")).alias("seq", "value")).filter("value <> ''")
    x, y = F.col("seq") % 40 * 10, F.floor(F.col("seq") / 40) * 30
    return t.select("page", F.col("seq").cast("long").alias("seq"), "value", x.cast("double").alias("left"), y.cast("double").alias("top"), (x + 9).cast("double").alias("right"), (y + 20).cast("double").alias("bottom"), F.lit(20.0).alias("em"))
