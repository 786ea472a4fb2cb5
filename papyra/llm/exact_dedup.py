"""Exact deduplication by 128-bit content hash with byte comparison inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm._shared import BROADCAST_ROWS, maybe_broadcast, table, text_or_empty


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def annotate_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash128: Callable[[Column], Column] = md5_128, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with `_keep_id`, `_group_size`, `_kept` and `_sha256` added.

    Documents are equal when their bytes are. A 128-bit hash finds candidate groups; rows whose hash occurs twice have
    their text grouped with the hash, byte for byte, so that a collision makes two groups. With up to `broadcast_rows`
    repeated hashes the other texts are never shuffled; with more, all texts are grouped, as a join that picks the
    repeated ones would shuffle them all as well, and each task combines its copies first. A hot group so costs one row
    for each map task in every aggregation; the last join is one that Spark splits when a key is skewed.

    Null text counts as empty. Rows that repeat id and text are one document: each has the same answer. Rows with a
    null id are in the group's size and stay only if no row of the group has an id. keep is "min" or "max" of the ids.
    An empty table gives an empty one.
    """
    best = {"min": F.min, "max": F.max}[keep]
    base = docs.withColumns({"_text": text_or_empty(docs, text_col)})
    base = base.withColumns({"_h": hash128(F.col("_text"))})
    repeated = table(base.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_h"), "repeated")
    members = base.select("_h", "_text", F.col(id_col).alias("_id"))
    if repeated.count() <= broadcast_rows:
        members = members.join(F.broadcast(repeated), "_h", "left_semi")
    groups = members.groupBy("_h", "_text").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_best")).filter("_n > 1")
    groups = table(groups.select("_h", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha256"), "_n", "_best"), "groups")
    base = base.withColumns({"_sha256": F.sha2(F.col("_text").cast("binary"), 256)}).drop("_text")
    out = base.join(maybe_broadcast(groups, limit=broadcast_rows), ["_h", "_sha256"], "left")
    keep_id = F.when(F.col("_n").isNull(), F.col(id_col)).otherwise(F.col("_best"))
    return out.withColumns({"_keep_id": keep_id, "_group_size": F.coalesce("_n", F.lit(1)).cast("long"), "_kept": keep_id.eqNullSafe(F.col(id_col))}).drop("_h", "_n", "_best")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", **options) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256. Odd rows and sizes: see annotate_duplicates; other columns don't matter."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = annotate_duplicates(slim, "doc_id", "text", keep, **options)
    return out.select(F.col("doc_id").alias(id_col), F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha256").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", **options) -> DataFrame:
    """docs with one row of each text, columns as they were.

    It is the row that exact_dedup keeps. Where several rows repeat that id, or no row of the group has an id, it is
    the first of these in the order of their JSON; so of copies never more than one row stays. See annotate_duplicates.
    """
    slim = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_txt"))
    kept = annotate_duplicates(slim, "_doc", "_txt", keep, **options).filter("_kept")
    single = kept.filter("_group_size = 1").select("_row")
    first = kept.filter("_group_size > 1").groupBy("_sha256").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))  # mostly one row each
    return single.union(first.select("_row")).select("_row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    """exact_dedup of documents; the largest doc_id of equal texts stays. A null text is an empty one, repeated rows answer alike."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
