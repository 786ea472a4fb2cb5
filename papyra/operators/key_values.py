"""Key information without a model: a key's value stands in its line, right of it, or below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.geometry import box
from papyra.functions.text import collapse_space


def normalise_label(key: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.lower(collapse_space(key)), ":$", ""))


#: Keys asked for up to which they are broadcast.
MOST_KEYS = 10_000


def extract_fields(lines: DataFrame, wanted: list[str], keys: list[str], line_id: str = "line_index") -> DataFrame:
    """keys, key_ordinal, key, value for each page and key in the order asked for; value is null if none is found.

    Inline: the first line that begins with the key, then `:`, `-` or white space, then text. Right: from a line that is
    just the key (the key's own `:` aside), the nearest line strictly right of it in half of its height. Below: likewise,
    half of its width. Ties go to the first label, then the first line; a blank nearest line is no value.
    """
    spark = lines.sparkSession
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(wanted)], "key_ordinal int, key string").withColumn("_k", normalise_label(F.col("key")))
    if len(wanted) <= MOST_KEYS:
        asked = F.broadcast(asked)
    base = lines.select(*keys, F.col(line_id).alias("i"), F.coalesce("text", F.lit("")).alias("text"), "min_x", "min_y", "max_x", "max_y")
    base = base.withColumn("n", F.lower(collapse_space(F.col("text"))))
    near = base.join(asked, (F.col("_k") != "") & F.col("n").startswith(F.col("_k")))
    rest = F.expr("substring(n, length(_k) + 1)")
    value = F.trim(F.regexp_extract(F.expr("substring(trim(regexp_replace(text, '(?U)\\\\s+', ' ')), length(_k) + 1)"), r"^(?:\s*[:\-]\s*|\s+)(.*)$", 1))
    inline = near.filter(rest.rlike(r"^(?U)[:\-\s]")).withColumn("v", value).filter("v <> ''")
    inline = inline.groupBy(*keys, "key_ordinal").agg(F.min_by("v", "i").alias("inline"))
    label = near.filter("n = _k").select(*keys, "key_ordinal", F.col("i").alias("li"), *[F.col(c).alias(f"l_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    pairs = label.join(base.filter("text <> ''"), keys).filter("i <> li")
    a, b = box("l_"), box()
    rows = F.least(a.max_y, b.max_y) - F.greatest(a.min_y, b.min_y) >= 0.5 * F.greatest(a.height, F.lit(1.0))
    cols = F.least(a.max_x, b.max_x) - F.greatest(a.min_x, b.min_x) >= 0.5 * F.greatest(a.width, F.lit(1.0))
    right = F.when((b.min_x > a.max_x) & rows, F.struct((b.min_x - a.max_x).alias("gap"), F.col("li"), F.col("i")))
    below = F.when((b.min_y > a.max_y) & cols, F.struct((b.min_y - a.max_y).alias("gap"), F.col("li"), F.col("i")))
    text = F.trim("text")
    beside = pairs.groupBy(*keys, "key_ordinal").agg(F.min_by(text, right).alias("right"), F.min_by(text, below).alias("below"))
    pages = lines.select(*keys).distinct().crossJoin(asked.drop("_k"))
    out = pages.join(inline, [*keys, "key_ordinal"], "left").join(beside, [*keys, "key_ordinal"], "left")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return out.select(*keys, "key_ordinal", "key", F.coalesce("inline", some("right"), some("below")).alias("value"))
