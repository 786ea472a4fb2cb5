"""Confidence quality of pages, calibration, votes and skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.paging import by_page
from papyra.functions.text import count_characters

LOW_CONFIDENCE = 0.85


def character_weight(text: Column) -> Column:
    return F.greatest(F.lit(1), count_characters(text))


def quality_summary(lines: DataFrame, keys: list[str], threshold: float = LOW_CONFIDENCE, pages: DataFrame | None = None) -> DataFrame:
    """Per page: lines, characters, mean, character-weighted mean, least, and lines below the threshold; zeros for pages without lines."""
    w, c = character_weight(F.col("text")), F.col("confidence")
    low = F.sum((c < threshold).cast("long"))
    out = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(count_characters(F.col("text"))).alias("character_count"), F.avg(c).alias("mean_confidence"),
        (F.sum(c * w) / F.sum(w)).alias("weighted_confidence"), F.min(c).alias("min_confidence"), low.alias("low_count"), (low / F.count(F.lit(1))).alias("low_ratio"),
    )
    if pages is not None:
        out = pages.select(*keys).join(out, keys, "left").na.fill(0)
    return out


def lines_for_review(lines: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    return lines.filter(F.col("confidence") < threshold)


def drop_weak(lines: DataFrame, drop_score: float = 0.0) -> DataFrame:
    """Without blank lines and those below the score."""
    return lines.filter((count_characters(F.col("text")) > 0) & (F.col("confidence") >= drop_score))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Per key, the first value at which the weight so far is half of all or more."""
    w = Window.partitionBy(*keys)
    run = rows.withColumn("_so_far", F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(weight).over(w))
    return run.filter(F.col("_so_far") >= F.col("_all") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def skew(quads: DataFrame, keys: list[str], least: int = 5, most_mad: float = 2.0) -> DataFrame:
    """Per page, the weighted median angle of elongated quads; 0 if they are fewer than five or disagree.

    quads: angle in degrees, width, height. A quad counts if it is at least twice as wide as high, by its width.
    """
    long = quads.filter((F.col("height") > 0) & (F.col("width") >= 2 * F.col("height")))
    mid = weighted_median(long, keys, "angle", "width").withColumnRenamed("weighted_median", "_mid")
    spread = long.join(mid, keys).groupBy(*keys).agg(F.median(F.abs(F.col("angle") - F.col("_mid"))).alias("_mad"), F.count(F.lit(1)).alias("_n"), F.first("_mid").alias("_mid"))
    found = spread.select(*keys, F.when((F.col("_n") >= least) & (F.col("_mad") < most_mad), F.col("_mid")).otherwise(F.lit(0.0)).alias("skew"))
    return quads.select(*keys).distinct().join(found, keys, "left").na.fill(0.0, ["skew"])


def reliability(samples: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Per key and bin of confidence (the last one closed): rows, mean confidence, share correct."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)).cast("int")
    return samples.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibration_errors(samples: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score."""
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(0)))
    ece = reliability(samples, keys, bins).withColumn("_part", F.col("n") / total * F.abs(F.col("mean_confidence") - F.col("accuracy"))).groupBy(*keys).agg(F.sum("_part").alias("ece"))
    brier = samples.groupBy(*keys).agg(F.avg(F.pow(F.col("confidence") - F.col("correct").cast("double"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))
    return ece.join(brier, keys) if keys else ece.crossJoin(brier)  # of one row each


def risk_coverage(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and distinct confidence, from the highest on: the share of rows accepted so far and the share of these that are wrong."""
    tied = samples.groupBy(*keys, "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("correct")).cast("long")).alias("wrong"))
    w = Window.partitionBy(*keys)
    run = w.orderBy(F.desc("confidence"))
    n, wrong = F.sum("n").over(run), F.sum("wrong").over(run)
    return tied.select(*keys, "confidence", (n / F.sum("n").over(w)).alias("coverage"), (wrong / n).alias("risk"))


def isotonic_curves(samples: DataFrame, key: str = "pack") -> DataFrame:
    """Per pack, the knots of the monotone fit of correctness on confidence, ties pooled, ends extended to 0 and 1.

    Rows are pooled by confidence before a pack's fit, so a task holds distinct confidences only.
    """
    tied = samples.groupBy(key, "raw_confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("double")).alias("hits"))

    def fit(rows: list[dict]):
        blocks: list[list[float]] = []  # hits, weight, first and last confidence
        for r in rows:
            blocks.append([r["hits"], r["n"], r["raw_confidence"], r["raw_confidence"]])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
                hits, n, _, end = blocks.pop()
                blocks[-1][0] += hits
                blocks[-1][1] += n
                blocks[-1][3] = end
        value = lambda x: next(h / n for h, n, a, b in blocks if a <= x <= b)
        xs = [r["raw_confidence"] for r in rows]
        raw = [0.0] * (xs[0] > 0) + xs + [1.0] * (xs[-1] < 1)
        ys = [value(min(max(x, xs[0]), xs[-1])) for x in raw]
        yield {key: rows[0][key], "raw": raw, "correctness": ys}

    return by_page(tied, [key], ["raw_confidence"], fit, f"{key} string, raw array<double>, correctness array<double>")


def pack_vote(readings: DataFrame, page: list[str]) -> DataFrame:
    """Per page, recogniser packs ranked: each crop votes for its best pack, a pack scores its votes' confidences; to 9 digits, so that the order of a sum decides no tie.

    readings: crop_id, pack, pack_order, confidence, text.
    """
    best = readings.groupBy(*page, "crop_id").agg(F.max_by(F.struct("pack", "pack_order", "confidence"), F.struct("confidence", -F.col("pack_order"))).alias("b"))
    score = best.groupBy(*page, F.col("b.pack").alias("pack")).agg(F.sum(F.greatest(F.lit(0.0), F.col("b.confidence"))).alias("score"), F.min("b.pack_order").alias("_o"))
    return score.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy(F.desc(F.round("score", 9)), "_o"))).drop("_o")


def orientation_vote(readings: DataFrame, page: list[str]) -> DataFrame:
    """Per page, the rotation whose text has the most confidence times characters, to 6 digits; the least rotation on ties."""
    s = readings.groupBy(*page, "rotation").agg(F.sum(F.col("confidence") * F.length("text")).alias("score"))
    return s.groupBy(*page).agg(F.max_by("rotation", F.struct(F.round("score", 6), -F.col("rotation"))).alias("rotation"), F.max("score").alias("score"))


def choose_reading(upright: Column, upright_conf: Column, turned: Column, turned_conf: Column) -> Column:
    """true if the turned reading wins: a blank one loses, else the more confident one wins, ties to upright."""
    blank = lambda t: count_characters(t) == 0
    return F.when(blank(turned), False).when(blank(upright), True).otherwise(turned_conf > upright_conf)


def accept_retry(before: Column, before_conf: Column, after: Column, after_conf: Column, gain: float = 0.05) -> Column:
    """A second reading counts if it is surer by the gain and differs by at most two edits or a quarter of the longer text."""
    edits = F.levenshtein(before, after)
    most = F.greatest(F.lit(2), F.floor(F.greatest(F.length(before), F.length(after)) * 0.25))
    return (after_conf >= before_conf + gain) & (edits <= most) & (count_characters(after) > 0)


def review_reasons(pages: DataFrame, lines: DataFrame, keys: list[str], threshold: float = LOW_CONFIDENCE, small_text: float = 16.0) -> DataFrame:
    """Per page the reasons to have it checked: no text, weak lines, weak mean, small text; sorted."""
    s = quality_summary(lines, keys, threshold, pages)
    h = lines.groupBy(*keys).agg(F.median(F.col("max_y") - F.col("min_y")).alias("_h"))
    s = s.join(h, keys, "left")
    when = lambda c, t: F.when(c, F.lit(t))
    reasons = F.array(when(F.col("line_count") == 0, "no-text"), when(F.col("low_count") > 0, "low-confidence-lines"), when((F.col("line_count") > 0) & (F.col("weighted_confidence") < threshold), "low-confidence-page"), when(F.col("_h") < small_text, "small-text"))
    return s.select(*keys, F.array_sort(F.filter(reasons, lambda r: r.isNotNull())).alias("reasons"))


def image_quality(pixels: DataFrame, keys: list[str], grid: int = 64) -> DataFrame:
    """Per page of luminance pixels (x, y, luma, width, height), on a grid of at most 64 x 64: contrast, edges, spread of quadrants."""
    sx, sy = F.greatest(F.lit(1), F.ceil(F.col("width") / grid)), F.greatest(F.lit(1), F.ceil(F.col("height") / grid))
    g = pixels.filter((F.col("x") % sx == 0) & (F.col("y") % sy == 0))
    before = F.lag("luma").over(Window.partitionBy(*keys, "y").orderBy("x"))
    g = g.withColumn("_edge", F.abs(F.col("luma") - before)).withColumn("_q", F.when(F.col("x") * 2 >= F.col("width"), 1).otherwise(0) + F.when(F.col("y") * 2 >= F.col("height"), 2).otherwise(0))
    whole = g.groupBy(*keys).agg((F.stddev_pop("luma") / 255).alias("contrast"), (F.avg("_edge") / 255).alias("edge_energy"))
    quad = g.groupBy(*keys, "_q").agg(F.avg("luma").alias("m")).groupBy(*keys).agg(((F.max("m") - F.min("m")) / 255).alias("luminance_spread"))
    return whole.join(quad, keys)
