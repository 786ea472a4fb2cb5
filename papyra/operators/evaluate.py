"""Transcription scores, slices, retries and paired bootstraps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.paging import by_page
from papyra.functions.text import bounded_count, physical_lines


def normalise_transcription(text: Column) -> Column:
    """Line ends as LF, runs of white space in a line as one space, none at its ends; nfc() is the caller's, as it needs Python."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n"), "\n")
    return F.array_join(F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"(?U)[\s&&[^\n]]+", " "))), "\n")


def _tokens(text: Column, by: str) -> Column:
    return F.filter(F.split(text, by), lambda t: t != "")


def coded_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of strings, inside the JVM: each different token becomes a private-use character.

    Holds for up to 131068 different tokens of a pair, the characters of planes 15 and 16.
    """
    names = F.array_distinct(F.concat(a, b))
    coded = lambda x: F.array_join(F.transform(x, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(names, t) + 0xF0000 - 1), 8, "0")), "UTF-32")), "")
    return F.levenshtein(coded(a), coded(b))


def score_pairs(pairs: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """pairs with character, word and line edits, lengths, error rates (null for an empty reference) and exact match."""
    r, p = normalise_transcription(F.col(reference)), normalise_transcription(F.col(prediction))
    out = pairs.withColumns({"_r": r, "_p": p})
    rw, pw = _tokens(F.col("_r"), r"\s+"), _tokens(F.col("_p"), r"\s+")
    rl, pl = _tokens(F.col("_r"), "\n"), _tokens(F.col("_p"), "\n")
    out = out.withColumns({
        "char_edits": F.levenshtein("_r", "_p"), "char_count": F.length("_r"), "word_edits": coded_distance(rw, pw), "word_count": F.size(rw), "line_edits": coded_distance(rl, pl), "line_count": F.size(rl), "exact": F.col("_r") == F.col("_p"),
    })
    rate = lambda e, n: F.when(F.col(n) > 0, F.col(e) / F.col(n))
    return out.withColumns({"cer": rate("char_edits", "char_count"), "wer": rate("word_edits", "word_count")}).drop("_r", "_p")


@F.pandas_udf(T.IntegerType())
def common_lines(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two lists, one addition of bit sets for each item of the second."""

    def length(x, y) -> int:
        places: dict[str, int] = {}
        for i, t in enumerate(x):
            places[t] = places.get(t, 0) | 1 << i
        full = open_ = (1 << len(x)) - 1
        for t in y:
            hit = open_ & places.get(t, 0)
            open_ = ((open_ + hit) | (open_ - hit)) & full
        return len(x) - open_.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b)], dtype="int32")


def exact_line_lcs(pairs: DataFrame, key: str = "id", reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """key, lcs: lines of the longest common subsequence of equal lines; a null text has none. Rows stay where they are."""
    lines = lambda c: F.coalesce(physical_lines(F.col(c)), F.array().cast("array<string>"))
    return pairs.select(key, common_lines(lines(reference), lines(prediction)).alias("lcs"))


def slices(scores: DataFrame, by: list[str], document: str = "document_id") -> DataFrame:
    """Micro-averages per value of each slicing column: documents, items, summed edits over summed length, null if that is 0."""
    out = None
    for column in by:
        s = scores.groupBy(F.lit(column).alias("slice"), F.col(column).cast("string").alias("value")).agg(
            F.countDistinct(document).alias("documents"), F.count(F.lit(1)).alias("items"),
            (F.sum("char_edits") / F.nullif(F.sum("char_count"), F.lit(0))).alias("cer"), (F.sum("word_edits") / F.nullif(F.sum("word_count"), F.lit(0))).alias("wer"),
        )
        out = s if out is None else out.unionByName(s)
    return out


def check_manifest(manifest: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """What is wrong: (problem, key) for ids missing, extra or repeated, and for documents and origins in several splits. Empty if all is well."""
    problem = lambda df, name: df.select(F.lit(name).alias("problem"), F.col(df.columns[0]).cast("string").alias("key"))
    m, p = manifest.select(key), predictions.select(key)
    out = problem(m.join(p, key, "left_anti"), "missing").union(problem(p.join(m, key, "left_anti"), "extra"))
    for name, df in (("repeated-item", m), ("repeated-prediction", p)):
        out = out.union(problem(df.groupBy(key).count().filter("count > 1").select(key), name))
    for column in ("document_id", "origin_group"):
        if column in manifest.columns:
            out = out.union(problem(manifest.groupBy(column).agg(F.countDistinct("split").alias("n")).filter("n > 1").select(column), f"{column}-in-splits"))
    return out


def retry_outcomes(cases: DataFrame) -> DataFrame:
    """cases (id, reference, before, after, critical_tokens) with edits before and after, the outcome, and critical tokens right before and after."""
    before, after = F.levenshtein("reference", "before"), F.levenshtein("reference", "after")
    outcome = F.when(F.col("before") == F.col("after"), "unchanged").when(after < before, "improved").when(after > before, "worsened").otherwise("neutral")
    hits = lambda c: F.aggregate("critical_tokens", F.lit(0), lambda a, t: a + F.least(bounded_count(F.col(c), t), bounded_count(F.col("reference"), t)))
    return cases.withColumns({"edits_before": before, "edits_after": after, "outcome": outcome, "tokens_before": hits("before"), "tokens_after": hits("after")})


def retry_summary(outcomes: DataFrame) -> DataFrame:
    kinds = ("unchanged", "improved", "worsened", "neutral")
    return outcomes.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds], F.sum("edits_before").alias("edits_before"), F.sum("edits_after").alias("edits_after"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))


def paired_bootstrap(scores: DataFrame, group: str = "subgroup", resamples: int = 2000, seed: int = 1729, margin: float = 0.0) -> DataFrame:
    """Per subgroup: documents, mean difference of candidate and baseline error, its 95 % interval over resampled documents, and the gate.

    The gate: `improved` if the interval lies below 0, `regressed` if above the margin, `inconclusive` if it reaches
    both sides, `insufficient` for fewer than two documents. Documents are pooled first, then those of the same
    difference, so a task holds a subgroup's different differences; a resample draws how often each occurs.
    """
    docs = scores.groupBy(group, "document_id").agg((F.avg("candidate_error") - F.avg("baseline_error")).alias("d"))
    tied = docs.filter("d is not null").groupBy(group, "d").agg(F.count(F.lit(1)).alias("n"))

    def resample(rows: list[dict]):
        d, n = np.array([r["d"] for r in rows]), np.array([r["n"] for r in rows])
        total = int(n.sum())
        rng, each = np.random.default_rng(seed), max(1, 4_000_000 // len(d))
        drawn = (rng.multinomial(total, n / total, min(each, resamples - i)) @ d / total for i in range(0, resamples, each))
        low, high = np.percentile(np.concatenate(list(drawn)), [2.5, 97.5])
        gate = "insufficient" if total < 2 else "improved" if high < 0 else "regressed" if low > margin else "inconclusive"
        yield {group: rows[0][group], "documents": total, "mean_difference": float(n @ d / total), "low": float(low), "high": float(high), "gate": gate}

    return by_page(tied, [group], ["d"], resample, f"{group} string, documents long, mean_difference double, low double, high double, gate string")


def token_usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Summed token counts of model calls; null where no call reported any."""
    return calls.groupBy(*keys).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def route_language(readings: DataFrame, page: list[str], curves: dict[str, list[tuple[float, float]]] | None = None, fast: float = 0.85, fast_packs: tuple[str, ...] = ("latin", "chinese"), most_packs: int = 0) -> DataFrame:
    """Per page, the recogniser pack: the first one if it is a fast one and sure enough, else the best of those admitted.

    readings: pack, pack_order, confidence (mean over the page). With curves, confidences are calibrated; a pack without one is refused.
    """
    from papyra.functions.numbers import calibrated

    r = readings
    if curves:
        raw = F.col("confidence")
        value = F.lit(None).cast("double")
        for pack, knots in curves.items():
            value = F.when(F.col("pack") == pack, calibrated(raw, knots)).otherwise(value)
        r = r.withColumn("confidence", value).filter("confidence is not null")
    rank = F.row_number().over(Window.partitionBy(*page).orderBy("pack_order"))
    r = r.withColumn("_r", rank)
    if most_packs:
        r = r.filter(F.col("_r") <= most_packs)
    first = F.max(F.when((F.col("_r") == 1) & F.col("pack").isin(*fast_packs) & (F.col("confidence") >= fast), F.struct("pack", "confidence")))
    best = F.max_by(F.struct("pack", "confidence"), F.struct(F.col("confidence"), -F.col("pack_order")))
    return r.groupBy(*page).agg(F.coalesce(first, best).alias("c"), first.isNotNull().alias("fast_path")).select(*page, "c.pack", "c.confidence", "fast_path")
