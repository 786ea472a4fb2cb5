"""Decoding of recognition matrices: greedy CTC, space recovery, words, tables' tokens, long lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import CJK


def vocabulary(lines: list[str], classes: int) -> list[str]:
    """Tokens of a model's classes from a dictionary's lines: class 0 is blank, and a space may follow, as the numbers tell."""
    if len(lines) == classes:
        return list(lines)
    if len(lines) + 1 == classes and lines:
        return ["", *lines[1:], " "] if lines[0] == "" else ["", *lines]
    whole = ["", *lines, " "]
    return whole if classes <= 0 else (whole + [""] * classes)[:classes]


def class_mask(tokens: list[str], allowed: str | None = None, blocked: str | None = None) -> list[bool]:
    """Which classes may win: blank always, space unless blocked; a blocked character loses even if allowed."""
    return [not t or (t == " " or allowed is None or t in set(allowed)) and not (blocked and t in set(blocked)) for t in tokens]


def arg_max(probs: Column, mask: list[bool] | None = None) -> Column:
    """The first largest class of a step, from 0 on."""
    if mask and not all(mask):
        keep = F.array(*map(F.lit, mask))
        probs = F.transform(probs, lambda p, i: F.when(F.get(keep, i), p).otherwise(F.lit(float("-inf"))))
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def greedy_decode(crops: DataFrame, tokens: list[str], probs: str = "probs", mask: list[bool] | None = None, space_threshold: float = 0.0) -> DataFrame:
    """crops with `text`, `confidence` (mean probability of what is emitted, 0 if nothing is) and `characters`.

    A step's winner is its first largest class. A winner equal to the step before widens the last character; class 0 and
    classes beyond the vocabulary emit nothing, yet count as the step before. A row is decoded inside the JVM.
    With a space threshold above 0, a space is put between two characters where blank won but space had so much.
    """
    vocab = F.array(*map(F.lit, tokens))
    steps = F.transform(probs, lambda p, i: F.struct(arg_max(p, mask).alias("k"), F.array_max(p).cast("double").alias("p"), i.cast("int").alias("i")))
    out = crops.withColumn("_s", steps)
    none = F.array().cast("array<struct<token:string,probability:double,first_step:int,last_step:int>>")
    start = F.struct(none.alias("c"), F.lit(-1).alias("before"))

    def step(acc, s):
        emits = (s["k"] > 0) & (s["k"] < len(tokens))
        fresh = F.struct(F.get(vocab, s["k"]).alias("token"), s["p"].alias("probability"), s["i"].alias("first_step"), s["i"].alias("last_step"))
        n = F.size(acc["c"])
        last = F.get(acc["c"], n - 1)
        wide = F.struct(last["token"].alias("token"), last["probability"].alias("probability"), last["first_step"].alias("first_step"), s["i"].alias("last_step"))
        grown = F.when(emits & (s["k"] != acc["before"]), F.array_append(acc["c"], fresh)).when(emits & (n > 0), F.array_append(F.slice(acc["c"], F.lit(1), F.greatest(n - 1, F.lit(0))), wide)).otherwise(acc["c"])
        return F.struct(grown.alias("c"), s["k"].alias("before"))

    chars = F.aggregate("_s", start, step)["c"]
    out = out.withColumn("characters", chars).drop("_s")
    confidence = F.when(F.size("characters") > 0, F.aggregate("characters", F.lit(0.0), lambda a, c: a + c["probability"]) / F.size("characters")).otherwise(F.lit(0.0))
    out = out.withColumn("confidence", confidence)
    if space_threshold > 0 and " " in tokens:
        space = tokens.index(" ")
        out = out.withColumn("characters", _with_spaces(F.col("characters"), F.col(probs), space, space_threshold))
    return out.withColumn("text", F.array_join(F.transform("characters", lambda c: c["token"]), ""))


def _with_spaces(chars: Column, probs: Column, space: int, threshold: float) -> Column:
    """A space after each character before whose successor, in the steps between, space reached the threshold; none beside marks, digits' points or CJK."""
    n = F.size(chars)

    def gap(c, i):
        nxt = F.get(chars, i + 1)
        between = F.slice(probs, c["last_step"] + 2, F.greatest(nxt["first_step"] - c["last_step"] - 1, F.lit(0)))
        peak = F.array_max(F.transform(between, lambda p: F.get(p, F.lit(space))))
        veto = (c["token"] == " ") | (nxt["token"] == " ") | c["token"].rlike(f"[(\\[{{{CJK}]") | nxt["token"].rlike(f"[)\\]}},.;:!?%{CJK}]") | (c["token"].rlike(r"[.,:/'-]") & nxt["token"].rlike(r"\d"))
        return F.coalesce((i + 1 < n) & (peak >= threshold) & ~veto, F.lit(False))

    mark = lambda c: F.struct(F.lit(" ").alias("token"), F.lit(0.0).alias("probability"), c["last_step"].alias("first_step"), c["last_step"].alias("last_step"))
    return F.flatten(F.transform(chars, lambda c, i: F.when(gap(c, i), F.array(c, mark(c))).otherwise(F.array(c))))


def words_of_characters(chars: Column) -> Column:
    """array<struct<text,confidence,first_step,last_step>>: cut at spaces, and around each CJK character."""
    none = F.array().cast("array<struct<text:string,total:double,n:int,first_step:int,last_step:int,open:boolean>>")

    def step(acc, c):
        n = F.size(acc)
        last = F.get(acc, n - 1)
        cjk = c["token"].rlike(f"[{CJK}]")
        joins = (n > 0) & last["open"] & ~cjk & (c["token"] != " ")
        fresh = F.struct(c["token"].alias("text"), c["probability"].alias("total"), F.lit(1).alias("n"), c["first_step"].alias("first_step"), c["last_step"].alias("last_step"), (~cjk).alias("open"))
        grown = F.struct(F.concat(last["text"], c["token"]).alias("text"), (last["total"] + c["probability"]).alias("total"), (last["n"] + 1).alias("n"), last["first_step"].alias("first_step"), c["last_step"].alias("last_step"), F.lit(True).alias("open"))
        closed = F.struct(last["text"].alias("text"), last["total"].alias("total"), last["n"].alias("n"), last["first_step"].alias("first_step"), last["last_step"].alias("last_step"), F.lit(False).alias("open"))
        head = F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0)))
        return F.when(c["token"] == " ", F.when(n > 0, F.array_append(head, closed)).otherwise(acc)).when(joins, F.array_append(head, grown)).otherwise(F.array_append(acc, fresh))

    return F.transform(F.aggregate(chars, none, step), lambda w: F.struct(w["text"].alias("text"), (w["total"] / w["n"]).alias("confidence"), w["first_step"].alias("first_step"), w["last_step"].alias("last_step")))


def word_boxes(words: Column, steps: Column, line: Column) -> Column:
    """The words with boxes: their steps' share of the line's width."""
    unit = (line["max_x"] - line["min_x"]) / steps
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), w["confidence"].alias("confidence"), (line["min_x"] + w["first_step"] * unit).alias("min_x"), line["min_y"].alias("min_y"), (line["min_x"] + (w["last_step"] + 1) * unit).alias("max_x"), line["max_y"].alias("max_y")))


def window_plan(length: Column, window: int, overlap: float = 0.2, most: int = 64) -> Column:
    """Starts of overlapping windows over a length, the last one flush with its end; one window if it fits, or if they were too many."""
    stride = max(1, int(window * (1 - overlap)))
    n = F.ceil((length - window) / stride).cast("int") + 1
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(i * stride, length - window).cast("int"))
    return F.when((length <= window) | (n > most), F.array(F.lit(0))).otherwise(starts)
