"""Embedded text of PDF pages: quality gate, glyphs to lines, fusion with recognised lines."""

from __future__ import annotations

import unicodedata
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.paging import by_page
from papyra.functions.text import reliable_native

# fixed values: least characters, most invalid and least letters; gaps in em; tracking; overlaps; coverage for automatic use
LEAST_CHARACTERS, MOST_INVALID, LEAST_LETTERS = 20, 0.05, 0.6
WORD_GAP, TRACKING_GAP, TRACKING_SAMPLES, COLUMN_GAP, VERTICAL_OVERLAP, BASELINE = 0.3, 1.5, 3, 2.0, 0.5, 0.5
LEAST_COVERAGE = 0.01
LINE = "text string, confidence double, min_x double, min_y double, max_x double, max_y double"


def quality_gate(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Per page, whether its characters can be trusted: enough of them, few invalid ones, mostly letters or digits."""
    v = F.col("value")
    seen = ~v.rlike(r"^(?U)\s$")
    invalid = v.rlike(r"[\x{FFFD}\p{Cc}\p{Co}]")
    count = lambda c: F.count_if(seen & c)
    n = F.count_if(seen)
    g = chars.groupBy(*keys).agg(n.alias("characters"), count(invalid).alias("invalid"), count(~invalid & v.rlike(r"[\p{L}\p{Nd}]")).alias("letters"))
    ok = (F.col("characters") >= LEAST_CHARACTERS) & (F.col("invalid") < F.col("characters") * MOST_INVALID) & (F.col("letters") >= F.col("characters") * LEAST_LETTERS)
    return g.withColumn("passes", ok)


def _joins(c: dict, before: dict, top: float, bottom: float) -> bool:
    em = max(c["em"], before["em"])
    if not -em <= c["left"] - before["right"] <= COLUMN_GAP * em:
        return False
    if c["top"] >= top and c["bottom"] <= bottom or c["top"] <= top and c["bottom"] >= bottom:
        return True
    overlap = min(bottom, c["bottom"]) - max(top, c["top"])
    enough = overlap >= VERTICAL_OVERLAP * min(max(1.0, bottom - top), max(1.0, c["bottom"] - c["top"]))
    return enough and min(abs(c["bottom"] - before["bottom"]), abs(c["bottom"] - bottom)) <= BASELINE * em


def _text_line(glyphs: list[tuple[dict, bool]]) -> dict:
    gaps = [b["left"] - a["right"] for (a, _), (b, space) in zip(glyphs, glyphs[1:]) if not space]
    typical = median(gaps) if len(gaps) >= TRACKING_SAMPLES else 0.0
    text = glyphs[0][0]["value"]
    for (a, _), (b, space) in zip(glyphs, glyphs[1:]):
        wide = b["left"] - a["right"] > max(WORD_GAP * max(a["em"], b["em"]), TRACKING_GAP * typical)
        text += (" " if space or wide else "") + b["value"]
    g = [x for x, _ in glyphs]
    return {"text": text, "confidence": 1.0, "min_x": min(x["left"] for x in g), "min_y": min(x["top"] for x in g), "max_x": max(x["right"] for x in g), "max_y": max(x["bottom"] for x in g)}


def glyphs_to_lines(chars: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """keys, line_index and the line: glyphs in order join a line while they stand beside its last one in its band."""

    def fold(rows: list[dict]):
        lines, line, pending, top, bottom = [], [], False, 0.0, 0.0
        for c in rows:
            if c["value"].isspace() or unicodedata.category(c["value"][0]) == "Cc":
                pending = pending or bool(line)
                continue
            if line and not _joins(c, line[-1][0], top, bottom):
                lines.append(line)
                line, pending = [], False
            top, bottom = (min(top, c["top"]), max(bottom, c["bottom"])) if line else (c["top"], c["bottom"])
            line.append((c, pending))
            pending = False
        for i, glyphs in enumerate([*lines, *([line] if line else [])]):
            yield {k: rows[0][k] for k in keys} | {"line_index": i} | _text_line(glyphs)

    types = dict(chars.dtypes)
    return by_page(chars, keys, [order], fold, ", ".join(f"{k} {types[k]}" for k in keys) + f", line_index int, {LINE}")


def coverage(lines: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """Lines' area as a share of the page's, overlaps counted twice, as the automatic mode has it."""
    area = F.sum((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))
    return lines.groupBy(*keys).agg((area / (width * height)).alias("coverage"))


def select_lines(chars: DataFrame, keys: list[str], mode: str, width: float, height: float) -> DataFrame:
    """Lines of the pages whose embedded text is used in a mode: Ignore, Prefer, Auto (enough of the page) or Hybrid (reliable lines)."""
    if mode not in ("Ignore", "Prefer", "Auto", "Hybrid"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "Ignore":
        chars = chars.limit(0)
    if mode == "Hybrid":
        return reliable_lines(glyphs_to_lines(chars, keys), width, height)
    lines = glyphs_to_lines(chars.join(quality_gate(chars, keys).filter("passes").select(*keys), keys, "left_semi"), keys)
    if mode == "Auto":
        lines = lines.join(coverage(lines, keys, width, height).filter(F.col("coverage") >= LEAST_COVERAGE).select(*keys), keys, "left_semi")
    return lines


def reliable_lines(lines: DataFrame, width: float, height: float) -> DataFrame:
    """Lines on the page with an area and text worth trusting."""
    finite = ~F.greatest(*[F.isnan(c).cast("int") for c in ("min_x", "min_y", "max_x", "max_y")]).cast("boolean")
    inside = (F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y")) & (F.col("max_x") > 0) & (F.col("max_y") > 0) & (F.col("min_x") < width) & (F.col("min_y") < height)
    return lines.filter(finite & inside & reliable_native(F.col("text")))


def _same(a: dict, b: dict) -> bool:
    both = max(0, min(a["max_x"], b["max_x"]) - max(a["min_x"], b["min_x"])) * max(0, min(a["max_y"], b["max_y"]) - max(a["min_y"], b["min_y"]))
    areas = sorted((x["max_x"] - x["min_x"]) * (x["max_y"] - x["min_y"]) for x in (a, b))
    return areas[0] > 0 and both / areas[0] >= 0.7 and both / areas[1] >= 0.5


def _plain(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", text or "").split())


def fuse(native: DataFrame, visual: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """Lines of both sources, each region once: native text wins, other readings are kept as alternatives, differing ones are conflicts.

    Natives come first, in order, then recognised lines; the result is from the top, then from the left.
    """
    columns = [*keys, "line_index", "text", "confidence", "min_x", "min_y", "max_x", "max_y"]
    both = reliable_lines(native, width, height).select(*columns, F.lit(0).alias("_s")).unionByName(visual.select(*columns, F.lit(1).alias("_s")))

    def fold(rows: list[dict]):
        kept: list[dict] = []
        for r in rows:
            r = r | {"source": "Ocr" if r["_s"] else "EmbeddedText", "alternatives": [], "has_conflict": False}
            hit = next((k for k in kept if (not r["_s"] or k["source"] == "EmbeddedText") and _same(k, r)), None)
            if hit is None:
                if not (r["_s"] and any(_same(k, r) and _plain(k["text"]) == _plain(r["text"]) for k in kept)):
                    kept.append(r)
                continue
            differs = _plain(hit["text"]) != _plain(r["text"])
            if r["_s"] or differs:
                hit["alternatives"].append(r["text"])
                hit["has_conflict"] = hit["has_conflict"] or differs
        for i, k in enumerate(sorted(kept, key=lambda k: (k["min_y"], k["min_x"]))):
            yield k | {"line_index": i}

    types = dict(both.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", line_index int, {LINE}, source string, alternatives array<string>, has_conflict boolean"
    return by_page(both, keys, ["_s", "line_index"], fold, schema)


def searchable_content(lines: DataFrame, keys: list[str], page_height: float, points_per_pixel: float = 1.0) -> DataFrame:
    """keys, content: a page's invisible text as PDF operators, one scaled text matrix for each line; hexadecimal UTF-16 glyph ids."""
    p = points_per_pixel
    w, h = (F.col("max_x") - F.col("min_x")) * p, (F.col("max_y") - F.col("min_y")) * p
    n = F.greatest(F.lit(1), F.length("text"))
    two = lambda c: F.format_string("%.2f", c)
    text = F.concat(F.lit("<"), F.hex(F.encode("text", "UTF-16BE")), F.lit("> Tj"))
    item = F.concat_ws(" ", two(h), F.lit("0 0"), two(h), two(F.col("min_x") * p), two(F.lit(page_height * p) - F.col("max_y") * p), F.lit("Tm"), text)
    item = F.concat(F.lit("BT 3 Tr /F0 1 Tf "), two(w / (h * n * 0.5) * 100), F.lit(" Tz "), item, F.lit(" ET"))
    good = lines.filter((F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y")) & (F.length(F.trim("text")) > 0))
    g = good.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_index", item.alias("t")))).alias("l"))
    return g.select(*keys, F.array_join(F.col("l.t"), "\n").alias("content"))
