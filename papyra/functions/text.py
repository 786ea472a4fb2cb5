"""Text helpers. Character classes are Unicode's, as (?U) makes Java's; lengths and offsets are code points."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: code points shown two cells wide
WIDE = (
    r"\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}"
    r"\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}"
)
#: Marks, format and control characters take no cell.
_NO_CELL = r"[\p{Mn}\p{Me}\p{Cf}\p{Cc}]"
# fixed values: right-to-left letters
RTL = r"\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}"
# fixed values: scripts in the order that breaks ties, and their ranges
SCRIPTS = {
    "Latin": r"\x{0041}-\x{005A}\x{0061}-\x{007A}\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}", "Cyrillic": r"\x{0400}-\x{052F}", "Greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
    "Arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}", "Devanagari": r"\x{0900}-\x{097F}", "Thai": r"\x{0E00}-\x{0E7F}",
    "Hangul": r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}", "Kana": r"\x{3040}-\x{30FF}", "Han": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}", "Tamil": r"\x{0B80}-\x{0BFF}", "Telugu": r"\x{0C00}-\x{0C7F}",
}
# fixed values: characters that are words of their own
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{FF66}-\x{FF9F}\x{3000}-\x{303F}\x{20000}-\x{2FA1F}"
_LINE_END = r"\r\n|[\r\n\x0B\x0C\x{85}\x{2028}\x{2029}]"


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def display_width(text: Column) -> Column:
    """Character cells: none for marks and controls, two for wide characters."""
    seen = F.regexp_replace(text, _NO_CELL, "")
    return F.length(seen) + count_matches(seen, f"[{WIDE}]")


def count_characters(text: Column) -> Column:
    """Characters that are no white space; null has none."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", ""))


def is_blank(text: Column) -> Column:
    return count_characters(text) == 0


def predominantly_rtl(text: Column) -> Column:
    rtl = count_matches(text, f"[{RTL}]")
    return rtl > count_matches(text, f"[\\p{{L}}&&[^{RTL}]]")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def is_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def dominant_script(text: Column) -> Column:
    """The script of most letters, ties to the earlier one; null without any."""
    best = F.array_max(F.array(*[F.struct(count_matches(text, f"[{r}]").alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("script")) for i, (name, r) in enumerate(SCRIPTS.items())]))
    return F.when(best["n"] > 0, best["script"])


def physical_lines(text: Column) -> Column:
    return F.split(text, _LINE_END)


def clean_horizontal_space(text: Column) -> Column:
    """Runs of space inside a line become one, and none stay at its ends."""
    lines = F.transform(physical_lines(text), lambda s: F.trim(F.regexp_replace(s, r"[\p{Zs}\t]+", " ")))
    return F.array_join(lines, "\n")


def join_hyphenated(text: Column) -> Column:
    return F.regexp_replace(text, r"(\p{L})-\r?\n(\p{L})", "$1$2")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode's composed form, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


NORMALISATIONS = (("unicode", nfc), ("line_ends", lambda c: F.regexp_replace(c, _LINE_END, "\n")), ("hyphens", join_hyphenated), ("space", clean_horizontal_space))


def normalise(text: Column, *, unicode: bool = False, line_ends: bool = False, hyphens: bool = False, space: bool = False) -> tuple[Column, Column]:
    """(text after the steps asked for, log of the steps that changed it as array<struct<kind,before,after>>); all are off unless asked for."""
    asked = {"unicode": unicode, "line_ends": line_ends, "hyphens": hyphens, "space": space}
    log = []
    for kind, step in NORMALISATIONS:
        if asked[kind]:
            after = step(text)
            log.append(F.when(~text.eqNullSafe(after), F.struct(F.lit(kind).alias("kind"), text.alias("before"), after.alias("after"))))
            text = after
    return text, F.filter(F.array(*log), lambda x: x.isNotNull()) if log else F.array().cast("array<struct<kind:string,before:string,after:string>>")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_xml(text: Column) -> Column:
    return F.replace(F.replace(escape_html(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))


def decode_entities(text: Column) -> Column:
    """The named entities that table cells use; the ampersand last."""
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def table_fragment(html: Column) -> Column:
    """From the first `<table` to the last `</table>`, in any letter case; null if there is none."""
    found = F.regexp_extract(html, r"(?is)<table.*</table>", 0)
    return F.when(found != "", found)


def balanced_table(html: Column) -> Column:
    """The text is one table's markup: begins and ends so, opens as many as it closes, and has as many `<` as `>`."""
    low = F.lower(F.trim(html))
    return low.startswith("<table") & low.endswith("</table>") & (count_matches(low, "<table") == count_matches(low, "</table>")) & (count_matches(low, "<") == count_matches(low, ">"))


def full_text(lines: Column, separator: str = "\n") -> Column:
    """Lines that are not empty, without line ends at their ends, joined."""
    kept = F.filter(lines, lambda t: t.isNotNull() & (t != ""))
    return F.array_join(F.transform(kept, lambda t: F.regexp_replace(t, r"[\r\n]+$", "")), separator)


def reliable_native(text: Column) -> Column:
    """Text worth trusting: a letter or digit, and no replacement, private-use or control character."""
    return F.coalesce(text.rlike(r"[\p{L}\p{Nd}]") & ~text.rlike(r"[\x{FFFD}\p{Co}\p{Cc}]"), F.lit(False))


def detokenise_latex(tokens: Column) -> Column:
    """Pieces with the byte-level space mark as one formula: special tokens go, white space collapses."""
    joined = F.array_join(F.filter(tokens, lambda t: ~t.isin("<s>", "</s>", "<pad>", "[BOS]", "[EOS]", "[PAD]")), "")
    return collapse_space(F.replace(F.replace(joined, F.lit("Ġ"), F.lit(" ")), F.lit("Ċ"), F.lit(" ")))


def bounded_count(text: Column, token: Column) -> Column:
    """How often the token stands in the text with no letter, mark or digit beside it."""
    quoted = F.regexp_replace(token, r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    return F.regexp_count(text, F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{M}\p{N}])")))
