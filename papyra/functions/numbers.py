"""Check digits, amounts and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS, _LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def mrz_check_digit(text: Column) -> Column:
    """Weights 7, 3, 1 over digits, letters from 10 on and filler 0, modulo 10; -1 if another character is there."""
    weighted = F.transform(_chars(text), lambda c, i: F.when(c == "<", F.lit(0)).otherwise(F.position(c, F.lit(_DIGITS + _LETTERS)) - 1) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int")))
    return F.when(text.rlike("^[0-9A-Z<]*$"), F.aggregate(weighted, F.lit(0), lambda a, x: a + x.cast("int")) % 10).otherwise(F.lit(-1))


def iban_remainder(iban: Column) -> Column:
    """Modulo 97 of the IBAN with its first four characters last and letters as two digits; null if it is none."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    fold = F.aggregate(_chars(turned), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.position(c, F.lit(_LETTERS)) + 9) % 97).cast("int"))
    return F.when(iban.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), fold)


def is_iban(iban: Column) -> Column:
    return F.coalesce(iban_remainder(iban) == 1, F.lit(False))


def to_digits(text: Column) -> Column:
    """Letters that look like digits as these."""
    return F.translate(text, "OoIlL|", "001111")


def is_card(text: Column) -> Column:
    """13 to 19 digits that begin with 2 to 6, aren't all the same and pass the check; at most two look-alikes among them."""
    bare = F.regexp_replace(text, "[ -]", "")
    digits = to_digits(bare)
    alike = F.length(F.regexp_replace(bare, "[^OoIlL|]", ""))
    return F.coalesce(digits.rlike("^[2-6][0-9]{12,18}$") & ~digits.rlike(r"^(.)\1*$") & (alike <= 2) & F.when(digits.rlike("^[0-9]+$"), F.call_function("luhn_check", digits)).otherwise(False), F.lit(False))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd, or null for a date that there isn't."""
    ok = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    text = F.format_string("%04d-%02d-%02d", F.coalesce(year, F.lit(0)), F.coalesce(month, F.lit(0)), F.coalesce(day, F.lit(0)))
    return F.when(ok & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def normalise_number(text: Column) -> Column:
    """`1.234,56` as `1234.56`: one or two digits after the last mark are decimals; null if group marks differ or are the decimal mark."""
    mark = F.regexp_extract(text, r"([.,])\d{1,2}$", 1)
    whole = F.regexp_replace(text, r"[.,]\d{1,2}$", "")
    groups = F.array_distinct(_chars(F.regexp_replace(whole, r"\d", "")))
    digits = F.regexp_replace(F.regexp_replace(whole, r"\D", ""), "^0+(?=.)", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    fraction = F.regexp_extract(text, r"[.,](\d{1,2})$", 1)
    bad = (F.size(groups) > 1) | ((mark != "") & F.array_contains(groups, mark))
    return F.when(~bad, F.when(fraction != "", F.concat(digits, F.lit("."), fraction)).otherwise(digits))


def canonical_decimal(text: Column, scale: int = 18) -> Column:
    """The text as decimal(38, scale) if it is one exactly: white space around, a sign and a point are all that may be beside digits; else null."""
    t = F.trim(text)
    plain = t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    fraction = F.regexp_replace(F.regexp_extract(t, r"\.(\d*)$", 1), "0+$", "")
    return F.when(plain & (F.length(fraction) <= scale), t.try_cast(f"decimal(38,{scale})"))


def auto_dpi(width_points: Column, height_points: Column) -> Column:
    """Resolution at which the longer side has about 4000 pixels, from 150 to 400; 400 for a page without size."""
    inches = F.greatest(width_points, height_points) / 72
    return F.when(inches > 0, F.greatest(F.lit(150), F.least(F.lit(400), F.floor(4000 / inches)))).otherwise(F.lit(400)).cast("int")


def auto_dpi_of(width_points: float, height_points: float) -> int:
    """auto_dpi of one page."""
    inches = max(width_points, height_points) / 72
    return max(150, min(400, int(4000 // inches))) if inches > 0 else 400


def calibrated(raw: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through ascending knots, clamped at the ends; 0 for what isn't finite."""
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        step = F.lit(float(y1)) if x1 == x0 else y0 + (raw - x0) / (x1 - x0) * (y1 - y0)
        out = F.when(raw <= x1, step).otherwise(out)
    out = F.when(raw <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)
    return F.when(raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf")), F.lit(0.0)).otherwise(out)


def percent(confidence: Column) -> Column:
    """0 to 100, halves to even."""
    return F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)) * 100).cast("int")


def column_number(letters: Column) -> Column:
    """A spreadsheet column's letters as its number from 1 on."""
    return F.aggregate(_chars(F.upper(letters)), F.lit(0), lambda a, c: (a * 26 + F.position(c, F.lit(_LETTERS))).cast("int"))
