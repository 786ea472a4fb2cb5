import pytest
import regex
from pyspark.sql import functions as F

from papyra.functions import numbers as N
from papyra.functions import text as X
from papyra.operators.patterns import BUILT_IN, find_matches, matches_of, Pattern

CASES = [
    ("Email", "write to Jan.Doe@EXAMPLE.Co.UK.", "Jan.Doe@EXAMPLE.Co.UK", "Jan.Doe@example.co.uk"), ("Email", "a@b", None, None),
    ("Url", "see https://x.org/a?b=1).", "https://x.org/a?b=1", None), ("Url", "www.example.com, and", "www.example.com", None),
    ("Phone", "+44 (0)20 7946 0958", "+44 (0)20 7946 0958", "+442079460958"), ("Phone", "1 234 567", None, None), ("Phone", "(555) 123-4567", "(555) 123-4567", "5551234567"), ("Phone", "(0555) 123-45678", "(0555) 123-45678", "055512345678"),
    ("Date", "on 2026-03-12", "2026-03-12", "2026-03-12"), ("Date", "31/02/2026", None, None), ("Date", "12/03/2026", "12/03/2026", None), ("Date", "13/03/2026", "13/03/2026", "2026-03-13"), ("Date", "March 12, 2026", "March 12, 2026", "2026-03-12"), ("Date", "1.5.26", None, None),
    ("Amount", "€ 1.234,56", "€ 1.234,56", "EUR 1234.56"), ("Amount", "$12.50", "$12.50", "$ 12.50"), ("Amount", "-5 USD", "-5 USD", "USD -5"), ("Amount", "1,234.5 EUR", "1,234.5 EUR", "EUR 1234.5"),
    ("Iban", "DE89 3704 0044 0532 0130 00 AB", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"), ("Iban", "DE88 3704 0044 0532 0130 00", None, None),
    ("PaymentCard", "4111 1111 1111 1111", "4111 1111 1111 1111", "4111111111111111"), ("PaymentCard", "4111 1111 1111 1112", None, None),
    ("Percentage", "-2,5 %", "-2,5 %", "-2.5%"), ("Percentage", "v1.5%", None, None),
]


@pytest.mark.parametrize("kind,text,value,normalized", CASES)
def test_cases(kind, text, value, normalized):
    ready = [(p, regex.compile(p.expression)) for p in BUILT_IN if p.kind == kind]
    found = [(v, n) for _, _, _, v, n in matches_of(text, ready)]
    assert found == ([(value, normalized)] if value else [])


def test_find_matches(spark):
    rows = [(1, 0, "日本 a@b.org x", 0.9, 0.0, 0.0, 150.0, 10.0), (1, 1, None, 0.9, 0.0, 0.0, 1.0, 1.0), (1, 2, "nothing", 0.5, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, line_index long, text string, confidence double, min_x double, min_y double, max_x double, max_y double")
    got = find_matches(df).collect()
    assert [(r.kind, r.start, r.length, r.min_x, r.max_x) for r in got] == [("Email", 3, 7, 5 * (150 / 14), 5 * (150 / 14) + 7 * (150 / 14))]
    own = Pattern("Code", "n[a-z]+", lambda m: (2, m[0].upper()))
    assert [(r.value, r.normalized) for r in find_matches(df, (own,)).collect()] == [("no", "NOTHING")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers(spark):
    lit = F.lit
    assert one(spark, N.mrz_check_digit(lit("L898902C3"))) == 6 and one(spark, N.mrz_check_digit(lit("520727"))) == 3 and one(spark, N.mrz_check_digit(lit("a"))) == -1
    assert one(spark, N.is_iban(lit("GB82WEST12345698765432"))) and not one(spark, N.is_iban(lit("GB83WEST12345698765432"))) and not one(spark, N.is_iban(lit("nonsense")))
    assert one(spark, N.is_card(lit("4111-1111-1111-1111"))) and one(spark, N.is_card(lit("4lll 1111 1111 1111"))) is False and not one(spark, N.is_card(lit("x")))
    assert one(spark, N.iso_date(lit(2024), lit(2), lit(29))) == "2024-02-29" and one(spark, N.iso_date(lit(2023), lit(2), lit(29))) is None
    for text, want in (("1.234,56", "1234.56"), ("1,234", "1234"), ("007", "7"), ("1.234.56", None), ("1'234,000.5", None), ("0.50", "0.50")):
        assert one(spark, N.normalise_number(lit(text))) == want
    assert str(one(spark, N.canonical_decimal(lit(" +10.250 ")))) .startswith("10.25") and one(spark, N.canonical_decimal(lit("1e3"))) is None and one(spark, N.canonical_decimal(lit("0." + "1" * 19))) is None
    assert one(spark, N.auto_dpi(lit(612.0), lit(792.0))) == 363 and one(spark, N.auto_dpi(lit(0.0), lit(0.0))) == 400
    knots = [(0.0, 0.2), (0.5, 0.4), (1.0, 1.0)]
    assert [round(one(spark, N.calibrated(lit(x), knots)), 6) for x in (-1.0, 0.25, 0.75, 2.0, float("nan"))] == [0.2, 0.3, 0.7, 1.0, 0.0]
    assert [one(spark, N.percent(lit(x))) for x in (0.125, 0.005, 2.0)] == [12, 0, 100]
    assert one(spark, N.column_number(lit("AB"))) == 28


def test_text(spark):
    lit = F.lit
    assert one(spark, X.display_width(lit("日本é a"))) == 7 and one(spark, X.count_characters(lit(" a b😀"))) == 3
    assert one(spark, X.predominantly_rtl(lit("שלום ab"))) and not one(spark, X.predominantly_rtl(lit("ab")))
    assert one(spark, X.dominant_script(lit("абв ab"))) == "Cyrillic" and one(spark, X.dominant_script(lit("12"))) is None
    text, log = X.normalise(lit("exam-\r\nple  x"), hyphens=True, space=True)
    assert one(spark, text) == "example x" and [r.kind for r in one(spark, log)] == ["hyphens", "space"]
    assert one(spark, X.normalise(lit("é"), unicode=True)[0]) == "é"
    assert one(spark, X.balanced_table(lit("<table><tr></tr></table>"))) and not one(spark, X.balanced_table(lit("<table><table></table>")))
    assert one(spark, X.table_fragment(lit("x<TABLE>a</TABLE>y"))) == "<TABLE>a</TABLE>" and one(spark, X.decode_entities(lit("&amp;lt;"))) == "&lt;"
    assert one(spark, X.bounded_count(lit("a+b xa+b a+b."), lit("a+b"))) == 2
    assert one(spark, X.full_text(F.array(lit("a\n"), lit(""), lit("b")))) == "a\nb"


def test_numbers_behind_a_phone(spark):
    """Other numbers after an international phone don't hide it, and one of too many digits is none."""
    from papyra.operators.patterns import count_kinds

    ready = [(p, regex.compile(p.expression)) for p in BUILT_IN if p.kind == "Phone"]
    cases = [("call +1 (826) 555-4081 190.137.2.41 now", "+1 (826) 555-4081 190"), ("+1 (826) 555-4081", "+1 (826) 555-4081"), ("+1234567890123456", None), ("+12 34", None)]
    for text, value in cases:
        assert [v for _, _, _, v, _ in matches_of(text, ready)] == ([value] if value else [])
        assert count_kinds(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().phones == bool(value)
