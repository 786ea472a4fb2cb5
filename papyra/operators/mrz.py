"""Machine-readable zones of travel documents: TD1, TD2, TD3 and visas, from the lines of a page."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from itertools import cycle

from pyspark.sql import DataFrame

from papyra.functions.paging import by_page
from papyra.schemas import MRZ

# fixed values: look-alikes, and characters read for the filler
DIGIT_FOR = str.maketrans("OQDILZSGB", "000112568")
LETTER_FOR = str.maketrans("012568", "OIZSGB")
FILLERS = str.maketrans("‹＜≺", "<<<")
SLACK = 4


@dataclass(frozen=True)
class Layout:
    """Where a format's fields are: lines' length, slices that hold letters or digits only, and (line, from, to) of fields."""

    name: str
    lines: int
    length: int
    letters: tuple[tuple[int, int, int], ...]
    digits: tuple[tuple[int, int, int], ...]
    fields: dict[str, tuple[int, int, int]]
    composite: tuple[tuple[int, int, int], ...]
    composite_digit: tuple[int, int] | None
    optional_digit: tuple[int, int] | None = None


_TWO = {"type": (0, 0, 2), "country": (0, 2, 5), "number": (1, 0, 9), "nation": (1, 10, 13), "birth": (1, 13, 19), "sex": (1, 20, 21), "expiry": (1, 21, 27)}
_TWO_LETTERS = ((1, 10, 13), (1, 20, 21))
_TWO_DIGITS = ((1, 9, 10), (1, 13, 20), (1, 21, 28))
LAYOUTS = (
    Layout("Td3", 2, 44, ((0, 0, 44), *_TWO_LETTERS), (*_TWO_DIGITS, (1, 42, 44)), _TWO | {"names": (0, 5, 44), "optional": (1, 28, 42)}, ((1, 0, 10), (1, 13, 20), (1, 21, 43)), (1, 43), (1, 42)),
    Layout("Td2", 2, 36, ((0, 0, 36), *_TWO_LETTERS), (*_TWO_DIGITS, (1, 35, 36)), _TWO | {"names": (0, 5, 36), "optional": (1, 28, 35)}, ((1, 0, 10), (1, 13, 20), (1, 21, 35)), (1, 35)),
    Layout(
        "Td1", 3, 30, ((0, 0, 5), (1, 7, 8), (1, 15, 18), (2, 0, 30)), ((1, 0, 7), (1, 8, 15), (1, 29, 30)),
        {"type": (0, 0, 2), "country": (0, 2, 5), "number": (0, 5, 14), "nation": (1, 15, 18), "birth": (1, 0, 6), "sex": (1, 7, 8), "expiry": (1, 8, 14), "names": (2, 0, 30), "optional": (0, 15, 30)},
        ((0, 5, 30), (1, 0, 7), (1, 8, 15), (1, 18, 29)), (1, 29),
    ),
)


def check_digit(text: str) -> int:
    """-1 if a character has no value."""
    total = 0
    for c, weight in zip(text, cycle((7, 3, 1))):
        if not (c == "<" or c.isascii() and (c.isdigit() or c.isupper())):
            return -1
        total += weight * (0 if c == "<" else int(c, 36))
    return total % 10


def passes(text: str, digit: str, filler: bool = False) -> bool:
    found = check_digit(text)
    return found >= 0 and (filler and found == 0 if digit == "<" else digit == str(found))


def normalise(line: str | None) -> str | None:
    """A line as zone characters: no white space, upper case, fillers alike, two Ks or more at the end as fillers; null if another character is there."""
    text = "".join((line or "").split()).translate(FILLERS).upper()
    if not text or any(c not in "<«" and not (c.isascii() and c.isalnum()) for c in text):
        return None
    bare = text.rstrip("K")
    return bare + "<" * (len(text) - len(bare)) if len(text) - len(bare) >= 2 else text


def fit(line: str, length: int) -> str | None:
    """The line at that length: exactly, or up to four fillers short or over at its end; a double sign stands for two fillers or one."""
    forms = [line.replace("«", "<<"), line.replace("«", "<")]
    if any(len(f) == length for f in forms):
        return next(f for f in forms if len(f) == length)
    for f in forms:
        short = length - len(f)
        if 0 < short <= SLACK and f[-1] == "<" or -SLACK <= short < 0 and not f[length:].strip("<"):
            return (f + "<" * max(short, 0))[:length]
    return None


def _date(text: str, latest: int) -> date | None:
    if not (text.isascii() and text.isdigit()):
        return None
    year = 2000 + int(text[:2])
    try:
        return date(year - 100 * (year > latest), int(text[2:4]), int(text[4:]))
    except ValueError:
        return None


def _clean(text: str) -> str:
    return text.rstrip("<").replace("<", " ").strip()


def parse(lines: list[str], layout: Layout, ref_year: int) -> dict | None:
    """The fields of lines that fit a layout, repaired where only letters or digits can be; null if they can't begin one."""
    rows = [list(x) for x in lines]

    def put(line, a, b, table):
        rows[line][a:b] = "".join(rows[line][a:b]).translate(table)

    get = lambda line, a, b: "".join(rows[line][a:b])
    for part in layout.letters:
        put(*part, LETTER_FOR)
    if not ("A" <= rows[0][0] <= "Z"):
        return None
    for part in layout.digits:
        put(*part, DIGIT_FOR)
    visa = rows[0][0] == "V" and layout.lines == 2
    f = dict(layout.fields)
    line, a, b = f["number"]
    long = layout.name == "Td1" and rows[0][14] == "<" and rows[0][15] != "<"
    if long:  # the number goes on in the optional field, its check digit last
        end = get(0, 15, 30).find("<")
        end = 30 if end < 0 else 15 + end
        put(0, end - 1, end, DIGIT_FOR)
        number = get(0, 5, 14).rstrip("<") + get(0, 15, end - 1)
        number_ok = end >= 17 and passes(number, rows[0][end - 1])
        optional = get(0, end + 1, 30)
    else:
        if layout.name == "Td1":
            put(0, 14, 15, DIGIT_FOR)
        number_ok = passes(get(line, a, b), rows[line][b])
        if not number_ok and passes(get(line, a, b).translate(DIGIT_FOR), rows[line][b]):
            put(line, a, b, DIGIT_FOR)
            number_ok = True
        number = _clean(get(line, a, b))
        optional = get(1, 28, layout.length) if visa else get(*f["optional"])
    ends = {k: rows[f[k][0]][f[k][2]] for k in ("birth", "expiry")}
    checks = {"document": number_ok, "birth": passes(get(*f["birth"]), ends["birth"]), "expiry": passes(get(*f["expiry"]), ends["expiry"]), "optional": None, "composite": None}
    if not visa:
        if layout.optional_digit:
            checks["optional"] = passes(get(*f["optional"]), rows[layout.optional_digit[0]][layout.optional_digit[1]], True)
        checks["composite"] = passes("".join(get(*p) for p in layout.composite), rows[layout.composite_digit[0]][layout.composite_digit[1]])
    names = get(*f["names"]).rstrip("<").split("<<", 1)
    words = lambda t: " ".join(t.replace("<", " ").split())
    valid = all(v is not False for v in checks.values())
    return {
        "format": layout.name, "document_type": _clean(get(*f["type"])), "issuing_country": _clean(get(*f["country"])), "surname": words(names[0]), "given_names": words(names[1]) if len(names) > 1 else "",
        "document_number": number, "nationality": _clean(get(*f["nation"])), "birth_date": _date(get(*f["birth"]), ref_year), "sex": get(*f["sex"]), "expiry_date": _date(get(*f["expiry"]), ref_year + 50), "optional_data": _clean(optional),
    } | {f"check_{k}": v for k, v in checks.items()} | {"score": 100 if valid else sum(v is True for v in checks.values())}


def best_zone(lines: list[str | None], ref_year: int) -> dict | None:
    """The best-scored zone in neighbouring lines, the first of equals; none with a score of 0."""
    clean = [n for n in map(normalise, lines) if n]
    best = None
    for i in range(len(clean)):
        for layout in LAYOUTS:
            some = [fit(x, layout.length) for x in clean[i : i + layout.lines]]
            if len(some) == layout.lines and None not in some:
                found = parse(some, layout, ref_year)
                if found and found["score"] > (best["score"] if best else 0):
                    best = found
    return best


def find_mrz(lines: DataFrame, keys: list[str], ref_year: int, line_id: str = "line_index") -> DataFrame:
    """keys and the fields of schemas.MRZ for each page with a zone. ref_year decides on centuries, not the clock.

    Lines at one height are read as one row first; the lines as they are count if that gives no valid zone.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    # only long runs of zone characters can be part of one
    some = lines.filter(F.regexp_replace("text", r"(?U)\s", "").rlike("^[A-Za-z0-9<«‹＜≺]{4,}$"))

    def read(rows: list[dict]):
        by_row: list[list[dict]] = []
        for r in sorted(rows, key=lambda r: (r["min_y"], r["min_x"])):
            row = by_row[-1] if by_row else None
            overlap = min(row[-1]["max_y"], r["max_y"]) - max(row[-1]["min_y"], r["min_y"]) if row else 0
            if row and overlap >= 0.5 * min(row[-1]["max_y"] - row[-1]["min_y"], r["max_y"] - r["min_y"]) > 0:
                row.append(r)
            else:
                by_row.append([r])
        best = best_zone(["".join(x["text"] for x in sorted(row, key=lambda x: x["min_x"])) for row in by_row], ref_year)
        if not best or best["score"] < 100:
            other = best_zone([r["text"] for r in rows], ref_year)
            if other and (not best or other["score"] > best["score"]):
                best = other
        if best:
            yield {k: rows[0][k] for k in keys} | best

    schema = StructType([*[some.schema[k] for k in keys], *StructType.fromDDL(MRZ).fields])
    return by_page(some.select(*keys, line_id, "text", "min_x", "min_y", "max_x", "max_y"), keys, [line_id], read, schema)
