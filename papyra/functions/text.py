"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.chunking import chunks  # noqa: F401 (part of the text functions)

# Fixed value: white space as regular expressions of the source data's language count it (Java's \s is ASCII only).
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Fixed value: a page footer, "page n / m".
FOOTER = "페이지" + WS + "*[0-9]+" + WS + "*/" + WS + "*[0-9]+"
# Fixed value: where a sentence ends.
SENTENCE_END = "(?<=[.!?다요함됨])" + WS + "+"


def compact(text: Column) -> Column:
    """All white space deleted."""
    return F.regexp_replace(text, WS + "+", "")


def clean(text: Column) -> Column:
    """Footers dropped, white space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, FOOTER, " "), WS + "+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(c)


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def iso_date(text: Column) -> Column:
    """The first loose date (separated by . / - or spaces, or by 년 월 일) as YYYY-MM-DD, else null. Spaces are those of WS."""
    sep = lambda unit: f"{WS}*[./\\-{unit}{WS[1:-1]}]{WS}*"
    p = rf"(\d{{4}}){sep('년')}(\d{{1,2}}){sep('월')}(\d{{1,2}})"
    part = lambda k: F.lpad(F.regexp_extract(text, p, k), 4 if k == 1 else 2, "0")
    return F.when(text.rlike(p), F.concat_ws("-", part(1), part(2), part(3)))


def is_iso(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def number(text: Column) -> Column:
    """Thousands separators dropped; "-" and blanks are null."""
    return F.replace(F.nullif(F.trim(text), F.lit("-")), F.lit(","), F.lit("")).try_cast("double")


def money(amount: Column, unit: Column) -> Column:
    """An amount in 백만원 (10^6) or 억원 (10^8) as whole won."""
    return F.round(amount.cast("decimal(28,6)") * F.when(unit == "백만원", 1_000_000).when(unit == "억원", 100_000_000)).cast("long")


def normal_label(text: Column) -> Column:
    """Lower case letters and digits only, to compare labels."""
    return F.lower(F.regexp_replace(text, r"[^0-9A-Za-z가-힣]+", ""))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, x))


def half_steps(x: Column) -> Column:
    """To the nearest 0.5, halves up."""
    return F.floor(x * 2 + 0.5) / 2


def to_fixed(x: Column, digits: int = 2) -> Column:
    """A double with so many decimals (up to 9), rounded by its exact binary value, halves away from zero: 1.005 is under its half and gives 1.00.

    The formatter works on the exact value but takes halves to even. A half is
    a whole number of 2 ** -(digits + 1), which doubles hold exactly, so halves
    are told apart without error and rounded in whole numbers. Numbers of 2^62
    and more, infinities and NaN are written as they are, null stays null.
    """
    size, unit = F.abs(x), float(1 << (digits + 1))
    units = (F.least(size, F.lit(float(1 << 52))) * unit).cast("bigint").cast("decimal(19,0)")
    # size * 10 ** digits * 2, exact wherever size is a whole number of units; from 2 ** 52 on there are no halves.
    twice = units * F.lit(5**digits).cast("decimal(10,0)")
    half = (size * unit == F.floor(size * unit).cast("double")) & (size < float(1 << 52)) & (twice % 2 == 1)
    whole = F.call_function("div", twice + 1, F.lit(2)).cast("string")
    padded = F.when(F.length(whole) <= digits, F.lpad(whole, digits + 1, "0")).otherwise(whole)
    point = F.lit(".") if digits else F.lit("")
    exact = F.concat(F.when(x < 0, "-").otherwise(""), F.left(padded, F.length(padded) - digits), point, F.right(padded, F.lit(digits)))
    plain = F.replace(F.format_number(F.when(x == 0, F.lit(0.0)).otherwise(x), digits), F.lit(","), F.lit(""))
    large = F.isnan(x) | (size >= float(1 << 62))
    return F.when(x.isNull(), None).when(large, x.cast("string")).when(half, exact).otherwise(plain)


def padded_id(prefix: str, n: Column, width: int = 6) -> Column:
    """Prefix and zero-padded number; longer numbers are kept whole."""
    digits = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def union_pages(*lists: Column) -> Column:
    """Page lists like "1|4|8" united in order of first appearance."""
    return F.array_join(F.array_distinct(F.array_remove(F.split(F.concat_ws("|", *lists), r"\|"), "")), "|")


def split_sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: s != "")


def classify(label: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first rule whose pattern the label matches."""
    out = None
    for pattern, value in rules:
        out = F.when(label.rlike(pattern), value) if out is None else out.when(label.rlike(pattern), value)
    return F.lit(default) if out is None else out.otherwise(default)


def is_integer(c: Column) -> Column:
    """Whether a number has no fraction; null is none."""
    return F.coalesce(c == F.floor(c), F.lit(False))


def is_finite(c: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    x = c.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def short_year(text: Column, fallback: Column) -> Column:
    """The first date with a year of two digits (yy. m. d) as 20yy-mm-dd, else the fallback."""
    p = r"(?<![0-9])([0-9]{2})\s*[./-]\s*([0-9]{1,2})\s*[./-]\s*([0-9]{1,2})(?![0-9])"
    part = lambda k: F.lpad(F.regexp_extract(text, p, k), 2, "0")
    return F.when(text.rlike(p), F.concat(F.lit("20"), part(1), F.lit("-"), part(2), F.lit("-"), part(3))).otherwise(fallback)


def years_between(start: Column, end: Column) -> Column:
    """Years from one ISO date to another, by whole and part months."""
    return F.months_between(end.cast("date"), start.cast("date")) / 12


def literal(token: Column) -> Column:
    r"""A pattern that matches the token itself, quotes (\Q, \E) inside included."""
    return F.concat(F.lit("\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def slashes(path: Column) -> Column:
    """Back slashes of a path as slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def rate_complement(rate: Column, digits: int = 4) -> Column:
    return F.round(1 - rate, digits)


def preview(text: Column, n: int = 500) -> Column:
    return F.left(text, F.lit(n))


def korean(c):
    """The column compared and sorted as a Korean dictionary does."""
    return F.collate(c, "ko")
