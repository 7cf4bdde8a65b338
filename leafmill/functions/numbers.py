"""Number parsing with Python's rules where the JVM's differ, and matching of numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import BLANKS, bind, collapse, normalize_text, strip

_FLOAT = r"[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"
_INT = r"[+-]?\d+(_\d+)*"
_MONEY = "$€£¥"

#: A token of digits with points and commas, and blanks only in front of exactly three digits.
LOCALE_TOKEN = r"\d(?:[.,\d]|\x20(?=\d{3}(?!\d)))*\d|\d"
_LOOKS = r"[₹¥£€$\s]*(\d+|\d{1,3}(,\d{3})+)([.]\d+)?[₹¥£€$\s]*"


def _whole(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(rf"\A(?:{pattern})\z"))


def strict_double(x: Column) -> Column:
    """What Python's float() makes of a string; null where it would fail."""
    return bind(strip(x), _strict_double)


def _strict_double(s: Column) -> Column:
    word = F.regexp_replace(F.lower(s), r"^\+", "")
    special = F.when(word.isin("inf", "infinity"), F.lit(float("inf"))).when(word.isin("-inf", "-infinity"), F.lit(float("-inf"))).when(F.regexp_replace(word, "^-", "") == "nan", F.lit(float("nan")))
    return F.when(_whole(s, _FLOAT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double")).otherwise(special)


def strict_long(x: Column) -> Column:
    """What Python's int() makes of a string; null where it would fail or not fit 64 bits."""
    return bind(strip(x), lambda s: F.when(_whole(s, _INT), F.replace(F.regexp_replace(s, r"^\+", ""), F.lit("_"), F.lit("")).try_cast("bigint")))


def looks_numeric(x: Column) -> Column:
    """Digits, US thousands groups and a decimal part, with currency signs around; no sign."""
    return _whole(x, _LOOKS)


def first_number(x: Column) -> Column:
    """First unsigned number, thousands commas dropped; null without one."""
    return F.nullif(F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"\d+(?:[.]\d+)?", 0), F.lit("")).try_cast("double")


def number_candidates(token: Column) -> Column:
    """The US and the European reading of a token: up to two numbers."""
    t = F.replace(token, F.lit(" "), F.lit(""))
    us = F.replace(t, F.lit(","), F.lit("")).try_cast("double")
    eu = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.array_compact(F.array_distinct(F.array(us, eu)))


def locale_numbers(text: Column) -> Column:
    """All readings of all number tokens of a text."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(LOCALE_TOKEN), F.lit(0)), number_candidates))


def value_in_text(value: Column, text: Column) -> Column:
    """A numeric-looking value is in a text when one of its tokens reads as that number; others when they are part of it once normalised."""
    def numeric(v):
        return bind(first_number(v), lambda n: F.exists(locale_numbers(collapse(text)), lambda c: F.abs(c - n) <= 1e-6))

    def found(v):
        plain = bind(normalize_text(v), lambda p: (p != "") & F.contains(normalize_text(text), p))
        return F.when(looks_numeric(v), F.coalesce(numeric(v), F.lit(False))).otherwise(plain)

    return F.coalesce(bind(strip(value), found), F.lit(False))


def cell_number(x: Column) -> Column:
    """A table cell's number: currency, percent and blanks dropped; a final comma with one or two digits is a decimal comma."""
    return bind(F.translate(x, f"%{_MONEY}{BLANKS}", ""), _cell_number)


def _cell_number(s: Column) -> Column:
    eu = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    comma = F.regexp_like(s, F.lit(r"\A[+-]?\d[.,\d]*,\d{1,2}\z"))
    return bind(F.when(comma, eu).otherwise(F.replace(s, F.lit(","), F.lit(""))), _strict_double)


def numbers_match(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """At most ``tolerance`` apart as decimals: 1.01 and 1.00 match within 0.01, though their doubles are a little further apart."""
    def match(x):
        return F.coalesce(F.abs(x["a"] - x["b"]) <= tolerance + 2.0**-52 * (F.abs(x["a"]) + F.abs(x["b"])), F.lit(False))

    return bind(F.struct(a.alias("a"), b.alias("b")), match)


def is_close(a: Column, b: Column, rel: float = 1e-6, abs_: float = 1e-9) -> Column:
    def close(x):
        gap = F.greatest(rel * F.greatest(F.abs(x["a"]), F.abs(x["b"])), F.lit(abs_))
        return F.coalesce(F.abs(x["a"] - x["b"]) <= gap, F.lit(False))

    return bind(F.struct(a.alias("a"), b.alias("b")), close)
