"""Text normalisation, counting and snippets. Whitespace is Unicode-aware throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s"


def bind(x: Column, f) -> Column:
    """f(x) with x evaluated once: a lambda variable stands for it, so expressions don't grow with each use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: What WS matches, for trims without a pattern.
BLANKS = "\t\n\x0b\f\r\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(x: Column) -> Column:
    """``strip`` for short strings, such as lines and cells: no pattern, but some memory for each character."""
    return F.btrim(x, F.lit(BLANKS))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"{WS}+\z|\A{WS}+", "")


def collapse(x: Column) -> Column:
    """Runs of whitespace become one space; ends are stripped."""
    return strip(F.regexp_replace(x, rf"{WS}+", " "))


def normalize_text(x: Column) -> Column:
    return collapse(F.lower(x))


def normalize_alphanumeric(x: Column) -> Column:
    """Lower case, nothing but ASCII letters and digits."""
    return F.regexp_replace(F.lower(x), "[^0-9a-z]", "")


def casefold(x: Column) -> Column:
    """Lower case with sharp s unfolded; other special folds are left alone."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def normalize_span(x: Column) -> Column:
    """Collapsed and folded, for quoted spans."""
    return casefold(collapse(x))


def normalize_lines(x: Column) -> Column:
    """Folded, with runs of blanks and tabs as one space; line ends stay."""
    return casefold(F.regexp_replace(x, r"[ \t]+", " "))


def lines(x: Column) -> Column:
    """Lines without a trailing empty one; an empty text has none."""
    cut = F.split(F.regexp_replace(x, r"\R\z", ""), r"\R", -1)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(cut)


def normalize_value(x: Column) -> Column:
    """Stripped and collapsed; an empty string becomes null."""
    return F.nullif(collapse(x), F.lit(""))


def quote(x: Column) -> Column:
    """A text as a literal pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def contains_word(hay: Column, needle: Column) -> Column:
    """Some occurrence of ``needle`` has no letter or digit next to it."""
    return (needle != "") & F.regexp_like(hay, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quote(needle), F.lit(r"(?![\p{L}\p{N}])")))


def count_tokens(x: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(x, F.lit(""))) / 4)).cast("long")


def text_length(x: Column) -> Column:
    return F.length(strip(F.coalesce(x, F.lit(""))))


def char_validity(x: Column) -> Column:
    """Share of letters and digits among characters that are not whitespace; 0 without any."""
    solid = F.regexp_replace(F.coalesce(x, F.lit("")), rf"{WS}+", "")
    word = F.length(F.regexp_replace(solid, r"[^\p{L}\p{N}]+", ""))
    return F.when(F.length(solid) == 0, 0.0).otherwise(word / F.length(solid))


def text_sufficiency(x: Column, enough: int = 200) -> Column:
    return F.least(F.lit(1.0), text_length(x) / enough)


def snippet(text: Column, size: int = 120) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, size)


def evidence_snippet(text: Column, evidence: Column, size: int = 120) -> Column:
    """``size`` characters around the evidence; the place is that in the normalised text, as quoted spans are found there."""
    at = F.position(normalize_span(evidence), normalize_span(text))
    start = F.greatest(F.lit(0), at - 1 - size // 2)
    return F.when(at == 0, snippet(text, size)).otherwise(F.substr(text, start + 1, F.lit(size)))


def significant_tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits longer than two."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit("[0-9a-z]+"), F.lit(0)), lambda t: F.length(t) > 2)


def token_recall(value: Column, text: Column) -> Column:
    """Share of the value's tokens (each time it has them) that the text has; null for fewer than two tokens."""
    v, t = significant_tokens(value), F.array_distinct(significant_tokens(text))
    return F.when(F.size(v) >= 2, F.size(F.filter(v, lambda x: F.array_contains(t, x))) / F.size(v))


def relaxed_answer(x: Column) -> Column:
    """Lower case letters, digits and spaces, stripped."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^ 0-9a-z]", ""))


def relaxed_match(prediction: Column, golds: Column) -> Column:
    """Some gold answer equals the prediction or, if not empty, is part of it."""
    p = relaxed_answer(prediction)
    return F.exists(golds, lambda g: (relaxed_answer(g) == p) | ((relaxed_answer(g) != "") & F.contains(p, relaxed_answer(g))))
