"""Tagged values against declared types: missing tests, coercion, equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.numbers import is_close, strict_double, strict_long
from leafmill.functions.text import bind, normalize_alphanumeric, strip
from leafmill.schema import FieldSpec

YES, NO = ("1", "true", "yes"), ("0", "false", "no")


def kind(v: Column) -> Column:
    return F.coalesce(v["kind"], F.lit("null"))


def is_null(v: Column) -> Column:
    return kind(v) == "null"


def is_missing(v: Column) -> Column:
    """Null or an empty string: the rule of validation and provenance."""
    return is_null(v) | (kind(v).isin("string") & (v["s"] == ""))


def is_absent(values: Column, name: str) -> Column:
    """No such field, null, or an empty string: the rule of business rules."""
    return is_missing(values[name])


def is_filled(v: Column) -> Column:
    """Neither null, nor a blank string, nor an empty list or object: the rule of scorers."""
    blank = kind(v).isin("string") & (strip(v["s"]) == "")
    hollow = kind(v).isin("json") & F.regexp_like(F.coalesce(v["s"], F.lit("")), F.lit(r"\A\s*(\[\s*\]|\{\s*\})\s*\z"))
    return ~(is_null(v) | blank | hollow)


def as_double(v: Column) -> Column:
    """A number, or a string that Python's float() takes; booleans give null."""
    return F.when(kind(v).isin("int", "float", "string"), strict_double(v["s"]))


def coerced(v: Column, spec: FieldSpec) -> Column:
    """The value in the declared type, tagged; null where it does not fit."""
    k, s = kind(v), v["s"]
    tag = lambda name, x: F.when(x.isNotNull(), F.struct(F.lit(name).alias("kind"), x.cast("string").alias("s")))
    if spec.type == "string":
        return F.struct(F.lit("string").alias("kind"), s.alias("s"))
    if spec.type == "integer":
        d = strict_double(s)
        whole = F.when((k == "float") & (d == F.floor(d)) & (F.abs(d) < 9.2e18), d.try_cast("bigint"))
        return tag("int", F.when(k.isin("int", "string"), strict_long(s)).otherwise(whole))
    if spec.type == "number":
        return tag("float", as_double(v))
    low = F.lower(strip(s))
    word = F.when(k == "bool", low).when((k == "string") & low.isin(*YES), "true").when((k == "string") & low.isin(*NO), "false")
    return tag("bool", word)


def fits(v: Column, spec: FieldSpec) -> Column:
    return coerced(v, spec).isNotNull()


def eval_double(s: Column) -> Column:
    number = strict_double(F.regexp_replace(s, r"[,$€£¥₹]|(?U)\s", ""))
    return bind(number, lambda d: F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d))


def values_match(a: Column, b: Column, type_: str = "string") -> Column:
    """Type-aware equality of two strings; null never matches, an unknown type counts as string."""
    if type_ == "number":
        hit = is_close(eval_double(a), eval_double(b))
    elif type_ == "integer":
        hit = bind(F.struct(strict_double(a).alias("a"), strict_double(b).alias("b")), lambda x: (x["a"] == x["b"]) & (x["a"] == F.floor(x["a"])))
    elif type_ == "boolean":
        side = lambda s: bind(F.lower(strip(s)), lambda w: F.when(w.isin(*YES), True).when(w.isin(*NO), False))
        hit = side(a) == side(b)
    else:
        hit = normalize_alphanumeric(a) == normalize_alphanumeric(b)
    return F.coalesce(hit, F.lit(False))


def match_key(v: Column) -> Column:
    """A value's key for equality of records: numbers and booleans compare as numbers."""
    number = F.when(kind(v) == "bool", F.when(F.lower(v["s"]) == "true", 1.0).otherwise(0.0)).when(kind(v).isin("int", "float"), strict_double(v["s"]))
    return F.when(number.isNotNull(), F.concat(F.lit("n:"), (number + 0.0).cast("string"))).otherwise(F.concat(kind(v), F.lit(":"), F.coalesce(v["s"], F.lit(""))))
