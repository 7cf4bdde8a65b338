"""Scalar functions against literal cases and small Python statements of the rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import coercion, numbers, tables, text
from leafmill.schema import FieldSpec


def col(spark, rows, names, expr):
    df = spark.createDataFrame(rows, names)
    return [r[0] for r in df.coalesce(1).select(expr).collect()]


IN_TEXT = [
    ("12.5", "total 12.50 paid", True), ("12.5", "invoice 1250 subtotal 99.00", False), ("105.00", "x total 105.00", True), ("BOOK TA.K SDN BHD", "by  book   ta.k  sdn bhd", True),
    ("MISSING CORP", "Company: ACME", False), ("8.25", "total 8,25 gross", True), ("544.46", "$544,46", True), ("1767.34", "sum 1.767,34", True), ("57483.07", "57 483,07", True),
    ("1234.56", "1,234.56", True), ("125", "amount 1250", False), ("", "anything", False), ("-5", "a -5 b", True), ("7", "", False),
]


def test_value_in_text(spark):
    got = col(spark, [(v, t) for v, t, _ in IN_TEXT], "v string, t string", numbers.value_in_text(F.col("v"), F.col("t")))
    assert got == [x for *_, x in IN_TEXT]


def test_strict_double_is_pythons_float(spark):
    rng = random.Random(5)
    given = ["12d", "1_000", "_1", "1__0", "inf", "-Infinity", "nan", " 3 ", "+4.", ".5", ".", "1e5", "1e", "0x1", "", "--1", "1.2.3", "１"[:0]]
    given += ["".join(rng.choice("0123456789.+-eE_ dfn") for _ in range(rng.randint(1, 6))) for _ in range(2000)]

    def py(s):
        try:
            return float(s)
        except ValueError:
            return None

    got = col(spark, [(s,) for s in given], "s string", numbers.strict_double(F.col("s")))
    for s, g in zip(given, got):
        w = py(s)
        assert (g is None) == (w is None) and (w is None or g == w or (math.isnan(g) and math.isnan(w))), s


def test_coercion(spark):
    cases = [
        (("string", "12.0"), "integer", None), (("float", "12.0"), "integer", "12"), (("float", "12.5"), "integer", None), (("bool", "true"), "integer", None), (("string", " 1_2 "), "integer", "12"),
        (("string", "abc"), "number", None), (("int", "3"), "number", "3.0"), (("string", "YES"), "boolean", "true"), (("string", "t"), "boolean", None), (("int", "1"), "boolean", None), (("int", "7"), "string", "7"),
    ]
    for (k, s), t, want in cases:
        v = F.struct(F.lit(k).alias("kind"), F.lit(s).alias("s"))
        got = spark.range(1).select(coercion.coerced(v, FieldSpec("x", t))["s"]).first()[0]
        assert got == want, (k, s, t)


MATCH = [
    ("12.5", "12.50", "number", True), ("USD", "usd ", "string", True), ("7", "7", "integer", True), ("yes", "true", "boolean", True), ("12.5", "13.0", "number", False), ("7", "8", "integer", False),
    ("yes", "false", "boolean", False), ("BOOK TA .K (HILL) SDN", "BOOK TAK(HILL)SDN", "string", True), ("18 Main St", "19 Main St", "string", False), (None, "x", "string", False), ("7.0", "7", "integer", True),
]


@pytest.mark.parametrize("a,b,kind,want", MATCH)
def test_values_match(spark, a, b, kind, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(coercion.values_match(F.col("a"), F.col("b"), kind)).first()[0] is want


def test_token_recall(spark):
    t = "jalan sagu taman daya sdn bhd receipt"
    given = [("JALAN SAGU TAMAN DAYA", 1.0), ("JALAN SAGU MISSING STREET", 0.5), ("UNKNOWN MISSING CORP", 0.0), ("9.00", None), ("01/01/2020", None), ("ab cd", None), ("", None)]
    got = col(spark, [(v, t) for v, _ in given], "v string, t string", text.token_recall(F.col("v"), F.col("t")))
    assert got == [x for _, x in given]


def test_scores(spark):
    got = col(spark, [("",), ("a" * 50,), ("a" * 400,), ("!!!! a",), ("  ",)], "t string", F.struct(text.text_sufficiency(F.col("t")), text.char_validity(F.col("t"))))
    assert [tuple(x) for x in got] == [(0.0, 0.0), (0.25, 1.0), (1.0, 1.0), (0.03, 0.2), (0.0, 0.0)]


def test_lines(spark):
    given = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb", "a b"]
    got = col(spark, [(s,) for s in given], "t string", text.lines(F.col("t")))
    assert got == [s.splitlines() for s in given]


def test_tables(spark):
    md = "x\n| a | b |\n|---|:-:|\n| 1,5 | 2 | 3 |\n\n  | h |\n| v |\nend"
    got = spark.createDataFrame([(md,)], "t string").select(tables.markdown_tables(F.col("t")).alias("x")).first()["x"]
    assert [(t["header"], t["rows"]) for t in got] == [(["a", "b"], [["1,5", "2", "3"]]), (["h"], [["v"]])]
    heads = spark.createDataFrame([(md,)], "t string").select(tables.headers_of_value(tables.markdown_tables(F.col("t")), F.lit(3.0))).first()[0]
    assert heads == [""]


def test_contains_word(spark):
    given = [("total 10.00", "10.00", True), ("x110.00", "10.00", False), ("a.b", "a.b", True), ("a\\Eb c", "\\Eb", False), ("é10", "10", False), ("", "", False)]
    got = col(spark, [(h, n) for h, n, _ in given], "h string, n string", text.contains_word(F.col("h"), F.col("n")))
    assert got == [x for *_, x in given]
