"""Markdown tables: rendering, parsing, look-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.numbers import cell_number, numbers_match
from leafmill.functions.text import BLANKS, bind, lines, strip, trimmed

TABLE = "struct<header:array<string>,rows:array<array<string>>>"


def cells(line: Column) -> Column:
    """A table line's cells, stripped, without one outer pipe on each side."""
    front = lambda s: F.when(F.startswith(s, F.lit("|")), F.substr(s, F.lit(2))).otherwise(s)
    back = lambda s: F.when(F.endswith(s, F.lit("|")), F.left(s, F.length(s) - 1)).otherwise(s)
    return bind(bind(trimmed(line), front), lambda s: F.transform(F.split(back(s), r"\|", -1), trimmed))


def markdown_tables(text: Column) -> Column:
    """Tables of a text: runs of lines that begin with a pipe; the first is the header, rule lines are dropped, ragged rows stay."""
    # other lines become empty, so that empty lines part the tables; each line is looked at once, and no table is copied as it grows
    marked = F.transform(lines(text), lambda x: F.when(F.startswith(F.ltrim(x, F.lit(BLANKS)), F.lit("|")), x).otherwise(""))
    runs = F.filter(F.split(F.array_join(marked, "\n"), "\n\n+", -1), lambda r: ~r.isin("", "\n"))

    def table(rows):
        body = F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: ~F.regexp_like(x, F.lit(r"\A[-|:\s]++\z")))
        return F.struct(cells(F.get(rows, F.lit(0))).alias("header"), F.transform(body, cells).alias("rows")).cast(TABLE)

    return F.transform(runs, lambda r: bind(F.split(F.regexp_replace(r, r"\A\n|\n\z", ""), "\n", -1), table))


def to_markdown(header: Column, rows: Column) -> Column:
    """A table as GFM; rows are padded or cut to the header's width, null cells are empty."""
    n = F.size(header)
    tidy = lambda a: F.transform(a, lambda c: strip(F.coalesce(c, F.lit(""))))
    line = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(tidy(r), F.array_repeat(F.lit(""), n)), F.lit(1), n)
    rule = line(F.array_repeat(F.lit("---"), n))
    return F.array_join(F.concat(F.array(line(tidy(header)), rule), F.transform(rows, lambda r: line(fit(r)))), "\n")


def headers_of_value(tables: Column, number: Column) -> Column:
    """The header of each cell that holds the number; '' for a cell beyond the header."""
    def of_row(header, row, n):
        hits = F.filter(F.transform(row, lambda c, i: F.struct(F.coalesce(numbers_match(cell_number(c), n), F.lit(False)).alias("hit"), F.coalesce(F.get(header, i), F.lit("")).alias("h"))), lambda x: x["hit"])
        return F.transform(hits, lambda x: x["h"])

    return bind(number, lambda n: F.flatten(F.transform(tables, lambda t: F.flatten(F.transform(t["rows"], lambda r: of_row(t["header"], r, n))))))
