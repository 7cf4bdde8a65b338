"""Semantic verification: does a value stand under the right label or column? And document archetypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.numbers import cell_number
from leafmill.functions.tables import headers_of_value, markdown_tables
from leafmill.functions.text import bind, collapse, lines, normalize_lines, quote
from leafmill.functions.text import casefold as fold
from leafmill.model import settled

LABEL_STATUSES = ("label_mismatch", "no_evidence", "no_label", "unlocated", "verified")
COLUMN_STATUSES = ("column_mismatch", "column_no_label", "column_verified", "no_table", "value_not_in_table")


def _words(s: str) -> list[str]:
    return sorted(s.split(";"))


#: field -> (labels that confirm, labels that contradict)
LABELS = {
    "subtotal": (_words("total net;net;sub-total;subtotal"), _words("total gross;gross;amount due;grand total")),
    "tax": (_words("gst;vat;tax"), _words("net;gross;grand total;subtotal")),
    "total": (_words("total gross;gross;amount payable;balance due;amount due;grand total;total"), _words("shipping;discount;cash;change;gst;vat;tax;total net;net;sub-total;subtotal")),
}
COLUMN_LABELS = {
    "subtotal": (_words("total net;sub-total;subtotal;net amount;net worth;net"), _words("unit price;qty;gst;tax;vat;total;grand total;gross worth;gross")),
    "tax": (_words("total vat;tax amount;vat amount;gst;tax;vat"), _words("unit price;qty;total;grand total;subtotal;gross worth;gross;net worth;net")),
    "total": (_words("balance due;amount due;grand total;total;gross worth;gross"), _words("unit price;qty;discount;gst;tax;vat;subtotal;net price;net worth;net")),
}

Labels = dict[str, tuple[list[str], list[str]]]


def label_pattern(labels: list[str]) -> str | None:
    """Any of the labels as whole words."""
    esc = [r"\b\Q" + " ".join(x.lower().replace("ß", "ss").split()) + r"\E\b" for x in labels]
    return "|".join(esc) or None


def _any(text: Column, labels: list[str]) -> Column:
    p = label_pattern(labels)
    return F.regexp_like(text, F.lit(p)) if p else F.lit(False)


def verify_label(evidence: Column, text: Column, expect: list[str], reject: list[str], reach: int = 60) -> Column:
    """Status of a quoted span by the labels on its line, up to ``reach`` characters before it, and in it; contradiction wins."""
    def located(e):
        return bind(normalize_lines(F.coalesce(text, F.lit(""))), lambda t: bind(F.position(e, t), lambda at: status(e, t, at)))

    def status(e, t, at):
        line = F.substring_index(F.substr(t, F.lit(1), F.greatest(at - 1, F.lit(0))), "\n", -1)
        return F.when(at == 0, "unlocated").otherwise(bind(F.concat(F.right(line, F.lit(reach)), e), by_labels))

    def by_labels(window):
        return F.when(_any(window, reject), "label_mismatch").when(_any(window, expect), "verified").otherwise("no_label")

    e = F.trim(normalize_lines(F.coalesce(evidence, F.lit(""))))
    return bind(e, lambda e: F.when(e == "", "no_evidence").otherwise(located(e)))


def verify_column(value: Column, tables: Column, expect: list[str], reject: list[str]) -> Column:
    """Status of a number by the headers of the table cells that hold it; confirmation wins."""
    found = F.transform(headers_of_value(tables, cell_number(value)), lambda h: fold(collapse(h)))

    def status(heads: Column) -> Column:
        some = lambda labels: F.exists(heads, lambda h: _any(h, labels))
        empty = F.coalesce(F.size(heads), F.lit(0)) == 0
        return F.when(empty, "value_not_in_table").when(some(expect), "column_verified").when(some(reject), "column_mismatch").otherwise("column_no_label")

    # bound to a lambda variable, so the headers are looked up once and not in each branch
    return F.when(F.size(tables) == 0, "no_table").otherwise(F.get(F.transform(F.array(found), status), F.lit(0)))


def _status(name: str, of: Column) -> Column:
    """A field's status, made only where the record has the field."""
    ok = F.map_contains_key("values", name)
    return F.struct(F.lit(name).alias("key"), F.when(ok, of).alias("value"), ok.alias("ok"))


def _statuses(made: list[Column]) -> Column:
    if not made:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.transform(F.filter(F.array(*made), lambda e: e["ok"]), lambda e: F.struct(e["key"], e["value"])))


def verify_labels(records: DataFrame, text: str = "text", labels: Labels | None = None) -> DataFrame:
    """Set ``label_status`` of configured fields that a record has. Narrow; ``records`` carries the document's text."""
    made = [_status(f, verify_label(F.col("evidence")[f], F.col(text), *el)) for f, el in (LABELS if labels is None else labels).items()]
    return settled(records, label_status=_statuses(made))


def verify_columns(records: DataFrame, text: str = "text", labels: Labels | None = None) -> DataFrame:
    """Set ``column_status`` of configured fields that a record has; tables are parsed once a row. Narrow."""
    out = settled(records, _tables=markdown_tables(F.coalesce(F.col(text), F.lit(""))))
    made = [_status(f, verify_column(F.col("values")[f]["s"], F.col("_tables"), *el)) for f, el in (COLUMN_LABELS if labels is None else labels).items()]
    return settled(out, column_status=_statuses(made)).drop("_tables")


def status_counts(records: DataFrame, column: str = "label_status") -> DataFrame:
    """(doc_id, one count for each status, 0 where there is none)."""
    kinds = LABEL_STATUSES if column == "label_status" else COLUMN_STATUSES
    n = lambda s: F.sum(F.size(F.filter(F.map_values(column), lambda v: v == s))).cast("long").alias(s)
    return records.groupBy("doc_id").agg(*[n(s) for s in kinds])


def archetype_signals(text: Column, has_figures: Column) -> Column:
    heads = F.size(F.filter(lines(text), lambda x: F.regexp_like(x, F.lit(r"\A\s*#{1,6}\s"))))
    return F.struct(has_figures.alias("has_figures"), F.size(markdown_tables(text)).alias("n_tables"), heads.alias("n_headings"), F.length(text).alias("text_len"))


def archetype(s: Column) -> Column:
    """mixed, visual, hierarchical, tabular or flat, from the signals."""
    return (
        F.when(s["has_figures"], F.when(s["text_len"] >= 800, "mixed").otherwise("visual"))
        .when(s["n_headings"] >= 5, "hierarchical").when(s["n_tables"] >= 1, "tabular").when(s["n_headings"] >= 2, "hierarchical").otherwise("flat")
    )


def classify(docs: DataFrame, text: Column, has_figures: Column | None = None) -> DataFrame:
    """Add ``archetype`` and ``archetype_signals``. Narrow."""
    out = docs.withColumn("archetype_signals", archetype_signals(F.coalesce(text, F.lit("")), F.lit(False) if has_figures is None else has_figures))
    return out.withColumn("archetype", archetype(F.col("archetype_signals")))


def verify_by_archetype(records: DataFrame, text: str = "text", labels: Labels | None = None, columns: Labels | None = None) -> DataFrame:
    """Column verification for tabular documents, label verification for others; each row takes one way only."""
    tab = F.col("archetype") == "tabular"
    return verify_columns(records.where(tab), text, columns).unionByName(verify_labels(records.where(~F.coalesce(tab, F.lit(False))), text, labels))
