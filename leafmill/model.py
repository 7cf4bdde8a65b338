"""Row types, and helpers for tagged values.

Documents are rows of DOCUMENT columns; records are rows of RECORD columns, keyed by (doc_id, record_ix). A value is
tagged with its kind, and keeps its literal text, so that 1 and 1.0 stay apart. Stages add or rewrite columns; none of
them needs a shuffle unless it says so.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK = f"struct<text:string,bbox:{BBOX},meta:map<string,string>>"
PAGE = f"struct<index:int,text:string,blocks:array<{BLOCK}>,image_ref:string>"
FIGURE = f"struct<id:string,page:int,bbox:{BBOX},width:int,height:int,mime:string,result:string>"
VALUE = "struct<kind:string,s:string>"
PROVENANCE = f"struct<page:int,bbox:{BBOX},source_text:string,evidence:string,method:string>"
DOCUMENT = f"doc_id string, path string, mime string, pages array<{PAGE}>, markdown string, error_class string, error string"
RECORD = (
    f"doc_id string, record_ix int, values map<string,{VALUE}>, confidence map<string,double>, evidence map<string,string>, "
    f"label_status map<string,string>, column_status map<string,string>, provenance map<string,{PROVENANCE}>"
)
COST = "doc_id string, seq int, stage string, model string, tokens_in bigint, tokens_out bigint, usd double, unpriced boolean, unmetered boolean"

_SIDE = [("confidence", "map<string,double>"), ("evidence", "map<string,string>"), ("label_status", "map<string,string>"), ("column_status", "map<string,string>"), ("provenance", f"map<string,{PROVENANCE}>")]


@dataclass(frozen=True)
class Dataset:
    """The tables that a pipeline passes on. Frozen: a stage returns a new one, so a fallback may start from an earlier one."""

    documents: DataFrame
    records: DataFrame | None = None
    figures: DataFrame | None = None
    costs: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def with_(self, **changes) -> "Dataset":
        return replace(self, **changes)

    def also(self, **tables: DataFrame) -> "Dataset":
        return replace(self, extra={**self.extra, **tables})


def tagged(kind: str, s: Column) -> Column:
    """A value of one kind; null where ``s`` is null."""
    return F.struct(F.when(s.isNull(), F.lit("null")).otherwise(F.lit(kind)).alias("kind"), s.cast("string").alias("s"))


def text_value(s: Column) -> Column:
    return tagged("string", s)


def empty_map(kind: str) -> Column:
    return F.create_map().cast(kind)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` added or replaced, each computed once a row.

    Spark puts a column's expression in every place that uses it, in a lambda once an element; a generator of one row keeps it apart.
    """
    order = [*df.columns, *(c for c in columns if c not in df.columns)]
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made).select(*order)


def as_records(df: DataFrame, values: dict[str, Column], doc_id: str = "doc_id", record_ix: str | None = "record_ix", carry: tuple[str, ...] = ()) -> DataFrame:
    """RECORD rows from ordinary columns: ``values`` gives each field's tagged value; columns to ``carry`` stay, such as the text."""
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values())).cast(f"map<string,{VALUE}>")
    ix = F.col(record_ix) if record_ix else F.lit(0)
    return with_sides(df.select(F.col(doc_id).cast("string").alias("doc_id"), ix.cast("int").alias("record_ix"), m.alias("values"), *carry))


def with_sides(df: DataFrame) -> DataFrame:
    """Add the per-field maps a record lacks, empty."""
    for name, kind in _SIDE:
        if name not in df.columns:
            df = df.withColumn(name, empty_map(kind))
    return df


def in_order(pages: Column) -> Column:
    """Pages by index."""
    return F.array_sort(pages, lambda a, b: a["index"] - b["index"])


def full_text(pages: Column) -> Column:
    """Page texts in order of index, joined by a newline."""
    return F.array_join(F.transform(in_order(pages), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def document_text(markdown: Column, pages: Column) -> Column:
    """The markdown where it is not empty, else the full text."""
    return F.coalesce(F.nullif(markdown, F.lit("")), full_text(pages))
