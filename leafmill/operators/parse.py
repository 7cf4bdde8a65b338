"""Pages to markdown, source classification and routing by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.tables import to_markdown
from leafmill.functions.text import strip
from leafmill.model import in_order

Parser = Callable[[DataFrame], DataFrame]

_IMAGES = "bmp jpeg jpg png tif tiff webp".split()
#: Document type to parser name. Engines that are not built in are registered by the deployer.
DEFAULT_ROUTES = {t: "parser.layout" for t in ("pdf_scan", "image_scan")} | {"pdf_digital": "parser.tables"} | {t: "parser.passthrough" for t in ("unknown", "spreadsheet", "text")}


def page_header(page: Column) -> Column:
    return F.concat(F.lit("## Page "), page["index"].cast("string"))


def passthrough_section(page: Column) -> Column:
    """Header, text, and the block texts that the page's text does not already hold."""
    text = F.coalesce(page["text"], F.lit(""))
    blocks = F.filter(F.transform(F.coalesce(page["blocks"], F.array()), lambda b: F.coalesce(b["text"], F.lit(""))), lambda t: (t != "") & ~F.contains(text, t))
    parts = F.array(page_header(page), text, F.array_join(blocks, "\n"))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def passthrough(docs: DataFrame) -> DataFrame:
    """Sets ``markdown`` from the pages, with a header for each page."""
    return docs.withColumn("markdown", F.array_join(F.transform(in_order(F.col("pages")), passthrough_section), "\n\n"))


def table_sections(pages: Column, tables: Column) -> Column:
    """Page text followed by its tables as GFM; pages with neither get no header. ``tables``: map of page index to tables."""
    def section(p):
        found = F.coalesce(tables[p["index"]], F.array().cast("array<struct<header:array<string>,rows:array<array<string>>>>"))
        body = F.concat(F.array(strip(F.coalesce(p["text"], F.lit("")))), F.transform(found, lambda t: to_markdown(t["header"], t["rows"])))
        body = F.filter(body, lambda x: x != "")
        return F.when(F.size(body) > 0, F.array_join(F.concat(F.array(page_header(p)), body), "\n\n"))

    return F.array_join(F.array_compact(F.transform(in_order(pages), section)), "\n\n")


def with_tables(docs: DataFrame, tables: str = "tables") -> DataFrame:
    """As ``passthrough``, from the text layer and the tables an engine found."""
    return docs.withColumn("markdown", table_sections(F.col("pages"), F.col(tables)))


def extension(path: Column) -> Column:
    """Lower-cased suffix of the last path element, with its dot; '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/\\]+(\.[^./\\]+)$", 1))


def classify_source(path: Column, pages: Column) -> Column:
    """image_scan, text, spreadsheet, pdf_digital, pdf_scan or unknown. A PDF is digital when a page has text."""
    ext = extension(path)
    has_text = F.exists(F.coalesce(pages, F.array()), lambda p: strip(F.coalesce(p["text"], F.lit(""))) != "")
    return (
        F.when(ext.isin([f".{e}" for e in _IMAGES]), "image_scan")
        .when(ext.isin(".md", ".txt"), "text")
        .when(ext == ".xlsx", "spreadsheet")
        .when((ext == ".pdf") & has_text, "pdf_digital")
        .when(ext == ".pdf", "pdf_scan")
        .otherwise("unknown")
    )


def route(docs: DataFrame, parsers: dict[str, Parser], routes=None) -> DataFrame:
    """Parse each document with its type's parser; one pass a parser in use, so an engine sees its own documents only."""
    routes = DEFAULT_ROUTES if routes is None else routes
    last = routes.get("unknown", "parser.passthrough")
    names = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv]) if routes else F.create_map(F.lit("unknown"), F.lit(last))
    typed = docs.withColumn("_type", classify_source(F.col("path"), F.col("pages")))
    typed = typed.withColumn("_parser", F.coalesce(names[F.col("_type")], F.lit(last)))
    out = None
    for name in sorted({*routes.values(), last}):
        parse = parsers.get(name, passthrough)
        part = parse(typed.where(F.col("_parser") == name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("parser_route", F.struct(F.col("_type").alias("doc_type"), F.col("_parser").alias("parser"))).drop("_type", "_parser")
