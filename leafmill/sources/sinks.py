"""Records out: JSON, CSV, envelopes, resumable caches, printed reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.coercion import kind
from leafmill.functions.numbers import strict_double
from leafmill.schema import TargetSchema


def cell(v: Column) -> Column:
    """A value as a table cell: null is '', booleans are True and False, floats keep a decimal part."""
    d = strict_double(v["s"])
    floating = F.when((F.abs(d) < 1e16) & (d == F.floor(d)), F.concat(d.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(v["s"])
    return F.when(kind(v) == "null", "").when(kind(v) == "bool", F.initcap(v["s"])).when(kind(v) == "float", floating).otherwise(F.coalesce(v["s"], F.lit("")))


def wide(records: DataFrame, schema: TargetSchema | None = None) -> DataFrame:
    """(doc_id, record_ix, a column for each field). Without a schema the fields are those that occur, in order of first sight."""
    if schema and schema.fields:
        names = schema.names()
    else:
        seen = records.select("doc_id", "record_ix", F.posexplode(F.map_keys("values")).alias("p", "k")).groupBy("k").agg(F.min(F.struct("doc_id", "record_ix", "p")).alias("at"))
        names = [r["k"] for r in seen.orderBy("at").toLocalIterator()]
    return records.select("doc_id", "record_ix", *[cell(F.col("values")[n]).alias(n) for n in names])


def write_csv(records: DataFrame, path: str, schema: TargetSchema | None = None) -> None:
    w = wide(records, schema)
    w.drop("doc_id", "record_ix").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def record_json(values: Column) -> Column:
    """A record's JSON, numbers and booleans bare, literals unchanged."""
    def item(e):
        v = e["value"]
        bare = kind(v).isin("int", "float", "bool", "json")
        q = lambda s: F.substr(F.to_json(F.struct(s.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(s.alias("v")))) - 6)
        return F.concat(q(e["key"]), F.lit(":"), F.when(kind(v) == "null", "null").when(bare, v["s"]).otherwise(q(v["s"])))

    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(values), item), ","), F.lit("}"))


def result_json(records: DataFrame, validation: DataFrame | None = None, deduped: DataFrame | None = None) -> DataFrame:
    """(doc_id, json) with records, validation and normalize, a row a document."""
    r = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("record_ix", record_json(F.col("values")).alias("j")))).alias("r"))
    out = r.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ","), F.lit("]")).alias("r"))
    parts = [F.lit('{"records":'), F.col("r")]
    for name, table in (("validation", validation), ("normalize", deduped)):
        if table is not None:
            cols = [c for c in table.columns if c != "doc_id"]
            out = out.join(table.select("doc_id", F.to_json(F.struct(*cols)).alias(f"_{name}")), "doc_id", "left")
            parts += [F.lit(f',"{name}":'), F.coalesce(f"_{name}", F.lit("null"))]
    return out.select("doc_id", F.concat(*parts, F.lit("}")).alias("json"))


def write_json(results: DataFrame, path: str) -> None:
    """One document a line."""
    results.select("json").write.mode("overwrite").text(path)


def extraction_result(records: DataFrame, costs: DataFrame | None = None, metrics: DataFrame | None = None, trace: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): all a caller gets for a document: records, confidence, low_confidence, provenance, cost, metrics, trace."""
    side = [c for c in ("confidence", "low_confidence", "provenance", "errors") if c in records.columns]
    g = records.select("doc_id", "record_ix", record_json(F.col("values")).alias("record"), F.to_json(F.struct(*[F.col(c) for c in side]) if side else F.struct(F.lit(None).alias("none"))).alias("side"))
    g = g.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("record_ix", "record", "side"))).alias("r"))
    arr = lambda f: F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x[f]), ","), F.lit("]"))
    out = g.select("doc_id", arr("record").alias("records"), arr("side").alias("fields"))
    parts = [F.lit('{"records":'), F.col("records"), F.lit(',"fields":'), F.col("fields")]
    for name, table in (("cost", costs), ("metrics", metrics), ("trace", trace)):
        if table is not None:
            cols = [c for c in table.columns if c != "doc_id"]
            t = table.groupBy("doc_id").agg(F.to_json(F.collect_list(F.struct(*cols))).alias(f"_{name}"))
            out = out.join(t, "doc_id", "left")
            parts += [F.lit(f',"{name}":'), F.coalesce(f"_{name}", F.lit("[]"))]
    return out.select("doc_id", F.concat(*parts, F.lit("}")).alias("json"))


def todo(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def resume(work: DataFrame, path: str, key: str, run) -> DataFrame:
    """Run ``run`` on what the JSON-lines cache at ``path`` lacks, append it, and return the whole cache."""
    spark = work.sparkSession
    fresh = run(work.limit(0))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    left = todo(work, spark.read.schema(fresh.schema).json(path), key) if exists else work
    run(left).write.mode("append").json(path)
    return spark.read.schema(fresh.schema).json(path)


def table_text(rows: list[dict], columns: list[str]) -> str:
    """Rows as padded text; for small results on the driver."""
    cells = [[("" if r.get(c) is None else str(r[c])) for c in columns] for r in rows]
    width = [max([len(c), *(len(x[i]) for x in cells)]) for i, c in enumerate(columns)]
    line = lambda x: "  ".join(s.ljust(w) for s, w in zip(x, width)).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in width]), *map(line, cells)])


def write_sweep(sweep: DataFrame, path: str) -> None:
    sweep.select(*"threshold accuracy total_usd escalations".split()).orderBy("threshold").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report_text(report: dict, per_field: dict[str, float]) -> str:
    """An evaluation report in fixed layout."""
    head = [f"cases           {report['case_count']}", f"field accuracy  {report['overall_field_accuracy']:.4f}", f"escalations     {report['escalation_count']}", f"cost            {report['total_usd']:.6f} USD"]
    tail = [f"latency         p50 {report['latency_p50_ms']:.2f} ms, p95 {report['latency_p95_ms']:.2f} ms", f"review rate     {report['review_rate']:.4f}"]
    return "\n".join([*head, *tail, *[f"  {k:<14}{v:.4f}" for k, v in per_field.items()]])


def recall_text(rows: list[dict]) -> str:
    """OCR recall by field; an em dash where no value had enough tokens."""
    dash = lambda x: "—" if x is None else f"{x:.2f}"
    return table_text([{"field": r["field"], "exact": dash(r["exact_recall"]), "token": dash(r["token_recall"])} for r in rows], ["field", "exact", "token"])
