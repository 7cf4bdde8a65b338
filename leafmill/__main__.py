"""python -m leafmill: run a pipeline file over documents, evaluate it, or sweep a cascade's threshold."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafmill.model import Dataset
from leafmill.operators import evaluate
from leafmill.plans.build import Pipeline, build, load_pipeline, set_threshold
from leafmill.sources import load, sinks


def extract(spark: SparkSession, pipeline: Pipeline, path: str) -> Dataset:
    docs = load.read_documents(spark, path, max_pages=pipeline.context.options.get("max_pages"))
    return pipeline.run(Dataset(docs))


def evaluate_cases(spark: SparkSession, pipeline: Pipeline, dataset: str, folder: str = "") -> dict:
    """Field metrics of one batch run over all cases. A case is its whole path, so files of one name in several folders are several cases."""
    home = os.getcwd()

    def bare(path):
        """A path without its scheme, absolute and without dots."""
        p = F.regexp_replace(path, r"^file:/*", "/")
        p = F.when(p.rlike(r"^/|^[a-z][a-z0-9+.-]*://"), p).otherwise(F.concat(F.lit(home + "/"), p))
        return F.regexp_replace(p, r"/(?:\./)+", "/")

    cases = load.load_dataset(spark, dataset)
    key = cases.select("key_field").first()
    prefix = folder.rstrip("/") + "/" if folder else ""
    paths = [prefix + r["input_path"] for r in cases.select("input_path").distinct().toLocalIterator()]
    out = pipeline.run(Dataset(load.ingest(spark.read.format("binaryFile").load(paths))))
    predicted = out.records.join(out.documents.select("doc_id", bare(F.col("path")).alias("case_id")), "doc_id").select("case_id", F.col("record_ix").alias("row_ix"), F.transform_values("values", lambda k, v: v["s"]).alias("fields"))
    expected = cases.select(bare(F.concat(F.lit(prefix), "input_path")).alias("case_id"), F.posexplode("expected").alias("row_ix", "fields"))
    schema = pipeline.context.schema
    pairs = evaluate.align_by_key(predicted, expected, key["key_field"]) if key and key["key_field"] else evaluate.align_by_index(predicted, expected)
    fields = {r["field"]: r["accuracy"] for r in evaluate.field_metrics(pairs, schema).collect()}
    overall = evaluate.record_metrics(pairs, schema).first().asDict()
    return overall | {"fields": {k: v for k, v in fields.items() if k is not None}}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="leafmill")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="extract records")
    run.add_argument("--config", required=True)
    run.add_argument("--input", required=True)
    run.add_argument("--out")
    run.add_argument("--csv")
    run.add_argument("--show", type=int, default=100, help="records printed when nothing is written")
    ev = sub.add_parser("eval", help="compare with expected records")
    ev.add_argument("--config", required=True)
    ev.add_argument("--dataset", required=True)
    ev.add_argument("--folder", default="")
    sw = sub.add_parser("sweep", help="accuracy at several thresholds")
    sw.add_argument("--config", required=True)
    sw.add_argument("--dataset", required=True)
    sw.add_argument("--folder", default="")
    sw.add_argument("--thresholds", help="comma-separated", required=True)
    be = sub.add_parser("bench", help="run a self-contained benchmark file")
    be.add_argument("spec")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    if a.command == "run":
        pipeline = load_pipeline(a.config)
        out = extract(spark, pipeline, a.input)
        if a.out:
            sinks.write_json(sinks.result_json(out.records, out.extra.get("validation"), out.extra.get("deduped")), a.out)
        if a.csv:
            sinks.write_csv(out.records, a.csv, pipeline.context.schema)
        if not (a.out or a.csv):
            w = sinks.wide(out.records, pipeline.context.schema).drop("doc_id", "record_ix")
            some = w.take(a.show + 1)
            print(sinks.table_text([r.asDict() for r in some[: a.show]], w.columns))
            if len(some) > a.show:
                print(f"the first {a.show} of {w.count()} records; --show, --out and --csv give more")
    elif a.command == "bench":
        spec = load.load_spec(a.spec)
        print(spec["name"], evaluate_cases(spark, build(spec), spec["dataset"], spec.get("folder", "")))
    elif a.command == "eval":
        print(evaluate_cases(spark, load_pipeline(a.config), a.dataset, a.folder))
    else:
        import yaml

        with open(a.config, encoding="utf-8") as f:
            config = yaml.safe_load(f)
        for t in map(float, a.thresholds.split(",")):
            print(t, evaluate_cases(spark, build(set_threshold(config, t)), a.dataset, a.folder)["overall_field_accuracy"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
