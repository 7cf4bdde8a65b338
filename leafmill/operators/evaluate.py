"""Evaluation: alignment of predicted and expected records, field metrics, reports, sweeps, OCR recall, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.coercion import values_match
from leafmill.functions.misc import percentile_nearest
from leafmill.functions.numbers import value_in_text
from leafmill.functions.text import relaxed_match, strip, token_recall
from leafmill.schema import TargetSchema

# Predicted and expected rows: (case_id, row_ix, fields map<string,string>).


def _sides(predicted: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = predicted.select("case_id", "row_ix", F.col("fields").alias("predicted"))
    return p, expected.select("case_id", "row_ix", F.col("fields").alias("expected"))


def align_by_index(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, row_ix, predicted, expected): the n-th with the n-th, the longer side with nulls. One full outer join."""
    p, e = _sides(predicted, expected)
    return p.join(e, ["case_id", "row_ix"], "full_outer")


def align_by_key(predicted: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(case_id, key, predicted, expected): by the stripped key; blank keys and all but the first of a key are dropped on either side."""
    def keyed(df, name):
        k = F.nullif(strip(F.col(name)[key]), F.lit(""))
        w = Window.partitionBy("case_id", "key").orderBy("row_ix")
        return df.withColumn("key", k).where("key is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("case_id", "key", name)

    p, e = _sides(predicted, expected)
    return keyed(p, "predicted").join(keyed(e, "expected"), ["case_id", "key"], "full_outer")


def dropped_keys(rows: DataFrame, key: str) -> DataFrame:
    """(case_id, blank, repeated): what alignment by key leaves out."""
    k = F.nullif(strip(F.col("fields")[key]), F.lit(""))
    return rows.groupBy("case_id").agg(F.count_if(k.isNull()).alias("blank"), (F.count(k) - F.count_distinct(k)).alias("repeated"))


def field_verdicts(pairs: DataFrame, schema: TargetSchema) -> DataFrame:
    """(case_id, field, correct, in_pair): a row for each pair and declared field. Narrow."""
    made = [F.struct(F.lit(s.name).alias("field"), values_match(F.col("predicted")[s.name], F.col("expected")[s.name], s.type).alias("correct")) for s in schema.fields]
    out = pairs.withColumn("v", F.array(*made)).withColumn("exact", F.col("predicted").isNotNull() & F.col("expected").isNotNull() & F.forall("v", lambda x: x["correct"]))
    return out.select("case_id", "predicted", "expected", "exact", "v")


def field_metrics(pairs: DataFrame, schema: TargetSchema) -> DataFrame:
    """(field, correct, total, accuracy): a row for each field, and one with a null field for all of them."""
    v = field_verdicts(pairs, schema).select(F.explode("v").alias("v")).select("v.*")
    g = v.rollup("field").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    return g.withColumn("accuracy", F.coalesce(F.col("correct") / F.nullif("total", F.lit(0)), F.lit(0.0)))


def record_metrics(pairs: DataFrame, schema: TargetSchema) -> DataFrame:
    """One row: overall_field_accuracy, record counts, exact_record_match_ratio."""
    n = max(1, len(schema.fields))
    v = field_verdicts(pairs, schema).withColumn("hits", F.size(F.filter("v", lambda x: x["correct"])))
    return v.agg(
        F.coalesce(F.sum("hits") / F.nullif(F.count("*") * n, F.lit(0)), F.lit(0.0)).alias("overall_field_accuracy"),
        F.count("predicted").alias("record_count_predicted"), F.count("expected").alias("record_count_expected"),
        F.coalesce(F.count_if("exact") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("exact_record_match_ratio"),
    )


def case_metrics(pairs: DataFrame, schema: TargetSchema) -> DataFrame:
    """(case_id, accuracy, hits: array of (field, correct, total))."""
    v = field_verdicts(pairs, schema)
    hits = F.array(*[F.struct(F.lit(s.name).alias("field"), F.count_if(F.get("v", F.lit(i))["correct"]).alias("correct"), F.count("*").alias("total")) for i, s in enumerate(schema.fields)])
    out = v.groupBy("case_id").agg(hits.alias("hits"))
    total = lambda f: F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x[f])
    return out.select("case_id", F.coalesce(total("correct") / F.nullif(total("total"), F.lit(0)), F.lit(0.0)).alias("accuracy"), "hits")


def report(cases: DataFrame) -> DataFrame:
    """One row from (case_id, accuracy, escalated, usd, latency_ms, review_flagged): accuracy is the mean over cases."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cases.agg(
        F.count("*").alias("case_count"), zero(F.avg("accuracy")).alias("overall_field_accuracy"), F.count_if("escalated").alias("escalation_count"), zero(F.sum("usd")).alias("total_usd"),
        zero(percentile_nearest("latency_ms", 0.5)).alias("latency_p50_ms"), zero(percentile_nearest("latency_ms", 0.95)).alias("latency_p95_ms"), zero(F.avg(F.col("review_flagged").cast("double"))).alias("review_rate"),
    )


def pooled_accuracy(cases: DataFrame) -> DataFrame:
    """(field, accuracy) pooled over all cases."""
    h = cases.select(F.explode("hits").alias("h")).groupBy("h.field").agg(F.sum("h.correct").alias("c"), F.sum("h.total").alias("t"))
    return h.select("field", F.coalesce(F.col("c") / F.nullif("t", F.lit(0)), F.lit(0.0)).alias("accuracy"))


def sweep(cases: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, accuracy, total_usd, escalations) from (score, primary_accuracy, primary_usd, fallback_accuracy, fallback_usd).

    Both tiers ran once; a threshold only chooses between them. The thresholds are a literal array, so nothing is joined.
    """
    ts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    x = cases.select(ts, "*").withColumn("up", F.coalesce("score", F.lit(0.0)) < F.col("threshold"))
    usd = F.coalesce("primary_usd", F.lit(0.0)) + F.when(F.col("up"), F.coalesce("fallback_usd", F.lit(0.0))).otherwise(0.0)
    return x.groupBy("threshold").agg(F.avg(F.when(F.col("up"), F.col("fallback_accuracy")).otherwise(F.col("primary_accuracy"))).alias("accuracy"), F.sum(usd).alias("total_usd"), F.count_if("up").alias("escalations"))


def sample_recall(samples: DataFrame) -> DataFrame:
    """(sample_id, field, exact, token) from (sample_id, text, fields map<string,string>)."""
    rows = samples.select("sample_id", F.coalesce("text", F.lit("")).alias("text"), F.explode("fields").alias("field", "value"))
    return rows.select("sample_id", "field", value_in_text(F.col("value"), F.col("text")).alias("exact"), token_recall(F.col("value"), F.col("text")).alias("token"))


def ocr_recall(recalls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((field, exact_recall, token_recall), one row of overall figures): exact is the mean of sample means, token the mean over fields."""
    hit = F.col("exact").cast("double")
    fields = recalls.groupBy("field").agg(F.avg(hit).alias("exact_recall"), F.avg("token").alias("token_recall"))
    samples = recalls.groupBy("sample_id").agg(F.avg(hit).alias("e")).agg(F.count("*").alias("n_samples"), F.coalesce(F.avg("e"), F.lit(0.0)).alias("overall_exact"))
    return fields, samples.crossJoin(fields.agg(F.avg("token_recall").alias("overall_token")))


def qa_accuracy(answers: DataFrame) -> DataFrame:
    """One row from (golds, text_answer, visual_answer): accuracy of either, and the gap in points."""
    t, v = (F.avg(relaxed_match(F.col(c), F.col("golds")).cast("double")) for c in ("text_answer", "visual_answer"))
    return answers.agg(F.count("*").alias("n"), t.alias("text_accuracy"), v.alias("visual_accuracy"), ((v - t) * 100).alias("gap_points"))


def calibration_table(predictions: DataFrame) -> DataFrame:
    """(raw, n, empirical) from (confidence, correct), raw scores rounded to three places."""
    return predictions.groupBy(F.round("confidence", 3).alias("raw")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("empirical"))


def calibration_error(table: DataFrame) -> DataFrame:
    """One row ``ece``: mean gap between raw and empirical, by number of predictions."""
    return table.agg((F.sum(F.abs(F.col("raw") - F.col("empirical")) * F.col("n")) / F.sum("n")).alias("ece"))


def calibration_map(table: DataFrame) -> dict[float, float]:
    """For ``score_confidence``; raw scores are rounded, so at most 1001 rows reach the driver."""
    return {r["raw"]: r["empirical"] for r in table.toLocalIterator()}


def is_exact(prediction: Column, golds: Column) -> Column:
    return relaxed_match(prediction, golds)
