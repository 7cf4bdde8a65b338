"""Metrics of documents and of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.misc import percentile_nearest


def _join(base: DataFrame, other: DataFrame | None, agg) -> DataFrame:
    return base if other is None else base.join(agg(other), "doc_id", "left")


def document_metrics(docs: DataFrame, trace: DataFrame | None = None, records: DataFrame | None = None, rules: DataFrame | None = None, router: DataFrame | None = None, costs: DataFrame | None = None) -> DataFrame:
    """A row a document: latency by stage, stages that went well or not, escalation, counts, cost. Tables are aggregated before they are joined."""
    m = docs.select(F.col("doc_id").cast("string").alias("doc_id"))

    def traced(t):
        per = t.groupBy("doc_id", "stage").agg(F.sum("duration_ms").alias("ms"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("bad"))
        return per.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "ms"))).alias("stage_latency_ms"), F.sum("ms").alias("total_latency_ms"), F.sum("ok").alias("stages_ok"), F.sum("bad").alias("stages_failed"))

    def counted(r):
        repaired = F.sum(F.aggregate("repair_log", F.lit(0), lambda a, x: a + F.size(x["fields"]))) if "repair_log" in r.columns else F.lit(0)
        low = F.sum(F.size("low_confidence")) if "low_confidence" in r.columns else F.lit(0)
        return r.groupBy("doc_id").agg(F.count("*").alias("records"), low.alias("low_confidence"), repaired.alias("repaired_fields"), F.min(F.array_min(F.map_values("confidence"))).alias("lowest_confidence"))

    m = _join(m, trace, traced)
    m = _join(m, records, counted)
    m = _join(m, rules, lambda r: r.groupBy("doc_id").agg(F.count_if(F.col("status") == "violation").alias("rule_violations")))
    m = _join(m, router, lambda r: r.groupBy("doc_id").agg(F.bool_or(F.col("tier") == "fallback").alias("escalated")))
    m = _join(m, costs, lambda c: c.groupBy("doc_id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(F.coalesce("usd", F.lit(0.0))).alias("cost_usd")))
    for name, zero in (("stage_latency_ms", F.create_map().cast("map<string,double>")), ("total_latency_ms", F.lit(0.0)), ("escalated", F.lit(False)), ("cost_usd", F.lit(0.0)), *[(n, F.lit(0).cast("long")) for n in ("stages_ok", "stages_failed", "records", "low_confidence", "repaired_fields", "rule_violations", "tokens_in", "tokens_out")]):
        m = m.withColumn(name, F.coalesce(name, zero) if name in m.columns else zero)
    return m if "lowest_confidence" in m.columns else m.withColumn("lowest_confidence", F.lit(None).cast("double"))


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    """One row. ``low_confidence_rate`` is a mean count, so it may exceed one; over nothing all is 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return metrics.agg(
        F.count("*").alias("n_documents"), zero(F.avg(F.col("escalated").cast("double"))).alias("escalation_rate"), zero(F.avg((F.col("rule_violations") >= 1).cast("double"))).alias("violation_rate"),
        zero(F.avg("low_confidence")).alias("low_confidence_rate"), zero(F.sum("cost_usd")).alias("total_cost_usd"), zero(F.avg(F.col("tokens_in") + F.col("tokens_out"))).alias("mean_tokens"),
    )


def stage_latencies(metrics: DataFrame) -> DataFrame:
    """(stage, mean, p95)."""
    rows = metrics.select(F.explode("stage_latency_ms").alias("stage", "ms"))
    return rows.groupBy("stage").agg(F.avg("ms").alias("mean"), percentile_nearest("ms", 0.95).alias("p95"))
