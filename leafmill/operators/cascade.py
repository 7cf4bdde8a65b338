"""Scorers, cost ledger, budgets, and the cascade from a cheap to a strong extractor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.durable import keep as keep_
from leafmill.functions.coercion import is_filled
from leafmill.functions.numbers import value_in_text
from leafmill.functions.text import char_validity, count_tokens, text_length, text_sufficiency
from leafmill.model import Dataset
from leafmill.schema import TargetSchema

#: A scorer makes a column from a document's text and its records (array of value maps).
Scorer = Callable[[Column, Column], Column]
_KNOWN: dict[str, Scorer] = {}


def register_scorer(name, scorer: Scorer) -> None:
    _KNOWN[name] = scorer


def get_scorer(name: str) -> Scorer:
    if name not in _KNOWN:
        raise KeyError(f"no scorer {name!r}; there are {sorted(_KNOWN)}")
    return _KNOWN[name]


register_scorer("text_length", lambda t, r: text_length(t).cast("double"))
register_scorer("char_validity", lambda t, r: char_validity(t))
register_scorer("text_sufficiency", lambda t, r: text_sufficiency(t))


def _mean(x: Column) -> Column:
    """Mean of an array of doubles; 0 for none."""
    return F.coalesce(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(x), F.lit(0)), F.lit(0.0))


def required_fill_ratio(schema: TargetSchema) -> Scorer:
    """Share of records with all required fields filled, which they are when nothing is required; 0 without records."""
    need = [f.name for f in schema.fields if f.required]

    def score(text, records):
        ok = lambda r: F.when(F.forall(F.array(*[F.lit(n) for n in need]), lambda n: F.coalesce(is_filled(r[n]), F.lit(False))), 1.0).otherwise(0.0)
        return _mean(F.transform(records, ok)) if need else F.when(F.coalesce(F.size(records), F.lit(0)) > 0, 1.0).otherwise(0.0)

    return score


def field_coverage(schema: TargetSchema) -> Scorer:
    """Mean share of declared fields that are filled."""
    names = schema.names()

    def score(text, records):
        if not names:
            return F.when(F.coalesce(F.size(records), F.lit(0)) > 0, 1.0).otherwise(0.0)
        part = lambda r: F.size(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(is_filled(r[n]), F.lit(False)))) / len(names)
        return _mean(F.transform(records, part))

    return score


def grounding(schema: TargetSchema) -> Scorer:
    """Mean over records of the share of filled declared fields that the text holds; a record without filled fields counts 0."""
    names = schema.names()

    def score(text, records):
        def part(r):
            filled = F.filter(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: F.coalesce(is_filled(r[n]), F.lit(False)))
            hit = F.size(F.filter(filled, lambda n: value_in_text(r[n]["s"], text)))
            return F.coalesce(hit / F.nullif(F.size(filled), F.lit(0)), F.lit(0.0))

        return _mean(F.transform(records, part))

    return score


BOUND = {"required_fill_ratio": required_fill_ratio, "field_coverage": field_coverage, "grounding": grounding, "grounding_ratio": grounding}


def composite(parts: list[tuple[Scorer, float]]) -> Scorer:
    """Weighted mean; a component that is null (failed) is left out and the weights count anew; 0 without weight."""

    def score(text, records):
        both = [(s(text, records), float(w)) for s, w in parts]
        if not both:
            return F.lit(0.0)
        top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in both), F.lit(0.0))
        weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in both), F.lit(0.0))
        return F.when(weight > 0, top / weight).otherwise(0.0)

    return score


def resolve_scorer(spec, schema: TargetSchema) -> Scorer:
    """A scorer from its name, or from {composite: [{scorer, weight}, ...]}."""
    if isinstance(spec, str):
        return BOUND[spec](schema) if spec in BOUND else get_scorer(spec)
    if isinstance(spec, dict) and isinstance(spec.get("composite"), list) and spec["composite"]:
        parts = []
        for p in spec["composite"]:
            if not isinstance(p, dict) or "scorer" not in p:
                raise ValueError(f"a part of a composite needs a scorer: {p}")
            parts.append((resolve_scorer(p["scorer"], schema), float(p.get("weight", 1.0))))
        return composite(parts)
    raise ValueError(f"a scorer is a name or a composite: {spec}")


def score_documents(data: Dataset, scorer: Scorer, text: Column) -> DataFrame:
    """(doc_id, score). Shuffles the records by document when there are any."""
    docs = data.documents.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("_t"))
    if data.records is None:
        scored = docs.withColumn("_r", F.array().cast("array<map<string,struct<kind:string,s:string>>>"))
    else:
        per = data.records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("record_ix", F.map_entries("values").alias("v")))).alias("_x"))
        per = per.select("doc_id", F.transform("_x", lambda x: F.map_from_entries(x["v"])).alias("_r"))
        scored = docs.join(per, "doc_id", "left").withColumn("_r", F.coalesce("_r", F.array().cast("array<map<string,struct<kind:string,s:string>>>")))
    return scored.select("doc_id", scorer(F.col("_t"), F.col("_r")).alias("score"))


def cascade(data: Dataset, primary: Callable[[Dataset], Dataset], fallback: Callable[[Dataset], Dataset], scorer: Scorer, threshold: float, text: Column, keep: Callable[[DataFrame], DataFrame] | None = None) -> Dataset:
    """Run ``primary``; documents that score below ``threshold`` run ``fallback`` from the state before it.

    The router (doc_id, tier, score, threshold) is appended to. Costs of a discarded primary stay in the ledger. ``keep``
    materialises the primary's records and the scores, so engines are not asked twice; by default it does (``durable.keep``).
    """
    first = primary(data)
    hold = keep or keep_
    if first.records is not None:
        first = first.with_(records=hold(first.records))
    scores = hold(score_documents(first, scorer, text))
    weak = scores.where(F.coalesce(F.col("score"), F.lit(0.0)) < threshold).select("doc_id")
    only = lambda df, how: df.join(weak, "doc_id", how)
    again = fallback(data.with_(documents=only(data.documents, "left_semi"), records=None if data.records is None else only(data.records, "left_semi"), costs=None))
    def both(a, b):
        return b if a is None else a if b is None else only(a, "left_anti").unionByName(b, allowMissingColumns=True)
    costs = first.costs if again.costs is None else again.costs if first.costs is None else first.costs.unionByName(again.costs)
    tier = F.when(F.coalesce(F.col("score"), F.lit(0.0)) < threshold, "fallback").otherwise("primary")
    routed = scores.select("doc_id", tier.alias("tier"), "score", F.lit(float(threshold)).alias("threshold"))
    old = first.extra.get("router")
    return first.with_(documents=both(first.documents, again.documents), records=both(first.records, again.records), costs=costs).also(router=routed if old is None else old.unionByName(routed))


# --- cost

#: model, USD for 1000 tokens in, out
PRICES = [("gpt-4o", 25e-4, 1e-2), ("gpt-4o-mini", 15e-5, 6e-4), ("anthropic.claude-3-5-sonnet", 3e-3, 15e-3)]


def price_table(spark: SparkSession, prices: list[tuple[str, float, float]] | None = None) -> DataFrame:
    return spark.createDataFrame(PRICES if prices is None else prices, "key string, usd_in double, usd_out double")


def price_key(model: Column, keys: list[str]) -> Column:
    """The longest price key that the model's name, without a provider's prefix, begins with, else that it holds; null for none."""
    name = F.regexp_replace(F.trim(model), r"\A[^/]*/", "")
    known = F.array(*[F.lit(k) for k in sorted(keys, key=lambda k: (-len(k), keys.index(k)))]).cast("array<string>")
    first = lambda test: F.get(F.filter(known, test), F.lit(0))
    return F.coalesce(first(lambda k: F.startswith(name, k)), first(lambda k: F.contains(name, k)))


def estimate_usd(model: Column, tokens_in: Column, tokens_out: Column, prices: list[tuple[str, float, float]] | None = None) -> Column:
    """Cost in USD; null for a model without a price. The price list is a literal, bounded by what the driver was given."""
    table = PRICES if prices is None else prices
    if not table:
        return F.lit(None).cast("double")
    key = price_key(model, [p[0] for p in table])
    rate = lambda i: F.create_map(*[F.lit(x) for p in table for x in (p[0], float(p[i]))])[key]
    return tokens_in / 1000 * rate(1) + tokens_out / 1000 * rate(2)


def cost_entries(calls: DataFrame, stage: str, prices: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """COST rows from (doc_id, seq, model, tokens_in, tokens_out); null tokens are unmetered, an unknown model unpriced."""
    metered = F.col("tokens_in").isNotNull() & F.col("tokens_out").isNotNull()
    usd = F.when(metered, estimate_usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), prices))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return calls.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("int").alias("seq"), F.lit(stage).alias("stage"), "model", zero("tokens_in"), zero("tokens_out"), usd.alias("usd"), (metered & usd.isNull()).alias("unpriced"), (~metered).alias("unmetered"))


_LEDGER = lambda: (
    F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("total_usd"),
    F.max_by("model", "seq").alias("model"), F.bool_or("unpriced").alias("unpriced"), F.bool_or("unmetered").alias("unmetered"),
)


def ledger(costs: DataFrame) -> DataFrame:
    """Totals of each document; the last model wins, flags are or-ed."""
    return costs.groupBy("doc_id").agg(*_LEDGER())


def ledger_by_stage(costs: DataFrame) -> DataFrame:
    return costs.groupBy("doc_id", "stage").agg(*_LEDGER())


def running_cost(costs: DataFrame) -> DataFrame:
    """COST rows with ``spent``, the document's sum so far in order of ``seq``."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return costs.withColumn("spent", F.sum(F.coalesce("usd", F.lit(0.0))).over(w))


def over_budget(costs: DataFrame, budget: float) -> DataFrame:
    """(doc_id, seq, spent) of the first call of each document after which the budget is exceeded."""
    first = running_cost(costs).where(F.col("spent") > budget).groupBy("doc_id").agg(F.min_by(F.struct("seq", "spent"), "seq").alias("x"))
    return first.select("doc_id", "x.*")


def preflight(asked: DataFrame, model: str, expected_out: int, budget: float | None, spent: Column | None = None, prices=None) -> DataFrame:
    """Mark requests whose projected cost, on top of what is spent, exceeds the budget; they are not sent."""
    if budget is None:
        return asked
    extra = F.coalesce(estimate_usd(F.lit(model), count_tokens(F.col("prompt")), F.lit(expected_out), prices), F.lit(0.0))
    over = extra + (F.lit(0.0) if spent is None else F.coalesce(spent, F.lit(0.0))) > budget
    return asked.withColumn("error_class", F.coalesce("error_class", F.when(over, "budget_exceeded")))
