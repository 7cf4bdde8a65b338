"""Pipelines from YAML: a list of stages, each a name or a mapping of one name to its parameters.

All checks run on the driver before any job. A stage is a function Dataset -> Dataset; a pipeline composes them into one lazy plan.
Names that need an engine (a model client, a parser of scans) take it from ``engines``.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.durable import keep as keep_
from leafmill.operators.clients import engines_of
from leafmill.functions.text import count_tokens
from leafmill.model import Dataset, document_text
from leafmill.operators import cascade as cas
from leafmill.operators import extract as ext
from leafmill.operators import figures as fig
from leafmill.operators import observe, parse, quality, verify
from leafmill.schema import TargetSchema
from leafmill.sources import load

Stage = Callable[[Dataset], Dataset]


@dataclass(frozen=True)
class Context:
    """What stages may look up: the schema, options such as max_pages and budget_usd, engines by name, and how to materialise."""

    schema: TargetSchema = field(default_factory=TargetSchema)
    options: dict[str, Any] = field(default_factory=dict)
    engines: dict[str, Any] = field(default_factory=dict)
    keep: Callable[[DataFrame], DataFrame] = keep_


def text() -> Column:
    return document_text(F.col("markdown"), F.col("pages"))


class Registry:
    """Names to factories (context, **parameters) -> stage."""

    def __init__(self):
        self._known: dict[str, Callable[..., Any]] = {}

    def register(self, name: str, factory: Callable[..., Any]) -> None:
        self._known[name] = factory

    def factory(self, name: str) -> Callable[..., Any]:
        if name not in self._known:
            raise KeyError(f"nothing is registered as {name!r}; there are: {', '.join(self.keys()) or 'no names'}")
        return self._known[name]

    def create(self, name: str, *args: Any, **params: Any) -> Any:
        return self.factory(name)(*args, **params)

    def keys(self) -> list[str]:
        return sorted(self._known)

    def clear(self) -> None:
        self._known.clear()


def _records(data: Dataset) -> DataFrame:
    if data.records is None:
        raise ValueError("this stage needs records; put an extract stage before it")
    return data.records


def _with_document(data: Dataset, *cols: str) -> DataFrame:
    """Records with their document's text (and pages, archetype): a join by document, so only where a stage needs it."""
    docs = data.documents.select(F.col("doc_id").cast("string").alias("doc_id"), text().alias("text"), *cols)
    return _records(data).join(docs, "doc_id")


def _engine(ctx: Context, name: str):
    if name not in ctx.engines:
        raise ValueError(f"the pipeline needs an engine {name!r}; there are {sorted(ctx.engines)}")
    return ctx.engines[name]


def _ask(ctx: Context, client: str, prompts: DataFrame) -> DataFrame:
    """Completions from a replay table or a client; a client's are materialised."""
    engine = _engine(ctx, client)
    return engine if isinstance(engine, DataFrame) else ctx.keep(ext.complete(prompts, engine))


def _parser(name: str, ctx: Context) -> parse.Parser:
    if name in ("passthrough", "parser.passthrough"):
        return parse.passthrough
    return ctx.engines.get(name) or ctx.engines.get("parser." + name.removeprefix("parser.")) or parse.passthrough


def _ingest(ctx, max_pages: int | None = None):
    limit = max_pages or ctx.options.get("max_pages")

    def run(d: Dataset) -> Dataset:
        if "content" not in d.documents.columns:  # documents that come as text have their pages
            n = F.coalesce(F.size("pages"), F.lit(0))
            over = F.lit(False) if limit is None else n > int(limit)
            return d.with_(documents=d.documents.withColumn("error_class", F.coalesce("error_class", F.when(over, "input_too_large"))))
        return d.with_(documents=load.ingest(d.documents, load.Loaders.default(ctx.engines.get("pdf")), limit))

    return run


def _parse(ctx, parser: str = "passthrough"):
    p = _parser(parser, ctx)
    return lambda d: d.with_(documents=p(d.documents))


def _route(ctx, routes: dict[str, str] | None = None):
    chosen = {k: "parser." + v.split(".", 1)[-1] for k, v in (routes or parse.DEFAULT_ROUTES).items()}
    parsers = {n: _parser(n, ctx) for n in chosen.values()}
    return lambda d: d.with_(documents=parse.route(d.documents, parsers, chosen))


def _table(ctx):
    return lambda d: d.with_(records=ext.extract_tables(d.documents, ctx.schema))


def _costs(d: Dataset, asked: DataFrame, stage: str, prices) -> Dataset:
    calls = asked.where("attempts is not null").select("doc_id", F.lit(0).alias("seq"), "model", F.col("prompt_tokens").alias("tokens_in"), F.col("completion_tokens").alias("tokens_out"))
    new = cas.cost_entries(calls, stage, prices)
    return d.with_(costs=new if d.costs is None else d.costs.unionByName(new))


def _model(ctx, client: str = "model", evidence: bool = False, max_input_tokens: int | None = None, prices=None, model: str | None = None, expected_out: int = 0):
    def run(d: Dataset) -> Dataset:
        asked = ext.requests(d.documents, ctx.schema, text(), evidence, max_input_tokens)
        asked = cas.preflight(asked, model or "", expected_out, ctx.options.get("budget_usd"), prices=prices)
        done = _ask(ctx, client, asked.where("error_class is null"))
        records, calls = ext.extract(d.documents, ctx.schema, done, text(), evidence, max_input_tokens)
        out = _costs(d.with_(records=records.where("error_class is null").drop("error_class", "error")), calls, "extract", prices)
        return out.also(errors=records.where("error_class is not null").select("doc_id", "error_class", "error").unionByName(asked.where("error_class is not null").select("doc_id", "error_class", F.lit(None).cast("string").alias("error"))))

    return run


def _chunked(ctx, client: str = "model", max_chars: int = 8000, evidence: bool = False, prices=None):
    def run(d: Dataset) -> Dataset:
        chunks = ext.chunked(d.documents, text(), max_chars).withColumn("prompt", ext.prompt(F.col("chunk"), ctx.schema, evidence)).withColumn("prompt_sha", ext.prompt_key(F.col("prompt")))
        done = _ask(ctx, client, chunks)
        got = chunks.join(done.withColumnRenamed("text", "reply"), "prompt_sha")
        at = F.concat("doc_id", F.lit("\x00"), F.lpad(F.col("chunk_ix").cast("string"), 9, "0"))
        rows = ext.parse_replies(got.select(at.alias("doc_id"), "reply"), evidence).where("error_class is null").drop("error_class", "error")
        ix = (F.split("doc_id", "\x00")[1].cast("long") * 100_000 + F.col("record_ix")).cast("int")
        rows = rows.withColumn("record_ix", ix).withColumn("doc_id", F.split("doc_id", "\x00")[0])
        calls = got.withColumn("seq", F.col("chunk_ix"))
        new = cas.cost_entries(calls.select("doc_id", "seq", "model", F.col("prompt_tokens").alias("tokens_in"), F.col("completion_tokens").alias("tokens_out")), "extract", prices)
        budget = ctx.options.get("budget_usd")
        out = d.with_(records=ext.dedup_records(rows), costs=new if d.costs is None else d.costs.unionByName(new))
        return out if budget is None else out.also(over_budget=cas.over_budget(new, float(budget)))

    return run


def _hybrid(ctx, rules: dict[str, dict] | None = None, client: str | None = None, prices=None):
    rules = rules or {}
    for r in rules.values():
        ext.apply_rule(F.lit(""), r)
    left = [n for n in ctx.schema.names()]

    def run(d: Dataset) -> Dataset:
        if client is None:
            return d.with_(records=ext.hybrid(d.documents, ctx.schema, rules, text()).drop("rule_fields", "model_fields"))
        base = d.documents.withColumn("_found", F.map_keys(ext.rule_values(text(), rules)))
        need = base.where(F.size(F.array_except(F.array(*[F.lit(n) for n in left]), "_found")) > 0).drop("_found")
        asked = ext.requests(need, ctx.schema, text())
        done = _ask(ctx, client, asked)
        replies, calls = ext.extract(need, ctx.schema, done, text())
        got = ext.hybrid(d.documents, ctx.schema, rules, text(), replies.where("error_class is null"))
        return _costs(d.with_(records=got.drop("rule_fields", "model_fields")), calls, "extract", prices)

    return run


def _ensemble(ctx, clients: list[str] | None = None, prices=None):
    if not clients or len(clients) < 2:
        raise ValueError("an ensemble needs at least two clients")

    def run(d: Dataset) -> Dataset:
        rows, out = None, d
        for i, c in enumerate(clients):
            asked = ext.requests(d.documents, ctx.schema, text())
            replies, calls = ext.extract(d.documents, ctx.schema, _ask(ctx, c, asked), text())
            first = replies.where("error_class is null and record_ix = 0").select("doc_id", F.lit(i).alias("client_ix"), "values")
            all_ = d.documents.select(F.col("doc_id").cast("string").alias("doc_id")).join(first, "doc_id", "left").withColumn("client_ix", F.lit(i))
            rows = all_ if rows is None else rows.unionByName(all_)
            out = _costs(out, calls, "extract", prices)
        records, split = ext.ensemble(rows, ctx.schema)
        return out.with_(records=records).also(disagreement=split)

    return run


def _validate(ctx):
    def run(d: Dataset) -> Dataset:
        r = quality.validate(_records(d), ctx.schema)
        return d.with_(records=r).also(validation=quality.validation_summary(r))

    return run


def _normalize(ctx):
    def run(d: Dataset) -> Dataset:
        r = quality.normalize(_records(d))
        return d.with_(records=r).also(deduped=quality.deduped(_records(d), r))

    return run


def _rules(ctx, rules: list[dict] | None = None):
    compiled = quality.compile_rules(rules or [])

    def run(d: Dataset) -> Dataset:
        results = quality.apply_rules(_records(d), compiled)
        return d.also(rule_results=results, rules=quality.rule_summary(results))

    return run


def _confidence(ctx, threshold: float = 0.5, calibration: dict | None = None):
    calib = {float(k): float(v) for k, v in calibration.items()} if calibration else None
    return lambda d: d.with_(records=quality.score_confidence(_with_document(d), ctx.schema, "text", threshold, calib).drop("text"))


def _provenance(ctx):
    return lambda d: d.with_(records=quality.add_provenance(_with_document(d, "pages"), ctx.schema).drop("text", "pages"))


def _label(ctx, labels: dict | None = None):
    own = {k: (v.get("expect", []), v.get("reject", [])) for k, v in labels.items()} if labels else None
    return lambda d: d.with_(records=verify.verify_labels(_with_document(d), "text", own).drop("text"))


def _column(ctx, labels: dict | None = None):
    own = {k: (v.get("expect_col", v.get("expect", [])), v.get("reject_col", v.get("reject", []))) for k, v in labels.items()} if labels else None
    return lambda d: d.with_(records=verify.verify_columns(_with_document(d), "text", own).drop("text"))


def _archetype(ctx, dispatch: bool = False):
    def run(d: Dataset) -> Dataset:
        docs = d.documents
        has = F.lit(False)
        if d.figures is not None:
            some = d.figures.select(F.col("doc_id"), F.lit(True).alias("_fig")).distinct()
            docs = docs.join(some, "doc_id", "left")
            has = F.coalesce("_fig", F.lit(False))
        docs = verify.classify(docs, text(), has).drop("_fig")
        out = d.with_(documents=docs)
        return out.with_(records=verify.verify_by_archetype(_with_document(out, "archetype")).drop("text", "archetype")) if dispatch else out

    return run


def _repair(ctx, client: str = "model", max_rounds: int = 1):
    def run(d: Dataset) -> Dataset:
        r = _with_document(d)
        if "low_confidence" not in r.columns:
            r = r.withColumn("low_confidence", F.array().cast("array<struct<field:string,confidence:double,reason:string>>"))

        def answer(prompts: DataFrame) -> DataFrame:
            got = _ask(ctx, client, prompts)
            rows = ext.parse_replies(prompts.join(got, "prompt_sha").select(F.col("prompt_sha").alias("doc_id"), F.col("text").alias("reply")))
            return rows.where("record_ix = 0 and error_class is null").select(F.col("doc_id").alias("prompt_sha"), "values")

        return d.with_(records=quality.repair(r, ctx.schema, answer, "text", max_rounds, ctx.keep).drop("text"))

    return run


def _review(ctx):
    return lambda d: d.also(review=quality.review_queue(_records(d)))


def _policy(ctx, policies: list[dict] | None = None):
    checked = [quality.check_policy(p) for p in policies or []]

    def run(d: Dataset) -> Dataset:
        m = observe.document_metrics(d.documents, None, d.records, d.extra.get("rule_results"), d.extra.get("router"), d.costs)
        return d.also(policy=quality.apply_policies(m.withColumn("total_usd", F.col("cost_usd")), checked))

    return run


def _figures_extract(ctx):
    def run(d: Dataset) -> Dataset:
        if d.figures is None:
            return d
        named = fig.assign_ids(d.figures)
        return d.with_(figures=named, documents=fig.place_tokens(d.documents, named))

    return run


def _figures_process(ctx, engine: str | None = None):
    work = fig.stub_result if engine is None else (lambda f: ctx.keep(fig.process(f, _engine(ctx, engine))))
    return lambda d: d if d.figures is None else d.with_(figures=work(d.figures))


def _figures_merge(ctx):
    return lambda d: d if d.figures is None else d.with_(documents=fig.merge_figures(d.documents, d.figures))


def default_registry() -> Registry:
    r = Registry()
    for name, f in {
        "ingest.default": _ingest, "parse.default": _parse, "parse.router": _route, "extract.table": _table, "extract.default": _model, "extractor.litellm": _model, "extract.chunked": _chunked,
        "extract.hybrid": _hybrid, "extract.ensemble": _ensemble, "validate.default": _validate, "normalize.default": _normalize, "rules.default": _rules, "confidence.default": _confidence,
        "provenance.default": _provenance, "repair.default": _repair, "review.default": _review, "policy.default": _policy, "verify.label": _label, "verify.column": _column, "archetype.router": _archetype,
        "figures.extract": _figures_extract, "figures.process": _figures_process, "figures.merge": _figures_merge,
    }.items():
        r.register(name, f)
    for p in ("passthrough", "docling", "pdfplumber", "pymupdf4llm"):
        r.register(f"parse.{p}", lambda ctx, p=p: _parse(ctx, p))
        r.register(f"parser.{p}", lambda ctx, p=p: _parse(ctx, p))
    for kind in ("pdf", "image", "xlsx", "office", "text"):
        r.register(f"loader.{kind}", _ingest)
    for engine in ("pdfplumber", "pymupdf"):
        r.register(f"pdf.{engine}", lambda ctx, engine=engine: _engine(ctx, f"pdf.{engine}"))
    return r


class StageFailed(RuntimeError):
    """A stage raised while the plan was built or run; the cause is chained."""


@dataclass(frozen=True)
class Pipeline:
    stages: list[tuple[str, Stage]]
    context: Context

    def run(self, data: Dataset) -> Dataset:
        """Compose all stages. ``extra['trace']`` rows time the composition; engines and actions are timed by Spark's own metrics."""
        trace = []
        for i, (name, stage) in enumerate(self.stages):
            t = time.perf_counter()
            try:
                data = stage(data)
            except Exception as e:
                raise StageFailed(f"Stage {name} failed") from e
            trace.append((i, name, True, (time.perf_counter() - t) * 1000.0, None))
        spark = data.documents.sparkSession
        return data.also(trace=spark.createDataFrame(trace, "seq int, stage string, ok boolean, duration_ms double, error string"))


def item(entry, at: int):
    """(name, parameters) of an entry of the list of stages."""
    where = f"pipeline[{at}]"
    if isinstance(entry, str):
        return entry, {}
    if not isinstance(entry, dict):
        raise ValueError(f"{where}: expected a name or a mapping, not {type(entry).__name__}")
    if len(entry) != 1:
        raise ValueError(f"{where}: a mapping names one stage, this one has {len(entry)} keys: {sorted(map(str, entry))}")
    (name, params), = entry.items()
    if not isinstance(name, str):
        raise ValueError(f"{where}: the name must be text, not {type(name).__name__}")
    if params is not None and not isinstance(params, dict):
        raise ValueError(f"{where}: parameters of {name!r} must be a mapping, not {type(params).__name__}")
    return name, dict(params or {})


def _stage(registry: Registry, name: str, params: dict, ctx: Context, at: int) -> Stage:
    f = registry.factory(name)
    try:
        inspect.signature(f).bind(ctx, **params)
    except TypeError as e:
        raise ValueError(f"pipeline[{at}] {name}: {e}") from e
    return f(ctx, **params)


def _cascade(registry: Registry, params: dict, ctx: Context, at: int) -> Stage:
    for k in ("threshold", "scorer", "fallback", "primary"):
        if k not in params:
            raise ValueError(f"pipeline[{at}] cascade: {k!r} is missing")
    low, high = (_stage(registry, *item(params[k], at), ctx, at) for k in ("primary", "fallback"))
    scorer = cas.resolve_scorer(params["scorer"], ctx.schema)
    return lambda d: cas.cascade(d, low, high, scorer, float(params["threshold"]), text(), ctx.keep)


def build(config: dict, engines: dict[str, Any] | None = None, keep=None, registry: Registry | None = None) -> Pipeline:
    """A pipeline from a mapping with ``pipeline`` and, if wanted, ``schema``, ``options`` and ``engines`` (commands).

    What engines return is written once (``durable.keep``), so no later action asks them again; ``keep`` may do otherwise.
    """
    if not isinstance(config, dict) or not isinstance(config.get("pipeline"), list):
        raise ValueError("a pipeline file is a mapping with a list 'pipeline'")
    ctx = Context(TargetSchema.from_config(config.get("schema")), dict(config.get("options") or {}), engines_of(config.get("engines")) | (engines or {}), keep or keep_)
    registry = registry or default_registry()
    stages = []
    for i, entry in enumerate(config["pipeline"]):
        name, params = item(entry, i)
        stages.append((name, _cascade(registry, params, ctx, i) if name == "cascade" else _stage(registry, name, params, ctx, i)))
    return Pipeline(stages, ctx)


def load_pipeline(path: str, **how) -> Pipeline:
    import yaml

    with open(path, encoding="utf-8") as f:
        return build(yaml.safe_load(f), **how)


def swap_parser(config: dict, parser: str) -> dict:
    """The config with its first parse stage replaced."""
    out, done = [], False
    for i, e in enumerate(config["pipeline"]):
        name, _ = item(e, i)
        if not done and name.startswith("parse."):
            out.append({"parse.default": {"parser": parser}})
            done = True
        else:
            out.append(e)
    return {**config, "pipeline": out}


def set_threshold(config: dict, threshold: float) -> dict:
    """The config with its cascade's threshold replaced; ValueError without a cascade."""
    names = [item(e, i)[0] for i, e in enumerate(config["pipeline"])]
    if "cascade" not in names:
        raise ValueError("the pipeline has no cascade")
    return {**config, "pipeline": [{"cascade": {**e["cascade"], "threshold": float(threshold)}} if n == "cascade" else e for n, e in zip(names, config["pipeline"])]}


def token_count(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", count_tokens(text()).alias("tokens"))
