"""Validation, normalisation, business rules, confidence, provenance, review, policies and repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.coercion import as_double, coerced, is_absent, is_missing
from leafmill.functions.numbers import value_in_text
from leafmill.functions.text import bind, contains_word, evidence_snippet, normalize_span, normalize_value, snippet, strip
from leafmill.durable import materialise
from leafmill.model import PROVENANCE, VALUE, in_order, settled
from leafmill.operators.extract import dedup_records, prompt_key
from leafmill.schema import FieldSpec, TargetSchema

# --- validation and normalisation


def _has(values: Column, name: str) -> Column:
    return F.map_contains_key(values, name)


def _put(m: Column, changes: Column) -> Column:
    """Map ``m`` with the entries of ``changes`` over it."""
    return F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(changes, k)), changes)


def _entries(items: list[Column], kind: str) -> Column:
    """Map of the structs (key, value, ok) that are ok."""
    if not items:
        return F.create_map().cast(kind)
    return F.map_from_entries(F.transform(F.filter(F.array(*items), lambda e: F.coalesce(e["ok"], F.lit(False))), lambda e: F.struct(e["key"], e["value"])))


def validate(records: DataFrame, schema: TargetSchema) -> DataFrame:
    """Coerce declared fields that are present; ``errors`` says which are missing or do not fit (those keep their value). Narrow."""
    v = F.col("values")
    changes, errors = [], []
    for s in schema.fields:
        x, c = v[s.name], coerced(v[s.name], s)
        missing = ~_has(v, s.name) | is_missing(x)
        changes.append(F.struct(F.lit(s.name).alias("key"), c.alias("value"), (~missing & c.isNotNull()).alias("ok")))
        bad = F.concat(F.lit(f"{s.name}: not {'an' if s.type == 'integer' else 'a'} {s.type}: "), F.coalesce(x["s"], F.lit("")))
        none = F.lit(f"{s.name}: required but missing") if s.required else F.lit(None).cast("string")
        errors.append(F.when(missing, none).when(c.isNull(), bad))
    errs = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    return records.withColumn("errors", errs).withColumn("values", _put(v, _entries(changes, f"map<string,{VALUE}>")) if changes else v)


def validation_summary(records: DataFrame) -> DataFrame:
    """(doc_id, valid, invalid, errors): records counted, messages in record order."""
    g = records.groupBy("doc_id").agg(F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid"), F.array_sort(F.collect_list(F.struct("record_ix", "errors"))).alias("e"))
    return g.select("doc_id", "valid", "invalid", F.flatten(F.transform("e", lambda x: x["errors"])).alias("errors"))


def normalize_values(records: DataFrame) -> DataFrame:
    """Strings stripped and collapsed, empty ones null; others untouched. Narrow."""
    def tidy(k, v):
        t = normalize_value(v["s"])
        return F.when(v["kind"] == "string", F.struct(F.when(t.isNull(), "null").otherwise("string").alias("kind"), t.alias("s"))).otherwise(v)

    return records.withColumn("values", F.transform_values("values", tidy))


def normalize(records: DataFrame) -> DataFrame:
    """``normalize_values``, then the first of equal records of each document."""
    return dedup_records(normalize_values(records))


def deduped(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, deduped): how many records normalisation dropped."""
    n = after.groupBy("doc_id").agg(F.count("*").alias("n"))
    return before.groupBy("doc_id").agg(F.count("*").alias("m")).join(n, "doc_id", "left").select("doc_id", (F.col("m") - F.coalesce("n", F.lit(0))).alias("deduped"))


# --- business rules

#: A rule makes, from the values, a message (null when it holds) and whether it cannot be evaluated.
Rule = Callable[[Column], tuple[Column, Column]]
_RULES: dict[str, Callable[..., Rule]] = {}


def register_rule(name: str, factory: Callable[..., Rule]) -> None:
    _RULES[name] = factory


def get_rule(name: str) -> Callable[..., Rule]:
    if name not in _RULES:
        raise KeyError(f"no rule {name!r}; there are {sorted(_RULES)}")
    return _RULES[name]


def rule_number(values: Column, name: str) -> Column:
    return F.when(~is_absent(values, name), as_double(values[name]))


def sum_equals(fields, target, tolerance=0.01) -> Rule:
    """The fields add up to the target, but for the tolerance."""
    def check(v):
        parts = [rule_number(v, f) for f in fields]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        want = rule_number(v, target)
        off = F.abs(total - want) > tolerance
        text = F.concat(F.lit(f"{' + '.join(fields)} = "), total.cast("string"), F.lit(f", but {target} = "), want.cast("string"))
        return F.when(off, text), off.isNull()

    return check


def in_set(field: str, allowed: list) -> Rule:
    ok = [str(a).strip().lower() for a in allowed]

    def check(v):
        x = v[field]
        null = F.coalesce(x["kind"], F.lit("null")) == "null"
        bad = ~F.lower(strip(x["s"])).isin(ok)
        return F.when(~null & bad, F.concat(F.lit(f"{field} is none of the allowed values: "), x["s"])), null

    return check


def range_(field, min=None, max=None) -> Rule:  # noqa: A002
    """Within the bounds given, which belong to it."""
    def check(v):
        n = rule_number(v, field)
        low = F.lit(False) if min is None else n < min
        high = F.lit(False) if max is None else n > max
        s = n.cast("string")
        return F.when(low, F.concat(F.lit(f"{field} below {min}: "), s)).when(high, F.concat(F.lit(f"{field} above {max}: "), s)), n.isNull()

    return check


def non_negative(field: str) -> Rule:
    def check(v):
        n = rule_number(v, field)
        return F.when(n < 0, F.concat(F.lit(f"{field} is negative: "), n.cast("string"))), n.isNull()

    return check


for _n, _f in (("sum_equals", sum_equals), ("in_set", in_set), ("range", range_), ("non_negative", non_negative)):
    register_rule(_n, _f)


def compile_rules(specs: list[dict]) -> list[tuple[str, Rule]]:
    """Rules from mappings with a key ``rule`` (or ``type``) and the factory's arguments; checked on the driver."""
    out = []
    for spec in specs:
        args = dict(spec)
        name = args.pop("rule", None) or args.pop("type", None)
        if not name:
            raise ValueError(f"a rule needs a name: {spec}")
        try:
            out.append((name, get_rule(name)(**args)))
        except TypeError as e:
            raise ValueError(f"rule {name!r}: {e}") from e
    return out


def apply_rules(records: DataFrame, rules: list[tuple[str, Rule]]) -> DataFrame:
    """(doc_id, record_ix, rule, status: ok | violation | cannot_evaluate, message): a row for each rule and record. Narrow."""
    made = []
    for name, rule in rules:
        message, unknown = rule(F.col("values"))
        status = F.when(unknown, "cannot_evaluate").when(message.isNotNull(), "violation").otherwise("ok")
        made.append(F.struct(F.lit(name).alias("rule"), status.alias("status"), F.when(unknown, F.lit(f"cannot evaluate {name}")).otherwise(message).alias("message")))
    if not made:
        return records.where("false").select("doc_id", "record_ix", F.lit("").alias("rule"), F.lit("").alias("status"), F.lit("").alias("message"))
    return records.select("doc_id", "record_ix", F.explode(F.array(*made)).alias("r")).select("doc_id", "record_ix", "r.*")


def rule_summary(results: DataFrame) -> DataFrame:
    """(doc_id, checked, violations, cannot_evaluate)."""
    return results.groupBy("doc_id").agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "violation").alias("violations"), F.count_if(F.col("status") == "cannot_evaluate").alias("cannot_evaluate"))


# --- confidence

MISSING, MISFIT, UNGROUNDED, GROUNDED, MISMATCH_CAP = 0.0, 0.3, 0.4, 0.9, 0.2


def mismatched(name: str) -> Column:
    return F.coalesce(F.col("label_status")[name] == "label_mismatch", F.lit(False)) | F.coalesce(F.col("column_status")[name] == "column_mismatch", F.lit(False))


def raw_confidence(v: Column, spec: FieldSpec, text: Column) -> Column:
    """struct(score, reason) of one value against the document's text."""
    rank = bind(v[spec.name], lambda x: F.when(is_missing(x), 0).when(coerced(x, spec).isNull(), 1).when(~value_in_text(x["s"], text), 2).otherwise(3))
    levels = F.array(*[F.lit(s) for s in (MISSING, MISFIT, UNGROUNDED, GROUNDED)])
    reasons = F.array(F.lit("missing"), F.lit("type_mismatch"), F.lit("ungrounded"), F.lit(None).cast("string"))
    return bind(rank, lambda r: F.struct(F.get(levels, r).alias("score"), F.get(reasons, r).alias("reason")))


def score_confidence(records: DataFrame, schema: TargetSchema, text: str = "text", threshold=0.5, calibration=None) -> DataFrame:
    """Set ``confidence`` and ``low_confidence`` (array of field, confidence, reason). ``records`` carries the document's text. Narrow.

    Scores that are already there stay: they are neither calibrated nor capped, and have no reason.
    """
    calib = F.create_map(*[F.lit(float(x)) for kv in (calibration or {}).items() for x in (round(kv[0], 3), kv[1])]) if calibration else None
    made = []
    out = settled(records, **{f"_raw{i}": raw_confidence(F.col("values"), s, F.col(text)) for i, s in enumerate(schema.fields)}) if schema.fields else records
    for i, s in enumerate(schema.fields):
        raw = F.col(f"_raw{i}")
        score = raw["score"]
        if calib is not None:
            score = F.coalesce(calib[F.round(score, 3)], score)
        capped = mismatched(s.name) & (score > MISMATCH_CAP)
        fresh = F.struct(F.lit(s.name).alias("field"), F.when(capped, MISMATCH_CAP).otherwise(score).alias("confidence"), F.when(capped, "verification_mismatch").otherwise(raw["reason"]).alias("reason"))
        preset = F.col("confidence")[s.name]
        kept = F.struct(F.lit(s.name).alias("field"), preset.alias("confidence"), F.lit(None).cast("string").alias("reason"))
        made.append(F.when(preset.isNotNull(), kept).otherwise(fresh))
    if not made:
        return out.withColumn("low_confidence", F.array().cast("array<struct<field:string,confidence:double,reason:string>>"))
    out = settled(out, _scores=F.array(*made))
    scores = F.map_from_entries(F.transform("_scores", lambda x: F.struct(x["field"], x["confidence"])))
    out = out.withColumn("confidence", _put(F.col("confidence"), scores)).withColumn("low_confidence", F.filter("_scores", lambda x: x["confidence"] < threshold))
    return out.drop("_scores", *[f"_raw{i}" for i in range(len(made))])


# --- provenance


def _spot(pages: Column, hit: Callable[[Column], Column], page_snippet: Callable[[Column], Column], evidence: Column, method: str) -> Column:
    """First place in page order, blocks before the page's own text."""
    def of_page(p):
        blocks = F.transform(F.filter(F.coalesce(p["blocks"], F.array()), lambda b: hit(b["text"])), lambda b: F.struct(p["index"].alias("page"), b["bbox"].alias("bbox"), b["text"].alias("source_text"), evidence.alias("evidence"), F.lit(method).alias("method")).cast(PROVENANCE))
        own = F.struct(p["index"].alias("page"), F.lit(None).alias("bbox"), page_snippet(p["text"]).alias("source_text"), evidence.alias("evidence"), F.lit(method).alias("method")).cast(PROVENANCE)
        return F.when(F.size(blocks) > 0, F.slice(blocks, 1, 1)).when(hit(p["text"]), F.array(own)).otherwise(F.array().cast(f"array<{PROVENANCE}>"))

    return F.get(F.flatten(F.transform(in_order(pages), of_page)), F.lit(0))


def locate_evidence(evidence: Column, pages: Column) -> Column:
    """Where a quoted span stands with word boundaries; null if nowhere (a quote that was made up)."""
    needle = normalize_span(F.coalesce(evidence, F.lit("")))
    hit = lambda t: F.coalesce(contains_word(normalize_span(F.coalesce(t, F.lit(""))), needle), F.lit(False))
    return F.when(needle != "", _spot(pages, hit, lambda t: evidence_snippet(t, evidence), evidence, "evidence"))


def locate_value(value: Column, pages: Column) -> Column:
    """First block or page whose text holds the value."""
    return _spot(pages, lambda t: value_in_text(value, F.coalesce(t, F.lit(""))), snippet, F.lit(None).cast("string"), "value_search")


def add_provenance(records: DataFrame, schema: TargetSchema, pages: str = "pages") -> DataFrame:
    """Set ``provenance`` for declared fields with a value: by evidence, else by value; nothing is made up. Narrow; ``records`` carries the pages."""
    made = []
    for s in schema.fields:
        x = F.col("values")[s.name]
        where = F.coalesce(locate_evidence(F.col("evidence")[s.name], F.col(pages)), locate_value(x["s"], F.col(pages)))
        made.append(F.struct(F.lit(s.name).alias("key"), F.when(~is_missing(x), where).alias("value")))
    if not made:
        return records
    found = F.filter(F.array(*made), lambda e: e["value"].isNotNull())
    return records.withColumn("provenance", _put(F.col("provenance"), F.map_from_entries(F.transform(found, lambda e: F.struct(e["key"], e["value"])))))


# --- review


def review_queue(records: DataFrame) -> DataFrame:
    """(doc_id, record_ix, field, value, reasons, confidence, evidence, source_text, page), a row a field that needs a look. Narrow.

    Reasons of a field are merged and sorted. ``records`` has been scored and, if wanted, verified.
    """
    low = F.transform("low_confidence", lambda x: F.struct(x["field"].alias("field"), F.coalesce(x["reason"], F.lit("low_confidence")).alias("reason")))
    bad = lambda m, s: F.transform(F.map_keys(F.map_filter(m, lambda k, v: v == s)), lambda k: F.struct(k.alias("field"), F.lit(s).alias("reason")))
    flags = F.concat(low, bad("label_status", "label_mismatch"), bad("column_status", "column_mismatch"))
    rows = records.withColumn("_flags", F.array_sort(F.array_distinct(flags))).withColumn("field", F.explode(F.array_distinct(F.transform("_flags", lambda x: x["field"]))))
    reasons = F.transform(F.filter("_flags", lambda x: x["field"] == F.col("field")), lambda x: x["reason"])
    at = lambda c: F.col(c)[F.col("field")]
    return rows.select(
        "doc_id", "record_ix", "field", at("values")["s"].alias("value"), reasons.alias("reasons"), at("confidence").alias("confidence"), F.coalesce(at("evidence"), F.lit("")).alias("evidence"),
        F.coalesce(at("provenance")["source_text"], F.lit("")).alias("source_text"), at("provenance")["page"].alias("page"),
    )


# --- policies

CONDITIONS = ("has_rule_violations", "max_review_fields", "max_total_usd", "min_confidence")
ACTIONS = ("halt", "tag", "flag_review")


def check_policy(p: dict) -> dict:
    """The policy, or ValueError for what it lacks or does not know."""
    if not isinstance(p, dict) or not isinstance(p.get("when"), dict):
        raise ValueError("a policy is a mapping with a mapping 'when'")
    for k in p["when"]:
        if k not in CONDITIONS:
            raise ValueError(f"unknown condition {k!r}; there are {CONDITIONS}")
    if p.get("action") not in ACTIONS:
        raise ValueError(f"unknown action {p.get('action')!r}; there are {ACTIONS}")
    if p["action"] == "tag" and not p.get("tag"):
        raise ValueError("the action 'tag' needs a tag")
    return p


def _condition(k: str, x) -> Column:
    zero = F.lit(0)
    return {
        "min_confidence": lambda: F.coalesce(F.col("lowest_confidence") < float(x), F.lit(False)),
        "max_total_usd": lambda: F.coalesce(F.col("total_usd") > float(x), F.lit(False)),
        "max_review_fields": lambda: F.coalesce("low_confidence", zero) > int(x),
        "has_rule_violations": lambda: (F.coalesce("rule_violations", zero) > 0) == F.lit(bool(x)),
    }[k]()


def apply_policies(metrics: DataFrame, policies: list[dict]) -> DataFrame:
    """Add ``policy`` (triggered, review, tags, halted) to per-document rows (lowest_confidence, total_usd, low_confidence, rule_violations). Narrow.

    Policies fire in order, all their conditions met; an empty ``when`` always does. Nothing fires after a halt.
    """
    made = []
    for i, p in enumerate(map(check_policy, policies)):
        hit = F.lit(True)
        for k, x in p["when"].items():
            hit = hit & _condition(k, x)
        made.append(F.struct(F.lit(i).alias("policy"), F.lit(p["action"]).alias("action"), F.lit(p.get("tag")).cast("string").alias("tag"), hit.alias("hit")))
    kind = "array<struct<policy:int,action:string,tag:string,hit:boolean>>"
    fired = F.filter(F.array(*made) if made else F.array().cast(kind), lambda x: x["hit"])
    stop = F.array_position(F.transform(fired, lambda x: x["action"]), "halt")
    fired = F.when(stop > 0, F.slice(fired, F.lit(1), F.greatest(stop, F.lit(1)).cast("int"))).otherwise(fired)
    out = metrics.withColumn("_fired", fired)
    is_ = lambda a: F.exists("_fired", lambda x: x["action"] == a)
    tags = F.transform(F.filter("_fired", lambda x: x["action"] == "tag"), lambda x: x["tag"])
    art = F.struct(F.transform("_fired", lambda x: x["policy"]).alias("triggered"), is_("flag_review").alias("review"), tags.alias("tags"), is_("halt").alias("halted"))
    return out.withColumn("policy", art).drop("_fired")


# --- repair


def failed_fields(schema: TargetSchema, repaired: Column | None = None) -> Column:
    """Declared fields to repair, each once: missing ones (always), then low confidence, then mismatches, less those repaired already."""
    names = F.array(*[F.lit(n) for n in schema.names()]).cast("array<string>")

    def failed(r):
        gone = F.filter(names, lambda n: bind(r["values"][n], is_missing))
        low = F.filter(F.transform(r["low_confidence"], lambda x: x["field"]), lambda f: F.array_contains(names, f))
        off = F.filter(names, lambda n: F.coalesce(r["label_status"][n] == "label_mismatch", F.lit(False)) | F.coalesce(r["column_status"][n] == "column_mismatch", F.lit(False)))
        stale = F.concat(low, off)
        if repaired is not None:
            stale = F.array_except(stale, repaired)
        return F.array_distinct(F.concat(gone, stale))

    return bind(F.struct("values", "low_confidence", "label_status", "column_status"), failed)


def repair_prompt(text: Column, failed: Column, schema: TargetSchema) -> Column:
    """The request for some fields of a record again: the record, what is wanted, a hint where verification failed, the document."""
    spec = F.create_map(*[F.lit(x) for s in schema.fields for x in (s.name, f"{s.type}{', required' if s.required else ''}{': ' + s.description if s.description else ''}")])
    off = lambda n: (F.col("label_status")[n] == "label_mismatch") | (F.col("column_status")[n] == "column_mismatch")
    hint = lambda n: F.when(F.coalesce(off(n), F.lit(False)), " [the value was taken from the wrong place; look for the one under the right label]").otherwise("")
    wanted = F.array_join(F.transform(failed, lambda n: F.concat(F.lit("* "), n, F.lit(" ("), spec[n], F.lit(")"), hint(n))), "\n")
    now = F.to_json(F.transform_values("values", lambda k, x: x["s"]))
    return F.concat(F.lit("Correct these fields of a record; answer with a JSON object of them alone.\n"), wanted, F.lit("\nThe record so far: "), now, F.lit("\nDocument:\n"), text)


def repair(records: DataFrame, schema: TargetSchema, answer: Callable[[DataFrame], DataFrame], text: str = "text", max_rounds: int = 1, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Up to ``max_rounds`` rounds of asking for failed fields; ``repair_log`` lists (round, fields). A bounded driver loop.

    ``answer``: (prompt_sha, prompt) rows to (prompt_sha, values) rows, a first record each. ``keep``: materialises a round, so that an
    engine is asked once; give it whenever ``answer`` calls one. What a round asks is written once, as requests and answers both need it;
    records without failed fields are through, and take no part in the join or in later rounds.
    """
    none = F.array().cast("array<string>")
    out = records.withColumn("repaired", none).withColumn("repair_log", F.array().cast("array<struct<round:int,fields:array<string>>>"))
    through = []
    for n in range(1, max_rounds + 1):
        out = materialise(out.withColumn("_failed", failed_fields(schema, F.col("repaired"))), "repair")
        through.append(out.where("size(_failed) = 0").drop("_failed"))
        asked = settled(out.where("size(_failed) > 0"), _prompt=repair_prompt(F.col(text), F.col("_failed"), schema)).withColumn("prompt_sha", prompt_key(F.col("_prompt")))
        got = answer(asked.select("prompt_sha", F.col("_prompt").alias("prompt")).distinct()).select("prompt_sha", F.col("values").alias("_new"))
        out = asked.drop("_prompt").join(got, "prompt_sha", "left")
        new = F.map_filter(F.coalesce("_new", F.create_map().cast(f"map<string,{VALUE}>")), lambda k, v: F.array_contains("_failed", k))
        out = settled(out, _use=new).withColumn("values", _put(F.col("values"), F.col("_use")))
        fields = F.array_intersect("_failed", F.map_keys("_use"))
        log = F.concat("repair_log", F.array(F.struct(F.lit(n).alias("round"), fields.alias("fields"))))
        out = out.withColumn("repair_log", log).withColumn("repaired", F.array_union("repaired", fields)).drop("_failed", "prompt_sha", "_new", "_use")
        if keep:
            out = keep(out)
    for part in through:
        out = out.unionByName(part)
    return out.drop("repaired")
