"""Text to records: tables, prompts and completions, JSON replies, chunks, rules first, ensembles."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.coercion import match_key, values_match
from leafmill.functions.text import bind, count_tokens, lines, strip
from leafmill.model import VALUE, in_order, tagged, with_sides
from leafmill.schema import TargetSchema

# --- tables in plain text


def header_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(strip(x)), "[ _]", "")


def table_records(text: Column, schema: TargetSchema) -> Column:
    """Records of one page of tab-separated lines, the first of which is the header; none when no header names a field."""
    names = schema.names()
    none = F.array().cast(f"array<map<string,{VALUE}>>")
    entry = f"array<struct<key:string,value:{VALUE},ok:boolean>>"

    def of_lines(all_lines):
        # the last column whose header names a field, counted from 0; -1 for none
        header = F.reverse(F.transform(F.split(F.get(all_lines, F.lit(0)), "\t", -1), header_key))
        at = F.array(*[F.when(F.array_contains(header, header_key(F.lit(n))), F.size(header) - F.array_position(header, header_key(F.lit(n)))).otherwise(-1).cast("int") for n in names])
        rows = F.filter(F.slice(all_lines, 2, F.greatest(F.size(all_lines) - 1, F.lit(0))), lambda x: strip(x) != "")

        def of_columns(column):
            def record(row):
                def of_cells(cells):
                    made = [F.struct(F.lit(n).alias("key"), F.struct(F.lit("string").alias("kind"), F.coalesce(F.get(cells, column[i]), F.lit("")).alias("s")).alias("value"), (column[i] >= 0).alias("ok")) for i, n in enumerate(names)]
                    return F.map_from_entries(F.transform(F.filter(F.array(*made).cast(entry), lambda e: e["ok"]), lambda e: F.struct(e["key"], e["value"])))

                return bind(F.split(row, "\t", -1), of_cells)

            return F.when(F.array_max(column) >= 0, F.transform(rows, record)).otherwise(none)

        return F.when(F.size(all_lines) > 0, bind(at, of_columns)).otherwise(none)

    return bind(lines(F.coalesce(text, F.lit(""))), of_lines)


def extract_tables(docs: DataFrame, schema: TargetSchema) -> DataFrame:
    """RECORD rows of all pages, in order. Narrow: each page is read where it lies."""
    if not schema.fields:
        return with_sides(docs.where("false").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("record_ix"), F.create_map().cast(f"map<string,{VALUE}>").alias("values")))
    every = F.flatten(F.transform(in_order(F.col("pages")), lambda p: table_records(p["text"], schema)))
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(every).alias("record_ix", "values"))
    return with_sides(out.select("doc_id", F.col("record_ix").cast("int").alias("record_ix"), "values"))


# --- prompts


def prompt_head(schema: TargetSchema, evidence: bool = False) -> str:
    """What a request says before the document."""
    head = f"List every record the document holds, as a JSON object with one key \"records\".\nUse these keys only: {', '.join(schema.names())}.\n{schema.as_lines()}\n"
    if evidence:
        head += 'Give each record a key "_evidence" too: for each field, the words of the document it was taken from, unchanged.\n'
    return head + "Leave out what the document does not say. Document:\n"


def prompt(text: Column, schema: TargetSchema, evidence: bool = False) -> Column:
    """The request for all records of a text; the text comes last."""
    return F.concat(F.lit(prompt_head(schema, evidence)), text)


def prompt_key(p: Column) -> Column:
    return F.sha2(p, 256)


@dataclass(frozen=True)
class Completion:
    text: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    model: str | None = None
    attempts: int = 1


COMPLETION = "prompt_sha string, model string, text string, prompt_tokens int, completion_tokens int, attempts int"


def with_retry(call: Callable, attempts: int = 3, base: float = 0.5, transient: Callable[[Exception], bool] | None = None, rng: Callable[[], float] = random.random, sleep=time.sleep, on_retry=None):
    """Call again after transient failures, waiting base * 2^k * (1 + jitter)."""
    transient = transient or (lambda e: isinstance(e, (ConnectionError, TimeoutError)))
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not transient(e):
                raise
            if on_retry:
                on_retry(k + 1, e)
            sleep(base * 2**k * (1 + 0.1 * rng()))


def complete(prompts: DataFrame, client: Callable[[str], Completion], attempts: int = 3) -> DataFrame:
    """COMPLETION rows for (prompt_sha, prompt) rows, in Python workers. Materialise the result: a lost task calls again."""

    def run(it: Iterator[pd.DataFrame]):
        for part in it:
            rows = []
            for sha, p in zip(part["prompt_sha"], part["prompt"]):
                tries = [1]
                got = with_retry(lambda p=p: client(p), attempts, on_retry=lambda k, e, tries=tries: tries.__setitem__(0, k + 1))
                rows.append((sha, got.model, got.text, got.prompt_tokens, got.completion_tokens, tries[0]))
            yield pd.DataFrame(rows, columns=["prompt_sha", "model", "text", "prompt_tokens", "completion_tokens", "attempts"])

    return prompts.select("prompt_sha", "prompt").distinct().mapInPandas(run, COMPLETION)


def requests(docs: DataFrame, schema: TargetSchema, text: Column, evidence: bool = False, max_input_tokens: int | None = None) -> DataFrame:
    """(doc_id, prompt, prompt_sha, tokens_in, error_class): requests over the limit carry an error and are not sent."""
    p = prompt(text, schema, evidence)
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), p.alias("prompt")).withColumn("prompt_sha", prompt_key(F.col("prompt"))).withColumn("tokens_in", count_tokens(F.col("prompt")))
    over = F.lit(False) if max_input_tokens is None else F.col("tokens_in") > max_input_tokens
    return out.withColumn("error_class", F.when(over, "input_too_large"))


# --- replies


def _is(json_: Column, mark: str) -> Column:
    return F.startswith(F.ltrim(json_, F.lit(" \t\n\x0b\f\r")), F.lit(mark))


def _parses(c: Column) -> Column:
    return (_is(c, "[") | _is(c, "{")) & F.try_parse_json(c).isNotNull()


def reply_json(reply: Column, strict: bool = False) -> Column:
    """The reply's JSON list or object; null for none. Strict takes the whole reply only."""
    if strict:
        return F.when(_is(reply, "{") & F.try_parse_json(reply).isNotNull(), reply)
    # in order: fenced blocks, outermost brackets, outermost braces, all of it; what comes after the first that parses is not looked at
    fences = F.transform(F.regexp_extract_all(reply, F.lit(r"(?s)```(?:json|JSON)?\s*(.*?)```"), F.lit(1)), strip)
    fenced = F.when(F.contains(reply, F.lit("```")), F.get(F.filter(fences, _parses), F.lit(0)))
    cut = lambda a, b: F.regexp_extract(reply, rf"(?s)({a}.*{b})", 1)
    first = lambda x: bind(x, lambda c: F.when(_parses(c), c))
    return F.coalesce(fenced, first(cut(r"\[", r"\]")), first(cut(r"\{", r"\}")), first(strip(reply)))


def reply_records(reply: Column, strict: bool = False) -> Column:
    """Each record of a reply as JSON text; null when it holds none, or an element that is no object."""
    def of_object(j):
        single = F.lit(None).cast("array<string>") if strict else F.array(j)
        return bind(F.get_json_object(j, "$.records"), lambda inner: F.when(_is(inner, "["), F.from_json(inner, "array<string>")).otherwise(single))

    got = bind(reply_json(reply, strict), lambda j: F.when(_is(j, "["), F.from_json(j, "array<string>")).otherwise(of_object(j)))
    return bind(got, lambda g: F.when(F.forall(g, lambda r: _is(r, "{")), g))


def json_value(raw: Column) -> Column:
    """A raw JSON value, tagged; strings lose their quotes."""
    s = F.regexp_replace(raw, r"\A\s+|\s+\z", "")
    text = F.get_json_object(F.concat(F.lit('{"v":'), s, F.lit("}")), "$.v")
    kind = (
        F.when(s.isNull() | (s == "null"), "null").when(F.startswith(s, F.lit('"')), "string").when(s.isin("true", "false"), "bool")
        .when(_is(s, "[") | _is(s, "{"), "json").when(F.regexp_like(s, F.lit(r"\A-?\d+\z")), "int").otherwise("float")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "null", None).when(kind == "string", text).otherwise(s).alias("s"))


class _Int(str):
    """A JSON integer's literal."""


class _Float(str):
    """A JSON number's literal that is no integer."""


_LITERALS = json.JSONDecoder(parse_int=_Int, parse_float=_Float, parse_constant=_Float)


def _raw_fields(record: str) -> list[tuple[str, str, str | None]]:
    """(key, kind, literal) of a JSON object, with Python's parser: the last of repeated keys counts."""
    kinds = {bool: "bool", _Int: "int", _Float: "float", str: "string"}
    out, plain = [], None
    for k, v in _LITERALS.decode(record).items():
        if v is None:
            out.append((k, "null", None))
        elif type(v) in kinds:
            out.append((k, kinds[type(v)], ("true" if v else "false") if isinstance(v, bool) else str(v)))
        else:
            plain = json.loads(record) if plain is None else plain
            out.append((k, "json", json.dumps(plain[k], ensure_ascii=False, separators=(",", ":"))))
    return out


def parse_replies(replies: DataFrame, evidence: bool = False, strict: bool = False) -> DataFrame:
    """RECORD rows, with error_class ``unparseable`` rows for replies without records, from (doc_id, reply).

    The envelope is found by Catalyst; each object's fields are split by Python's JSON parser, a batch at a time, as
    keys are open and literals must stay as they are.
    """
    found = replies.select(F.col("doc_id").cast("string").alias("doc_id"), reply_records(F.col("reply"), strict).alias("rs"), F.col("reply"))
    rows = found.select("doc_id", F.when(F.coalesce(F.size("rs"), F.lit(0)) <= 0, F.col("reply")).alias("reply"), F.posexplode_outer("rs").alias("record_ix", "record"))
    kind = "doc_id string, record_ix int, fields array<struct<key:string,kind:string,s:string>>, error_class string, error string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            fields, ends, classes, errors = [], [0], [], []
            for reply, r in zip(part.column("reply").to_pylist(), part.column("record").to_pylist()):
                bad = r is None and not (reply is not None and json_is_empty(reply))
                classes.append("unparseable" if bad else None)
                errors.append(f"no records in: {(reply or '')[:500]}" if bad else None)
                fields += [] if r is None else _raw_fields(r)
                ends.append(len(fields))
            text = [pa.array([f[i] for f in fields], pa.string()) for i in range(3)]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(text, ["key", "kind", "s"]))
            sides = [pa.array(x, pa.string()) for x in (classes, errors)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("record_ix"), listed, *sides], ["doc_id", "record_ix", "fields", "error_class", "error"])

    got = rows.mapInArrow(run, kind).where("record_ix is not null or error_class is not null")
    plain = F.filter("fields", lambda f: f["key"] != "_evidence")
    values = F.map_from_entries(F.transform(plain, lambda f: F.struct(f["key"], F.struct(f["kind"].alias("kind"), f["s"].alias("s")).alias("value"))))
    quoted = F.from_json(F.get(F.filter("fields", lambda f: f["key"] == "_evidence"), F.lit(0))["s"], "map<string,string>")
    out = got.withColumn("values", values)
    if evidence:
        kept = F.map_filter(F.coalesce(quoted, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != ""))
        out = out.withColumn("evidence", kept)
    return with_sides(out.drop("fields"))


def json_is_empty(reply: str) -> bool:
    """The reply holds an empty list of records: no record, and no error."""
    try:
        j = json.loads(reply.strip().removeprefix("```json").removeprefix("```").removesuffix("```"))
    except ValueError:
        return False
    return j == [] or (isinstance(j, dict) and j.get("records") == [])


def extract(docs: DataFrame, schema: TargetSchema, completions: DataFrame, text: Column, evidence: bool = False, max_input_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, requests joined with their completions). ``completions``: COMPLETION rows, the replay table or fresh ones."""
    asked = requests(docs, schema, text, evidence, max_input_tokens)
    answered = asked.where("error_class is null").join(completions.withColumnRenamed("text", "reply"), "prompt_sha")
    return parse_replies(answered, evidence), asked.join(completions.select("prompt_sha", "model", "prompt_tokens", "completion_tokens", "attempts"), "prompt_sha", "left")


# --- chunks


def chunk_text(text: Column, max_chars: int) -> Column:
    """Whole lines packed greedily into chunks of at most ``max_chars``; a longer line is a chunk; empty ones are left out."""
    if not max_chars > 0:
        raise ValueError("max_chars must be above 0")
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("now"))
    flush = lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"])))

    def step(a, line):
        joined = F.concat(a["now"], F.lit("\n"), line)
        return (
            F.when(F.length(line) > max_chars, F.struct(F.concat(flush(a), F.array(line)).alias("done"), none.alias("now")))
            .when(a["now"].isNull(), F.struct(a["done"].alias("done"), line.alias("now")))
            .when(F.length(joined) <= max_chars, F.struct(a["done"].alias("done"), joined.alias("now")))
            .otherwise(F.struct(flush(a).alias("done"), line.alias("now")))
        )

    return F.filter(F.aggregate(lines(F.coalesce(text, F.lit(""))), start, step, flush), lambda c: c != "")


def chunked(docs: DataFrame, text: Column, max_chars: int) -> DataFrame:
    """(doc_id, chunk_ix, chunk)."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(chunk_text(text, max_chars)).alias("chunk_ix", "chunk"))


def record_key(values: Column) -> Column:
    """A digest, equal for records with the same fields and equal values, whatever their order."""
    return F.sha2(F.to_json(F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct(e["key"].alias("k"), match_key(e["value"]).alias("v"))))), 256)


def dedup_records(records: DataFrame) -> DataFrame:
    """The first of equal records of each document; record_ix is kept as it is. Shuffles by document and key."""
    w = Window.partitionBy("doc_id", "_key").orderBy("record_ix")
    return records.withColumn("_key", record_key(F.col("values"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


# --- rules first

_CODES = "AUD CAD CHF CNY EUR GBP HKD IDR INR JPY KRW MYR NZD PHP SGD THB TWD USD VND".split()
_SIGNS = [("€", "EUR"), ("RM", "MYR"), ("£", "GBP"), ("¥", "JPY"), ("$", "USD"), ("₹", "INR"), ("₩", "KRW")]
_DATES = [r"\b\d{4}(?:-\d\d){2}\b", *[rf"\b\d{{2}}{s}\d{{2}}{s}\d{{4}}\b" for s in ("/", "-", r"\.")]]


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def match_number(text: Column) -> Column:
    return _first(text, r"\d+(?:[.]\d+)?")


def match_currency(text: Column) -> Column:
    """First ISO code, else the code of the first sign."""
    sign = _first(text, "|".join(rf"\Q{s}\E" for s, _ in _SIGNS))
    return F.coalesce(F.upper(_first(text, rf"(?i)\b(?:{'|'.join(_CODES)})\b")), F.create_map(*[F.lit(x) for kv in _SIGNS for x in kv])[sign])


def match_date(text: Column) -> Column:
    """First date of the first form that occurs, unchanged; forms in order: ISO, with slashes, hyphens, points."""
    return F.coalesce(*[_first(text, p) for p in _DATES])


def match_email(text: Column) -> Column:
    return _first(text, r"\b[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*[.][a-zA-Z]{2,}\b")


MATCHERS = {"number": match_number, "currency": match_currency, "date": match_date, "email": match_email}


def apply_rule(text: Column, rule: dict) -> Column:
    """The value of one rule, {pattern, group} or {matcher}; null where nothing matches."""
    if "pattern" in rule:
        p, g = rule["pattern"], int(rule.get("group", 0))
        return F.when(F.regexp_like(text, F.lit(p)), F.regexp_extract(text, p, g))
    if rule.get("matcher") in MATCHERS:
        return MATCHERS[rule["matcher"]](text)
    raise ValueError(f"a rule needs a pattern or one of the matchers {sorted(MATCHERS)}: {rule}")


def rule_values(text: Column, rules: dict[str, dict]) -> Column:
    """Map of the fields whose rule matched."""
    if not rules:
        return F.create_map().cast(f"map<string,{VALUE}>")
    made = F.array(*[F.struct(F.lit(n).alias("key"), apply_rule(text, r).alias("s")) for n, r in rules.items()])
    hit = F.filter(made, lambda e: e["s"].isNotNull())
    return F.map_from_entries(F.transform(hit, lambda e: F.struct(e["key"], F.struct(F.lit("string").alias("kind"), e["s"].alias("s")).alias("value"))))


def hybrid(docs: DataFrame, schema: TargetSchema, rules: dict[str, dict], text: Column, replies: DataFrame | None = None) -> DataFrame:
    """One record a document: what rules find, and for documents with fields left, the first record of ``replies`` (RECORD rows) over it."""
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), rule_values(text, rules).alias("by_rule"))
    base = base.withColumn("missing", F.array_except(F.array(*[F.lit(n) for n in schema.names()]), F.map_keys("by_rule")))
    out = base.withColumn("by_model", F.create_map().cast(f"map<string,{VALUE}>"))
    if replies is not None:
        first = replies.where("record_ix = 0").select("doc_id", F.col("values").alias("_m"))
        none = F.create_map().cast(f"map<string,{VALUE}>")
        use = F.when(F.size("missing") > 0, F.map_filter(F.coalesce("_m", none), lambda k, v: F.array_contains("missing", k))).otherwise(none)
        out = base.join(first, "doc_id", "left").withColumn("by_model", use).drop("_m")
    merged = F.map_concat(F.map_filter("by_rule", lambda k, v: ~F.map_contains_key("by_model", k)), "by_model")
    return with_sides(out.select("doc_id", F.lit(0).alias("record_ix"), merged.alias("values"), F.map_keys("by_rule").alias("rule_fields"), F.map_keys("by_model").alias("model_fields")))


# --- ensembles


def consensus(values: Column, type_: str = "string") -> Column:
    """struct(value, agreement, size) of an array of values in client order.

    Values are grouped with the first member of a group they match; nulls match each other. The largest group
    wins, the earliest of equals.
    """
    group = "struct<first:string,n:int>"
    same = lambda a, b: (a.isNull() & b.isNull()) | F.coalesce(values_match(a, b, type_), F.lit(False))

    def step(acc, v):
        at = F.array_position(F.transform(acc, lambda g: same(g["first"], v)), True)
        grown = F.transform(acc, lambda g, i: F.struct(g["first"].alias("first"), (g["n"] + F.when(i + 1 == at, 1).otherwise(0)).cast("int").alias("n")))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(F.struct(v.alias("first"), F.lit(1).alias("n")).cast(group))))

    groups = F.aggregate(values, F.array().cast(f"array<{group}>"), step)
    top = F.array_max(F.transform(groups, lambda g: g["n"]))
    best = F.get(F.filter(groups, lambda g: g["n"] == top), F.lit(0))
    return F.struct(best["first"].alias("value"), F.coalesce(top / F.size(values), F.lit(0.0)).alias("agreement"), F.size(groups).alias("groups"))


def ensemble(predictions: DataFrame, schema: TargetSchema) -> tuple[DataFrame, DataFrame]:
    """(records, disagreements) from (doc_id, client_ix, values): first record of each client, field by field.

    Shuffles once, by document. Confidence is the agreement; fields below full agreement are disagreements.
    """
    rows = predictions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("client_ix", "values")), lambda a, b: a["client_ix"] - b["client_ix"]).alias("c"))
    def said(name):
        return F.transform("c", lambda x: x["values"][name]["s"])

    fields = [F.struct(F.lit(s.name).alias("field"), consensus(said(s.name), s.type).alias("r")) for s in schema.fields]
    made = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("record_ix"), F.array(*fields).alias("f"))
    present = F.filter("f", lambda x: x["r"]["value"].isNotNull())
    values = F.map_from_entries(F.transform(present, lambda x: F.struct(x["field"], F.struct(F.lit("string").alias("kind"), x["r"]["value"].alias("s")).alias("value"))))
    scores = F.map_from_entries(F.transform("f", lambda x: F.struct(x["field"], x["r"]["agreement"])))
    records = with_sides(made.select("doc_id", "record_ix", values.alias("values"), scores.alias("confidence")))
    split = made.select("doc_id", F.explode("f").alias("x")).where("x.r.agreement < 1").select("doc_id", "x.field", F.col("x.r.agreement").alias("agreement"))
    return records, split


def tagged_text(s: Column) -> Column:
    return tagged("string", s)
