"""Operators on literal cases."""

import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from leafmill.model import DOCUMENT, PAGE, Dataset, as_records, tagged, with_sides
from leafmill.operators import cascade, evaluate, extract, figures, quality, verify
from leafmill.plans.build import Registry, build, default_registry, item, set_threshold, swap_parser
from leafmill.schema import TargetSchema
from leafmill.sources import load, sinks


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", "a.txt", None, [load.page(0, t)], None, None, None) for i, t in enumerate(texts)], DOCUMENT)


def values(row):
    return {k: v["s"] for k, v in row["values"].items()}


def rec(spark, *maps):
    kind = {str: "string", int: "int", float: "float", bool: "bool", type(None): "null"}
    rows = [("d", i, {k: (kind[type(v)], None if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for k, v in m.items()}) for i, m in enumerate(maps)]
    return with_sides(spark.createDataFrame(rows, "doc_id string, record_ix int, values map<string,struct<kind:string,s:string>>"))


def test_table_extract(spark):
    schema = TargetSchema.of("name", "sku", "price")
    d = docs(spark, "Name\tS KU\tPrice\tExtra\nA\tX-1\t9.99\tx\n \t\nB\tX-2", "foo\tbar\n1\t2", "", "name\tname\n1\t2")
    got = [(r["doc_id"], r["record_ix"], values(r)) for r in extract.extract_tables(d, schema).orderBy("doc_id", "record_ix").collect()]
    assert got == [("d0", 0, {"name": "A", "price": "9.99", "sku": "X-1"}), ("d0", 1, {"name": "B", "price": "", "sku": "X-2"}), ("d3", 0, {"name": "2"})]


def test_chunks(spark):
    t = "aaa\nbbb\nccc\nddd\neee"
    one = lambda s, n: spark.createDataFrame([(s,)], "t string").select(extract.chunk_text(F.col("t"), n)).first()[0]
    assert one(t, 7) == ["aaa\nbbb", "ccc\nddd", "eee"]
    assert one("short\n" + "x" * 20 + "\nend", 10) == ["short", "x" * 20, "end"]
    assert one("", 5) == [] and one("\n\na", 5) == ["\n\na"]
    with pytest.raises(ValueError):
        extract.chunk_text(F.lit("x"), 0)


ONE_TWO = [{"a": str(n)} for n in (1, 2)]
PAIR = ", ".join('{"a": %d}' % n for n in (1, 2))
ENV = '{"records": [' + PAIR + "]}"
REPLIES = [
    (ENV, ONE_TWO), (f'```json\n{ENV}\n```', ONE_TWO), (f'Sure: {ENV} done', ONE_TWO),
    (f'[{PAIR}]', ONE_TWO), ('{"a": 1.0, "b": null, "c": {"x": 1}}', [{"a": "1.0", "b": None, "c": '{"x":1}'}]), ('{"a": [1]}', None), ("no json", None), ("[1, 2]", None), ('{"records": []}', []),
]


def test_replies(spark):
    r = extract.parse_replies(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPLIES)], "doc_id int, reply string")).collect()
    for i, (_, want) in enumerate(REPLIES):
        mine = sorted((x for x in r if x["doc_id"] == str(i)), key=lambda x: x["record_ix"] or 0)
        if want is None:
            assert [x["error_class"] for x in mine] == ["unparseable"], i
        else:
            assert [values(x) for x in mine] == want, i


def test_evidence_is_split_off(spark):
    reply = '{"records": [{"a": "x", "_evidence": {"a": "x y", "b": ""}}]}'
    r = extract.parse_replies(spark.createDataFrame([("d", reply)], "doc_id string, reply string"), evidence=True).first()
    assert values(r) == {"a": "x"} and r["evidence"] == {"a": "x y"}


def test_matchers(spark):
    cases = [("number", "due 42.5 today", "42.5"), ("currency", "EUR only", "EUR"), ("currency", "for $19.99", "USD"), ("currency", "paid eur $", "EUR"), ("date", "on 31/12/2020 or 2020-01-02", "2020-01-02"),
             ("date", "31-12-2020", "31-12-2020"), ("date", "31.12.2020", "31.12.2020"), ("email", "mail a.b@c.example.org now", "a.b@c.example.org"), ("number", "none", None)]
    for name, t, want in cases:
        assert spark.createDataFrame([(t,)], "t string").select(extract.apply_rule(F.col("t"), {"matcher": name})).first()[0] == want
    assert spark.createDataFrame([("no: 7",)], "t string").select(extract.apply_rule(F.col("t"), {"pattern": r"no: (\d)", "group": 1})).first()[0] == "7"
    with pytest.raises(ValueError):
        extract.apply_rule(F.lit(""), {"matcher": "nothing"})


def test_consensus(spark):
    cases = [(["BOOK TAK"] * 2 + ["OTHER CO"], "string", ("BOOK TAK", 2 / 3)), (["BOOK TAK", "BOOK TA K", "BOOK TAK"], "string", ("BOOK TAK", 1.0)), (["105.0", "105", "$105.00"], "number", ("105.0", 1.0)), ([None, None, "x"], "string", (None, 2 / 3)), (["a", "b"], "string", ("a", 0.5))]
    for vs, t, want in cases:
        r = spark.createDataFrame([(vs,)], "v array<string>").select(extract.consensus(F.col("v"), t).alias("c")).first()["c"]
        assert (r["value"], r["agreement"]) == want


def test_validate_and_normalize(spark):
    schema = TargetSchema.of("name*", "price:number", "qty:integer", "active:boolean")
    r = quality.validate(rec(spark, {"name": "A", "price": "9.5", "active": "yes", "qty": "3", "extra": "e"}, {"price": "abc", "qty": 2.5}, {"name": ""}), schema).orderBy("record_ix").collect()
    assert values(r[0]) == {"name": "A", "price": "9.5", "qty": "3", "active": "true", "extra": "e"} and r[0]["errors"] == []
    assert len(r[1]["errors"]) == 3 and values(r[1])["price"] == "abc" and len(r[2]["errors"]) == 1
    n = quality.normalize(rec(spark, {"a": " x  y ", "n": 1}, {"n": 1.0, "a": "x y"}, {"a": "", "n": True}, {"a": None, "n": 1})).orderBy("record_ix").collect()
    assert [x["record_ix"] for x in n] == [0, 2] and values(n[0])["a"] == "x y" and values(n[1])["a"] is None


def test_rules(spark):
    rules = quality.compile_rules([dict(rule="sum_equals", target="total", fields=["subtotal", "tax"]), dict(rule="range", min=1, field="qty"), dict(rule="non_negative", field="price"), dict(rule="in_set", allowed=["EUR"], field="currency")])
    r = rec(spark, {"tax": 10, "subtotal": 100, "total": 110, "qty": 1, "price": 0, "currency": " eur "}, {"tax": 10, "subtotal": 110, "total": 110, "qty": 0, "price": -1, "currency": ""}, {"tax": "abc", "subtotal": 100, "qty": "n/a", "total": 110, "currency": None})
    got = [[x["status"] for x in quality.apply_rules(r, rules).where(f"record_ix = {i}").collect()] for i in range(3)]
    assert got == [["ok"] * 4, ["violation"] * 4, ["cannot_evaluate"] * 4]
    with pytest.raises(KeyError):
        quality.get_rule("nothing")


LABEL = [
    ("x Grand Total 100.00 y", "Grand Total 100.00", "verified"), ("Total net worth 7.50", "7.50", "label_mismatch"), ("Subtotal 5.00", "Subtotal 5.00", "label_mismatch"), ("Total net worth 7.50\nand\nTotal gross worth 8.25", "8.25", "verified"),
    ("Grand Total 100.00", "", "no_evidence"), ("Grand Total 100.00", "Grand Total 999.99", "unlocated"), ("12.34 items listed", "12.34", "no_label"),
]


def test_labels(spark):
    for t, e, want in LABEL:
        df = spark.createDataFrame([(t, e)], "t string, e string")
        assert df.select(verify.verify_label(F.col("e"), F.col("t"), *verify.LABELS["total"])).first()[0] == want, (t, e)


HEADS = "No.;Description;Qty;Net price;Net worth;VAT [%];Gross worth".split(";")
ROW = "1.;Corkscrew;1,00;7,50;7,50;10%;8,25".split(";")
TABLE = "\n".join(f"| {' | '.join(r)} |" for r in (HEADS, ["---"] * 7, ROW))


@pytest.mark.parametrize("field,value,text,want", [
    ("total", "8.25", TABLE, "column_verified"), ("total", "7.50", TABLE, "column_mismatch"), ("subtotal", "7.50", TABLE, "column_verified"), ("subtotal", "8.25", TABLE, "column_mismatch"), ("tax", "8.25", TABLE, "column_mismatch"),
    ("tax", "0.75", "| Total VAT |\n| 0,75 |", "column_verified"), ("total", "999.99", TABLE, "value_not_in_table"), ("total", "1", "no pipes", "no_table"), ("total", "42.00", "| Reference |\n| 42 |", "column_no_label"),
    ("total", "8,25", "| Net | Gross |\n| 8,25 | 8,25 |", "column_verified"),
])
def test_columns(spark, field, value, text, want):
    r = rec(spark, {field: value}).withColumn("text", F.lit(text))
    assert verify.verify_columns(r).first()["column_status"] == {field: want}


def test_confidence_and_review(spark):
    schema = TargetSchema.of("total:number", "who")
    r = rec(spark, {"total": "12.50", "who": "ACME"}, {"total": "x", "who": "NOBODY"}, {"who": ""}).withColumn("text", F.lit("ACME paid 12,50"))
    s = quality.score_confidence(r, schema, calibration={0.9: 0.83}).orderBy("record_ix").collect()
    assert [x["confidence"] for x in s] == [{"total": 0.83, "who": 0.83}, {"total": 0.3, "who": 0.4}, {"total": 0.0, "who": 0.0}]
    q = quality.review_queue(quality.score_confidence(r, schema)).collect()
    assert sorted((x["record_ix"], x["field"], tuple(x["reasons"])) for x in q) == [(1, "total", ("type_mismatch",)), (1, "who", ("ungrounded",)), (2, "total", ("missing",)), (2, "who", ("missing",))]
    preset = r.withColumn("confidence", F.create_map(F.lit("total"), F.lit(0.1)))
    low = quality.score_confidence(preset, schema).where("record_ix = 0").first()
    assert low["confidence"]["total"] == 0.1 and low["low_confidence"][0]["reason"] is None


def test_provenance(spark):
    schema = TargetSchema.of("total")
    pages = [load.page(0, "Subtotal 10.00\nTax 10.00\nTotal 10.00", [load.block(t, (0, i, 1, i + 1)) for i, t in enumerate(("Subtotal 10.00", "Tax 10.00", "Total 10.00"))])]
    def run(evidence):
        r = rec(spark, {"total": "10.00"}).crossJoin(spark.createDataFrame([(pages,)], f"pages array<{PAGE}>"))
        r = r.withColumn("evidence", F.create_map(F.lit("total"), F.lit(evidence)))
        p = quality.add_provenance(r, schema).first()["provenance"]["total"]
        return p["source_text"], p["method"]
    assert run("") == ("Subtotal 10.00", "value_search") and run("Total 10.00") == ("Total 10.00", "evidence") and run("made up") == ("Subtotal 10.00", "value_search")


def test_policy(spark):
    m = spark.createDataFrame([("a", 0.4, 2.0, 3, 0), ("b", 0.9, 0.1, 0, 1)], "doc_id string, lowest_confidence double, total_usd double, low_confidence int, rule_violations int")
    p = [dict(action="tag", tag="x", when={"min_confidence": 0.5, "max_total_usd": 1}), dict(when={"has_rule_violations": True}, action="halt"), dict(action="flag_review", when={}), dict(action="tag", tag="y", when={"has_rule_violations": False, "max_review_fields": 2})]
    got = {r["doc_id"]: r["policy"] for r in quality.apply_policies(m, p).collect()}
    assert (got["a"]["tags"], got["a"]["review"], got["a"]["halted"]) == (["x", "y"], True, False) and (got["b"]["tags"], got["b"]["review"], got["b"]["halted"]) == ([], False, True)
    for bad in (dict(action="halt", when={"zzz": 1}), dict(action="zzz", when={}), dict(action="tag", when={}), dict(action="halt")):
        with pytest.raises(ValueError):
            quality.check_policy(bad)


def test_scorers(spark):
    schema = TargetSchema.of("who*", "total")
    r = rec(spark, *({"total": t, "who": "ACME"} for t in ("12.50", "999.99")))
    data = Dataset(docs(spark, "Vendor ACME paid total 12.50").withColumn("doc_id", F.lit("d")), r)
    t = F.get("pages", F.lit(0))["text"]
    one = lambda s: cascade.score_documents(data, s, t).first()["score"]
    assert one(cascade.grounding(schema)) == 0.75 and one(cascade.field_coverage(schema)) == 1.0 and one(cascade.required_fill_ratio(schema)) == 1.0
    none = lambda t, r: F.lit(None).cast("double")
    assert one(cascade.composite([(none, 9), (lambda t, r: F.lit(1.0), 1)])) == 1.0
    assert one(cascade.composite([(lambda t, r: F.lit(0.5), 3), (lambda t, r: F.lit(1.0), 1)])) == 0.625
    empty = Dataset(data.documents)
    assert cascade.score_documents(empty, cascade.field_coverage(schema), t).first()["score"] == 0.0


def test_cascade_costs_count_each_call_once(spark):
    d = docs(spark, "good text", "x")
    def tier(name, usd):
        def run(x):
            c = x.documents.select("doc_id", F.lit(0).alias("seq"), F.lit(name).alias("stage"), F.lit(name).alias("model"), F.lit(1).cast("long").alias("tokens_in"), F.lit(1).cast("long").alias("tokens_out"), F.lit(usd).alias("usd"), F.lit(False).alias("unpriced"), F.lit(False).alias("unmetered"))
            r = with_sides(x.documents.select("doc_id", F.lit(0).alias("record_ix"), F.create_map(F.lit("v"), tagged("string", F.lit(name))).alias("values")))
            return x.with_(records=r, costs=c if x.costs is None else x.costs.unionByName(c))
        return run
    out = cascade.cascade(Dataset(d), tier("p", 1.0), tier("f", 5.0), lambda t, r: F.length(t).cast("double"), 5, F.get("pages", F.lit(0))["text"])
    assert {r["doc_id"]: r["total_usd"] for r in cascade.ledger(out.costs).collect()} == {"d0": 1.0, "d1": 6.0}
    assert {r["doc_id"]: values(r)["v"] for r in out.records.collect()} == {"d0": "p", "d1": "f"}
    assert {r["doc_id"]: r["tier"] for r in out.extra["router"].collect()} == {"d0": "primary", "d1": "fallback"}


def test_price_keys(spark):
    keys = [p[0] for p in cascade.PRICES]
    for m, want in (("openai/gpt-4o-mini-x", "gpt-4o-mini"), ("gpt-4o", "gpt-4o"), ("bedrock/eu.anthropic.claude-3-5-sonnet-v2", "anthropic.claude-3-5-sonnet"), ("zzz", None)):
        assert spark.range(1).select(cascade.price_key(F.lit(m), keys)).first()[0] == want


def test_alignment(spark):
    def side(*names):
        return spark.createDataFrame([("c", i, {"k": n}) for i, n in enumerate(names)], "case_id string, row_ix int, fields map<string,string>")
    get = lambda df: sorted((r["predicted"] and r["predicted"]["k"] or "", r["expected"] and r["expected"]["k"] or "") for r in df.collect())
    assert get(evaluate.align_by_index(side("A", "B"), side("A"))) == [("A", "A"), ("B", "")]
    assert get(evaluate.align_by_key(side("B", "A", "A", " "), side("A", "C"), "k")) == [("", "C"), ("A", "A"), ("B", "")]


def test_figures(spark):
    t = "# One <!-- image --> <!-- image -->\n# Two <!-- image -->"
    run = lambda ids: spark.createDataFrame([(t, ids)], "t string, i array<string>").select(figures.replace_markers(F.col("t"), F.col("i"))).first()[0]
    assert run(["a", "b", "c"]) == "# One [[FIGURE:a]] [[FIGURE:b]]\n# Two [[FIGURE:c]]" and run(["a"]).count(" image ") == 2 and run([]) == t and run(list("abcd")).endswith("\n[[FIGURE:d]]")
    place = lambda md, ids: spark.createDataFrame([(md, ids)], "t string, i map<int,array<string>>").select(figures.insert_placeholders(F.col("t"), F.col("i"))).first()[0]
    assert place("## Page 0\n\nx\n\n## Page 1\n\ny", {0: ["a"], 1: ["b"]}) == "## Page 0\n\nx\n[[FIGURE:a]]\n\n## Page 1\n\ny\n[[FIGURE:b]]"
    assert place("no heads", {1: ["b"], 0: ["a"]}) == "no heads\n[[FIGURE:a]]\n[[FIGURE:b]]" and place("", {0: ["a"]}) == "[[FIGURE:a]]" and place("## Page 0\n\nx", {3: ["z"]}) == "## Page 0\n\nx\n[[FIGURE:z]]"
    done = spark.createDataFrame([("a [[FIGURE:x]] b [[FIGURE:y]]", {"x": "X"})], "t string, r map<string,string>").select(figures.merge(F.col("t"), F.col("r"))).first()[0]
    assert done == "a X b [unprocessed figure y]"


MARK = "<!-- image -->"


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0) + b"\0\0\0\0" + zlib.compress(b"")


def workbook():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>price</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="B2"><v>2.5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_loaders(spark, tmp_path):
    assert load.load_xlsx("a", workbook())[0]["text"] == "name\tprice\n\t2.5"
    assert load.image_size(png(3, 4)) == ("png", 3, 4)
    assert load.load_html("a", b"<html><head><title>t</title></head><body><h1>H</h1><p>a <b>b</b></p><img src=x><table><tr><th>x</th></tr><tr><td>1</td></tr></table></body></html>")[0]["text"] == "# H\n\na b\n\n" + MARK + "\n\n| x |\n| --- |\n| 1 |"
    files = {"a.txt": b"hi \xff", "b.xlsx": workbook(), "c.png": png(1, 1), "d.pdf": b"%PDF", "e.zzz": b"?", "f.xlsx": b"no zip", "g.MD": b"# x"}
    for n, c in files.items():
        (tmp_path / n).write_bytes(c)
    got = {r["path"].rsplit("/", 1)[1]: r for r in load.read_documents(spark, str(tmp_path)).collect()}
    assert {n: r["error_class"] for n, r in got.items()} == {"a.txt": None, "b.xlsx": None, "c.png": None, "d.pdf": "unreadable", "e.zzz": "unknown_type", "f.xlsx": "unreadable", "g.MD": None}
    assert got["a.txt"]["pages"][0]["text"] == "hi �" and got["c.png"]["pages"][0]["image_ref"]
    small = {r["error_class"] for r in load.read_documents(spark, str(tmp_path / "b.xlsx"), max_bytes=10).collect()}
    assert small == {"input_too_large"}


def test_pipeline_from_config(spark):
    config = {"schema": {"fields": [dict(required=True, name="name"), dict(type="number", name="price")]}, "pipeline": [*"ingest.default parse.passthrough extract.table validate.default normalize.default".split(), {"rules.default": {"rules": [{"rule": "non_negative", "field": "price"}]}}, {"confidence.default": {"threshold": 0.6}}, "provenance.default", "verify.label", "verify.column", "archetype.router", "review.default", {"policy.default": {"policies": [{"when": {"max_review_fields": 0}, "action": "flag_review"}]}}]}
    out = build(config).run(Dataset(load.sample_catalogue(spark)))
    got = sorted(values(r)["name"] for r in out.records.collect())
    assert got == ["Desk lamp", "Notebook", "Pencil", "Shelf", "Stapler"]
    assert out.extra["validation"].first()["valid"] == 5 and out.extra["rules"].first()["violations"] == 0 and out.extra["trace"].count() == 13
    assert out.extra["policy"].first()["policy"]["review"] is False
    j = json.loads(sinks.result_json(out.records, out.extra["validation"], out.extra["deduped"]).first()["json"])
    assert len(j["records"]) == 5 and j["records"][0]["price"] == 24.5 and j["normalize"] == {"deduped": 0}


def test_model_stages_and_cascade(spark):
    from leafmill.operators.extract import Completion

    def cheap(prompt):
        return Completion('{"records": [{"who": "x"}]}', 100, 10, "gpt-4o-mini")

    def strong(prompt):
        return Completion('```json\n[{"who": "ACME", "total": 5}]\n```', 100, 10, "gpt-4o")

    config = {"schema": {"fields": [dict(name="who"), dict(type="number", name="total")]}, "pipeline": ["parse.default", {"cascade": {"threshold": 0.6, "primary": {"extract.default": {"client": "cheap"}}, "fallback": {"extract.default": {"client": "strong"}}, "scorer": "grounding"}}, "confidence.default", {"repair.default": {"client": "strong"}}]}
    p = build(config, engines={"cheap": cheap, "strong": strong}, keep=lambda df: df.persist())
    out = p.run(Dataset(docs(spark, "paid 5 to ACME", "x marks")))
    assert {r["doc_id"]: r["tier"] for r in out.extra["router"].collect()} == {"d0": "fallback", "d1": "primary"}
    got = {r["doc_id"]: r for r in out.records.collect()}
    assert values(got["d0"]) == {"who": "ACME", "total": "5"} and values(got["d1"])["total"] == "5" and got["d1"]["repair_log"][0]["fields"] == ["total"]
    for stage in ({"extract.chunked": {"client": "strong", "max_chars": 8}}, {"extract.hybrid": {"client": "strong", "rules": dict(total=dict(matcher="number"))}}, {"extract.ensemble": {"clients": ["cheap", "strong"]}}):
        o = build({"schema": config["schema"], "pipeline": [stage]}, engines={"cheap": cheap, "strong": strong}).run(Dataset(docs(spark, "paid 5 to ACME\nline two")))
        assert o.records.count() == 1, stage


def test_engines_are_asked_once(spark, tmp_path):
    """However many results are written, in JSON and CSV, each document is sent once; unusable replies are not sent again either."""
    calls = tmp_path / "calls"
    asked = str(calls)

    def client(prompt):
        from leafmill.operators.extract import Completion

        with open(asked, "a", encoding="utf-8") as f:
            f.write("x")
        return Completion('{"records": [{"who": "ACME"}]}', 100, 10, "gpt-4o")

    config = {"schema": {"fields": [dict(name="who")]}, "pipeline": ["parse.default", {"extract.default": {"client": "c"}}, "validate.default", "normalize.default", "confidence.default"]}
    p = build(config, engines={"c": client})
    out = p.run(Dataset(docs(spark, "from ACME", "to ACME", "by ACME")))
    for k in range(2):
        sinks.write_json(sinks.result_json(out.records, out.extra.get("validation"), out.extra.get("deduped")), f"{tmp_path}/out{k}.json")
        sinks.write_csv(out.records, f"{tmp_path}/out{k}.csv", p.context.schema)
    assert out.records.count() == 3 and out.costs.count() == 3
    assert len(calls.read_text()) == 3


def test_command_client(spark, tmp_path):
    from leafmill.operators.clients import command_client, engines_of

    reply = "print('{\"records\": [{\"who\": \"' + x.split()[-1] + '\"}]}')"
    for stdin, x in ((False, "sys.argv[-1]"), (True, "sys.stdin.read()")):
        got = command_client(["python3", "-c", f"import sys; x = {x}; {reply}"], model="local", stdin=stdin)("it says ACME")
        assert got.text == '{"records": [{"who": "ACME"}]}' and got.model == "local" and got.prompt_tokens is None
    for command in (["python3", "-c", "import sys; print(1); sys.exit(3)"], ["no-such-command"]):
        assert command_client(command)("x").text == ""
    assert command_client(["sleep"], timeout=0.2)("5").text == ""
    config = {"engines": {"echo": {"command": ["echo"], "model": "m"}}, "schema": {"fields": [dict(name="who")]}, "pipeline": ["parse.default", {"extract.default": {"client": "echo"}}]}
    assert build(config).run(Dataset(docs(spark, "x"))).costs.count() == 1
    for bad in ({"e": {}}, {"e": {"command": []}}, {"e": {"command": ["x"], "other": 1}}, ["e"]):
        with pytest.raises(ValueError):
            engines_of(bad)


def test_cases_of_one_name_in_two_folders(spark, tmp_path, capsys):
    from leafmill.__main__ import evaluate_cases

    cases = []
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "1.txt").write_text(f"name\tprice\n{k}\t{1 + (k == 'b')}")
        cases.append({"input_path": f"{k}/1.txt", "expected": [{"name": k, "price": str(1 + (k == "b"))}]})
    (tmp_path / "cases.json").write_text(json.dumps({"cases": cases}))
    p = build(dict(pipeline=["parse.default", "extract.table", "validate.default"], schema=dict(fields=[dict(name="name"), dict(type="number", name="price")])))
    got = evaluate_cases(spark, p, str(tmp_path / "cases.json"), str(tmp_path))
    assert got["overall_field_accuracy"] == 1.0 and got["record_count_predicted"] == got["record_count_expected"] == 2


def test_config_grammar():
    assert item("a", 0) == ("a", {}) and item({"a": None}, 0) == ("a", {}) and item({"a": {"x": 1}}, 0) == ("a", {"x": 1})
    for bad in (3, {"a": 1, "b": 2}, {1: {}}, {"a": [1]}):
        with pytest.raises(ValueError):
            item(bad, 0)
    with pytest.raises(KeyError):
        build({"pipeline": ["nothing"]})
    with pytest.raises(ValueError):
        build({"pipeline": [{"extract.chunked": {"zzz": 1}}]})
    with pytest.raises(ValueError):
        build(dict(pipeline=[{"cascade": {"primary": "extract.table"}}]))
    with pytest.raises(ValueError):
        build({})
    c = {"pipeline": ["parse.default", {"cascade": {"primary": "extract.table", "fallback": "extract.table", "scorer": "text_length", "threshold": 1}}]}
    assert set_threshold(c, 0.5)["pipeline"][1]["cascade"]["threshold"] == 0.5 and swap_parser(c, "x")["pipeline"][0] == {"parse.default": {"parser": "x"}}
    r = Registry()
    r.register("a", lambda: 1)
    assert r.create("a") == 1 and r.keys() == ["a"] and "repair.default" in default_registry().keys()


def test_retry():
    n, waits = [0], []
    def call():
        n[0] += 1
        if n[0] < 3:
            raise ConnectionError
        return "ok"
    assert extract.with_retry(call, 3, rng=lambda: 0.0, sleep=waits.append) == "ok" and waits == [0.5, 1.0]
    with pytest.raises(ValueError):
        extract.with_retry(lambda: (_ for _ in ()).throw(ValueError()), 3, sleep=waits.append)


def test_sinks(spark, tmp_path):
    r = rec(spark, {"a": 1.0, "b": True, "c": None, "d": 'q"'}, {"a": "x"})
    w = sinks.wide(r).orderBy("record_ix").collect()
    assert [w[0][c] for c in "abcd"] == ["1.0", "True", "", 'q"'] and w[1]["b"] == ""
    sinks.write_csv(r, str(tmp_path / "csv"), TargetSchema.of("a", "zzz"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["a", "zzz"]
    work = spark.range(4).selectExpr("id as k")
    calls = []
    def run(df):
        calls.append(df.count())
        return df.withColumn("v", F.col("k") * 2)
    path = str(tmp_path / "cache")
    assert sinks.resume(work.where("k < 2"), path, "k", run).count() == 2 and sinks.resume(work, path, "k", run).count() == 4 and calls[-1] == 2


def test_as_records(spark):
    r = as_records(spark.range(1).selectExpr("id as doc_id", "'x' as t"), {"t": tagged("string", F.col("t"))}, record_ix=None).first()
    assert values(r) == {"t": "x"} and r["confidence"] == {}


def test_command_line_functions(spark, tmp_path):
    from leafmill.__main__ import evaluate_cases, extract as run_files

    (tmp_path / "a.txt").write_text("name\tprice\nx\t1.50\ny\t2")
    cases = {"key_field": "name", "cases": [{"input_path": "a.txt", "expected": [{"name": "x", "price": "1.5"}, {"name": "y", "price": "3"}]}]}
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    assert run_files(spark, build({"pipeline": ["parse.default"]}), str(tmp_path / "a.txt")).documents.count() == 1
    p = build(dict(pipeline=["parse.default", "extract.table", "validate.default"], schema=dict(fields=[dict(name="name"), dict(type="number", name="price")])))
    got = evaluate_cases(spark, p, str(tmp_path / "cases.json"), str(tmp_path))
    assert got["overall_field_accuracy"] == 0.75 and got["fields"] == {"name": 1.0, "price": 0.5} and got["exact_record_match_ratio"] == 0.5
    (tmp_path / "spec.yaml").write_text("name: n\npipeline: []\n")
    with pytest.raises(ValueError):
        load.load_spec(str(tmp_path / "spec.yaml"))
    (tmp_path / "m.json").write_text(json.dumps([{"image": "x.png", "fields": {"a": "1"}}]))
    assert load.load_manifest(spark, str(tmp_path / "m.json")).first()["image"] == f"{tmp_path}/x.png"
    reply = '{"Blocks": [{"BlockType": "PAGE"}, {"BlockType": "LINE", "Text": "a"}, {"BlockType": "LINE", "Text": "b"}]}'
    assert spark.createDataFrame([(reply,)], "r string").select(load.ocr_text(F.col("r"))).first()[0] == "a b"


def office(kind):
    out = io.BytesIO()
    ns = 'xmlns:a="http://a" xmlns:r="http://r" xmlns:p="http://p" xmlns:w="http://w"'
    with zipfile.ZipFile(out, "w") as z:
        if kind == "pptx":
            z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="rId2"/><p:sldId id="2" r:id="rId1"/></p:sldIdLst></p:presentation>')
            z.writestr("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="rId1" Target="slides/slide1.xml"/><Relationship Id="rId2" Target="slides/slide2.xml"/></Relationships>')
            pic = lambda rid, cx: f'<p:pic><p:blipFill><a:blip r:embed="{rid}"/></p:blipFill><p:spPr><a:xfrm><a:off x="12700" y="0"/><a:ext cx="{cx}" cy="254000"/></a:xfrm></p:spPr></p:pic>'
            for n, inner in ((1, pic("rId1", 254000)), (2, f'<a:p><a:r><a:t>First</a:t></a:r></a:p><p:grpSp>{pic("rId1", 508000)}</p:grpSp>{pic("rId1", 12700)}')):
                z.writestr(f"ppt/slides/slide{n}.xml", f"<p:sld {ns}>{inner}</p:sld>")
                z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", '<Relationships><Relationship Id="rId1" Target="../media/i.png"/></Relationships>')
            z.writestr("ppt/media/i.png", png(7, 8))
        else:
            z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r><a:blip r:embed="rId1"/></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
            z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId1" Target="media/i.png"/></Relationships>')
            z.writestr("word/media/i.png", png(5, 6))
    return out.getvalue()


def test_office_files(spark, tmp_path):
    assert load.load_docx("a", office("docx"))[0]["text"] == "## Head\n\ntext\n\n" + MARK + "\n\n| a |\n| --- |\n| 1 |"
    assert load.load_pptx("a", office("pptx"))[0]["text"].split("\n\n") == ["First", MARK, MARK, MARK]
    images = load.pptx_images(office("pptx"))
    assert [(i["page"], i["width"], i["bbox"]["x1"]) for i in images] == [(0, 7, 41.0), (1, 7, 21.0)]
    for k in ("docx", "pptx"):
        (tmp_path / f"f.{k}").write_bytes(office(k))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    figs = load.figures_of(files)
    d = build({"pipeline": "ingest.default parse.default figures.extract figures.process figures.merge".split()}).run(Dataset(files.select("path", "content"), figures=figs))
    got = {r["path"][-4:]: r["markdown"] for r in d.documents.collect()}
    assert "[figure fig_0_0: 5x6 image/png]" in got["docx"] and got["pptx"].count("[figure ") == 2 and got["pptx"].count(MARK) == 1


def test_costly_columns_stand_once_in_a_plan(spark, tmp_path):
    from leafmill import queries

    spark.createDataFrame([(i, 10.0 + i) for i in range(10)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    plan = queries.repair_candidates(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Total net worth") <= 3 and plan.count("no_evidence") <= 3


def test_repair_asks_and_joins_only_what_failed(spark):
    from leafmill.schema import TargetSchema

    schema = TargetSchema.of("total*:number")
    value = "struct('string' as kind, if(id % 2 = 0, '', '5') as s)"
    r = with_sides(spark.range(6).selectExpr("cast(id as string) doc_id", "0 record_ix", f"map('total', {value}) as values", "concat('text ', id) as text"))
    r = r.withColumn("low_confidence", F.array().cast("array<struct<field:string,confidence:double,reason:string>>"))
    asked = []

    def answer(p):
        asked.append((len(p.inputFiles()) > 0, p.count()))
        return p.select("prompt_sha", F.expr("map('total', struct('string' as kind, '7' as s))").alias("values"))

    got = {x["doc_id"]: (x["values"]["total"]["s"], len(x["repair_log"])) for x in quality.repair(r, schema, answer, max_rounds=2).collect()}
    assert got == {str(i): ("5", 0) if i % 2 else ("7", 1) for i in range(6)}
    assert asked == [(True, 3), (True, 0)], "each round reads what is written, and asks for failed records only"
