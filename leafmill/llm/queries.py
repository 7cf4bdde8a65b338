"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import chat, decontam, fingerprints, langid, licenses, packing, simhash, toxicity, urls, warc
from leafmill.llm.common import scratch


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_t(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_t(spark, sf_dir, "documents"))


OP4 = rf"""
with x as (select row_number() over () as rid, doc_id, lang, trim(lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{M}}]+', ' ', 'g'))) as t from documents where doc_id is not null),
p as (select rid, doc_id, lang, ' ' || t || ' ' as t from x where t <> ''),
c as (select rid, lang, unnest(string_split(t, '')) as a, unnest(range(1, length(t) + 1)) as i from p),
w as (select rid, lang, a, lead(a, 1) over o as b, lead(a, 2) over o as d from c window o as (partition by rid order by i)),
g as (select rid, lang, unnest(list_filter([case when a <> ' ' then a end, a || b, case when b <> ' ' then a || b || d end], lambda y: y is not null)) as g from w),
n as (select rid, any_value(lang) as lang, g, count(*) as n from g group by rid, g),
mine as (select * from (select rid, g, row_number() over (partition by rid order by n desc, length(g), g) - 1 as r from n) where r < {langid.PROFILE}),
prof as (select * from (select lang, g, row_number() over (partition by lang order by n desc, length(g), g) - 1 as r from (select lang, g, sum(n) as n from n where trim(lang) <> '' group by all)) where r < {langid.PROFILE}),
size as (select rid, count(*) as m from mine group by 1),
near as (select rid, q.lang, sum({langid.PROFILE} - abs(m.r - q.r)) as s from mine m join prof q using (g) group by all),
dist as (select s.rid, l.lang, (m * {langid.PROFILE} - coalesce(near.s, 0))::double / (m * {langid.PROFILE}) as d from size s cross join (select distinct lang from prof) l left join near on near.rid = s.rid and near.lang = l.lang),
own as (select dist.lang, list_sort(list(d)) as ds from dist join p on p.rid = dist.rid and p.lang = dist.lang group by 1),
bar as (select lang, least({langid.REJECT}, ds[ceil({langid.QUANTILE} * len(ds))::int] + {langid.MARGIN}) as bar from own),
best as (select rid, first(lang order by d, lang) as language, min(d) as distance, list_sort(list(d))[2] as second from dist group by 1)
select x.doc_id, b.language, coalesce(b.distance, 1.0) as distance, case when b.rid is null then 0.0 else coalesce(b.second, 1.0) - b.distance end as margin, b.rid is null or b.distance > coalesce(bar.bar, {langid.REJECT}) as rejected
from x left join best b using (rid) left join bar on bar.lang = b.language"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files to the shared folder, and read back by byte ranges."""
    folder = scratch(spark, "warc")
    pages = _t(spark, sf_dir, "pages").where("page_id is not null")
    rows = pages.select(F.col("url").alias("uri"), F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")).alias("record_id"), F.col("html").alias("body"))
    warc.write_warc(rows, folder).count()
    back = warc.read_warc(spark, [folder], split=4 << 20)
    return back.select(F.regexp_extract("record_id", r"(-?\d+)>$", 1).cast("long").alias("page_id"), F.col("uri").alias("url"), F.col("type"), F.length("body").cast("long").alias("n_bytes"), F.decode("body", "utf-8").alias("html"))


OP5 = """select page_id, url, 'resource' as type, cast(octet_length(encode(coalesce(html, ''))) as bigint) as n_bytes, coalesce(html, '') as html
from pages where page_id is not null"""


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_t(spark, sf_dir, "conversations"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_t(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_t(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no labels of URLs (``labels`` is about documents), so the pages' own weak labels are mined."""
    pages = _t(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.weak_labels(pages))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.links(fingerprints.sketches(_t(spark, sf_dir, "documents")))


OP10 = rf"""
with r as (select row_number() over () as rid, doc_id, trim(lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))) as t from documents where doc_id is not null),
s as (select rid, doc_id, string_split(t, ' ') as a from r where t <> ''),
w as (select rid, doc_id, len(a) as words, unnest(a) as word, unnest(range(1, len(a) + 1)) as i from s),
v as (select rid, doc_id, words, i, cast('0x' || substr(md5(word), 1, 15) as hugeint) as x from w),
g as (select doc_id, words, i, ({' + '.join(f"coalesce(lead(x, {j}) over o, 0) * {fingerprints.place(j)}::hugeint" for j in range(fingerprints.K))}) % 18446744073709551616::hugeint as h
      from v window o as (partition by rid order by i)),
k as (select distinct doc_id, cast(h as bigint) as h from g where i <= greatest(words - {fingerprints.K - 1}, 1) and h < {fingerprints.KEEP}::hugeint * 1152921504606846976),
d as (select doc_id, list_sort(list(h)) as sk from k group by 1),
e as (select sk, min(doc_id) as id, count(*) as copies, len(sk) as n from d group by sk),
p as (select id, n, unnest(sk) as h from e),
c as (select a.id as a, b.id as b, a.n as n, count(*) as shared from p a join p b on a.h = b.h and a.id <> b.id group by all having count(*) >= {fingerprints.CONTAINED} * a.n),
o as (select a as id, count(*) as containers, arg_max(b, shared::double * 1e12 - b) as container, max(shared) / max(n) as containment from c group by 1),
i as (select b as id, count(*) as contents from c group by 1)
select q.doc_id, e.id as entry, coalesce(e.copies, 0) as copies, coalesce(e.n, 0) as hashes, coalesce(o.containers, 0) as containers, coalesce(i.contents, 0) as contents, o.container, coalesce(o.containment, 0) as containment
from (select distinct doc_id from r) q left join d using (doc_id) left join e on d.sk = e.sk left join o on o.id = e.id left join i on i.id = e.id"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_decontamination, op4_language, op5_warc, op6_chat, op7_packing, op8_licenses, op9_urls, op10_fingerprints)}
ORACLES = {"op4_language": OP4, "op5_warc": OP5, "op6_chat": chat.ORACLE, "op8_licenses": licenses.oracle(), "op10_fingerprints": OP10}
