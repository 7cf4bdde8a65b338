"""URL filters by association rules.

A URL's tokens are its scheme, the labels of its host and their hyphenated parts, the segments of its path, the
names and name=value pairs of its query, and its fragment, each marked with where it stands. FP-growth mines the token
combinations that bad URLs, at least ``min_support`` of all labelled ones and ``min_count``, hold: only bad URLs and
tokens that enough of these have can take part, so only they are mined; a token that bad URLs alone have is a rule at once,
and no combination with it can be surer. Of tokens that always come together in all
labelled URLs the first by name stands for all, so a template of many constant tokens is one. How many labelled URLs in
all hold a combination is counted by the index that also applies rules. Rules ``tokens -> bad`` stay when confidence,
support and lift reach their bars and no rule with a subset of the tokens has at least the same confidence; that, too, is
found by the index. All URLs are then matched through the inverted index, token -> rules: a rule fires when as many of its
tokens are found as it has.

``weak_labels`` makes labels where none are given: a page is bad when a word of its host is one of ``SEEDS``. Rules then
carry the judgement on to what else such URLs have in common, such as the other words of their hosts.

Rules are what is broadcast, behind a check of their number. Defined results: null and empty URLs have no tokens and are
never flagged; null labels and ids are not mined; labels that repeat an id count once, the worst; without bad
labels or rules nothing is flagged; rows with a null page_id are left out; repeated rows are judged each; extra columns
are not returned.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialise, release

MIN_SUPPORT = 0.0005
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
#: Bad labelled URLs that must hold a combination, whatever the share.
MIN_COUNT = 3
#: Pairs (token, rule) up to which the index is broadcast.
SMALL = 200_000
#: Host words of gambling, pharmacy, adult and advertising sites.
SEEDS = ("casino", "poker", "bet", "bets", "betting", "pills", "viagra", "cialis", "pharmacy", "porn", "xxx", "escort", "ads", "adserver", "doubleclick", "popunder")


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    scheme = F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*)://", 1)
    rest = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@|:\d*$", "")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    mark = F.regexp_extract(rest, r"#(.*)$", 1)
    pre = lambda p, a: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(p), x))
    labels = F.split(host, r"\.")
    pieces = F.split(host, r"[.-]")
    params = F.split(query, r"[&;]")
    ext = F.regexp_extract(path, r"\.([a-z0-9]{1,6})$", 1)
    groups = [
        pre("scheme:", F.array(scheme)),
        pre("host:", labels),
        pre("word:", F.when(F.contains(host, F.lit("-")), pieces).otherwise(F.array(F.lit("")))),
        pre("path:", F.split(path, "/")),
        pre("ext:", F.array(ext)),
        pre("query:", F.concat(params, F.transform(params, lambda x: F.regexp_extract(x, r"^([^=]*)=", 1)))),
        pre("fragment:", F.array(mark)),
    ]
    return F.array_sort(F.array_distinct(F.concat(*groups)))


def weak_labels(pages: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(doc_id, bad) of each page with an id and a URL: 1 where a word of the host is a seed."""
    words = F.transform(F.filter(url_tokens(F.col("url")), lambda t: t.startswith("host:")), lambda t: F.split(F.substr(t, F.lit(6)), "-"))
    bad = F.arrays_overlap(F.flatten(words), F.array(*[F.lit(w) for w in seeds]))
    return pages.where("page_id is not null and trim(url) <> ''").select(F.col("page_id").alias("doc_id"), F.coalesce(bad, F.lit(False)).cast("int").alias("bad"))


def labelled(pages: DataFrame, labels: DataFrame, bad: Column) -> DataFrame:
    """(tokens, bad) of pages that have a label."""
    lab = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad")).where("bad is not null")
    return pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), url_tokens(F.col("url")).alias("tokens")).join(lab, "page_id").where(F.size("tokens") > 0).select("tokens", "bad")


def _index(rules: DataFrame) -> DataFrame:
    """(token, rule_id, need), broadcast where it is small."""
    index = rules.select("rule_id", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    return F.broadcast(index) if index.count() <= SMALL else index


def _fired(rows: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, rule_id) of the rules all of whose tokens a row (key, tokens) holds."""
    hits = rows.select(key, F.explode("tokens").alias("token")).join(_index(rules), "token")
    return hits.groupBy(key, "rule_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need").select(key, "rule_id")


def mine(examples: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT) -> DataFrame:
    """(rule_id, tokens, confidence, support, lift) from (tokens, bad)."""
    spark = examples.sparkSession
    kind = "rule_id long, tokens array<string>, confidence double, support double, lift double"
    # equal URLs are one row of so many
    rows = examples.groupBy("tokens").agg(F.count("*").alias("m"), F.sum("bad").cast("long").alias("bad"))
    rows = materialise(rows.withColumn("id", F.xxhash64("tokens")), "examples")
    n, n_bad = rows.agg(F.sum("m"), F.sum("bad")).first()
    if not n or not n_bad:
        release(rows)
        return spark.createDataFrame([], kind)
    least = max(1, min_count, -int(-min_support * n // 1))
    each = rows.select("id", "m", "bad", F.explode("tokens").alias("token"))
    # tokens that enough bad URLs have; those of the same URLs have one leader
    often = each.groupBy("token").agg(F.sum("bad").alias("b"), F.sum("m").alias("all"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("y")).where(F.col("b") >= least)
    lead = materialise(often.groupBy("rows", "x", "y").agg(F.min("token").alias("token"), F.first("b").alias("b"), F.first("all").alias("all")).select("token", "b", "all"), "tokens")
    # a token of bad URLs only is a rule, and nothing with more tokens is surer; the others are combined
    alone = lead.where("b = all").select(F.array("token").alias("tokens"), "b", "all")
    mixed = lead.where("b < all").select("token")
    kept = each.join(F.broadcast(mixed) if lead.count() <= SMALL else mixed, "token").groupBy("id").agg(F.max("m").alias("m"), F.max("bad").alias("bad"), F.array_sort(F.collect_list("token")).alias("tokens"))
    kept = kept.groupBy("tokens").agg(F.sum("m").alias("m"), F.sum("bad").alias("bad"))
    kept = materialise(kept.withColumn("id", F.xxhash64("tokens")), "baskets")
    # FP-growth takes rows, so a row for each bad URL
    items = kept.where("bad > 0").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("bad"))), "tokens").select("tokens")
    baskets = items.count()
    counted = alone
    if baskets:
        model = FPGrowth(itemsCol="tokens", minSupport=min(1.0, (least - 0.5) / baskets), minConfidence=1.0).fit(items)
        sets = model.freqItemsets.where(F.col("freq") >= least).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("b"))
        sets = materialise(sets.withColumn("rule_id", F.monotonically_increasing_id()), "sets")
        held = _fired(kept, "id", sets).join(kept.select("id", "m"), "id").groupBy("rule_id").agg(F.sum("m").alias("all"))
        counted = alone.unionByName(sets.join(held, "rule_id").select("tokens", "b", "all"))
    sure = counted.select("tokens", (F.col("b") / F.col("all")).alias("confidence"), (F.col("b") / n).alias("support"), (F.col("b") / F.col("all") / (n_bad / n)).alias("lift"))
    sure = materialise(sure.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)).withColumn("rule_id", F.monotonically_increasing_id()), "sure")
    # a rule is pruned when a more general one is as sure
    more = sure.select(F.col("rule_id").alias("big"), F.col("confidence").alias("big_confidence"), F.size("tokens").alias("size"), "tokens")
    general = _fired(more.select("big", "tokens"), "big", sure).join(more.drop("tokens"), "big").join(sure.select("rule_id", "confidence", F.size("tokens").alias("own")), "rule_id")
    pruned = general.where("own < size and confidence >= big_confidence").select(F.col("big").alias("rule_id")).distinct()
    out = materialise(sure.join(pruned, "rule_id", "left_anti").select(*[c.split()[0] for c in kind.split(", ")]), "rules")
    release(rows, lead, kept, sure, *([sets] if baskets else []))
    return out


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, flagged, confidence of the surest rule that fires, rules that fire: their tokens), a row for each page."""
    given = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", url_tokens(F.col("url")).alias("tokens"))
    urls = given.where(F.size("tokens") > 0).select("url", "tokens").distinct()
    named = rules.select("rule_id", "confidence", F.array_join("tokens", " ").alias("rule"))
    fired = _fired(urls, "url", rules).join(F.broadcast(named) if named.count() <= SMALL else named, "rule_id")
    best = fired.groupBy("url").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_list("rule")).alias("rules"))
    out = given.select("page_id", "url").join(best, "url", "left")
    return out.select("page_id", "url", F.col("confidence").isNotNull().alias("flagged"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


def filter_urls(pages: DataFrame, labels: DataFrame, bad: Column | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT) -> DataFrame:
    """Mine rules on the labelled pages (``labels``: doc_id and, unless ``bad`` says otherwise, bad) and judge all pages."""
    return apply_rules(pages, mine(labelled(pages, labels, F.col("bad") == 1 if bad is None else bad), min_support, min_confidence, min_lift, min_count))
