"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the ``profile_size`` most frequent character n-grams (1 to 3, words padded with one space) in
order of frequency, ties by length and then by code points. A document's distance to a language is the mean,
over the n-grams of its own profile, of the difference between its rank and the language's rank, or
``profile_size`` where the language lacks the n-gram, divided by ``profile_size``. The nearest language wins,
ties by name. A document is rejected when even that distance is above the bar of that language, or it has no letters.
The bar is the ``QUANTILE`` of the distances of the language's own documents, and ``MARGIN``, at most ``REJECT``;
a number given as ``reject`` is the bar of all languages.

Profiles and bars are of all documents that carry a language, and of their whole texts; the quantile is one of the
distances, exactly. Null or blank languages are not fitted. Null and empty texts, and texts without letters, are
rejected with a null language; so is everything when there is no labelled text. Rows with a null doc_id are left out by ``identify`` and rejected by ``keep_identified``.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import judged, materialise, release, small_batches, steps

PROFILE = 300
REJECT = 0.8
QUANTILE = 0.999
MARGIN = 0.05
#: Ranges of distances that are counted before the values in one of them.
BINS = 4096
#: Bytes of text that are counted or compared together; what that takes for a while is some fifty times as much.
STEP = 1 << 18


def letters(col):
    """' word word ' in lower case; '' where there is no letter."""
    t = F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"[^\p{L}\p{M}]+", " "))
    t = F.trim(t)
    return F.when(t == "", "").otherwise(F.concat(F.lit(" "), t, F.lit(" ")))


def grams(data: np.ndarray, offs: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) sorted by row and n-gram; an n-gram is its code points, 21 bits each, shorter ones first. ``group``: what to count by instead of rows."""
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offs]
    m = len(offs) - 1
    of = np.repeat(np.arange(m, dtype=np.uint64), np.diff(chars))
    by = of if group is None else group.astype(np.uint64)[of.astype(np.int64)]
    alphabet = np.flatnonzero(np.bincount(code)) if len(code) else np.zeros(0, np.int64)
    lut = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint32)
    lut[alphabet] = np.arange(1, len(alphabet) + 1)
    c = lut[code].astype(np.uint64)
    k = np.uint64(max(1, int(len(alphabet)).bit_length()))
    space = np.uint64(lut[32]) if len(lut) > 32 else np.uint64(0)
    out = []
    for n in (1, 2, 3):
        if len(c) < n:
            continue
        g = c[: len(c) - n + 1]
        ok = np.ones(len(g), bool)
        for i in range(1, n):
            nxt = c[i : len(c) - n + 1 + i]
            g = (g << k) | nxt
            ok &= of[i : len(c) - n + 1 + i] == of[: len(g)]
        if n == 1:
            ok &= c != space
        if n == 3:  # no n-gram across words
            ok &= c[1 : len(g) + 1] != space
        x = np.sort((by[: len(g)][ok] << (k * np.uint64(n))) | g[ok])
        if not len(x):
            continue
        new = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        cnt = np.diff(np.append(new, len(x)))
        x = x[new]
        row = x >> (k * np.uint64(n))
        code_n = np.zeros(len(x), np.uint64)
        for i in range(n):
            part = (x >> (k * np.uint64(n - 1 - i))) & ((np.uint64(1) << k) - np.uint64(1))
            code_n = (code_n << np.uint64(21)) | alphabet[part.astype(np.int64) - 1].astype(np.uint64)
        out.append((row.astype(np.int64), code_n, cnt))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z
    return tuple(np.concatenate(v) for v in zip(*out))


def ranked(data, offs, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, rank) of each text's profile."""
    row, gram, cnt = grams(data, offs)
    order = np.lexsort((gram, -cnt, row))
    row, gram = row[order], gram[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < size
    return row[keep], gram[keep], rank[keep]


def _count(batches):
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        own = langs.indices.to_numpy()
        for lo, hi, data, offs in steps(batch, "t", STEP):
            lang, gram, n = grams(data, offs, own[lo:hi])
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def _labelled(docs: DataFrame) -> DataFrame:
    """(t, lang) of the documents that carry a language."""
    small_batches(docs.sparkSession)
    return docs.where("doc_id is not null and trim(lang) <> ''").select(letters(F.col("text")).alias("t"), "lang")


def profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language to its n-grams by rank; at most ``size`` for each language reach the driver."""
    counts = _labelled(docs).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
    out: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


def distances(data, offs, table: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Texts x languages; nan for a text without n-grams. table: sorted n-grams, and their rank in each language."""
    row, gram, rank = ranked(data, offs, size)
    union, ranks = table
    at = np.minimum(np.searchsorted(union, gram), len(union) - 1)
    known = union[at] == gram
    gap = np.where(known[:, None], np.abs(ranks[at] - rank[:, None]), size)
    gap = np.where(known[:, None] & (ranks[at] >= size), size, gap)
    m = len(offs) - 1
    n = np.bincount(row, minlength=m)
    out = np.stack([np.bincount(row, gap[:, k], m) for k in range(ranks.shape[1])], 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / (n[:, None] * size)


def rank_table(found: dict[str, np.ndarray], size: int) -> tuple[list[str], tuple[np.ndarray, np.ndarray]]:
    langs = sorted(found)
    union = np.unique(np.concatenate([found[k] for k in langs]))
    ranks = np.full((len(union), len(langs)), size, np.int64)
    for k, lang in enumerate(langs):
        ranks[np.searchsorted(union, found[lang]), k] = np.arange(len(found[lang]))
    return langs, (union, ranks)


def _own(d: np.ndarray, langs: list[str], given: list) -> pa.Array:
    """Each text's distance to the language it carries; null without such a profile or without n-grams."""
    place = {k: i for i, k in enumerate(langs)}
    at = np.array([place.get(x, -1) for x in given], np.int64)
    own = d[np.arange(len(d)), at]
    return pa.array(own, mask=(at < 0) | np.isnan(own))


def _quantiles(own: DataFrame, langs: list[str]) -> dict[str, float]:
    """Bars from all rows of (lang, own): ranges of distances are counted, then the values in the range where the quantile lies.

    At most ``BINS`` rows a language reach the driver, then some thousand: distances are fractions of no more than ``size * size``.
    """
    own = own.where("own is not null").withColumn("bin", F.floor(F.col("own") * BINS))
    counts: dict[str, list] = {}
    for r in own.groupBy("lang", "bin").agg(F.count("*").alias("n")).orderBy("lang", "bin").collect():
        counts.setdefault(r["lang"], []).append((r["bin"], r["n"]))
    left, here = {}, F.lit(False)
    for lang, bins in counts.items():
        q = Fraction(str(QUANTILE)) * sum(n for _, n in bins)
        rank = -(-q.numerator // q.denominator)
        for at, n in bins:
            if rank <= n:
                break
            rank -= n
        left[lang] = rank
        here |= (F.col("lang") == lang) & (F.col("bin") == at)
    out = dict.fromkeys(langs, REJECT)
    if left:
        for r in own.where(here).groupBy("lang", "own").agg(F.count("*").alias("n")).orderBy("lang", "own").collect():
            if 0 < left[r["lang"]] <= r["n"]:
                out[r["lang"]] = min(REJECT, r["own"] + MARGIN)
            left[r["lang"]] -= r["n"]
    return out


def bars(docs: DataFrame, found: dict[str, np.ndarray], size: int = PROFILE) -> dict[str, float]:
    """Language to the distance above which a document is rejected; ``REJECT`` where it has no documents with letters."""
    if not found:
        return {}
    langs, table = rank_table(found, size)

    def run(batches):
        for batch in batches:
            given = batch.column(1)
            for lo, hi, data, offs in steps(batch, "t", STEP):
                yield pa.RecordBatch.from_arrays([given[lo:hi], _own(distances(data, offs, table, size), langs, given[lo:hi].to_pylist())], names=["lang", "own"])

    own = materialise(_labelled(docs).mapInArrow(run, "lang string, own double"), "distances")
    out = _quantiles(own, langs)
    release(own)
    return out


def _nearest(d: np.ndarray) -> tuple[np.ndarray, ...]:
    """(texts without n-grams, nearest language, distance, margin to the second)."""
    none = np.isnan(d[:, 0])
    d = np.where(none[:, None], 1.0, d)
    best = d.argmin(1)
    at = np.arange(len(d)), best
    dist = d[at]
    rest = d.copy()
    rest[at] = np.inf
    second = rest.min(1) if d.shape[1] > 1 else np.ones(len(d))
    return none, best, dist, np.where(none, 0.0, second - dist)


def _identify(langs, table, size):
    def run(batches):
        for batch in batches:
            ids, given = batch.column(0), batch.column(2)
            for lo, hi, data, offs in steps(batch, "t", STEP):
                d = distances(data, offs, table, size)
                none, best, dist, margin = _nearest(d)
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], pa.array(np.array(langs, object)[best], pa.string(), mask=none), pa.array(dist), pa.array(margin), given[lo:hi], _own(d, langs, given[lo:hi].to_pylist())],
                    names=["doc_id", "language", "distance", "margin", "lang", "own"],
                )

    return run


OUT = "doc_id long, language string, distance double, margin double, lang string, own double"


def identify(docs: DataFrame, size: int = PROFILE, reject: float | None = None, found: dict | None = None) -> DataFrame:
    """(doc_id, language, distance, margin to the second, rejected), a row for each row with a doc_id."""
    small_batches(docs.sparkSession)
    found = profiles(docs, size) if found is None else found
    carried = F.col("lang") if reject is None else F.lit(None).cast("string")
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), letters(F.col("text")).alias("t"), F.when(F.trim(carried) != "", carried).alias("lang"))
    if not found:
        return d.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(1.0).alias("distance"), F.lit(0.0).alias("margin"), F.lit(True).alias("rejected"))
    langs, table = rank_table(found, size)
    near = d.mapInArrow(_identify(langs, table, size), OUT)
    if reject is None:  # distances serve the bars and the answer
        near = materialise(near, "distances")
        bar = _quantiles(near.select("lang", "own"), langs)
    else:
        bar = dict.fromkeys(langs, float(reject))
    bar = F.create_map(*[F.lit(x) for item in bar.items() for x in item])
    return near.select("doc_id", "language", "distance", "margin", (F.col("language").isNull() | (F.col("distance") > bar[F.col("language")])).alias("rejected"))


def keep_identified(docs: DataFrame, size: int = PROFILE, reject: float | None = None) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects. The verdict is a function of the row's own text, so rows that repeat a doc_id are judged alone."""
    found = profiles(docs, size)
    if not found:
        return docs.limit(0)
    given = bars(docs, found, size) if reject is None else dict.fromkeys(found, reject)
    langs, table = rank_table(found, size)
    bar = np.array([given[k] for k in langs])

    def good(data, offs):
        none, best, dist, _ = _nearest(distances(data, offs, table, size))
        return ~none & (dist <= bar[best])

    return docs.where("doc_id is not null").where(judged(lambda: good, letters(F.col("text")), STEP))
