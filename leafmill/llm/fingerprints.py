"""Threshold-scaled document sketches and containment between documents.

A shingle is ``k`` consecutive words (all words of a shorter text). A word's hash is the first 60 bits of its MD5; a
shingle's is the sum of its words' hashes, each times the constant of its place, modulo 2^64. A sketch keeps the
distinct hashes below ``keep`` sixteenths of 2^64, that is a fixed fraction of all shingles however long the text, so
sketches of any texts can be merged (union) and compared: the share of a's kept hashes that b also has estimates how
much of a is contained in b, also where b is far longer.

``links`` compares all documents with all. Documents with equal sketches are one entry, and entries that share the
same hashes with others (hashes that no other entry has apart) are one class, so copies, near copies that differ in
words of their own, and documents that have but a passage in common meet once and not pair by pair. A class looks up
only its rarest hashes: of n kept ones a container must have ceil(at_least n), so it has one of any other
n - ceil(at_least n) + 1; what meets is compared in full. All of it is exact on the sketches and has no bar of size.

Defined results: rows with a null doc_id are left out; null and empty texts, and texts none of whose hashes is kept
(a text of w words has about w / 16), have an empty sketch, so no entry and no links; rows that repeat a doc_id are
one document, its sketch their union; ties between containers go to the smallest entry.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialise, release, small_batches, steps, words, words_text

K = 5
KEEP = 1
CONTAINED = 0.5
#: Odd constants of the places in a shingle.
PLACES = (0xB5026F5AA96619E, 0x9E3779B97F4A7C1, 0xC2B2AE3D27D4EB5, 0x165667B19E3779F, 0xD6E8FEB86659FD9)
#: A hash is hot, and its number of entries broadcast, from this share of all postings on; at most 1 / HOT_SHARE can be.
HOT_SHARE = 1 / 2000
#: Words whose MD5 a worker remembers.
KNOWN_WORDS = 1_000_000


def place(j: int) -> int:
    """The constant of place ``j`` of a shingle."""
    return (PLACES[j % len(PLACES)] + 2 * (j // len(PLACES))) | 1


def _word_values(data, h, size, of, offs, known: dict[int, int]) -> np.ndarray:
    """60 bits of each word's MD5; ``known`` holds those met before, by the words' hashes."""
    empty = np.append(0, np.cumsum(offs[1:] > offs[:-1]))
    start = np.cumsum(size + 1) - (size + 1) - empty[of]
    u, first, inv = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    out = np.empty(len(u), np.uint64)
    if len(known) > KNOWN_WORDS:
        known.clear()
    for i, (x, a, n) in enumerate(zip(u.tolist(), start[first].tolist(), size[first].tolist())):
        v = known.get(x)
        if v is None:
            v = known[x] = int(hashlib.md5(raw[a : a + n], usedforsecurity=False).hexdigest()[:15], 16)
        out[i] = v
    return out[inv]


def kept(data: np.ndarray, offs: np.ndarray, k: int, keep: int, known: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, kept hash) of texts of words, distinct and sorted."""
    h, size, begin, of = words(data, offs)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = _word_values(data, h, size, of, offs, known)
    at = np.arange(len(h))
    n = np.minimum(np.diff(begin), k)
    x = np.zeros(len(h), np.uint64)
    for j in range(k):
        live = np.flatnonzero(at + j < begin[of + 1])
        x[live] += v[live + j] * np.uint64(place(j))
    ok = at + n[of] <= begin[of + 1]
    if keep < 16:
        ok &= x < np.uint64(keep << 60)
    of, x = of[ok], x[ok].view(np.int64)
    order = np.lexsort((x, of))
    of, x = of[order], x[order]
    new = np.append(True, (x[1:] != x[:-1]) | (of[1:] != of[:-1]))[: len(x)]
    return of[new], x[new]


def _sketch(k: int, keep: int):
    def run(batches):
        known: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in steps(batch, "t"):
                of, x = kept(data, offs, k, keep, known)
                bounds = np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.ListArray.from_arrays(pa.array(bounds), pa.array(x))], names=["doc_id", "sketch"])

    return run


def sketches(docs: DataFrame, k: int = K, keep: int = KEEP) -> DataFrame:
    """(doc_id, sketch: sorted kept hashes), a row for each row with a doc_id."""
    small_batches(docs.sparkSession)
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words_text(F.col("text")).alias("t"))
    return d.mapInArrow(_sketch(k, keep), "doc_id long, sketch array<long>")


def merge(sketched: DataFrame, by: str) -> DataFrame:
    """(``by``, sketch): one sketch for each value, the union."""
    return sketched.select(by, F.explode("sketch").alias("h")).groupBy(by).agg(F.array_sort(F.collect_set("h")).alias("sketch"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null for an empty sketch."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def _digest(h: Column, part: int) -> Column:
    return F.xxhash64(h, F.lit(part))


def _signed(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, d1, d2): size and digest of each document's sketch, (doc_id, h)): rows that repeat an id are merged."""
    zero = F.lit(0).cast("long")
    fold = lambda part: F.aggregate("sketch", zero, lambda a, x: a.bitwiseXOR(_digest(x, part)))
    sign = lambda d: d.select("doc_id", F.size("sketch").cast("long").alias("n"), fold(1).alias("d1"), fold(2).alias("d2"))
    again = materialise(sketched.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return sign(sketched), sketched.select("doc_id", F.explode("sketch").alias("h"))
    once = sketched.join(again, "doc_id", "left_anti")
    more = sketched.join(again, "doc_id", "left_semi").select("doc_id", F.explode_outer("sketch").alias("h")).distinct()
    some = more.groupBy("doc_id").agg(F.count("h").alias("n"), *[F.bit_xor(F.when(F.col("h").isNotNull(), _digest(F.col("h"), p)).otherwise(zero)).alias(f"d{p}") for p in (1, 2)])
    return sign(once).unionByName(some), once.select("doc_id", F.explode("sketch").alias("h")).unionByName(more.where("h is not null"))


def _shared(postings: DataFrame) -> DataFrame:
    """(id, h, df) of the hashes that several entries have. Hot hashes find their number by broadcast, the others by shuffle."""
    df = materialise(postings.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    hot = max(1000, int((df.agg(F.sum("df")).first()[0] or 0) * HOT_SHARE))
    often = df.where(F.col("df") >= hot)
    return postings.join(F.broadcast(often.select("h")), "h", "left_anti").join(df.where(F.col("df") < hot), "h").unionByName(postings.join(F.broadcast(often), "h")).select("id", "h", "df")


def links(sketched: DataFrame, at_least: float = CONTAINED) -> DataFrame:
    """A row for each document: (doc_id, entry, copies, hashes, containers, contents, container, containment).

    ``entry`` is the smallest doc_id with the same sketch and ``copies`` how many have it; ``containers`` counts the other
    entries that hold at least ``at_least`` of this one's ``hashes``, ``contents`` those of which this one holds as much;
    ``container`` is the entry that holds most, ``containment`` how much (null and 0 where none holds ``at_least``).
    """
    t = F.lit(at_least)
    given = materialise(sketched, "sketches")
    signed, postings = _signed(given)
    member = materialise(signed, "members")
    entry = materialise(member.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "entries")
    # postings of one document of each entry, and of them the hashes that other entries have as well
    reps = postings.withColumnRenamed("doc_id", "id").join(entry.select("id"), "id", "left_semi")
    shared = materialise(_shared(reps), "postings")
    own = shared.groupBy("id").agg(F.count("*").alias("s"), F.bit_xor(_digest(F.col("h"), 3)).alias("s1"), F.bit_xor(_digest(F.col("h"), 4)).alias("s2"))
    own = materialise(own.join(entry.select("id", "n"), "id"), "shared")
    classes = materialise(own.groupBy("s", "s1", "s2").agg(F.min("id").alias("c"), F.count("*").alias("members"), F.min("n").alias("least")), "classes")
    own = materialise(own.join(classes.select("s", "s1", "s2", "c"), ["s", "s1", "s2"]).select("id", "n", "s", "c"), "entry_classes")
    # a class looks up its rarest hashes among all hashes of the others
    lists = shared.join(classes.select(F.col("c").alias("id"), "s", "least"), "id").groupBy("id", "s", "least").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("x"))
    lists = materialise(lists.select(F.col("id").alias("c"), "least", F.greatest(F.lit(0), F.col("s") - F.ceil(t * F.col("least")) + 1).cast("int").alias("first"), F.transform("x", lambda x: x["h"]).alias("hs")), "lists")
    release(given, shared)
    start = lists.where("first > 0").select(F.col("c").alias("a"), F.explode(F.slice("hs", F.lit(1), F.col("first"))).alias("h"))
    pairs = start.join(lists.select(F.col("c").alias("b"), F.explode("hs").alias("h")), "h").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: lists.select(F.col("c").alias(c), F.col("least").alias(f"{c}_n"), F.col("hs").alias(f"{c}_hs"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_hs", "b_hs")).alias("shared"))
    met = materialise(both.where(F.col("shared") >= t * F.least("a_n", "b_n")).select("a", "b", "shared"), "pairs")
    release(lists)
    pair = met.select("shared", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select(F.col("p.a").alias("c"), F.col("p.b").alias("other"), "shared")
    sizes = own.groupBy("c", "n").agg(F.count("*").alias("m"), F.first("s").alias("s"))
    hit = pair.join(sizes, "c").where(F.col("shared") >= t * F.col("n")).join(classes.select(F.col("c").alias("other"), "members"), "other")
    hit = materialise(hit.select("c", "n", "m", "other", "members", "shared"), "hits")
    outer = hit.groupBy("c", "n").agg(F.sum("members").alias("outside"), F.max(F.struct("shared", (-F.col("other")).alias("id"))).alias("best"))
    inner = hit.groupBy(F.col("other").alias("c")).agg(F.sum("m").alias("inside"))
    within = sizes.groupBy("c").agg(F.sum(F.when(F.col("s") >= t * F.col("n"), F.col("m")).otherwise(0)).alias("fit"))
    second = own.where("id <> c").groupBy("c").agg(F.min("id").alias("second"))
    info = classes.select("c", "members").join(within, "c").join(second, "c", "left").join(inner, "c", "left")
    e = own.join(info, "c").join(outer, ["c", "n"], "left")
    fits = F.col("s") >= t * F.col("n")
    mate = F.when(fits & (F.col("members") > 1), F.struct(F.col("s").cast("int").alias("shared"), (-F.when(F.col("id") == F.col("c"), F.col("second")).otherwise(F.col("c"))).alias("id")))
    e = e.select("id", "n", (F.coalesce("outside", F.lit(0)) + F.when(fits, F.col("members") - 1).otherwise(0)).alias("containers"), (F.coalesce("inside", F.lit(0)) + F.col("fit") - fits.cast("int")).alias("contents"), F.greatest("best", mate).alias("top"))
    e = e.select("id", "containers", "contents", (-F.col("top.id")).alias("container"), (F.col("top.shared") / F.col("n")).alias("containment"))
    e = entry.join(e, "id", "left")
    out = member.join(e, ["n", "d1", "d2"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", F.col("id").alias("entry"), count("copies"), F.col("n").alias("hashes"), count("containers"), count("contents"), "container", F.coalesce("containment", F.lit(0.0)).alias("containment"))
