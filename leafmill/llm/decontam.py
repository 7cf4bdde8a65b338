"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: each segment (about 2 MB of text) is a row that holds, for every test term
in it, the sorted positions of that term; positions run through the segment, with a gap between documents.
Terms that no test item has can be part of no match and are not stored. The index is built once, over the terms of
the whole benchmark: where these are more than ``TERMS`` a Bloom filter of a fixed size stands in for them, so that
what is broadcast stays bounded, and the index holds some terms more. An item is searched by its rarest terms (by
occurrences in the whole corpus): their positions minus their offsets in the item are the places where the
item may begin; the other terms' offset-adjusted lists are intersected with those.

A document matches an item by *phrase* when at least ``phrase`` consecutive words of the item (all of a shorter
one) stand in it consecutively, and by *proximity* when words that carry at least ``coverage`` of the item's
inverse-frequency weight stand within ``slop`` places of where a copy would have them. Both are exact: starting
terms are chosen so that every match holds one. Items shorter than ``short`` words are too common a turn to judge by
the words near each other, so they match by phrase only.

Defined results: null and empty texts, items without words and rows with a null id match nothing; rows that repeat
an id are searched each and reported once with the longest match; long documents may lie in a segment of their own.
Test items are searched in slices of ``slice_words`` words, so what is broadcast stays bounded whatever the size of the
benchmark; frequencies are those of all words of the corpus and do not depend on the slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import fresh, materialise, mix, release, steps, words, words_text

PHRASE = 13
#: Items of fewer words match as phrases only.
SHORT = 5
COVERAGE = 0.6
SLOP = 8
SLICE_WORDS = 2_000_000
GAP = 64
#: Start places that are compared at once, in words of the item.
CHUNK = 1 << 20
#: Benchmark terms that are broadcast as they are; bits of the filter that stands in for more.
TERMS, FILTER_BITS = 2_000_000, 1 << 28
SEGMENT_BYTES = 2 << 20

SEGMENT = "doc_ids array<long>, doc_starts array<int>, terms array<long>, bounds array<int>, positions array<int>, n_words long"


def _items(batches):
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offs in steps(batch, "t"):
            h, _, begin, _ = words(data, offs)
            yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(h.view(np.int64)))], names=["item_id", "terms"])


def _segments(shared, gap):
    def run(batches):
        known = shared.value
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in steps(batch, "t", SEGMENT_BYTES):
                h, _, begin, of = words(data, offs)
                ok = np.flatnonzero(known.has(h))
                pos = ok + of[ok] * gap
                order = np.argsort(h[ok], kind="stable")
                term, pos = h[ok][order], pos[order]
                new = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
                one = lambda x, kind: pa.array([x.astype(kind)], pa.list_(pa.from_numpy_dtype(kind)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[lo:hi].to_pylist()], pa.list_(pa.int64())), one(begin[:-1] + np.arange(hi - lo) * gap, np.int32), one(term[new].view(np.int64), np.int64), one(np.append(new, len(term)), np.int32), one(pos, np.int32), pa.array([len(h)], pa.int64())],
                    names=["doc_ids", "doc_starts", "terms", "bounds", "positions", "n_words"],
                )

    return run


class Item:
    """An item's terms with what the search needs: places to start from and weights."""

    def __init__(self, terms: np.ndarray, count: np.ndarray, total: int, phrase: int, coverage: float, short: int = SHORT):
        self.terms = terms
        n = len(terms)
        self.span = min(phrase, n)
        starts = set()
        for a in range(n - self.span + 1):
            w = count[a : a + self.span]
            if w.min() > 0:
                starts.add(a + int(w.argmin()))
        self.exact = sorted(starts)
        self.weight = np.log((total + 2) / (count + 1.0))
        self.need = coverage * self.weight.sum()
        order = np.argsort(count, kind="stable")
        left = self.weight.sum() - np.append(0, np.cumsum(self.weight[order]))
        probes = order[: int(np.argmax(left < self.need))]
        self.near = [int(o) for o in probes if count[o] > 0]
        self.possible = n >= short and self.weight[count > 0].sum() >= self.need


def _starts(seeds: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where an item may begin and the documents they are for, from (place, position) of the terms found: the same place may be for two documents."""
    doc = np.searchsorted(doc_starts, seeds[1], "right") - 1
    key = np.unique(((seeds[0] + (1 << 31)) << 31) | doc)
    return (key >> 31) - (1 << 31), key & ((1 << 31) - 1)


def search_segment(items, terms, bounds, positions, doc_ids, doc_starts, slop):
    """Yield (item, doc_id, longest run, its start in the item, its start in the document, best coverage).

    ``items``: (item_id, item, whether a phrase is possible here, whether proximity is).
    """
    terms = terms.view(np.uint64)
    # all postings as one sorted list of (term, position), so that an item's terms are looked up together
    keys = (np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(bounds)) << 32) | positions.astype(np.int64)
    ends = np.append(doc_starts[1:] - 1, (1 << 31) - 1)
    for item_id, it, phrase, close in items:
        n = len(it.terms)
        place = np.minimum(np.searchsorted(terms, it.terms), len(terms) - 1)
        here = terms[place] == it.terms
        base = place.astype(np.int64) << 32
        offset = np.arange(n)
        rows = max(1, CHUNK // n)
        posts = lambda o: positions[bounds[place[o]] : bounds[place[o] + 1]].astype(np.int64)  # noqa: B023, E731
        found: dict[int, list] = {}
        seeds = [np.stack([p - o, p]) for o in it.exact if here[o] for p in (posts(o),)] if phrase else []
        if seeds:
            at, own = _starts(np.concatenate(seeds, 1), doc_starts)
            for c in range(0, len(at), rows):
                want = at[c : c + rows, None] + offset
                doc = own[c : c + rows]
                key = base + np.maximum(want, 0)
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = here & (keys[k] == key) & (want >= doc_starts[doc][:, None]) & (want <= ends[doc][:, None])
                run, best, end = (np.zeros(len(want), np.int64) for _ in range(3))
                for o in range(n):
                    run = np.where(hit[:, o], run + 1, 0)
                    up = run > best
                    best[up] = run[up]
                    end[up] = o + 1
                for i in np.flatnonzero(best >= it.span):
                    a = int(end[i] - best[i])
                    d = int(doc[i])
                    old = found.setdefault(d, [0, 0, 0, 0.0])
                    new = [int(best[i]), a, int(at[c + i] + a - doc_starts[d])]
                    if (-new[0], *new[1:]) < (-old[0], *old[1:3]):
                        old[:3] = new
        seeds = [np.stack([p - o, p]) for o in it.near if here[o] for p in (posts(o),)] if close else []
        if seeds:
            at, doc = _starts(np.concatenate(seeds, 1), doc_starts)
            for c in range(0, len(at), rows):
                mid = at[c : c + rows, None] + offset
                own = doc[c : c + rows]
                low = np.searchsorted(keys, base + np.maximum(mid - slop, doc_starts[own][:, None]))
                high = np.searchsorted(keys, base + np.minimum(mid + slop, ends[own][:, None]), "right")
                sure = (here & (high > low)) @ it.weight
                for i in np.flatnonzero(sure >= it.need - 1e-9):
                    d = int(own[i])
                    old = found.setdefault(d, [0, 0, 0, 0.0])
                    cover = float(sure[i] / it.weight.sum())
                    if cover > old[3]:
                        old[3] = cover
                        if not old[0]:
                            old[2] = max(0, int(at[c + i] - doc_starts[d]))
        for d, (run_, a, p, cover) in found.items():
            yield item_id, int(doc_ids[d]), run_, a, p, cover


OUT = "item_id long, doc_id long, phrase_words int, item_start int, doc_start int, coverage double"


class Batch:
    """Items, with their terms end to end, so that a segment tells at once which of them it can match."""

    def __init__(self, items: list[tuple[int, Item]]):
        self.items = items
        size = [len(it.terms) for _, it in items]
        self.start = np.append(0, np.cumsum(size))[:-1]
        self.terms = np.concatenate([it.terms for _, it in items])
        self.weight = np.concatenate([it.weight for _, it in items])
        self.need = np.array([it.need if it.possible else np.inf for _, it in items])
        self.root = np.zeros(len(self.terms), bool)
        for s, (_, it) in zip(self.start, items):
            self.root[s + np.array(it.exact, np.int64)] = True

    def possible(self, terms: np.ndarray):
        """(item_id, item, phrase possible, proximity possible) of items that a segment with these terms may match."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        here = terms[at] == self.terms
        phrase = np.logical_or.reduceat(here & self.root, self.start)
        close = np.add.reduceat(np.where(here, self.weight, 0.0), self.start) >= self.need - 1e-9
        return [(*self.items[i], bool(phrase[i]), bool(close[i])) for i in np.flatnonzero(phrase | close)]


def _search(shared, slop):
    def run(batches):
        known = shared.value
        for batch in batches:
            rows = []
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]]
            for doc_ids, doc_starts, terms, bounds, positions in zip(*cols):
                if len(terms):
                    rows += search_segment(known.possible(terms.view(np.uint64)), terms, bounds, positions, doc_ids, doc_starts.astype(np.int64), slop)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["item_id", "doc_id", "phrase_words", "item_start", "doc_start", "coverage"])

    return run


def _known(benchmark: DataFrame) -> DataFrame:
    """(item_id, terms) of the items that have words."""
    d = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words_text(F.col("text")).alias("t"))
    return d.mapInArrow(_items, "item_id long, terms array<long>").where(F.size("terms") > 0)


def _slices(items: DataFrame, slice_words: int):
    part, n = [], 0
    for r in items.orderBy("item_id", "terms").toLocalIterator():
        part.append((r["item_id"], np.array(r["terms"], np.int64).view(np.uint64)))
        n += len(r["terms"])
        if n >= slice_words:
            yield part
            part, n = [], 0
    if part:
        yield part


class Terms:
    """A set of terms: sorted, or beyond ``TERMS`` a Bloom filter, which may take others for its own."""

    def __init__(self, terms: np.ndarray | None, bits: np.ndarray | None = None):
        self.terms, self.bits = terms, bits

    @staticmethod
    def places(h: np.ndarray) -> list[np.ndarray]:
        return [mix(h + np.uint64(j)) % np.uint64(FILTER_BITS) for j in (1, 2, 3)]

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            return self.terms[at] == h
        out = np.ones(len(h), bool)
        for p in self.places(h):
            out &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _terms_of(items: DataFrame) -> Terms | None:
    """The benchmark's terms; None where it has none."""
    t = items.select(F.explode("terms").alias("h")).distinct()
    n = t.count()
    if n <= TERMS:
        h = np.sort(t.toPandas()["h"].to_numpy(np.int64).view(np.uint64))
        return Terms(h) if n else None
    bits = np.zeros(FILTER_BITS >> 3, np.uint8)
    for part in t.mapInArrow(_filter_bytes, "part int, bits binary").groupBy("part").agg(F.collect_list("bits").alias("bits")).toLocalIterator():
        for b in part["bits"]:
            x = np.frombuffer(b, np.uint8)
            bits[part["part"] * len(x) : (part["part"] + 1) * len(x)] |= x
    return Terms(None, bits)


def _filter_bytes(batches):
    """Bytes of the filter, in parts, of the terms of a task."""
    bits = np.zeros(FILTER_BITS >> 3, np.uint8)
    for batch in batches:
        for p in Terms.places(batch.column(0).to_numpy().view(np.uint64)):
            np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
    size = 1 << 20
    for k in range(0, len(bits), size):
        if bits[k : k + size].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), pa.array([bits[k : k + size].tobytes()], pa.binary())], names=["part", "bits"])


def build_index(docs: DataFrame, terms: Terms, gap: int) -> DataFrame:
    """Segments of ``docs`` over ``terms``, stored."""
    sc = docs.sparkSession.sparkContext
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words_text(F.col("text")).alias("t"))
    return materialise(d.mapInArrow(_segments(sc.broadcast(terms), gap), SEGMENT), "segments")


def contaminated(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, coverage: float = COVERAGE, slop: int = SLOP, short: int = SHORT, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(item_id, doc_id, phrase_words: longest run or 0, item_start, doc_start, coverage: 0 below the bar), one row a matching pair."""
    spark = docs.sparkSession
    gap = max(GAP, 2 * slop + 1)
    items = _known(benchmark)
    terms = _terms_of(items)
    if terms is None:
        return spark.createDataFrame([], OUT)
    index = build_index(docs, terms, gap)
    total = int(index.agg(F.sum("n_words")).first()[0] or 0)
    pairs = index.select(F.explode(F.expr("transform(terms, (t, i) -> struct(t as term, bounds[i + 1] - bounds[i] as n))")).alias("x"))
    known = materialise(pairs.groupBy("x.term").agg(F.sum("x.n").alias("n")), "frequencies")
    out = []
    for part in _slices(items, slice_words):
        vocab = np.unique(np.concatenate([t for _, t in part]))
        own = spark.createDataFrame(pa.table({"term": vocab.view(np.int64)}))  # at most slice_words
        seen = known.join(F.broadcast(own), "term").toPandas()
        counts = np.zeros(len(vocab), np.int64)
        if len(seen):
            counts[np.searchsorted(vocab, seen["term"].to_numpy(np.int64).view(np.uint64))] = seen["n"].to_numpy()
        batch = [(i, Item(t, counts[np.searchsorted(vocab, t)], total, phrase, coverage, short)) for i, t in part]
        found = index.mapInArrow(_search(spark.sparkContext.broadcast(Batch(batch)), slop), OUT)
        w = Window.partitionBy("item_id", "doc_id").orderBy(F.desc("phrase_words"), F.desc("coverage"), "item_start", "doc_start")
        best = found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        out.append(materialise(best, "matches"))
    release(index, known)
    if not out:
        return spark.createDataFrame([], OUT)
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2])] + out[len(out) // 2 * 2 :]
    return out[0]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents that match an item; rows with a null doc_id stay."""
    (name,) = fresh(docs, "_bad")
    bad = contaminated(docs, benchmark, **params).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"] == bad[name], "left_anti")
