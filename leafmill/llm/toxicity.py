"""Toxicity by nearest labelled examples: exact TF-IDF cosine, distance-weighted votes, evidence.

Examples are labelled documents, at most about ``max_examples`` (chosen by hash of doc_id). Terms are all words that
at least ``min_df`` examples have. A term weighs (1 + ln tf) * idf * rf in a text; idf = ln((n + 1) / (df + 1)) over
the examples, and rf = log2(2 + toxic df / clean df) is its relevance frequency, between 1 and 1 + log2 of the
toxic examples: no term is dropped, but words that toxic examples have more often count more. Vectors have length one.

The ``DENSE`` most frequent terms have full lists, which are multiplied for many texts at once; of the other terms a text has,
all postings are added up. Weights of examples are single, sums double precision. The k-th best of the largest sums of
blocks of ``BLOCK`` examples bounds the k-th best cosine from below, and all examples that reach it are compared in double
precision, so the k nearest are exact; equal cosines go by smaller doc_id. Votes weigh 1 / (1 - cosine + 0.1); isotonic regression
of the examples' own leave-one-out votes turns votes into scores.

Defined results: a document without any term, so also one with null or empty text, scores the rate of toxic
examples among those without a neighbour and has no evidence; without toxic or without clean examples all
scores are 0; null labels are no examples; of several labels of a doc_id the largest counts; rows with a null
doc_id are left out by ``score`` and kept by ``drop_toxic``; repeated rows are scored each.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import judged, materialise, release, small_batches, steps, words, words_text

BLOCK = 128
#: Postings that are prepared together, a few MB.
CHUNK = 1 << 19
DENSE = 512
#: Texts whose dense sums are made together.
TOGETHER = 128
MAX_EXAMPLES = 20_000
MIN_DF = 2
NEIGHBOURS = 15
THRESHOLD = 0.5
SOFT = 0.1
#: More than single precision errs in a sum of ``DENSE`` terms of unit vectors.
SLACK = 1e-4

def _terms(batches):
    """Distinct words (hash, tf) of each example, one row an example."""
    for batch in batches:
        ids = batch.column(0)
        y = batch.column(1)
        for lo, hi, data, offs in steps(batch, "t"):
            h, _, _, of = words(data, offs)
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))) if len(h) else np.zeros(0, np.int64)
            tf = np.diff(np.append(new, len(h)))
            bounds = pa.array(np.searchsorted(of[new], np.arange(hi - lo + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids[lo:hi], y[lo:hi], pa.ListArray.from_arrays(bounds, pa.array(h[new].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))],
                names=["doc_id", "toxic", "terms", "tf"],
            )


class BlockMaxIndex:
    """Postings of unit vectors by term; the largest sums of blocks of vectors tell which vectors can be near.

    ``row``, ``term``, ``tf``: the vectors' entries; ``weight``: a term's weight; ``ids`` and ``toxic``: a row's document and
    label. Counts instead of weights are sent and stored, a tenth of the size, and weights made where the index is used:
    what is made here can be pickled, and only what is unpickled can be searched, as the driver has no room for both.
    """

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        n = len(ids)
        order = np.argsort(ids, kind="stable")
        to = np.empty(n, np.int32)
        to[order] = np.arange(n)
        tf = tf.astype(np.min_scalar_type(int(tf.max(initial=0))))
        parts = [slice(c, c + CHUNK) for c in range(0, len(row), CHUNK)]
        df, norm = np.zeros(len(weight), np.int64), np.zeros(n)
        for x in parts:
            df += np.bincount(term[x], minlength=len(weight))
            w = ((1 + np.log(tf[x].astype(np.float64))) * weight[term[x]]).astype(np.float32)
            norm += np.bincount(row[x], w.astype(np.float64) ** 2, n)
        norm = np.sqrt(norm)
        norm[norm == 0] = 1
        often = np.sort(np.argsort(-df, kind="stable")[:DENSE])
        place = np.full(len(weight), -1, np.int32)
        place[often] = np.arange(len(often))
        dense = np.zeros((len(often), -(-max(n, 1) // BLOCK) * BLOCK), tf.dtype)
        df[often] = 0
        # each part's postings go behind those of the parts before, term by term
        fill = np.cumsum(df) - df
        rows, tfs = np.empty(int(df.sum()), np.min_scalar_type(n)), np.empty(int(df.sum()), tf.dtype)
        for x in parts:
            r, t, f = to[row[x]], term[x].astype(np.int64), tf[x]
            full = place[t] >= 0
            dense[place[t[full]], r[full]] = f[full]
            s = np.flatnonzero(~full)
            s = s[np.argsort(t[s] * n + r[s])]
            t = t[s]
            new = np.flatnonzero(np.append(True, t[1:] != t[:-1])[: len(t)])
            size = np.diff(np.append(new, len(t)))
            at = np.arange(len(t)) + np.repeat(fill[t[new]] - new, size)
            rows[at], tfs[at] = r[s], f[s]
            fill[t[new]] += size
        self.packed = ids[order], toxic[order], norm[order], weight, often, dense, df.astype(np.int32), rows, tfs

    def _build(self, *packed) -> None:
        self.ids, self.toxic, norm, weight, often, dense, df, row, tf = packed
        self.blocks = dense.shape[1] // BLOCK
        self.often = np.full(len(weight), -1, np.int32)
        self.often[often] = np.arange(len(often))
        wide = np.append(norm, np.ones(dense.shape[1] - len(norm)))
        self.dense = np.zeros(dense.shape, np.float32)
        for to, t, w in zip(self.dense, dense, weight[often]):
            has = np.flatnonzero(t)
            to[has] = (1 + np.log(t[has].astype(np.float64))) * w / wide[has]
        term = np.repeat(np.arange(len(weight), dtype=np.int32), df)
        # row and weight side by side, so that a term's postings are one stretch of memory
        self.post = np.empty((len(row), 2), np.float32)
        self.post.view(np.uint32)[:, 0] = row
        for c in range(0, len(row), CHUNK):
            part = slice(c, c + CHUNK)
            self.post[part, 1] = (1 + np.log(tf[part].astype(np.float64))) * weight[term[part]] / norm[row[part]]
        self.start = np.append(0, np.cumsum(df, dtype=np.int32))

    def __getstate__(self):
        return zlib.compress(pickle.dumps(self.packed, protocol=5), 1)

    def __setstate__(self, state):
        self._build(*pickle.loads(zlib.decompress(state)))  # noqa: S301

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, leave: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions and cosines of the k nearest, with a cosine above 0, of each (terms, weights); ``leave`` are positions to pass over."""
        out = []
        for a in range(0, len(queries), TOGETHER):
            part = queries[a : a + TOGETHER]
            q = np.zeros((len(part), len(self.dense)), np.float32)
            for i, (t, w) in enumerate(part):
                d = self.often[t]
                q[i, d[d >= 0]] = w[d >= 0]
            sums = q @ self.dense
            for i, (t, w) in enumerate(part):
                out.append(self._nearest(sums[i], t, w, k, -1 if leave is None else leave[a + i]))
        return out

    def _nearest(self, sums, terms, weights, k, leave):
        d = self.often[terms]
        full, rest = d >= 0, d < 0
        d, wd, terms, weights = d[full], weights[full], terms[rest], weights[rest]
        start, end = self.start[terms], self.start[terms + 1]
        post = np.concatenate([self.post[:0], *[self.post[a:b] for a, b in zip(start.tolist(), end.tolist())]])
        sparse = np.bincount(post.view(np.uint32)[:, 0], np.repeat(weights, end - start) * post[:, 1], self.blocks * BLOCK)
        # single precision chooses the rows that are then compared in double
        near = sums + sparse
        near[len(self.ids) :] = -1
        if leave >= 0:
            near[leave] = -1
        # k blocks have a row as good as the k-th best of their largest sums
        tops = near.reshape(-1, BLOCK).max(1) if k <= self.blocks else near
        least = max(-SLACK, np.partition(tops, -k)[-k] - 2 * SLACK) if k <= len(tops) else -SLACK
        near_i = np.flatnonzero(near >= least)
        if len(near_i) > k:
            near_i = near_i[near[near_i] >= np.partition(near[near_i], -k)[-k] - 2 * SLACK]
        c = np.round(wd @ self.dense[d[:, None], near_i].astype(np.float64) + sparse[near_i], 12)
        keep = np.lexsort((near_i, -c))[:k]
        keep = keep[c[keep] > 0]
        return near_i[keep], c[keep]

    def vote(self, rows: np.ndarray, cos: np.ndarray) -> float:
        w = 1 / (1 - cos + SOFT)
        return float((w * self.toxic[rows]).sum() / w.sum()) if len(rows) else -1.0


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on x (pool adjacent violators)."""
    ux, inv = np.unique(x, return_inverse=True)
    n = np.bincount(inv).astype(float)
    blocks: list[list[float]] = []
    for v, c, s in zip(ux, n, np.bincount(inv, y)):
        blocks.append([v, v, s, c])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1][1] = b[1]
            blocks[-1][2] += b[2]
            blocks[-1][3] += b[3]
    knots = [(v, s / c) for a, b, s, c in blocks for v in ((a,) if a == b else (a, b))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    """Terms, their weights and the index of the examples: all bounded by ``max_examples``. ``calibrate`` completes it.

    ``ids``, ``toxic``, ``size``: the examples and their numbers of terms; ``terms``, ``tf``: these (positions in the sorted ``vocab``).
    """

    def __init__(self, vocab: np.ndarray, df: np.ndarray, bad: np.ndarray, ids: np.ndarray, toxic: np.ndarray, size: np.ndarray, terms: np.ndarray, tf: np.ndarray, k: int):
        n, pos = len(ids), int(toxic.sum())
        self.k, self.vocab = k, vocab
        self.usable = 0 < pos < n
        self.base, self.knots = pos / max(n, 1), (np.zeros(1), np.zeros(1))
        self.weight = np.log((n + 1) / (df + 1.0)) * np.log2(2 + bad / np.maximum(1, df - bad))
        self.index = BlockMaxIndex(ids, toxic, np.repeat(np.arange(n, dtype=np.int32), size), terms, tf, self.weight)

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of positions in the vocabulary and their counts."""
        w = (1 + np.log(tf)) * self.weight[terms]
        norm = np.sqrt((w * w).sum())
        return (terms, w / norm) if norm > 0 else (terms[:0], w[:0])

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """Fit scores to the examples' leave-one-out votes (-1: no neighbour)."""
        lone = votes < 0
        if lone.any():
            self.base = float(toxic[lone].mean())
        self.knots = isotonic(votes[~lone], toxic[~lone]) if not lone.all() else (np.zeros(1), np.full(1, self.base))

    def score(self, votes: np.ndarray) -> np.ndarray:
        return np.where(votes < 0, self.base, np.interp(votes, *self.knots))


def _picked(known, batches):
    """(doc_id, toxic, terms as positions in the sorted ``known``, tf)."""
    for batch in batches:
        terms, tf = batch.column(2), batch.column(3)
        h = terms.flatten().to_numpy().view(np.uint64)
        begin = terms.offsets.to_numpy() - terms.offsets[0].as_py()
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        ok = known[at] == h if len(known) else np.zeros(len(h), bool)
        bounds = pa.array(np.append(0, np.cumsum(ok))[begin].astype(np.int32))
        # terms are sorted by hash, and so are the positions
        cols = [batch.column(0), batch.column(1), pa.ListArray.from_arrays(bounds, pa.array(at[ok].astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.flatten().to_numpy()[ok]))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "toxic", "terms", "tf"])


def _own_votes(shared):
    """(toxic, leave-one-out vote) of each example. Terms are picked here too: one Python function after another would hold two workers a task."""

    def run(batches):
        m = shared.value
        place = {int(i): p for p, i in enumerate(m.index.ids)}
        for batch in _picked(m.vocab, batches):
            ids = batch.column(0).to_pylist()
            q = [m.vector(np.asarray(t, np.int64), f) for t, f in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3)))]
            found = m.index.search(q, m.k, [place[i] for i in ids])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([m.index.vote(*x) for x in found], pa.float64())], names=["toxic", "vote"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, min_df: int = MIN_DF, k: int = NEIGHBOURS) -> Model:
    """Fit on labelled documents. The examples and their terms reach the driver: bounded by ``max_examples``, whatever the size of ``docs``."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    lab = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = lab.count()
    if n > max_examples:
        unit = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30))
        lab = lab.where(unit < int(max_examples / n * (1 << 30)))
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    kind = "doc_id long, toxic int, terms array<long>, tf array<int>"
    # at most about max_examples labels are broadcast, so that texts stay where they are
    rows = text.join(F.broadcast(lab), "doc_id").select("doc_id", "toxic", words_text(F.col("text")).alias("t")).mapInArrow(_terms, kind)
    rows = materialise(rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "terms", "tf")).alias("x")).select("doc_id", "x.*"), "examples")
    df = rows.select("toxic", F.explode("terms").alias("h")).groupBy("h").agg(F.count("*").alias("df"), F.sum("toxic").alias("bad")).where(F.col("df") >= min_df)
    terms = df.toPandas().sort_values("h", key=lambda h: h.to_numpy(np.int64).view(np.uint64))
    h = terms["h"].to_numpy(np.int64).view(np.uint64)
    vocab = sc.broadcast(h)
    t = rows.mapInArrow(lambda batches: _picked(vocab.value, batches), "doc_id long, toxic int, terms array<int>, tf array<int>").toArrow()
    join = lambda xs: np.concatenate([np.zeros(0, np.int32), *xs])
    size = join([np.diff(x.offsets.to_numpy()) for x in t["terms"].chunks])
    flat = [join([x.flatten().to_numpy() for x in t[c].chunks]) for c in ("terms", "tf")]
    ids, toxic = t["doc_id"].to_numpy(), t["toxic"].to_numpy().astype(np.int64)
    del t
    m = Model(h, terms["df"].to_numpy(np.float64), terms["bad"].to_numpy(np.float64), ids, toxic, size, *flat, k)
    m.shared = None
    shared = sc.broadcast(m)
    if m.usable:
        votes = rows.mapInArrow(_own_votes(shared), "toxic int, vote double").toPandas()
        m.calibrate(votes["vote"].to_numpy(), votes["toxic"].to_numpy(np.float64))
    m.index, m.vocab, m.weight, m.shared = None, None, None, shared  # the driver keeps what is small
    vocab.destroy()
    release(rows)
    return m


def _complete(m: Model) -> Model:
    """A fitted model with the index that was broadcast for it."""
    whole = m.shared.value
    whole.base, whole.knots = m.base, m.knots
    return whole


def _score_rows(m, data, offs):
    """Score of each text, and the nearest examples of those that have terms."""
    h, _, _, of = words(data, offs)
    n = len(offs) - 1
    near: dict[int, tuple] = {}
    votes = np.full(n, -1.0)
    if not m.usable:
        return np.zeros(n), near
    if len(m.vocab) and len(h):
        at = np.minimum(np.searchsorted(m.vocab, h), len(m.vocab) - 1)
        ok = np.flatnonzero(m.vocab[at] == h)
        key, tf = np.unique(of[ok] * len(m.vocab) + at[ok], return_counts=True)
        row, term = key // len(m.vocab), key % len(m.vocab)
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))[: len(row)]
        ends = np.append(begin[1:], len(row))
        found = m.index.search([m.vector(term[a:b], tf[a:b]) for a, b in zip(begin, ends)], m.k)
        for a, x in zip(begin, found):
            near[int(row[a])] = (m.index.ids[x[0]], x[1])
            votes[row[a]] = m.index.vote(*x)
    return m.score(votes), near


def _score(fitted, threshold):
    def run(batches):
        m = _complete(fitted)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in steps(batch, "t"):
                score, near = _score_rows(m, data, offs)
                evidence = [[{"doc_id": int(i), "cosine": float(c)} for i, c in zip(*near[r])] if r in near else [] for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], pa.array(score), pa.array(score >= threshold), pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])))],
                    names=["doc_id", "score", "toxic", "evidence"],
                )

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None, **fitting) -> DataFrame:
    """(doc_id, score, toxic, evidence: nearest labelled documents and their cosines)."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, labels, **fitting)
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words_text(F.col("text")).alias("t"))
    return d.mapInArrow(_score(model, threshold), "doc_id long, score double, toxic boolean, evidence array<struct<doc_id: long, cosine: double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; each row is judged by its own text."""
    fitted = fit(docs, labels, **fitting)

    def prepare():
        m = _complete(fitted)
        return lambda data, offs: _score_rows(m, data, offs)[0] < threshold

    return docs.where(judged(prepare, words_text(F.col("text"))))
