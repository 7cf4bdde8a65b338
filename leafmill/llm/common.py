"""Shared pieces: canonical word text, vectorised word hashing over Arrow buffers, durable tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.durable import _own_dir, materialise, qualified, release, scratch, shared_dir  # noqa: F401

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch; a task's JVM and its Python worker hold several copies of one, and buffers that grow by doubling. A longer text is a batch of its own.
BATCH_BYTES = 1 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that Parquet's reader puts in one vector; Spark's 4,096 texts are arrays of many MB, each grown by copying.
READ_ROWS = 256
READ_CONF = "spark.sql.parquet.columnarReaderBatchSize"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches be ``BATCH_BYTES`` and Parquet's ``READ_ROWS`` in this session, unless it has limits of its own; Spark's Arrow batches are 64 MB or 10,000 rows, so a whole partition is often one."""
    for key, most in ((BATCH_CONF, BATCH_BYTES), (READ_CONF, READ_ROWS)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def judged(prepare: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], text: Column, limit: int = STEP_BYTES) -> Column:
    """True or false for each text by a function of (bytes, offsets), which ``prepare`` makes in the worker. Only ``text`` goes to Python, and other columns stay where they are."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = prepare()
        for a in arrays:
            batch = pa.RecordBatch.from_arrays([a], names=["t"])
            yield pa.array(np.concatenate([np.zeros(0, bool), *(judge(data, offs) for _, _, data, offs in steps(batch, "t", limit))]))

    return F.arrow_udf(run, "boolean")(text)


_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_text(col: Column) -> Column:
    """Lower-cased words (runs of letters, marks and digits) joined by single spaces; null gives ''."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"[^\p{L}\p{M}\p{N}]+", " ")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def steps(batch: pa.RecordBatch, name: str, limit: int = STEP_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) over about ``limit`` bytes of a non-null string column."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n + 1:
        size = max(n + 1, STEP_BYTES + 1)
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (uint64) and byte lengths of all words of space-separated texts, in order; each text's first word (rows + 1); each word's text."""
    n = len(data)
    m = len(offs) - 1
    if n == 0:
        z = np.zeros(0, np.uint64)
        return z, z.astype(np.int64), np.zeros(m + 1, np.int64), z.astype(np.int64)
    w = data != 32
    first = w.copy()
    first[1:] &= ~w[:-1]
    at = offs[:-1][offs[:-1] < offs[1:]]
    first[at] = w[at]
    last = w.copy()
    last[:-1] &= ~w[1:]
    at = offs[1:][offs[:-1] < offs[1:]] - 1
    last[at] = w[at]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    p, q = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], dtype=np.uint64, out=total[1:])
    h = mix((total[end] - total[start]) * q[start])
    begin = np.searchsorted(start, offs)
    return h, end - start, begin, np.repeat(np.arange(m), np.diff(begin))


def word_hash(word: str) -> int:
    """The hash that ``words`` gives one word."""
    b = word.encode()
    return int(words(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0][0])
