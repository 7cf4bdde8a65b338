"""Best-fit packing of documents into windows by patterns fitted with non-negative least squares.

A text's length is its number of words and marks (``tokens``; or give ``length`` as a column). Texts longer than
a window fill whole windows first; what is left over is a piece of less than a window. Pieces are counted by
length, rounded up to ``window / bins``: that histogram is all the driver sees. Patterns are the multisets of up
to ``width`` bins that fill a window but for ``slack`` bins; non-negative least squares fits how often each is
used so that the histogram is met; counts are rounded down, and the residual is packed largest first, each
window topped up with the largest bin that fits, many equal windows at a time. Pieces take their places in
their bin by rank of (doc_id, copy): rows are sorted in ranges, and a piece's rank is its place in its range and the
number of those of its bin in the ranges before, so no bin is held by one task and the result does not depend on the
number of ranges. No window holds more than ``window`` tokens, and every token of every text is in one.

Defined results: null and empty texts have no tokens and no place; rows with a null doc_id are left out; rows
that repeat a doc_id are packed each (``copy`` counts them by length); ties go by doc_id; no texts give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import materialise

WINDOW = 2048
BINS = 64
WIDTH = 4
SLACK = 1
#: Rows of a helper table (bins and ranges) up to which it is broadcast; beyond, it is joined by shuffle.
SMALL_ROWS = 500_000


def tokens(text: Column) -> Column:
    """Number of words and of single marks in a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]"))


def patterns(bins: int, width: int, slack: int) -> np.ndarray:
    """Rows: how many of each bin (1 to ``bins``, column 0 is bin 1) a full window takes."""
    out: list[list[int]] = []

    def grow(parts, top, room):
        if parts and room <= slack:
            out.append(list(parts))
        if len(parts) < width:
            for b in range(min(top, room), 0, -1):
                if b * (width - len(parts)) + slack < room:
                    break
                grow([*parts, b], b, room - b)

    grow([], bins, bins)
    a = np.zeros((len(out), bins))
    for i, parts in enumerate(out):
        for b in parts:
            a[i, b - 1] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 1000) -> np.ndarray:
    """Lawson and Hanson's active set method for min |a x - b| with x >= 0."""
    n = a.shape[1]
    x = np.zeros(n)
    on = np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(steps):
        w = a.T @ (b - a @ x)
        w[on] = -np.inf
        j = int(w.argmax())
        if w[j] <= tol:
            break
        on[j] = True
        while True:
            z = np.zeros(n)
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z[on] > 0).all():
                break
            bad = on & (z <= 0)
            step = (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min()
            x = np.maximum(0, x + step * (z - x))
            on &= x > 1e-12
            x[~on] = 0
        x = z
    return x


def recipes(hist: np.ndarray, width: int = WIDTH, slack: int = SLACK) -> list[tuple[int, list[int]]]:
    """(repeats, bins of one window) that use up ``hist`` (pieces of bin 1, 2, ...) exactly."""
    bins = len(hist)
    left = hist.astype(np.int64).copy()
    pats = patterns(bins, width, slack)
    out: list[tuple[int, list[int]]] = []

    def use(times: int, row: np.ndarray):
        nonlocal left
        left -= times * row.astype(np.int64)
        out.append((times, [b for b in range(bins, 0, -1) for _ in range(int(row[b - 1]))]))

    if left.sum():
        scale = left.max()
        x = nnls(pats.T, left / scale) * scale
        for i in np.argsort(-x, kind="stable"):
            row = pats[i]
            some = row > 0
            times = min(int(x[i] + 1e-9), int((left[some] // row[some]).min()))
            if times > 0:
                use(times, row)
    while left.any():  # the residual: largest first, best fit
        row = np.zeros(bins)
        room = bins
        while True:
            fit = [b for b in range(room, 0, -1) if left[b - 1] - row[b - 1] > 0] if room else []
            if not fit:
                break
            row[fit[0] - 1] += 1
            room -= fit[0]
        some = row > 0
        use(int((left[some] // row[some]).min()), row)
    return out


def places(found: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, last rank + 1, first window, pieces of that bin in a window), from ``recipes``."""
    taken: dict[int, int] = {}
    out, window = [], 0
    for times, bins in found:
        for b in sorted(set(bins), reverse=True):
            m = bins.count(b)
            a = taken.get(b, 0)
            out.append((b, a, a + times * m, window, m))
            taken[b] = a + times * m
        window += times
    return out


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def _ranged(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` sorted by ``by`` in ranges, stored, with ``range`` and ``pos``: the number of the range and the place in it."""
    at = F.monotonically_increasing_id()
    some = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    some = materialise(some.withColumn("_at", at), "ranges")
    return some.withColumn("range", F.shiftright("_at", 33)).withColumn("pos", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")


def pack(docs: DataFrame, window: int = WINDOW, bins: int = BINS, width: int = WIDTH, slack: int = SLACK, length: Column | None = None) -> DataFrame:
    """(doc_id, copy, piece, doc_start, n_tokens, window_id, window_start): where each stretch of tokens goes. Window ids run from 0 without gaps for pieces; whole windows come after them."""
    spark = docs.sparkSession
    n = (tokens(F.col("text")) if length is None else length).cast("long")
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")).where("n > 0")
    given = given.withColumn("copy", (F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1).cast("long"))
    unit = -(-window // bins)
    rest = F.col("n") % window
    total = materialise(given.select("doc_id", "copy", "n", F.floor(F.col("n") / window).alias("whole"), rest.alias("rest"), F.ceil(rest / unit).cast("int").alias("bin")), "lengths")
    pieces = _ranged(total.where("rest > 0"), "bin", "doc_id", "copy")
    cells = pieces.groupBy("bin", "range").agg(F.min("pos").alias("pos0"), F.count("*").alias("many"))
    before = Window.partitionBy("bin").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialise(cells.withColumn("base", F.coalesce(F.sum("many").over(before), F.lit(0))), "cells")
    top = -(-window // unit)
    hist = np.zeros(top, np.int64)
    for r in cells.groupBy("bin").agg(F.sum("many").alias("n")).collect():  # a row a bin
        hist[r["bin"] - 1] = r["n"]
    found = recipes(hist, width, slack)
    windows = sum(t for t, _ in found)
    spot = spark.createDataFrame(places(found), "bin int, first long, past long, window0 long, many int").groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("first", "past", "window0", "many"))).alias("spots"))
    placed = pieces.join(_small(cells.select("bin", "range", "pos0", "base")), ["bin", "range"]).withColumn("r", F.col("pos") - F.col("pos0") + F.col("base"))
    placed = placed.join(F.broadcast(spot), "bin").withColumn("s", F.expr("filter(spots, x -> x.first <= r and r < x.past)[0]"))
    placed = placed.select("doc_id", "copy", F.col("whole").alias("piece"), (F.col("n") - F.col("rest")).alias("doc_start"), F.col("rest").alias("n_tokens"), (F.col("s.window0") + F.floor((F.col("r") - F.col("s.first")) / F.col("s.many"))).alias("window_id"))
    w = Window.partitionBy("window_id").orderBy(F.desc("n_tokens"), "doc_id", "copy")
    start = F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("window_start", start)
    long = _ranged(total.where("whole > 0"), "doc_id", "copy")
    # one row a range, so this window is as small as the number of ranges
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = long.groupBy("range").agg(F.sum("whole").alias("many"))
    sums = materialise(sums.select("range", (F.coalesce(F.sum("many").over(before), F.lit(0)) + windows).alias("base")), "sums")
    w = Window.partitionBy("range").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    full = long.withColumn("w0", F.coalesce(F.sum("whole").over(w), F.lit(0))).join(_small(sums), "range").withColumn("w0", F.col("w0") + F.col("base"))
    full = full.select("doc_id", "copy", "w0", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece"))
    full = full.select("doc_id", "copy", "piece", (F.col("piece") * window).alias("doc_start"), F.lit(window).cast("long").alias("n_tokens"), (F.col("w0") + F.col("piece")).alias("window_id"), F.lit(0).cast("long").alias("window_start"))
    return placed.unionByName(full)
