"""Near duplicates: 128-bit SimHash, searched by an LSH forest.

A document's features are its distinct words; each bit is the majority vote of the features' hash bits. Two documents
are near duplicates when their signatures differ in at most ``radius`` bits. Equal signatures are collapsed first.

The forest has ``trees`` tries, each over its own random permutation of the bits. In a trie, a node that holds
more than ``leaf`` signatures is split, so prefixes grow with density; where that goes beyond the depth at
which all tries together find a pair at ``radius`` with probability ``recall``, the search climbs back to
that depth. All signatures under one final prefix are compared in full, without caps; in a large leaf only those that
are not yet connected, which finds the same components. The number of tries follows from the number n of signatures, so
leaves stay near ``leaf`` at any size: it grows as about n^0.3, the exponent of bit-sampling LSH at this radius.

Defined results: rows with a null doc_id are left out; null and empty texts have no features and are never
duplicates; repeated rows of a doc_id are one document (that with the smallest text fingerprint counts, and is the row
that stays where whole rows are returned; of equal ones that with the smallest hash of the row); extra columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leafmill.llm.common import fresh, materialise, mix, release, steps, words, words_text

BITS = 128
KEY_BITS = 32
#: Share of equal bits of unrelated texts of one language, measured; sets how deep tries grow.
UNRELATED = 0.53
#: Ids up to which they are broadcast, so that texts stay where they are; more are joined by shuffle.
SMALL = 1_000_000
#: Entries of a task that are held before those in complete leaves are searched; a leaf of more than LARGE is not compared pair by pair.
HELD, LARGE = 200_000, 1024

SIG = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])


def sign_step(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of the word sequence, two words of signature) of each text; fingerprint 0 marks one without words."""
    h, _, begin, of = words(data, offs)
    m = len(offs) - 1
    fp = np.zeros(m, np.uint64)
    sig = np.zeros((m, 2), np.uint64)
    if not len(h):
        return fp, sig
    has = np.flatnonzero(np.diff(begin))
    place = np.arange(len(h), dtype=np.uint64) - begin[of].astype(np.uint64)
    fp[has] = mix(np.add.reduceat(mix(h + place * np.uint64(0xD6E8FEB86659FD93)), begin[has])) | np.uint64(1)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    begin = np.searchsorted(of, has)
    n = np.diff(np.append(begin, len(of)))
    bounds = [0]
    while bounds[-1] < len(has):  # 64k words at a time: their bits take 8 MB
        k = int(np.searchsorted(begin, begin[bounds[-1]] + 65536, "right")) - 1
        bounds.append(min(len(has), max(bounds[-1] + 1, k)))
    for part in range(2):
        for a, b in zip(bounds, bounds[1:]):
            lo, hi = begin[a], begin[b] if b < len(has) else len(of)
            x = mix(h[lo:hi] + np.uint64((part + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1)
            votes = np.add.reduceat(bits, begin[a:b] - lo, axis=0, dtype=np.int32)
            on = votes * 2 > n[a:b, None]
            sig[has[a:b], part] = np.ascontiguousarray(np.packbits(on, axis=1)).view(np.uint64)[:, 0]
    return fp, sig


def _sign(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, offs in steps(batch, "t"):
            fp, sig = sign_step(data, offs)
            ok = fp != 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo:hi][ok]), *(pa.array(x[ok].view(np.int64)) for x in (fp, sig[:, 0].copy(), sig[:, 1].copy()))], schema=SIG
            )


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, hi, lo) of each document that has words."""
    d = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), words_text(F.col("text")).alias("t"))
    return d.mapInArrow(_sign, "doc_id long, fp long, hi long, lo long")


def hit(depth: int, radius: int) -> float:
    """Probability that signatures ``radius`` bits apart agree on ``depth`` random bits."""
    return math.prod((BITS - radius - i) / (BITS - i) for i in range(depth))


def plan(n: int, radius: int, recall: float, leaf: int) -> tuple[int, int]:
    """(tries, deepest prefix): tries so many that ``recall`` at ``radius`` holds at the depth that gives leaves of ``leaf``."""
    want = min(KEY_BITS, max(4, math.ceil(math.log(max(n, 2) / leaf) / -math.log(UNRELATED)))) if n > leaf else 4
    trees = max(8, math.ceil(math.log(1 - recall) / math.log(1 - hit(want, radius))))
    depth = want
    while depth < KEY_BITS and 1 - (1 - hit(depth + 1, radius)) ** trees >= recall:
        depth += 1
    return trees, depth


def permutations(trees: int) -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(BITS)[:KEY_BITS] for _ in range(trees)])


def _plant(trees: int, cut: int):
    perm = permutations(trees)

    def run(batches):
        for batch in batches:
            ids, hi, lo = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a in range(0, len(ids), 20000):
                sig = np.stack([hi[a : a + 20000], lo[a : a + 20000]], 1)
                bits = np.unpackbits(sig.view(np.uint8), axis=1)
                for t in range(trees):
                    key = np.ascontiguousarray(np.packbits(bits[:, perm[t]], axis=1)).view(">u4")[:, 0].astype(np.int64)
                    n = len(key)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((np.int64(t) << cut) | (key >> (KEY_BITS - cut))).cast(pa.int64()), pa.array(key), pa.array(ids[a : a + n]), pa.array(sig[:, 0].copy()), pa.array(sig[:, 1].copy())],
                        names=["branch", "key", "id", "hi", "lo"],
                    )

    return run


def _common(key: np.ndarray, branch: np.ndarray) -> np.ndarray:
    """Bits that each entry of sorted (branch, key) shares with the next; -1 across branches."""
    diff = (key[1:] ^ key[:-1]).astype(np.float64)
    return np.where(branch[1:] == branch[:-1], KEY_BITS - np.frexp(diff)[1], -1)


def leaves(key: np.ndarray, branch: np.ndarray, cut: int, depth: int, leaf: int, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> np.ndarray:
    """Leaf number of each entry of sorted (branch, key). ``before``, ``behind``: how many entries of the first and last one's nodes of each depth are elsewhere."""
    n = len(key)
    common = _common(key, branch)
    start = np.zeros(n, bool)
    start[0] = True
    open_ = np.ones(n, bool)
    for d in range(cut, depth + 1):
        new = np.ones(n, bool)
        new[1:] = common < d
        node = np.cumsum(new) - 1
        size = np.bincount(node)
        if before is not None:
            size[0] += before[d]
        if behind is not None:
            size[-1] += behind[d]
        done = open_ & ((size[node] <= leaf) | (d == depth))
        start |= new & done
        open_ &= ~done
        if not open_.any():
            break
    return np.cumsum(start) - 1


def ready(key: np.ndarray, branch: np.ndarray, cut: int, depth: int, leaf: int, before: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many entries of sorted (branch, key), of which more may follow, lie in leaves that are complete; ``before`` for the rest, and ``behind`` for these."""
    common = _common(key, branch)
    last = len(key)
    begin = np.zeros(depth + 2, np.int64)  # where the last entry's node of each depth begins
    for d in range(cut, depth + 1):
        apart = np.flatnonzero(common < d)
        begin[d] = apart[-1] + 1 if len(apart) else 0
    size = np.array([last - begin[d] + (before[d] if not begin[d] else 0) for d in range(depth + 1)])
    # a node of more than ``leaf`` entries is split for certain, so all its children but the last entry's are complete
    d = cut
    while d < depth and size[d] > leaf:
        d += 1
    end = int(begin[d])
    after = np.array([end - begin[x] + (before[x] if not begin[x] else 0) if x < d else 0 for x in range(depth + 1)])
    behind = np.array([last - end if x < d and begin[x] < end else 0 for x in range(depth + 1)])
    return end, np.maximum(after, 0) if end else before, behind


def _blocks(hi, lo, radius):
    """Pairs of one large leaf, some rows at a time."""
    n = len(hi)
    rows = max(1, 2_000_000 // n)
    for a in range(0, n, rows):
        d = np.bitwise_count(hi[a : a + rows, None] ^ hi[None, a:]) + np.bitwise_count(lo[a : a + rows, None] ^ lo[None, a:])
        i, j = np.nonzero(d <= radius)
        ok = j > i
        yield i[ok] + a, j[ok] + a


def close_pairs(leaf_of: np.ndarray, hi: np.ndarray, lo: np.ndarray, radius: int):
    """Yield arrays (i, j) of positions in the same leaf whose signatures differ in at most ``radius`` bits."""
    size = np.bincount(leaf_of)
    small = size[leaf_of] <= 256
    at = np.flatnonzero(small)
    k = 1
    while len(at):
        at = at[at + k < len(leaf_of)]
        at = at[leaf_of[at] == leaf_of[at + k]]
        d = np.bitwise_count(hi[at] ^ hi[at + k]) + np.bitwise_count(lo[at] ^ lo[at + k])
        ok = at[d <= radius]
        if len(ok):
            yield ok, ok + k
        k += 1
    first = np.searchsorted(leaf_of, np.arange(len(size)))
    for x in np.flatnonzero(size > 256):
        s = slice(first[x], first[x] + size[x])
        for i, j in _blocks(hi[s], lo[s], radius):
            yield i + first[x], j + first[x]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join components of ``label`` (smallest member each) along edges, in place."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        m = np.minimum(a, b)
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _connect(hi: np.ndarray, lo: np.ndarray, radius: int) -> np.ndarray:
    """Component (smallest position) of each row of one large leaf: rows already connected are not compared again."""
    n = len(hi)
    label = np.arange(n)
    todo = np.arange(n)
    while len(todo):
        # a row of the component that has most rows left is compared with what is outside it
        i = todo[0]
        out = np.flatnonzero(label != label[i])
        if not len(out):
            break
        d = np.bitwise_count(hi[out] ^ hi[i]) + np.bitwise_count(lo[out] ^ lo[i])
        near = out[d <= radius]
        if len(near):
            met = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, met)] = met[0]
        # the rows of the largest component need not be looked at: all others are compared with them
        big = np.bincount(label).argmax()
        todo = todo[1:]
        todo = todo[label[todo] != big] if label[i] == big else todo
    return label


def _search(cut: int, depth: int, leaf: int, radius: int, pairs: bool):
    def solve(cols, before, behind):
        branch, key, ids, hi, lo = cols
        leaf_of = leaves(key, branch, cut, depth, leaf, before, behind)
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)
        size = np.bincount(leaf_of)
        large = np.zeros(0, np.int64) if pairs else np.flatnonzero(size > LARGE)
        node, of = np.unique(ids, return_inverse=True)
        label = np.arange(len(node))
        first = np.searchsorted(leaf_of, large)
        for x, a in zip(large, first):
            part = slice(a, a + size[x])
            own = _connect(hi[part], lo[part], radius)
            _merge(label, of[part], of[part][own])
        rest = ~np.isin(leaf_of, large)
        back = np.flatnonzero(rest)
        if len(back):
            for i, j in close_pairs(np.unique(leaf_of[rest], return_inverse=True)[1], hi[rest], lo[rest], radius):
                i, j = back[i], back[j]
                if pairs:
                    yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                else:
                    _merge(label, of[i], of[j])
        if not pairs:
            moved = np.flatnonzero(label != np.arange(len(node)))
            yield node[label[moved]], node[moved]

    def run(batches):
        held: list[list[np.ndarray]] = []
        size, before = 0, np.zeros(depth + 1, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += len(batch)
            if size < HELD:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            end, after, behind = ready(cols[1], cols[0], cut, depth, leaf, before)
            held, size = [[c[end:] for c in cols]], size - end
            if end:
                yield from out([c[:end] for c in cols], before, behind)
                before = after
        if size:
            yield from out([np.concatenate(c) for c in zip(*held)], before, None)

    def out(cols, before, behind):
        for a, b in solve(cols, before, behind):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def forest(reps: DataFrame, n: int, radius: int, recall: float, leaf: int, pairs: bool = False) -> DataFrame:
    """Links (a, b), a < b, found among ``n`` rows (doc_id, hi, lo): all close pairs, or as many links as keep them connected."""
    trees, depth = plan(n, radius, recall, leaf)
    cut = min(depth, max(0, math.floor(math.log2(max(1, n) / 20_000))))
    planted = reps.select("doc_id", "hi", "lo").mapInArrow(_plant(trees, cut), "branch long, key long, id long, hi long, lo long")
    grouped = planted.repartition("branch").sortWithinPartitions("branch", "key", "id")
    return grouped.mapInArrow(_search(cut, depth, leaf, radius, pairs), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of each connected component, for nodes other than roots.

    Alternating large-star and small-star steps; each round is a written table, so lineage stays short.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(mark) == seen:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = tuple(mark)
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        # smallest neighbours are found by partial aggregation, so a hub of many links fills no task
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        to = large.join(low, "v")
        small = to.select(F.col("u").alias("v"), F.col("m").alias("u")).union(to.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        after = materialise(small, "links")
        release(now)
        now = after


def near_duplicates(docs: DataFrame, radius: int = 22, recall: float = 0.9, leaf: int = 64) -> DataFrame:
    """(doc_id, group_id) of each document that is a copy or near copy of one with a smaller id; group_id is the group's smallest doc_id."""
    sig = materialise(signatures(docs), "signatures")
    one = sig.groupBy("doc_id").agg(F.min(F.struct("fp", "hi", "lo")).alias("s")).select("doc_id", "s.hi", "s.lo")
    one = materialise(one, "documents")
    rep = materialise(one.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "representatives")
    member = one.join(rep, ["hi", "lo"]).select("doc_id", "rep")
    release(sig)
    reps = rep.select(F.col("rep").alias("doc_id"), "hi", "lo")
    root = components(forest(reps, reps.count(), radius, recall, leaf))
    found = member.join(root.withColumnRenamed("node", "rep"), "rep", "left")
    return found.select("doc_id", F.coalesce("root", "rep").alias("group_id")).where("group_id <> doc_id")


def simhash_groups(docs: DataFrame, radius: int = 22, recall: float = 0.9, leaf: int = 64) -> DataFrame:
    """One row per document of a group of two or more: (doc_id, group_id, group_size, kept)."""
    lost = materialise(near_duplicates(docs, radius, recall, leaf), "duplicates")
    size = lost.groupBy("group_id").agg((F.count("*") + 1).alias("group_size"))
    all_ = lost.select("doc_id", "group_id").union(size.select(F.col("group_id").alias("doc_id"), "group_id"))
    return all_.join(size, "group_id").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, radius: int = 22, recall: float = 0.9, leaf: int = 64) -> DataFrame:
    """``docs`` with one document of each group left, that with the smallest doc_id; of rows that repeat a doc_id one stays. Rows with a null doc_id stay."""
    lost_, twice_ = fresh(docs, "_lost", "_twice")
    lost = materialise(near_duplicates(docs, radius, recall, leaf).select(F.col("doc_id").alias(lost_)), "lost")
    kept = docs.join(F.broadcast(lost) if lost.count() <= SMALL else lost, F.col("doc_id") == F.col(lost_), "left_anti")
    twice = materialise(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(twice_)).count().where("count > 1").select(twice_), "repeated")
    if twice.isEmpty():
        return kept
    single = kept.join(twice, F.col("doc_id") == F.col(twice_), "left_anti")
    again = kept.join(twice, F.col("doc_id") == F.col(twice_), "left_semi")
    t_, fp_ = fresh(docs, "_t", "_fp")
    names = docs.columns

    def print_(batches):
        for batch in batches:
            if len(batch):
                part = pa.RecordBatch.from_arrays([batch.column(0)], names=["t"])
                fp = np.concatenate([sign_step(data, offs)[0] for _, _, data, offs in steps(part, "t")])
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp.view(np.int64), mask=fp == 0)], names=[*names, fp_])

    cols = [F.col(f"`{c}`") for c in names]
    again = again.select(words_text(F.col("text")).alias(t_), *cols).mapInArrow(print_, StructType([*docs.schema.fields, StructField(fp_, LongType())]))
    key = F.struct(F.col(fp_).isNull(), F.col(fp_), F.xxhash64(*[F.to_json(F.struct(c)) for c in cols]))
    again = again.groupBy("doc_id").agg(F.min_by(F.struct(*cols), key).alias(t_)).select(f"{t_}.*")
    return single.unionByName(again)
