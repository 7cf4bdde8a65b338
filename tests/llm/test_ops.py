"""The ten operators: against brute force, planted cases, exact round trips, and awkward inputs."""

import gzip
import hashlib
import itertools
import math
import pickle
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from leafmill.llm import chat, common, decontam, fingerprints, langid, licenses, packing, simhash, toxicity, urls, warc
from leafmill.llm.common import materialise, release, word_hash, words

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, lang="en", extra=False):
    """documents from (doc_id, text) pairs; ``extra`` adds columns whose names clash with inner ones."""
    rows = [(i, t, lang, "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOC)
    if extra:
        for c in ("t", "fp", "hi", "lo", "toxic", "rep", "root", "node", "group_id", "id", "sketch", "n", "bin", "_t", "score", "language", "key", "branch", "a", "b", "_lost", "_bad", "_twice", "_id"):
            df = df.withColumn(c, F.lit(1))
    return df


AWKWARD = [(None, "null id here"), (1, None), (2, ""), (3, " \n\t "), (4, "!!! ... ***"), (5, "word"), (5, "word"), (5, "another text under the same id"), (6, "tie word"), (7, "tie word"), (8, "x" * 300_000), (9, "lorem ipsum " * 40_000), (10, "日本語のテキスト"), (11, "naïve café ÄÖÜß é")]


def words_of(t):
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", t or "").lower().split()


def sentence(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


VOCAB = ["".join(p) for p in itertools.product(["ka", "lo", "mi", "tu", "ser", "van"], ["ran", "dol", "pit", "nes"], ["a", "o", "um", "ix"])]


# --- shared pieces


def test_word_hashes():
    t = ["", "a", "ab cd", "é ß x", "cd ab"]
    raw = [x.encode() for x in t]
    offs = np.append(0, np.cumsum([len(x) for x in raw]))
    h, size, begin, of = words(np.frombuffer(b"".join(raw), np.uint8), offs)
    flat = [w for x in t for w in x.split()]
    assert h.tolist() == [word_hash(w) for w in flat] and size.tolist() == [len(w.encode()) for w in flat]
    assert np.diff(begin).tolist() == [len(x.split()) for x in t] and of.tolist() == [i for i, x in enumerate(t) for _ in x.split()]


def test_materialise(spark):
    m = materialise(spark.range(3), "x")
    assert m.count() == 3
    release(m)
    with pytest.raises(Exception):
        spark.read.parquet(m._leafmill_path).count()


# --- 1 toxicity


def toxic_corpus(n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 4 == 0
        t = sentence(rng, rng.randint(8, 60), VOCAB).split()
        if bad:
            for w in rng.sample(["grmble", "snarfo", "blecht", "zorkun"], 2):
                t.insert(rng.randrange(len(t)), w)
        out.append((i, " ".join(t), int(bad)))
    return out


def test_toxicity_finds_planted_and_keeps_clean(spark):
    rows = toxic_corpus()
    docs = table(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows[:160]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    test = rows[160:]
    assert np.mean([got[i]["toxic"] for i, _, y in test if y]) >= 0.95 and np.mean([got[i]["toxic"] for i, _, y in test if not y]) <= 0.05
    hit = next(i for i, _, y in test if y)
    assert got[hit]["evidence"] and all(0 < e["cosine"] <= 1 for e in got[hit]["evidence"])
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i in got if not got[i]["toxic"]}


def test_block_max_is_exact():
    rng = np.random.default_rng(3)
    n, m = 1000, 700
    ids, weight = rng.permutation(n), rng.uniform(0.5, 5, m)
    vec = []
    for _ in ids:
        t = np.sort(rng.choice(m, rng.integers(1, 9), replace=False, p=np.arange(m, 0, -1) / 245350))
        vec.append((t, rng.integers(1, 4, len(t))))
    row = np.repeat(np.arange(n), [len(t) for t, _ in vec])
    index = toxicity.BlockMaxIndex(ids, rng.integers(0, 2, n), row, np.concatenate([t for t, _ in vec]), np.concatenate([f for _, f in vec]), weight)
    index = pickle.loads(pickle.dumps(index))
    assert 0 < (index.often >= 0).sum() < m and index.blocks > 4
    unit = [(t, w / np.linalg.norm(w)) for t, w in ((t, (1 + np.log(f)) * weight[t]) for t, f in vec)]
    dense = np.zeros((n, m))
    for i, (t, w) in enumerate(unit):
        dense[i, t] = w.astype(np.float32)
    for k in (1, 15, 200):
        for leave in (None, [int(np.flatnonzero(index.ids == ids[q])[0]) for q in range(60)]):
            found = index.search(unit[:60], k, leave)
            for q, (t, w) in enumerate(unit[:60]):
                cos = np.round(dense[:, t] @ w, 6)
                order = sorted((i for i in range(n) if cos[i] > 0 and (leave is None or i != q)), key=lambda i: (-cos[i], ids[i]))[:k]
                got = np.round(found[q][1], 6)
                assert np.allclose(got, cos[order], atol=2e-6)
                assert {int(i) for i, c in zip(index.ids[found[q][0]], got) if c > got[-1] + 4e-6} == {int(ids[i]) for i in order if cos[i] > got[-1] + 4e-6}
                assert [(-c, i) for c, i in zip(found[q][1], index.ids[found[q][0]])] == sorted((-c, i) for c, i in zip(found[q][1], index.ids[found[q][0]]))


def brute_toxicity(docs, labels, k):
    """Score and neighbours of each text, by lists and loops."""
    lab = {i: max(y for j, y in labels if j == i) for i, _ in labels}
    ex = {i: Counter(words_of(t)) for i, t in docs if i in lab}
    n, bad, df = len(ex), Counter(), Counter()
    for i, c in ex.items():
        df.update(c.keys())
        bad.update(c.keys() if lab[i] else ())
    weight = {w: math.log((n + 1) / (m + 1)) * math.log2(2 + bad[w] / max(1, m - bad[w])) for w, m in df.items() if m >= 2}

    def vector(c):
        v = {w: (1 + math.log(f)) * weight[w] for w, f in c.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    vec = {i: vector(c) for i, c in ex.items()}

    def nearest(v, leave=None):
        cos = [(-round(sum(x * u[w] for w, x in v.items() if w in u), 6), j) for j, u in vec.items() if j != leave]
        return [(j, -c) for c, j in sorted(cos)[:k] if c < 0]

    def vote(near):
        w = [1 / (1 - c + 0.1) for _, c in near]
        return sum(x * lab[j] for x, (j, _) in zip(w, near)) / sum(w) if near else -1.0

    own = [(vote(nearest(v, i)), lab[i]) for i, v in vec.items()]
    lone = [y for v, y in own if v < 0]
    base = sum(lone) / len(lone) if lone else sum(lab[i] for i in ex) / n
    groups = []  # pool adjacent violators: [lowest vote, highest vote, toxic, all]
    for v, y in sorted((v, y) for v, y in own if v >= 0):
        if groups and abs(groups[-1][1] - v) < 1e-9:
            groups[-1][2] += y
            groups[-1][3] += 1
        else:
            groups.append([v, v, y, 1])
        while len(groups) > 1 and groups[-2][2] * groups[-1][3] >= groups[-1][2] * groups[-2][3]:
            g = groups.pop()
            groups[-1] = [groups[-1][0], g[1], groups[-1][2] + g[2], groups[-1][3] + g[3]]
    x, y = zip(*[(v, g[2] / g[3]) for g in groups for v in g[:2]]) if groups else ([0.0], [base])
    out = []
    for i, t in docs:
        near = nearest(vector(Counter(words_of(t))))
        v = vote(near)
        out.append((i, base if v < 0 else float(np.interp(v, x, y)), near))
    return out


def test_toxicity_score_is_brute_force(spark):
    try:
        docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
        labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic").collect()]
    except Exception:
        pytest.skip("no test tables")
    some = next(t for i, t in docs if i == labels[0][0])
    docs += [(10_000 + i, t) for i, t in enumerate([some, some, None, "", "zzz qqq", some + " " + some])]  # ties, no text, no known word
    labels += [(10_000, 0), (10_001, 1), (labels[0][0], 0)]
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, docs), spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int")).collect()}
    have = 0
    for i, want, near in brute_toxicity(docs, labels, toxicity.NEIGHBOURS):
        r = got[i]
        assert abs(r["score"] - want) < 1e-4, (i, r["score"], want)
        assert [round(e["cosine"], 5) for e in r["evidence"]] == pytest.approx([c for _, c in near], abs=2e-5)
        assert {e["doc_id"] for e in r["evidence"]} == {j for j, _ in near} or abs(near[-1][1] - r["evidence"][-1]["cosine"]) < 1e-5
        have += bool(near)
    assert have >= len(docs) - 8 and got[10_002]["evidence"] == got[10_004]["evidence"] == []


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert np.interp([0.0, 0.25, 0.9], x, y).tolist() == [0.0, 0.5, 1.0]


def test_toxicity_awkward(spark):
    docs = table(spark, AWKWARD, extra=True)
    some = spark.createDataFrame([(5, 1, 1), (6, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    none = some.where("false")
    for labels in (some, none, some.where("toxic = 1")):
        r = toxicity.score(docs, labels).collect()
        assert len(r) == len(AWKWARD) - 1 and all(0 <= x["score"] <= 1 for x in r)
        kept = toxicity.drop_toxic(docs, labels)
        assert kept.columns == docs.columns and kept.count() <= len(AWKWARD)
    assert toxicity.score(docs.where("false"), some).count() == 0


def test_toxicity_holds_one_worker_a_task(spark, monkeypatch):
    rows = toxic_corpus(80)
    docs = table(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    seen = []
    plan = lambda df: seen.append(len(re.findall("MapInArrow|EvalPython", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])))
    for name in ("toPandas", "toArrow"):
        monkeypatch.setattr(type(docs), name, lambda df, old=getattr(type(docs), name): (plan(df), old(df))[1])
    kept = toxicity.drop_toxic(docs, labels)
    plan(kept)
    assert len(seen) >= 4 and max(seen) == 1, seen
    assert 0 < kept.count() < 80


def test_dropping_sends_only_judged_text_to_python(spark):
    rows = toxic_corpus(80)
    docs = table(spark, [(i, t) for i, t, _ in rows], extra=True)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    for kept in (toxicity.drop_toxic(docs, labels), langid.keep_identified(docs)):
        text = kept._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in text and re.search(r"EvalPython \[run\([^,]*text#\d+", text), text
        assert kept.schema == docs.schema and 0 < kept.count() <= 80


def posting_corpus(n, terms, each, seed=5):
    """(ids, toxic, row, term, tf, weight) of n vectors of distinct terms, few of them frequent."""
    rng = np.random.default_rng(seed)
    term = np.concatenate([np.unique((terms * rng.random(each) ** 3).astype(np.int32)) for _ in range(n)])
    size = np.diff(np.append(np.flatnonzero(np.append(True, term[1:] <= term[:-1])), len(term)))
    return rng.permutation(n), rng.integers(0, 2, n), np.repeat(np.arange(n, dtype=np.int32), size), term, rng.integers(1, 4, len(term)).astype(np.int32), rng.uniform(0.5, 5, terms)


def test_toxicity_index_is_made_in_little_memory():
    corpus = posting_corpus(8000, 60_000, 250)
    tracemalloc.start()
    index = toxicity.BlockMaxIndex(*corpus)
    sent = pickle.dumps(index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sent) < 4 * len(corpus[2]) and peak < 30 * len(corpus[2]), peak / len(corpus[2])


def test_texts_go_to_python_in_small_batches(spark):
    key = common.BATCH_CONF
    old = spark.conf.get(key, None)
    text = " ".join(VOCAB[:200])
    docs = table(spark, [(i, text) for i in range(9_000)]).coalesce(1)
    most = lambda: max(r["n"] for r in docs.select("text").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect())
    try:
        for use in (lambda: langid.keep_identified(docs), lambda: toxicity.fit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))):
            spark.conf.unset(key)
            assert most() > 1.5 * common.BATCH_BYTES
            use()
            assert most() <= 1.1 * common.BATCH_BYTES
        spark.conf.set(key, "12345678")  # the session's own limit stays
        langid.keep_identified(docs)
        assert spark.conf.get(key) == "12345678"
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def test_pipeline_stages_send_a_megabyte_at_a_time(spark):
    key = common.BATCH_CONF
    old = spark.conf.get(key, None)
    docs = table(spark, [(i, " ".join(VOCAB[:200])) for i in range(9_000)]).coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    sizes = lambda: [r["n"] for r in docs.select("text").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect()]
    try:
        for use in (lambda: langid.keep_identified(docs), lambda: toxicity.drop_toxic(docs, labels)):
            spark.conf.unset(key)
            whole = sum(sizes())
            assert whole > 6 << 20
            use()
            assert max(sizes()) <= 1.1 * (1 << 20) and abs(sum(sizes()) - whole) < 0.02 * whole
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def test_texts_are_read_in_small_vectors(spark, tmp_path):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    old = {k: spark.conf.get(k, None) for k in (common.BATCH_CONF, key)}
    table(spark, [(i, "some text here") for i in range(2000)]).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")

    def vectors():
        plan = docs.select("text")._jdf.queryExecution().executedPlan()
        assert plan.executeCollect() and plan.child().nodeName() == "ColumnarToRow"
        return plan.child().metrics().apply("numInputBatches").value()

    try:
        for use in (lambda: langid.identify(docs), lambda: langid.keep_identified(docs), lambda: toxicity.drop_toxic(docs, labels), lambda: toxicity.score(docs, labels)):
            spark.conf.unset(key)
            assert vectors() == 1
            use()
            assert vectors() >= 2000 / 256
        spark.conf.set(key, "1000")  # the session's own limit stays
        langid.keep_identified(docs)
        assert vectors() == 2
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_language_counts_in_little_memory():
    rng = random.Random(8)
    batch = pa.RecordBatch.from_arrays([pa.array([" " + sentence(rng, 300, VOCAB).lower() + " " for _ in range(1500)]), pa.array(["xx"] * 1500)], names=["t", "lang"])
    tracemalloc.start()
    for _ in langid._count([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 2 << 20 and peak < 24 << 20, peak


# --- 2 simhash


def near_corpus(seed=2, n=400):
    rng = random.Random(seed)
    big = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 10))) for _ in range(6000)]
    texts = [sentence(rng, rng.randint(40, 160), big) for _ in range(n)]
    for k in range(0, n, 5):
        w = texts[k].split()
        for _ in range(max(1, len(w) // 20)):
            w[rng.randrange(len(w))] = rng.choice(big)
        texts.append(" ".join(w).capitalize() + ".")
    for k in range(1, n, 40):
        texts.append(texts[k].upper() + " !")
    return texts


def brute_pairs(sig, radius):
    hi, lo = (sig[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
    ids = sig["doc_id"].to_numpy()
    out = set()
    for i in range(len(ids)):
        d = np.bitwise_count(hi[i] ^ hi[i + 1 :]) + np.bitwise_count(lo[i] ^ lo[i + 1 :])
        out |= {(min(ids[i], ids[i + 1 + j]), max(ids[i], ids[i + 1 + j])) for j in np.flatnonzero(d <= radius)}
    return out


def test_signature_bits():
    t = b"alpha beta gamma alpha of"
    fp, sig = simhash.sign_step(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    feats = np.array([word_hash(w) for w in ("alpha", "beta", "gamma", "of")], np.uint64)
    for part in range(2):
        rows = np.unpackbits(simhash.mix(feats + np.uint64((part + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))).view(np.uint8).reshape(-1, 8), axis=1)
        assert np.unpackbits(sig[0, part : part + 1].view(np.uint8)).tolist() == (np.sum(rows, 0) * 2 > 4).astype(int).tolist()
    assert fp[0] != 0


def test_forest_recall(spark):
    sig = simhash.signatures(table(spark, list(enumerate(near_corpus())))).toPandas()
    want = brute_pairs(sig, 22)
    reps = spark.createDataFrame(sig[["doc_id", "hi", "lo"]])
    for leaf in (4, 64):
        got = {(r["a"], r["b"]) for r in simhash.forest(reps, len(sig), 22, 0.9, leaf, pairs=True).collect()}
        got = {p for p in got if p[0] != p[1]}
        assert got <= want and len(got) >= 0.9 * len(want), (leaf, len(got), len(want))


def test_simhash_groups_planted(spark):
    texts = near_corpus()
    docs = table(spark, list(enumerate(texts)))
    g = {r["doc_id"]: r for r in simhash.simhash_groups(docs).collect()}
    found = sum(g[k]["group_id"] == k == g[400 + k // 5]["group_id"] if 400 + k // 5 in g else False for k in range(0, 400, 5))
    assert found >= 76
    exact = [(k, 480 + i) for i, k in enumerate(range(1, 400, 40))]
    assert all(b in g and g[b]["group_id"] == g[a]["group_id"] for a, b in exact)
    assert not {k for k in range(2, 400, 5)} & set(g)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {i for i in range(len(texts)) if i not in g or g[i]["kept"]}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_leaf_compares_all():
    n = 700
    hi = np.arange(n, dtype=np.uint64)
    lo = np.zeros(n, np.uint64)
    got = set()
    for i, j in simhash.close_pairs(np.zeros(n, np.int64), hi, lo, 1):
        got |= set(zip(i.tolist(), j.tolist()))
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if bin(i ^ j).count("1") <= 1}


def test_large_leaf_is_connected_without_all_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    hi = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 40, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 60).astype(np.uint64)) for b in base])
    rng.shuffle(hi)
    lo = np.zeros(len(hi), np.uint64)
    for radius in (1, 2, 3, 30):
        want = np.arange(len(hi))
        for i, j in simhash.close_pairs(np.zeros(len(hi), np.int64), hi, lo, radius):
            simhash._merge(want, i, j)
        assert simhash._connect(hi, lo, radius).tolist() == want.tolist()


def test_leaves_in_pieces_are_leaves_at_once():
    rng = np.random.default_rng(5)
    for leaf, depth in ((3, 12), (10, 6)):
        key = np.sort(np.concatenate([rng.integers(0, 1 << 32, 400), np.full(50, 77 << 20), (5 << 27) + rng.integers(0, 1 << 10, 200)])).astype(np.int64)
        branch = key >> 30
        want = simhash.leaves(key, branch, 2, depth, leaf)
        for step in (1, 7, 100):
            got, before, held, base = [], np.zeros(depth + 1, np.int64), 0, 0
            for at in [*range(step, len(key), step), len(key)]:
                if at < len(key):
                    end, after, behind = simhash.ready(key[held:at], branch[held:at], 2, depth, leaf, before)
                else:
                    end, after, behind = at - held, before, None
                if end:
                    part = simhash.leaves(key[held : held + end], branch[held : held + end], 2, depth, leaf, before, behind)
                    got += (part + base).tolist()
                    base, before, held = got[-1] + 1, after, held + end
            assert got == want.tolist(), (leaf, depth, step)


def test_plan_meets_recall():
    for n in (2, 1000, 10**6, 10**9):
        trees, depth = simhash.plan(n, 22, 0.9, 64)
        assert 1 - (1 - simhash.hit(depth, 22)) ** trees >= 0.9 or depth <= 4


def test_simhash_awkward(spark):
    docs = table(spark, AWKWARD, extra=True)
    g = {r["doc_id"]: r["group_id"] for r in simhash.simhash_groups(docs).collect()}
    assert g[7] == g[6] == 6 and not {1, 2, 3, 4} & set(g)
    kept = simhash.drop_near_duplicates(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and 7 not in ids and ids.count(5) == 1 and None in ids and {1, 2, 3, 4, 6} <= set(ids)
    assert simhash.simhash_groups(docs.where("false")).count() == 0 and simhash.drop_near_duplicates(docs.where("false")).count() == 0


def test_numbers_and_short_words_tell_apart(spark):
    docs = table(spark, [(1, "reouti anatha"), (2, "reouti anatha 19 37 233 111"), (3, "reouti anatha 4 8 15 16")])
    assert simhash.simhash_groups(docs).count() == 0


def test_repeated_id_keeps_the_judged_row(spark):
    rng = random.Random(31)
    texts = [sentence(rng, 60, VOCAB) for _ in range(6)]
    docs = table(spark, [(1, t) for t in texts] + [(1, ""), (1, None)] + [(2, t) for t in texts])
    fp = {r["text"]: r["fp"] for r in simhash.signatures(table(spark, list(enumerate(texts)))).join(table(spark, list(enumerate(texts))), "doc_id").collect()}
    kept = simhash.drop_near_duplicates(docs).collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(1, min(texts, key=fp.get))]


# --- 3 decontamination


def brute_phrase(item, doc, phrase):
    a, b = words_of(item), words_of(doc)
    span = min(phrase, len(a))
    best = 0
    at = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    for i in range(len(a)):
        for j in at.get(a[i], []):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best if best >= span else 0


def test_decontamination_brute_force(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.randint(3, 40), VOCAB)) for i in range(12)]
    docs = []
    for d in range(60):
        t = sentence(rng, rng.randint(20, 200), VOCAB).split()
        if d % 3 == 0:
            w = items[d % 12][1].split()
            cut = w if d % 2 else w[2 : 2 + rng.randint(5, 30)]
            k = rng.randrange(len(t))
            t[k:k] = cut
        docs.append((d, " ".join(t)))
    got = {(r["item_id"], r["doc_id"]): r for r in decontam.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, x in items:
        for d, t in docs:
            want = brute_phrase(x, t, 13)
            assert (got[i, d]["phrase_words"] if (i, d) in got else 0) == want, (i, d)


def brute_coverage(item, doc, counts, total, slop):
    a, b = words_of(item), words_of(doc)
    pos = {}
    for j, w in enumerate(b):
        pos.setdefault(w, []).append(j)
    weight = [math.log((total + 2) / (counts[w] + 1)) for w in a]
    best = 0.0
    for s in range(-len(a), len(b)):
        best = max(best, sum(x for o, (w, x) in enumerate(zip(a, weight)) if any(abs(p - s - o) <= slop for p in pos.get(w, []))))
    return best / sum(weight)


def test_proximity_brute_force(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, 30, VOCAB)) for i in range(5)]
    docs = []
    for d in range(30):
        t = sentence(rng, rng.randint(30, 120), VOCAB).split()
        if d % 2 == 0:
            w = items[d % 5][1].split()
            for _ in range(rng.randint(1, 12)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            t[10:10] = w
        docs.append((d, " ".join(t)))
    counts = Counter(w for _, t in docs for w in words_of(t))
    total = sum(counts.values())
    got = {(r["item_id"], r["doc_id"]): r["coverage"] for r in decontam.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), slice_words=40).collect()}
    for i, x in items:
        for d, t in docs:
            c = brute_coverage(x, t, counts, total, decontam.SLOP)
            if abs(c - decontam.COVERAGE) > 1e-6:
                assert (got.get((i, d), 0.0) > 0) == (c >= decontam.COVERAGE), (i, d, c)


def test_decontamination_slices_and_awkward(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (None, "seven eight nine ten eleven"), (4, "too short"), (5, "tie word tie word tie word"), (6, "one two three four five six")], "item_id long, text string")
    docs = table(spark, [*AWKWARD, (20, "x one, TWO three. four five six y"), (21, "tie word tie word tie word")], extra=True)
    for n in (1, 10**6):
        got = {(r["item_id"], r["doc_id"]) for r in decontam.contaminated(docs, items, slice_words=n).collect()}
        assert {(1, 20), (6, 20), (5, 21)} <= got and not {i for i, _ in got} & {2, 3, 4}  # no text has "too short"
    kept = decontam.drop_contaminated(docs, items)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and 20 not in ids and None in ids and ids.count(5) == 3
    assert decontam.contaminated(docs.where("false"), items).count() == 0 and decontam.contaminated(docs, items.where("false")).count() == 0


def test_long_items_in_short_neighbours(spark):
    """Items longer than the gap between documents, whose places in two documents of a segment are the same."""
    rng = random.Random(22)
    big = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(4000)]
    docs, items = [], []
    for k in range(12):
        w = [rng.choice(big) for _ in range(rng.randint(100, 180))]
        items.append((k, " ".join(w)))
        n = len(w) // 2
        docs += [(10 * k, " ".join([rng.choice(big) for _ in range(rng.randint(3, 12))] + w[: rng.randint(3, 9)])), (10 * k + 1, " ".join(w[n:])), (10 * k + 2, " ".join(w[:n])), (10 * k + 3, " ".join([rng.choice(big) for _ in range(5)]))]
    counts = Counter(w for _, t in docs for w in words_of(t))
    total = sum(counts.values())
    for coverage in (0.3, 0.45, 0.6):
        found = decontam.contaminated(table(spark, docs).coalesce(1), spark.createDataFrame(items, "item_id long, text string"), coverage=coverage).collect()
        got = {(r["item_id"], r["doc_id"]): r for r in found}
        for i, x in items:
            for d, t in docs:
                run, c = brute_phrase(x, t, 13), brute_coverage(x, t, counts, total, decontam.SLOP)
                r = got.get((i, d))
                assert (r["phrase_words"] if r else 0) == run and (abs(c - coverage) < 1e-6 or ((r["coverage"] if r else 0) > 0) == (c >= coverage)), (i, d, c)


def test_many_benchmark_terms_go_by_filter(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}") for i in range(50)] + [(99, "hi there")], "item_id long, text string")
    docs = table(spark, [(i, f"word alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} and hi, there") for i in range(0, 50, 3)])
    want = sorted(map(tuple, decontam.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontam, "TERMS", 10)
    assert sorted(map(tuple, decontam.contaminated(docs, items).collect())) == want and len(want) == 34


def test_common_words_in_a_long_document():
    n = 300_000
    item = decontam.Item(np.full(40, 7, np.uint64), np.full(40, n), n, 13, 0.6)
    got = list(decontam.search_segment([(1, item, True, True)], np.array([7]), np.array([0, n]), np.arange(n, dtype=np.int32), np.array([5]), np.array([0]), 8))
    assert got[0][:3] == (1, 5, 40)


# --- 4 language


def profile(t, size):
    t = regex.sub(r"[^\p{L}\p{M}]+", " ", t.lower()).strip()
    if not t:
        return []
    c = Counter()
    for w in t.split():
        c.update(w)
        p = f" {w} "
        c.update(p[i : i + 2] for i in range(len(p) - 1))
        c.update(p[i : i + 3] for i in range(len(p) - 2))
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:size]


def gram_code(g):
    n = 0
    for ch in g:
        n = n << 21 | ord(ch)
    return n


def test_profiles_and_distance_brute_force(spark):
    rng = random.Random(9)
    docs = [(i, sentence(rng, rng.randint(1, 60), ["über", "haus", "groß", "lied", "tag"] if i % 2 else ["the", "house", "song", "day", "great"]), "de" if i % 2 else "en") for i in range(40)]
    df = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in docs], DOC)
    found = langid.profiles(df, 50)
    def count(lang):
        c = Counter()
        for _, t, x in docs:
            if x == lang:
                for w in t.split():
                    p = f" {w} "
                    c.update(w)
                    c.update(p[i : i + 2] for i in range(len(p) - 1))
                    c.update(p[i : i + 3] for i in range(len(p) - 2))
        return [gram_code(g) for g, _ in sorted(c.items(), key=lambda x: (-x[1], gram_code(x[0])))][:50]
    assert {k: v.tolist() for k, v in found.items()} == {k: count(k) for k in ("de", "en")}
    got = {r["doc_id"]: r for r in langid.identify(df, 50, found=found).collect()}
    for i, t, _ in docs:
        mine = profile(t, 50)
        want = {}
        for lang, p in found.items():
            rank = {g: k for k, g in enumerate(p.tolist())}
            want[lang] = sum(abs(rank[gram_code(g)] - k) if gram_code(g) in rank else 50 for k, g in enumerate(mine)) / (len(mine) * 50)
        best = min(sorted(want), key=lambda x: want[x])
        assert got[i]["language"] == best and abs(got[i]["distance"] - want[best]) < 1e-9, i


def test_language_held_out(spark):
    p = "/root/testdata/sf0.001/documents.parquet"
    try:
        df = spark.read.parquet(p)
    except Exception:
        pytest.skip("no test tables")
    found = langid.profiles(df.where("doc_id % 2 = 0"))
    r = langid.identify(df.where("doc_id % 2 = 1"), found=found).join(df.select("doc_id", "lang"), "doc_id")
    assert r.where("language = lang").count() >= 0.97 * r.count() and r.where("rejected").count() == 0


def test_language_awkward(spark):
    docs = table(spark, AWKWARD, extra=True)
    r = langid.identify(docs).collect()
    assert len(r) == len(AWKWARD) - 1
    by = {}
    for x in r:
        by.setdefault(x["doc_id"], []).append(x)
    assert all(by[i][0]["rejected"] and by[i][0]["language"] is None for i in (1, 2, 3, 4))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {1, 2, 3, 4, None} & {x["doc_id"] for x in kept.collect()}
    for none in (docs.where("false"), docs.withColumn("lang", F.lit(None).cast("string"))):
        assert langid.identify(none).where("not rejected").count() == 0 and langid.keep_identified(none).count() == 0


def test_language_rejects_junk_and_unseen(spark):
    p = "/root/testdata/sf0.001/documents.parquet"
    try:
        df = spark.read.parquet(p).select("doc_id", "text", "lang")
    except Exception:
        pytest.skip("no test tables")
    rng = random.Random(19)
    junk = [
        "Hyvää huomenta, tänään on kaunis päivä ja menemme yhdessä metsään poimimaan mustikoita ja puolukoita",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(200)),
        "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000)),
        "div span class href table tbody " * 60,
    ]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    r = {x["doc_id"]: x for x in langid.identify(df.unionByName(more)).collect()}
    assert [r[-1 - i]["rejected"] for i in range(len(junk))] == [True] * len(junk), [(r[-1 - i]["distance"]) for i in range(len(junk))]
    assert sum(x["rejected"] for i, x in r.items() if i >= 0) == 0
    assert {x["doc_id"] for x in langid.keep_identified(df.unionByName(more)).collect()} == {i for i in r if i >= 0}


def test_language_fits_all_documents_as_sql_does(spark):
    import duckdb

    from leafmill.llm.queries import OP4

    rng = random.Random(23)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    docs = []
    for lang, letters, n in (("aa", "abcdefgh", 5_500), (" b ", "efghijklö", 600), ("one", "xyz", 1)):
        many = [word(letters) for _ in range(400)]
        docs += [(lang, " ".join(rng.choice(many) for _ in range(rng.randint(1, 12)))) for _ in range(n)]
    docs += [("aa", word("qrstuv")) for _ in range(12)] + [(None, word("abcdijkl")) for _ in range(50)] + [("aa", None), ("aa", "12"), (" ", "hi"), ("none", "?")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, language, distance, margin, rejected from ({OP4})").fetchall()}
    got = {r[0]: tuple(r[1:]) for r in langid.identify(df).collect()}
    assert len(got) == len(docs) and got == want
    assert {r["doc_id"] for r in langid.keep_identified(df).collect()} == {i for i, r in want.items() if not r[3]}
    own = sorted(rng.choice([0.25, 0.5, rng.random() * 0.7]) for _ in range(2_345))
    assert langid._quantiles(spark.createDataFrame([("aa", v) for v in own] + [("aa", None)], "lang string, own double"), ["aa", "zz"]) == {"aa": own[math.ceil(2_345 * 999 / 1000) - 1] + langid.MARGIN, "zz": langid.REJECT}


# --- 5 warc


def test_warc_round_trip_at_any_split(spark, tmp_path):
    rng = random.Random(10)
    rows = [(f"http://h/{i}" if i % 7 else None, f"<urn:{i}>", bytes(rng.choice(b"\x1f\x8b\x08ab\r\n") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    rows += [("u", "<urn:fake>", gzip.compress(b"WARC/1.0\r\nno length\r\n\r\n") + b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc"), ("u", "<urn:null>", None), ("u", "<urn:same>", b"x"), ("u", "<urn:same>", b"x")]
    df = spark.createDataFrame(rows, "uri string, record_id string, body binary").repartition(2)
    want = sorted((r, u, bytes(b or b"")) for u, r, b in rows)
    for compress in (True, False):
        folder = f"file://{tmp_path}/{compress}"
        assert sum(x["records"] for x in warc.write_warc(df, folder, compress).collect()) == len(rows)
        for split in (37, 500, 1 << 20):
            got = sorted((x["record_id"], x["uri"], bytes(x["body"])) for x in warc.read_warc(spark, [folder], split).collect())
            assert got == want, (compress, split)


def test_warc_damage(spark, tmp_path):
    one = lambda i: gzip.compress(warc.render("resource", "u", b"body%d" % i, f"<urn:{i}>", "d", "c"))
    bad = bytearray(one(1))
    bad[len(bad) // 2] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(one(0) + bytes(bad) + one(2) + one(3)[:-9])
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x")
    for split in (20, 10**6):
        assert sorted(r["record_id"] for r in warc.read_warc(spark, [str(tmp_path)], split).collect()) == ["<urn:0>", "<urn:2>"]
    (tmp_path / "none").mkdir()
    assert warc.read_warc(spark, [str(tmp_path / "none")]).count() == 0


def test_warc_long_headers_many_records_and_records_inside(spark, tmp_path):
    rec = lambda i, body, head=b"": b"WARC/1.0\r\nWARC-Type: resource\r\n" + head + b"WARC-Record-ID: <%s>\r\nContent-Length: %d\r\n\r\n" % (i, len(body)) + body + b"\r\n\r\n"
    noise = bytes(random.Random(1).randrange(256) for _ in range(300))
    parts = [rec(b"a", b"one"), rec(b"long", b"two", b"X: " + b"y" * 200_000 + b"\r\n"), rec(b"outer", b"text\r\n\r\n" + rec(b"inner", b"body") + rec(b"inner2", b"") + noise), rec(b"last", noise * 5000)]
    want = [("<a>", 3), ("<last>", 1_500_000), ("<long>", 3), ("<outer>", len(b"text\r\n\r\n" + rec(b"inner", b"body") + rec(b"inner2", b"")) + 300)]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.warc").write_bytes(b"".join(parts))
    (tmp_path / "each").mkdir()
    # stored blocks hold a member as it is
    stored = lambda x: gzip.compress(x, compresslevel=0)
    (tmp_path / "each/a.warc.gz").write_bytes(b"".join(map(stored, parts)))
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.warc.gz").write_bytes(gzip.compress(b"".join(parts[:3])) + gzip.compress(parts[3]))
    (tmp_path / "inside").mkdir()
    (tmp_path / "inside/a.warc.gz").write_bytes(stored(rec(b"outer", stored(rec(b"inner", b"x" * 50)))) + stored(rec(b"b", b"z")))
    for name in ("plain", "each", "one"):
        for split in (1000, 30_000, 1 << 30):
            got = sorted((r["record_id"], len(r["body"])) for r in warc.read_warc(spark, [str(tmp_path / name)], split).collect())
            assert got == want, (name, split)
    small = b"".join([rec(b"a", b""), rec(b"outer", b"\r\n\r\n" + rec(b"inner", b"b")), rec(b"z", b"zz")])
    (tmp_path / "small").mkdir()
    (tmp_path / "small/a.warc").write_bytes(small)
    for split in (1, 7, 30, 60, 90):
        assert [r["record_id"] for r in warc.read_warc(spark, [str(tmp_path / "small")], split).orderBy("start").collect()] == ["<a>", "<outer>", "<z>"], split
        if split > 1:
            assert sorted(r["record_id"] for r in warc.read_warc(spark, [str(tmp_path / "inside")], split).collect()) == ["<b>", "<outer>"], split


def test_warc_plain_damage(spark, tmp_path):
    one = lambda i: warc.render("resource", "u", b"body%d" % i, f"<urn:{i}>", "d", "c")
    (tmp_path / "a.warc").write_bytes(b"junk\n\n" + one(0) + b"more junk\r\n\r\n" + one(1) + one(2)[:-9])
    for split in (3, 50, 10**6):
        assert sorted(r["record_id"] for r in warc.read_warc(spark, [str(tmp_path)], split).collect()) == ["<urn:0>", "<urn:1>"]


# --- 6 chat


def test_chat_machine(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (3, 0, "assistant", "a"), (4, 0, "user", "u"), (4, 0, "user", "v"), (5, 0, "user", " "), (5, 1, "assistant", "a"),
        (6, 0, "robot", "x"), (7, 0, None, "x"), (8, 0, "user", "u"), (8, 0, "user", "u"), (8, 1, "assistant", "a"), (9, None, "user", "u"), (None, 0, "user", "u"), (10, 0, "user", None), (11, 1, "assistant", "a"), (11, 0, "user", "u"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1)).withColumn("turns", F.lit(1))
    r = chat.format_chats(df).collect()
    faults = {x["conv_id"]: (x["fault"], x["fault_turn"]) for x in r if not x["valid"]}
    assert faults == {2: ("bad_end", 0), 3: ("bad_order", 0), 4: ("duplicate_turn", 0), 5: ("empty_text", 0), 6: ("bad_role", 0), 7: ("bad_role", 0), 9: ("bad_role", None), 10: ("empty_text", 0)}
    one = sorted((x["segment"], x["text"], x["loss"]) for x in r if x["conv_id"] == 1)
    assert "".join(t for _, t, _ in one) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert [t for _, t, loss in one if loss] == ["a", "<|im_end|>\n"]
    assert {x["conv_id"] for x in r if x["valid"]} == {1, 8, 11} and chat.format_chats(df.where("false")).count() == 0


# --- 7 packing


def check_packing(given, rows, window):
    """Every token once, no window too full, no overlap."""
    seen, use = {}, {}
    for r in rows:
        seen.setdefault((r["doc_id"], r["copy"]), []).append((r["doc_start"], r["n_tokens"]))
        use.setdefault(r["window_id"], []).append((r["window_start"], r["n_tokens"]))
    for parts in seen.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
    assert sorted(sum(n for _, n in p) for p in seen.values()) == sorted(n for n in given if n)
    for parts in use.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= window
    assert sorted(use) == list(range(len(use)))
    return len(use)


def brute_pack(lengths, window=2048, bins=64):
    """What ``pack`` returns, one piece after the other: recipes are used up in their order, bins by (doc_id, copy)."""
    unit = -(-window // bins)
    rows, copies = [], Counter()
    for i, n in sorted(lengths):
        if n:
            rows.append((i, copies[i], n))
            copies[i] += 1
    queue = {}
    for i, c, n in sorted(rows):
        if n % window:
            queue.setdefault(-(-(n % window) // unit), []).append((i, c, n))
    hist = np.array([len(queue.get(b, [])) for b in range(1, -(-window // unit) + 1)])
    out, w = [], 0
    for times, pattern in packing.recipes(hist):
        for _ in range(times):
            inside, at = [queue[b].pop(0) for b in pattern], 0
            for i, c, n in sorted(inside, key=lambda x: (-(x[2] % window), x[0], x[1])):
                out.append((i, c, n // window, n - n % window, n % window, w, at))
                at += n % window
            w += 1
    for i, c, n in sorted(rows):
        for k in range(n // window):
            out.append((i, c, k, k * window, window, w, 0))
            w += 1
    return sorted(out)


def test_packing(spark):
    rng = random.Random(11)
    n = [rng.choice([rng.randint(1, 60), rng.randint(100, 900), rng.randint(900, 9000), 2048]) for _ in range(1500)]
    ids = [(rng.randrange(-400, 1400), x) for x in n]  # repeated ids, ties of length
    df = spark.createDataFrame(ids, "doc_id long, size long").withColumn("text", F.lit(""))
    want, old = brute_pack(ids), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 3, 40):  # the number of ranges changes nothing
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            r = packing.pack(df, length=F.col("size")).collect()
            assert sorted(map(tuple, r)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert check_packing(n, r, 2048) <= 1.03 * math.ceil(sum(n) / 2048)


def test_nnls():
    rng = np.random.default_rng(12)
    for _ in range(20):
        a, x = rng.random((8, 5)), np.maximum(0, rng.normal(size=5))
        assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    a, b = rng.normal(size=(10, 6)), rng.normal(size=10)
    x = packing.nnls(a, b)
    g = a.T @ (a @ x - b)
    assert (x >= 0).all() and (g >= -1e-7).all() and abs(g @ x) < 1e-7


def test_recipes_use_all():
    rng = np.random.default_rng(13)
    for hist in (np.zeros(64, int), rng.integers(0, 500, 64), np.eye(64, dtype=int)[63] * 7, rng.integers(0, 2, 64), np.eye(64, dtype=int)[0] * 1000):
        left = hist.copy()
        for times, bins in packing.recipes(hist):
            assert sum(bins) <= 64 and times > 0
            for b in bins:
                left[b - 1] -= times
        assert not left.any()


def test_packing_awkward(spark):
    docs = table(spark, AWKWARD, extra=True)
    r = packing.pack(docs).collect()
    assert None not in {x["doc_id"] for x in r} and not {1, 2, 3} & {x["doc_id"] for x in r} and {x["copy"] for x in r if x["doc_id"] == 5} == {0, 1, 2}
    count = lambda t: len(regex.findall(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]", t or ""))
    check_packing([count(t) for i, t in AWKWARD if i is not None], r, 2048)
    assert packing.pack(docs.where("false")).count() == 0


# --- 8 licences


def test_licences(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 500)
    docs = table(spark, [
        *AWKWARD, (20, "text\nReleased under the MIT License.\nmore"), (21, "LICENSED under  cc-by-nc 4.0"), (22, mit.replace("<year>", "1999").upper()), (23, mit + "\nand more"), (24, "x\nThis work is licenced under the GNU General Public Licence; version 3\n"),
        (25, "we say: all rights reserved. not"), (26, "All rights reserved.\nAll rights reserved."),
    ], extra=True)
    got = sorted((r["doc_id"], r["part"], r["line"], r["license_id"]) for r in licenses.scan(docs).collect())
    assert got == [(20, "line", 1, "MIT"), (21, "text", -1, "CC-BY-NC-4.0"), (22, "text", -1, "MIT"), (24, "line", 1, "GPL-3.0"), (26, "line", 0, "proprietary"), (26, "line", 1, "proprietary")]
    assert licenses.scan(docs.where("false")).count() == 0 and licenses.scan(docs, [("x", "...")]).count() == 0


def test_licence_whole_texts(spark):
    bsd3 = next(t for i, t in licenses.KNOWN if i == "BSD-3-Clause" and len(t) > 500)
    named = "Copyright (c) 2001, Some One\nAll rights kept.\n".split("\n")[0] + "\n" + bsd3.replace("the copyright holder nor", "Some Institute, of Somewhere nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("COPYRIGHT HOLDER OR", "REGENTS OR")
    zlib_ = next(t for i, t in licenses.KNOWN if i == "Zlib")
    texts = [(1, named), (2, zlib_.upper().replace(" ", "\n ")), (3, bsd3 + "\nand more"), (4, bsd3.replace("1.", "*").replace("2.", "*"))]
    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0"}
    there = Path("/usr/share/common-licenses")
    want = {(1, "BSD-3-Clause"), (2, "Zlib")}
    for k, (f, i) in enumerate(files.items()):
        if (there / f).exists():
            texts.append((10 + k, (there / f).read_text().upper().replace("LICENSE", "LICENCE")))
            want.add((10 + k, i))
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan(table(spark, texts)).where("part = 'text'").collect()}
    assert got == want
    rows = licenses.long_digests()
    assert len(rows) > 20 and all(re.fullmatch(r"[0-9a-f]{64}", d) and w for _, d, w in rows) and len({d for _, d, _ in rows}) == len(rows)


def test_licence_anchors(spark):
    texts = [r["canonical"] for r in licenses.known_digests(spark).collect()]
    found = re.compile(licenses.anchors(texts))
    raw = [t for _, t in licenses.KNOWN] + [t.replace("icense", "icence") for _, t in licenses.KNOWN] + [t.upper() for _, t in licenses.KNOWN]
    assert all(found.search(t.lower()) for t in raw) and not found.search("the and attion to thanedble the, anea.")
    assert licenses._raw_forms("license") == {"license", "licence"} and "sub-licence" in licenses._raw_forms("sublicense")


# --- 9 urls


def test_url_tokens(spark):
    t = lambda u: spark.createDataFrame([(u,)], "u string").select(urls.url_tokens(F.col("u"))).first()[0]
    assert t("HTTPS://u@www.Cheap-pills.example.com:80/en/4.html?page=2&ref=x#top") == sorted(["scheme:https", "host:www", "host:cheap-pills", "host:example", "host:com", "word:www", "word:cheap", "word:pills", "word:example", "word:com", "path:en", "path:4.html", "ext:html", "query:page=2", "query:page", "query:ref=x", "query:ref", "fragment:top"])
    assert t(None) == t("") == []


def brute_rules(rows, min_support, min_confidence, min_lift, min_count):
    """{tokens: (confidence, support, lift)} by counting every set of tokens of every bad URL."""
    n, bad = len(rows), sum(y for _, y in rows)
    least = max(min_count, math.ceil(min_support * n - 1e-12))
    where = {}
    for i, (t, _) in enumerate(rows):
        for x in t:
            where.setdefault(x, set()).add(i)
    lead = {min(x for x in where if where[x] == w) for w in where.values()}
    sets = {frozenset(c) for t, y in rows if y for k in range(1, 5) for c in itertools.combinations(sorted(lead & t), k)}
    out = {}
    for s in sets:
        hold = [y for t, y in rows if s <= t]
        if sum(hold) >= least and sum(hold) / len(hold) >= min_confidence and sum(hold) / len(hold) / (bad / n) >= min_lift:
            out[s] = (sum(hold) / len(hold), sum(hold) / n, sum(hold) / len(hold) / (bad / n))
    return {s: x for s, x in out.items() if not any(g < s and out[g][0] >= x[0] for g in out)}


def test_mining_is_brute_force(spark):
    rng = random.Random(23)
    rows = []
    for _ in range(260):
        t = {rng.choice("ab"), rng.choice("cde"), rng.choice("fg")} | ({"x", "y", "z", "w"} if rng.random() < 0.3 else set())
        rows.append((t, int(rng.random() < (0.9 if {"a", "c"} <= t else 0.7 if "x" in t else 0.1))))
    rows += [({"q"}, 1)] * 4 + [({"q", "r"}, 0)]
    df = spark.createDataFrame([(sorted(t), y) for t, y in rows], "tokens array<string>, bad int")
    for args in ((0.01, 0.6, 1.2, 3), (0.05, 0.8, 1.0, 5), (0.001, 0.3, 1.0, 2)):
        got = {frozenset(r["tokens"]): (r["confidence"], r["support"], r["lift"]) for r in urls.mine(df, *args).collect()}
        want = brute_rules(rows, *args)
        assert set(got) == set(want) and len(want) > 2
        for s, x in want.items():
            assert got[s] == pytest.approx(x, abs=1e-9)


def test_template_of_many_tokens_is_one_rule(spark):
    df = spark.createDataFrame([([f"t{i:02}" for i in range(40)] + [f"v{k % 5}"], int(k % 5 < 4)) for k in range(60)] + [(["other"], 0)] * 60, "tokens array<string>, bad int")
    assert {tuple(r["tokens"]) for r in urls.mine(df).collect()} == {("t00",), *((f"v{i}",) for i in range(4))}


def test_url_rules(spark):
    rng = random.Random(14)
    rows = []
    for i in range(600):
        host, ref = rng.choice(["a", "b", "c"]), rng.choice(["x", "y"])
        rows.append((i, f"http://{host}.example.org/p/{rng.randrange(9)}?ref={ref}", int(host == "a" and ref == "x")))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(None, "http://a.example.org/?ref=x"), (900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1])], "page_id long, url string").withColumns({c: F.lit(1) for c in ("rules", "token", "tokens", "bad", "rule_id", "m", "doc_id", "id", "need")})
    labels = spark.createDataFrame([(i, 1 - y, 0) for i, _, y in rows[:300]] + [(None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    rules = urls.mine(urls.labelled(pages, labels, bad), min_confidence=0.9).collect()
    assert any(set(r["tokens"]) == {"host:a", "query:ref=x"} for r in rules)
    for a, b in itertools.permutations(rules, 2):
        assert not (set(a["tokens"]) < set(b["tokens"]) and a["confidence"] >= b["confidence"])
    got = urls.filter_urls(pages, labels, bad, min_confidence=0.9).collect()
    assert len(got) == 604 and [r["flagged"] for r in got if r["page_id"] in (900, 901)] == [False, False]
    flag = {r["page_id"]: r["flagged"] for r in got}
    yes = {i: y for i, _, y in rows[300:]}
    assert all(flag[i] for i, y in yes.items() if y) and np.mean([flag[i] for i, y in yes.items() if not y]) < 0.05
    # a rule fires exactly on the URLs that hold all its tokens
    sets = {r["page_id"]: set(r["t"]) for r in pages.where("page_id < 600").select("page_id", urls.url_tokens(F.col("url")).alias("t")).collect()}
    fired = {r["page_id"]: r["rules"] for r in got if r["page_id"] < 600}
    for i, s in sets.items():
        assert fired[i] == sorted(" ".join(r["tokens"]) for r in rules if set(r["tokens"]) <= s)
    assert urls.filter_urls(pages, labels.where("false"), bad).where("flagged").count() == 0 and urls.filter_urls(pages.where("false"), labels, bad).count() == 0


def test_weak_labels_flag_urls_of_the_same_kind(spark):
    hosts = ["casino-win", "cheap-pills", "win-now", "garden", "recipes-daily"]
    pages = spark.createDataFrame([(i, f"http://www.{hosts[i % 5]}.example.com/en/{i}") for i in range(100)] + [(None, "http://casino.com/"), (200, None), (201, " ")], "page_id long, url string")
    lab = {r["doc_id"]: r["bad"] for r in urls.weak_labels(pages).collect()}
    assert lab == {i: int(i % 5 < 2) for i in range(100)}
    # "win" stands in good hosts as often, so it is no rule
    flagged = {r["page_id"] for r in urls.filter_urls(pages, urls.weak_labels(pages)).where("flagged").collect()}
    assert flagged == {i for i in range(100) if i % 5 < 2}


# --- 10 fingerprints


def brute_sketch(t, k=5, keep=1):
    w = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in words_of(t)]
    if not w:
        return []
    h = {sum(x * fingerprints.place(j) for j, x in enumerate(w[i : i + k])) % 2**64 for i in range(max(1, len(w) - k + 1))}
    return sorted(x for x in h if x < keep << 60)


def brute_links(sketches, at_least=0.5):
    """What ``links`` returns, by comparing all with all."""
    entries = {}
    for i, x in sorted(sketches.items()):
        if x:
            entries.setdefault(tuple(x), []).append(i)
    share = {(a[0], b[0]): len(set(x) & set(y)) / len(x) for (x, a), (y, b) in itertools.permutations(entries.items(), 2)}
    out = set()
    for i, x in sketches.items():
        own = entries.get(tuple(x), [])
        e = own[0] if own else None
        up = sorted(((-c, b) for (a, b), c in share.items() if a == e and c >= at_least))
        down = sum(c >= at_least for (a, b), c in share.items() if b == e)
        out.add((i, e, len(own), len(x), len(up), down, up[0][1] if up else None, -up[0][0] if up else 0.0))
    return out


def test_sketches_and_links(spark):
    rng = random.Random(15)
    long = [sentence(rng, 1500, VOCAB) for _ in range(6)]
    texts = [*long]
    for t in long:
        w = t.split()
        texts += [" ".join(w[100:500]), " ".join(w[:900]), t + " " + sentence(rng, 200, VOCAB)]
    texts += [texts[0].upper(), long[1] + " " + long[2]]
    passage = sentence(rng, 90, VOCAB)
    texts += [sentence(rng, rng.randint(5, 150), VOCAB) + " " + passage for _ in range(40)]  # one class, of different texts
    for i in range(30):  # near copies, and texts of a few words inside long ones
        w = long[i % 6].split()
        w[rng.randrange(1500)] = "other"
        k = rng.randrange(1400)
        texts += [" ".join(w), " ".join(w[k : k + rng.randint(3, 40)])]
    docs = table(spark, list(enumerate(texts)) + AWKWARD[:1], extra=True)
    s = {r["doc_id"]: r["sketch"] for r in fingerprints.sketches(docs).collect()}
    want = {i: brute_sketch(t) for i, t in enumerate(texts)}
    assert s == want and sum(0 < len(x) < 4 for x in want.values()) > 10
    for at_least in (0.5, 0.3, 1.0):
        got = [tuple(r) for r in fingerprints.links(fingerprints.sketches(docs), at_least).collect()]
        assert len(got) == len(texts) and set(got) == brute_links(want, at_least)
    m = fingerprints.merge(fingerprints.sketches(docs).where("doc_id in (1, 2)").withColumn("g", F.lit(0)), "g").first()["sketch"]
    assert m == sorted(set(want[1]) | set(want[2]))
    assert abs(len(m) / 3000 - 1 / 16) < 0.02


def test_fingerprints_awkward(spark):
    docs = table(spark, AWKWARD, extra=True)
    s = fingerprints.sketches(docs)
    assert s.count() == len(AWKWARD) - 1
    every = {i: sorted({h for j, t in AWKWARD if j == i for h in brute_sketch(t, keep=16)}) for i, _ in AWKWARD if i is not None}
    big = fingerprints.sketches(docs, keep=16)
    signed = lambda x: {i: sorted(h - 2**64 if h >= 2**63 else h for h in v) for i, v in x.items()}
    assert {tuple(r) for r in fingerprints.links(big).collect()} == brute_links(signed(every))
    assert fingerprints.links(s.where("false")).count() == 0


def test_copies_alone_and_repeated_ids(spark):
    rng = random.Random(16)
    t, u = sentence(rng, 300, VOCAB), sentence(rng, 300, VOCAB)
    docs = table(spark, [(1, t), (2, t.upper()), (3, u), (4, ""), (7, t), (7, u), (7, u), (8, u)])
    want = {1: brute_sketch(t), 2: brute_sketch(t), 3: brute_sketch(u), 4: [], 7: sorted({*brute_sketch(t), *brute_sketch(u)}), 8: brute_sketch(u)}
    got = {tuple(r) for r in fingerprints.links(fingerprints.sketches(docs)).collect()}
    assert got == brute_links(want) and {r[:3] for r in got} >= {(1, 1, 2), (2, 1, 2), (3, 3, 2)}


def test_sketches_take_small_batches(spark):
    old = {k: spark.conf.get(k, None) for k in (common.BATCH_CONF, common.READ_CONF)}
    text = " ".join(VOCAB[:100])
    docs = table(spark, [(i, text) for i in range(5_000)]).coalesce(1)
    sizes = lambda: [r["n"] for r in docs.select("text").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect()]
    try:
        for k in old:
            spark.conf.unset(k)
        assert max(sizes()) > 2 * common.BATCH_BYTES
        rows = fingerprints.sketches(docs).collect()
        assert max(sizes()) <= 1.1 * common.BATCH_BYTES and spark.conf.get(common.READ_CONF) == str(common.READ_ROWS)
        assert {r["doc_id"] for r in rows} == set(range(5_000)) and {tuple(r["sketch"]) for r in rows} == {tuple(brute_sketch(text))}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_very_long_texts(spark):
    """Texts beyond a step (1 MB) and a segment (2 MB), for all operators."""
    rng = random.Random(41)
    w = [rng.choice(VOCAB) for _ in range(420_000)]
    item = " ".join(f"q{i}x" for i in range(30))
    long = " ".join(w)
    near = " ".join([*w[:1000], "changed", *w[1001:]])
    end = long + " " + item + "\nReleased under the MIT License."
    assert len(long) > 2_200_000
    texts = [(1, long), (2, near), (3, end), (4, " ".join(w[300_000:300_400])), (5, "a short text"), *((10 + i, t + (" grmble" if y else "")) for i, t, y in toxic_corpus(40))]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(10 + i, 1, y) for i, _, y in toxic_corpus(40)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    r = {x["doc_id"]: x for x in toxicity.score(docs, labels).collect()}
    assert len(r) == len(texts) and r[3]["evidence"][0]["doc_id"] == 3 and r[3]["evidence"][0]["cosine"] > 0.999 and not r[1]["toxic"]
    g = {x["doc_id"]: x["group_id"] for x in simhash.simhash_groups(docs).collect()}
    assert g[1] == g[2] == 1
    got = {(x["item_id"], x["doc_id"]): x for x in decontam.contaminated(docs, spark.createDataFrame([(7, item), (8, " ".join(w[-20:]))], "item_id long, text string")).collect()}
    assert got[7, 3]["phrase_words"] == 30 and got[7, 3]["doc_start"] == 420_000 and {(8, 1), (8, 2), (8, 3)} <= set(got) and not {d for _, d in got} & {5}
    x = {x["doc_id"]: x for x in langid.identify(docs).collect()}
    assert x[1]["language"] == "en" and not x[1]["rejected"]
    check_packing([len(regex.findall(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]", t)) for _, t in texts], packing.pack(docs).collect(), 2048)
    assert [(x["doc_id"], x["part"], x["license_id"]) for x in licenses.scan(docs).collect()] == [(3, "line", "MIT")]
    x = {x["doc_id"]: x for x in fingerprints.links(fingerprints.sketches(docs)).collect()}
    assert x[4]["containers"] >= 1 and x[4]["containment"] == 1.0 and x[4]["container"] in (1, 2, 3) and x[1]["contents"] >= 2
    chats = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", near)], "conv_id long, turn long, role string, text string")
    assert max(len(x["text"]) for x in chat.format_chats(chats).collect()) >= len(near)
    pages = spark.createDataFrame([(1, "http://casino.com/" + "x" * 300_000), (2, "http://a.com/?" + "&".join(f"p{i}={i}" for i in range(3000)))], "page_id long, url string")
    assert urls.filter_urls(pages, urls.weak_labels(pages)).count() == 2


def test_pyarrow_column_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "", "bc"])], names=["t"])
    from leafmill.llm.common import steps

    (lo, hi, data, offs), = steps(batch.slice(1), "t")
    assert (lo, hi, bytes(data), offs.tolist()) == (0, 2, b"bc", [0, 0, 2]) and re.match("b", "bc")


def test_shared_dir(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace as Fake

    from leafmill.llm import common

    given = spark.conf.get("spark.checkpoint.dir", None)
    want = common.qualified(spark, given) if given else common._own_dir(spark)
    assert common.shared_dir(spark) == want and materialise(spark.range(2), "here")._leafmill_path.startswith(f"{want}/leafmill/here-")
    assert common.qualified(spark, str(tmp_path)) == f"file://{tmp_path}" and common.qualified(spark, "file:///x") == "file:///x"
    assert common._own_dir(spark) == common._own_dir(spark)
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            common._own_dir(Fake(sparkContext=Fake(master=master)))
    for master in ("local", "local[*]", "local[4,2]"):
        assert common._own_dir(Fake(sparkContext=Fake(master=master))).startswith("file:///")
    if not given:  # setCheckpointDir counts as well
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        assert common.shared_dir(spark).startswith(f"file://{tmp_path}/")
