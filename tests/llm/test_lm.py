import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lm


def corpus():
    r = random.Random(8)
    tongues = [["the", "of", "and", "cat", "sat"], ["der", "und", "das", "katze", "sitzt"]]
    rows = []
    for i in range(400):
        t = tongues[i % 2]
        rows.append((i, " ".join(r.choice(t) if r.random() < 0.7 else r.choice(t)[:2] + r.choice("abcde") + str(i % 7) for _ in range(r.randint(0, 60)))))
    return rows + [(1000, None), (1001, ""), (1002, "THE unseen-word"), (None, "the")]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1.0, "w") for i, t in rows], "doc_id long, text string, score double, words string").repartition(3)
    got = {x.doc_id: x for x in lm.score_documents(docs).collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for i, ws in tokens.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    out = [i for i in held if held[i]]
    assert sum(got[i].score for i in out) > sum(got[i].base_score for i in out)
    assert lm.score_documents(docs.limit(0)).collect() == []


def test_score_against_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(lm, "words_for", lambda tokens: 8)
    nets, real = [], lm.fitted
    monkeypatch.setattr(lm, "fitted", lambda *a, **o: nets.append(real(*a, **o)) or nets[-1])
    rows = corpus() + [(5, "the " * 400 + "cat"), (5, "repeated id")]
    got = Counter((x.doc_id, x.n_tokens, round(x.score, 3)) for x in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    c = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in [*(t or "").lower().split(), None])
    common = [w for w, _ in sorted(((w, n) for w, n in c.items() if w), key=lambda x: (-x[1], x[0]))[:8]]
    kind = lambda w: 8 + lm.BUCKETS if w is None else common.index(w) if w in common else 8 + lm.bucket(w)
    n, v = Counter(), Counter()
    for w, k in c.items():
        n[kind(w)] += k
        v[kind(w)] += 1
    want, net = Counter(), nets[0]
    for i, t in rows:
        total, before = 0.0, [8 + lm.BUCKETS] * 2
        words = [*(t or "").lower().split(), None]
        for w in words:
            y = (net.inputs[before[1]] @ net.near + net.inputs[before[0]] @ net.far) @ net.outputs.T + net.bias
            y = y.astype(float)
            total += (y[kind(w)] - math.log(sum(math.exp(x) for x in y))) / math.log(10)
            if w is not None and w not in common:
                total += math.log10((c[w] + 1) / (n[kind(w)] + v[kind(w)] + 1))
            before = [before[1], kind(w)]
        want[(i, len(words), total)] += 1
    assert len(got) == len(want)
    for (i, k, x), (j, m, y) in zip(sorted(got, key=str), sorted(want, key=lambda z: str((z[0], z[1], round(z[2], 3))))):
        assert (i, k) == (j, m) and math.isclose(x, y, rel_tol=1e-4, abs_tol=2e-3)


def test_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 6**3, 200)
    net = lm.train(codes, rng.integers(1, 9, 200), classes=6, steps=30, dimensions=4)
    p = 10 ** net.log10_probabilities(np.arange(6), np.arange(6)[::-1])
    assert np.allclose(p.sum(axis=1), 1)


def test_training_finds_the_pattern():
    k = 8
    codes = np.array([(b * k + a) * k + (3 * a + 1) % k for a in range(k) for b in range(k)])
    net = lm.train(codes, np.full(len(codes), 100), classes=k, steps=600, dimensions=16)
    p = net.log10_probabilities(np.repeat(np.arange(k), k), np.tile(np.arange(k), k))
    hit = p[np.arange(k * k), (3 * np.repeat(np.arange(k), k) + 1) % k]
    assert hit.mean() > math.log10(2 / k)


def test_buckets_agree(spark):
    words = ["a", "the", "née", "日本語", "x" * 50, "ß"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(lm.bucket_column(lm.F.col("w"))).collect()]
    assert got == [lm.bucket(w) for w in words]


@pytest.mark.parametrize("sizes", [[1], [3, 1, 2]])
def test_contexts(sizes):
    t = np.arange(sum(sizes))
    a, b = lm.contexts(t, sizes)
    at = 0
    for s in sizes:
        seq = [lm.END, lm.END, *range(at, at + s)]
        assert a[at : at + s].tolist() == seq[1:-1] and b[at : at + s].tolist() == seq[:-2]
        at += s


def test_classes_and_training_grow(spark):
    assert lm.words_for(10**6) == lm.WORDS and lm.words_for(10**9) == 10 * lm.WORDS
    at, weight = lm.passed(np.array([1.0] * 50 + [1000.0]), np.random.default_rng(1))
    total = np.bincount(at, weight)
    assert set(at) == set(range(51)) and np.allclose(total[:50], total[50] / 1000)
    # most pairs of contexts are in one block only, so a model of the first block knows little of the others
    k, r = 256, np.random.default_rng(2)
    codes = np.unique(r.integers(0, k**2, 60000)) * k
    codes += 3 * (codes // k % k) % k
    n = r.integers(1, 9, len(codes))
    found = spark.createDataFrame(list(zip(codes.tolist(), n.tolist())), "triple long, n long").repartition(3)
    unigram = np.bincount(codes % k, n, k) + 0.5
    taken, begun, real = [], [], lm.train
    lm.train = lambda *a, **o: taken.append(len(a[0])) or begun.append(real(*a, **o)) or begun[-1]
    try:
        net = lm.fitted(found, k, unigram, block=12000)
    finally:
        lm.train = real
    assert len(taken) == 1 and taken[0] < len(codes) / 3  # the beginning; the other blocks are trained on in tasks

    def fit(net):
        p = net.log10_probabilities(codes // k % k, codes // k**2)
        assert np.allclose((10**p).sum(axis=1), 1)
        return float(np.average(p[np.arange(len(codes)), codes % k], weights=n))

    assert fit(net) > fit(begun[0])


def test_more_words_have_classes_in_a_larger_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm, "words_for", lambda tokens: 200)
    test_against_brute_force(spark)


def test_places_of_the_last_join_follow_the_shares(spark):
    import re

    docs = spark.createDataFrame([(i, f"one two w{i}") for i in range(60)], "doc_id long, text string").repartition(6)
    out = lm.score_documents(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(g#\d+L, 12\), REPARTITION_BY_NUM", plan)) == 2
    assert out.count() == 60
