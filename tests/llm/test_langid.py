import random
import zlib

import numpy as np

from millrace.llm.langid import CHUNK, _gradients, classify, identify, train, training_sample


def test_gradients_match_differences():
    net = train([b"abcabc", b"xyzxyz"], [0, 1], ["a", "x"], steps=2, hidden=3)
    for d in (net.forward, net.backward):
        d.table, d.within = d.table.astype(float), d.within.astype(float)
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    x = np.array([[97, 120], [98, 121], [99, 122], [97, 120]], np.uint8)
    gold = np.array([0, 1])

    def loss():
        total = 0.0
        hs = []
        for d, times in ((net.forward, range(4)), (net.backward, range(3, -1, -1))):
            h, kept = np.zeros((3, 2)), {}
            for t in times:
                h = d.step(x[t], h)[0]
                kept[t] = h
            hs.append(kept)
        for t in range(4):
            y = net.out @ np.concatenate([hs[0][t], hs[1][t]]) + net.bias
            p = np.exp(y) / np.exp(y).sum(axis=0)
            total -= np.log(p[gold, [0, 1]]).sum()
        return total / 8

    params = [net.forward.table, net.forward.within, net.backward.table, net.backward.within, net.out, net.bias]
    for p, g in zip(params, _gradients(net, x, gold)):
        for at in [(0, min(1, p.shape[1] - 1)), (p.shape[0] - 1, min(97, p.shape[1] - 1)), (1, 0)]:
            old = p[at]
            p[at] = old + 1e-4
            up = loss()
            p[at] = old - 1e-4
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-4 - g[at]) < 1e-4


def words(r, alphabet, n):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(2)
    rows = [(i, words(r, "etaoinshr" if i % 2 else "aeiouñlrj", r.randint(3, 200)), "en" if i % 2 else "es") for i in range(300)]
    rows += [(900, None, "en"), (901, "", "es"), (902, "123 !?", "en"), (None, "tins shore then", None), (903, words(r, "aeiouñlrj", 30000), None)]
    docs = spark.createDataFrame([(i, t, g, "s", 0.5) for i, t, g in rows], "doc_id long, text string, lang string, source string, score double")
    got = {x.doc_id: x for x in identify(docs).collect()}
    assert len(got) == len(rows)
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[903].lang_pred == "es" and got[None].held_out is False
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, x in got.items() if x.held_out and i is not None and i < 300} == set(held)
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())


def plain_forward(net, text):
    """Mean label probabilities over all bytes, place by place, a gate at a time."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, total = net.out.shape[1] // 2, 0.0
    for at in range(0, len(text), CHUNK):
        chunk, sides = text[at : at + CHUNK], []
        for d, seq in ((net.forward, range(len(chunk))), (net.backward, range(len(chunk) - 1, -1, -1))):
            h, kept = np.zeros(n), {}
            for t in seq:
                x, u = d.table[:, chunk[t]], d.within @ h
                z, r = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
                h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
                kept[t] = h
            sides.append(kept)
        for t in range(len(chunk)):
            y = np.exp(net.out @ np.concatenate([sides[0][t], sides[1][t]]) + net.bias[:, 0])
            total = total + y / y.sum()
    return total / len(text)


def test_predictions_against_plain_forward(spark):
    r = random.Random(6)
    net = train([words(r, "etaoinshr", 40).encode(), words(r, "aeiouñlrj", 40).encode(), words(r, "xyzwv", 40).encode()], [0, 1, 2], ["en", "es", "xx"], steps=40)
    texts = [words(r, a, n) for a in ("etaoinshr", "aeiouñlrj", "xyzwv") for n in (1, 5, 24, 25, 130, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for x in classify(docs, net, "text", "lang_pred", "score").collect():
        p = plain_forward(net, texts[x.doc_id].encode())
        assert x.lang_pred == net.labels[int(p.argmax())] and abs(x.score - p.max()) < 1e-4


def test_numerals_are_no_letters(spark):
    rows = [(i, "tins shore hat", "en") for i in range(8)] + [(100, "½ ² 3", "en"), (101, "Ⅷ ① 7", "en"), (102, "ª", "en"), (103, "7 日", "en")]
    got = {x.doc_id: x.lang_pred for x in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == "und" and got[102] == got[103] == "en"


def test_every_label_is_learned(spark):
    r = random.Random(3)
    rows = [(i, words(r, "abcdef", 20), f"l{i % 90:02}") for i in range(900)] + [(None, "same text", "null-ids")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    segments, targets, labels = training_sample(docs, "doc_id", "text", "lang", sample=180)
    assert len(labels) == 91 and set(targets) == set(range(91)) and len(segments) == len(targets) <= 4 * 182


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(x.lang_pred, x.score) for x in identify(docs).collect()] == [("und", 0.0)]
    assert identify(docs.limit(0)).collect() == []


def test_chunks_are_independent_of_their_neighbours():
    net = train([b"abcabc", b"xyzxyz"], [0, 1], ["a", "x"], steps=5)
    a, b = b"abc" * 100, b"xyz" * 7
    one = net.predict(np.frombuffer(a + b, np.uint8), np.array([0, 300, 321]))
    assert np.allclose(one[1], net.predict(np.frombuffer(b, np.uint8), np.array([0, 21]))[0], atol=1e-5)
    assert np.allclose(one.sum(axis=1), 1, atol=1e-4)
