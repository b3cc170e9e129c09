import hashlib
import random

import numpy as np
import pytest

from millrace.llm.repeats import Bytes, Repeats, Words
from millrace.llm.substring_dedup import SuffixAutomaton, automaton_matcher, dedup_word_spans, match_reference
from millrace.llm.suffix_dedup import array_matcher, dedup_substrings, longest_previous_factor, suffix_array


def brute(rows, tokens, width, join):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        t = tokens((text or "").encode())
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            w = tuple(t[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(t), sum(gone), spans, join([x for x, g in zip(t, gone) if not g]))
    return out


def corpus(seed, words=400):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(words)]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", " ", "\n", "  "]) for _ in range(n))
    line = text(14)
    docs = [text(r.randint(0, 120)) for _ in range(60)]
    for i in range(0, 60, 3):
        a = docs[r.randrange(60)]
        docs[i] = docs[i][:50] + a[r.randint(0, 30) : r.randint(60, 400)] + docs[i][50:]
    docs += [line + text(30) for _ in range(40)] + [docs[5]] * 4 + ["aaaa" * 200, "ab" * 300, "x y " * 100, "", "a", None]
    return [(None if i == 7 else i * 3, t) for i, t in enumerate(docs)]


def test_lpf_matches_brute_force():
    r = random.Random(3)
    for _ in range(20):
        d = np.array([r.randint(0, 2) for _ in range(r.randint(0, 60))], np.uint8)
        lpf = longest_previous_factor(d)
        n = len(d)
        want = [max([next(k for k in range(n - i + 1) if i + k == n or d[i + k] != d[j + k]) for j in range(i)], default=0) for i in range(n)]
        assert lpf.tolist() == want
        starts = np.arange(n) <= n - 4
        assert (longest_previous_factor(d, 4, starts) >= 4).nonzero()[0].tolist() == [i for i in range(n - 3) if lpf[i] >= 4]
        assert longest_previous_factor(d, 4).tolist() == np.minimum(lpf, 4).tolist()
        assert longest_previous_factor(d, 4, least=4).tolist() == longest_previous_factor(d, 4, starts, least=4).tolist() == np.where(lpf < 4, 0, 4).tolist()
        assert longest_previous_factor(d, 9, least=3).tolist() == np.where(lpf < 3, 0, np.minimum(lpf, 9)).tolist()
        assert suffix_array(d, max(1, n))[0].tolist() == sorted(range(n), key=lambda i: d[i:].tolist())


def test_lpf_of_long_chains():
    for text in (b"a" * 3000, b"ab" * 1500, b"abc" * 900 + b"zz" + b"abc" * 900, b"x" * 50 + b"a" * 999 + b"x" * 60):
        d = np.frombuffer(text, np.uint8)
        lpf, longest = longest_previous_factor(d, 40), np.array([max((k for k in range(41) if text.find(text[i : i + k]) < i and i + k <= len(text)), default=0) for i in range(len(text))])
        assert lpf.tolist() == longest.tolist()


def test_automaton_statistics():
    a = SuffixAutomaton()
    assert [a.feed(x) for x in "abcabca"] == [0, 0, 0, 1, 2, 3, 4]
    assert a.statistics("bcaxabc") == [1, 2, 3, 0, 1, 2, 3]


@pytest.mark.parametrize("crowd", [2, 512])
@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_repeats(spark, kind, crowd):
    rows = corpus(crowd)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "id long, text string, s string, kind string").repartition(3)
    from millrace.llm.common import keyed_text

    if kind == "bytes":
        got = Repeats(Bytes, 30, 8, array_matcher, crowd).cleaned(keyed_text(docs, "id"))
        want = brute(rows, lambda b: list(b), 30, bytes)
    else:
        got = Repeats(Words, 6, 3, automaton_matcher, crowd).cleaned(keyed_text(docs, "id"))
        want = brute(rows, bytes.split, 6, b" ".join)
    got = {None if r.id == -(2**63) else r.id: (r.n, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()}
    assert got == want


def test_long_pieces(spark, monkeypatch):
    import millrace.llm.repeats as m

    r = random.Random(1)
    a = "".join(r.choice("abc ") for _ in range(5000))
    rows = [(1, a), (2, a[100:4000] + a[:50]), (3, "z" + a)]
    monkeypatch.setattr(m, "BLOCK", 700)
    rp = Repeats(Bytes, 100, 32, array_matcher)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"id": [1, 2, 3], "text": [t for _, t in rows]})
    windows = sum(int((x["e"] - x["s"] + 1).sum()) for x in rp.runs_of(batch))
    assert windows == sum(len(t) - 99 for _, t in rows)


def test_interfaces_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int, kept int")
    assert dedup_substrings(empty).collect() == [] and dedup_word_spans(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, text, 5), (3, None, 5), (None, "", 5)], "doc_id long, text string, n_removed int")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in dedup_word_spans(docs).collect())
    assert got == [(-1, 0, 0, ""), (1, 40, 0, text), (1, 40, 0, text), (2, 40, 40, ""), (3, 0, 0, "")]
    got = sorted((r.doc_id or -1, r.n_removed, hashlib.sha256(r.kept).hexdigest()[:4]) for r in dedup_substrings(docs).collect())
    assert [g[1] for g in got] == [0, 0, 0, len(text), 0]


def test_match_reference(spark):
    ref = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"w{i}" for i in range(5, 30)) + " c"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in match_reference(docs, ref).collect()] == [(1, 2, 27)]
