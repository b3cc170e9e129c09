import itertools
import random

from millrace.llm.decontaminate import MASKS, leaks, lossless
from millrace.llm.quality import Rule, cascade_order, default_rules, quality_report, with_features
from pyspark.sql import functions as F


def test_masks_are_lossless():
    assert lossless(MASKS, 13, 2)
    assert not lossless(MASKS[:1], 13, 2) and not lossless(MASKS, 13, 3)


def brute_leaks(docs, items, w=13, s=2):
    import re

    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for (d, t), (i, u) in itertools.product(docs, items):
        a, b = tok(t), tok(u)
        size, need = (w, w - s) if len(b) >= w else (len(b), len(b))
        if not size or size < 4 and size != len(a):
            continue
        hits = [(x, n) for x in range(len(a) - size + 1) for y in range(len(b) - size + 1) if (n := sum(p == q for p, q in zip(a[x : x + size], b[y : y + size]))) >= need]
        if hits:
            out[d, i] = (max(n for _, n in hits), min(x for x, _ in hits), max(x for x, _ in hits) + size)
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([40, 25, 13, 12, 9, 8, 7, 1, 0])] + [(90, None), (91, "dup " * 30)]
    docs = []
    for d in range(80):
        body = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        src = (r.choice(items)[1] or "").split()
        part = src[r.randint(0, 3) :][: r.randint(8, 40)]
        for _ in range(r.randint(0, 4)):
            if part:
                part[r.randrange(len(part))] = "other"
        docs.append((d, (" ".join(body + part + body[:5])).replace("w1 ", "W1, ")))
    docs += [(None, None), (200, ""), (201, "dup " * 40), (202, "x"), (203, items[7][1]), (204, f"{items[7][1]} x"), (205, f"a b {items[6][1]} c"), (206, ("z " * 70000) + items[0][1])]
    df = spark.createDataFrame([(d, t, 1, "q") for d, t in docs], "doc_id long, text string, item long, tokens string").repartition(3)
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    want = brute_leaks(docs, items)
    for block in (100_000, 40):
        got = {(x.doc_id, x.item_id): (x.best, x.doc_from, x.doc_to) for x in leaks(df, bench, block_seeds=block).collect()}
        assert got == want and len(want) > 20 and {(203, 7), (205, 6), (206, 0)} <= set(got) and (204, 7) not in got
    assert leaks(df.limit(0), bench).collect() == [] and leaks(df, bench.limit(0)).collect() == []


def test_quality_edges(spark):
    good = " ".join(f"word{'abcdefgh'[i % 8]}{'xyzuvw'[i % 6]}" for i in range(60))
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, "a b"), (4, "same line here\n" * 40), (5, good + " " + "#" * 60), (6, "LOUD WORDS " + " ".join(f"X{chr(65 + i % 26)}Q{chr(65 + i // 26)}" for i in range(70))), (7, "a\x0bb c"), (8, good * 50)]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, n_words int, words string")
    got = [(x.doc_id, x.n_words, x.n_repeat_words, x.base_failed, x.kept) for x in quality_report(docs).collect()]
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(rows) and by[1] == by[2] == (0, 0, True, False)
    assert by[None][:2] == (2, 0) and by[7][0] == 2
    assert by[4] == (120, 120, True, False)
    assert by[5][3] is False and by[6][3] is False
    w = good.split()
    tri = [tuple(w[i : i + 3]) for i in range(58)]
    assert by[3][1] == len({i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)})
    assert quality_report(docs.limit(0)).collect() == []


def test_cascade_orders_by_rejection_per_cost(spark):
    df = with_features(spark.createDataFrame([(i, "a b c " * (i % 3)) for i in range(30)], "id long, text string"))
    rules = [Rule("dear", F.lit(True), F.lit(100.0)), Rule("cheap", F.col("n_words") > 3, F.lit(1.0)), Rule("never", F.lit(False), F.lit(1.0))]
    assert [r.name for r in cascade_order(df, rules, 30)] == ["cheap", "dear", "never"]
    assert len(cascade_order(df.limit(0), default_rules(), 0)) == len(default_rules())
