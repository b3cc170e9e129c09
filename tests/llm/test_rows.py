"""Rows whose ids are null or repeated are documents of their own."""

import random

import pytest

from millrace.llm.substring_dedup import dedup_word_spans
from millrace.llm.suffix_dedup import dedup_substrings

r = random.Random(8)
word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
text = lambda n: " ".join(word() for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stage_keeps_null_and_repeated_ids(spark):
    import corpus_pipeline

    own = [(None, text(60)) for _ in range(30)] + [(7, text(60)), (7, text(60)), (8, text(60))]
    a, b = text(60), text(60)
    linked = [(None, a), (50, a), (None, b), (60, b)]
    got = corpus_pipeline.simhash_dedup(spark, frame(spark, own + linked), "")
    assert sorted(x.text for x in got.collect()) == sorted([t for _, t in own] + [a, b])
    got = corpus_pipeline.simhash_dedup(spark, frame(spark, [(5, a), (5, a), (4, b), (9, b)]), "")
    assert sorted((x.doc_id, x.text) for x in got.collect()) == sorted([(5, a), (4, b)])


def test_later_stages_keep_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    item = text(30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(None, text(60)) for _ in range(20)] + [(3, text(60))]
    docs = frame(spark, clean + [(None, text(20) + " " + item), (3, item)])
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(x.text for x in got.collect()) == sorted(t for _, t in clean)
    line = text(25)
    rows = [(None, text(k) + " " + line + " " + text(5)) for k in range(10, 20)] + [(3, text(60)), (3, text(60))]
    got = [x.text for x in corpus_pipeline.substring_dedup(spark, frame(spark, rows), "").collect()]
    assert sum(line in t for t in got) == 1
    assert sorted(len(t.split()) for t in got) == sorted([60, 60] + [k + 5 + 25 * (line in x) for k in range(10, 20) for x in [next(t for t in got if t.split()[0] == rows[k - 10][1].split()[0])]])


@pytest.mark.parametrize("dedup", [dedup_substrings, dedup_word_spans])
def test_dedup_of_null_and_repeated_ids(spark, dedup):
    line, whole = text(40), text(50)
    rows = [(i, text(k) + " " + line + " " + text(7)) for k in range(1, 9) for i in (None, 5)] + [(None, whole)] * 3 + [(5, text(60)), (6, whole)]
    got = [(x.doc_id, bytes(x.kept).decode() if not isinstance(x.kept, str) else x.kept) for x in dedup(frame(spark, rows)).collect()]
    assert sorted(str(i) for i, _ in got) == sorted(str(i) for i, _ in rows)
    kept = " ".join(t for _, t in got)
    assert kept.count(line) == 1 and kept.count(whole) == 1
    assert all(any(w in t for _, t in got) for _, x in rows for w in [x.split()[0], x.split()[-1]])
    assert (5, rows[-2][1]) in got


def test_numbered_orders_rows(spark):
    from millrace.llm.common import NULL_ID, keyed_text, numbered

    rows = [(None, "b"), (None, "b"), (2, "x"), (2, "x"), (2, "y"), (1, "z")]
    got = sorted((x.id, x.doc, x.text) for x in numbered(keyed_text(frame(spark, rows))).collect())
    assert [d for _, d, _ in got] == [NULL_ID, NULL_ID, 1, 2, 2, 2] and len({k for k, _, _ in got}) == 5
    assert len({x.id for x in numbered(keyed_text(frame(spark, rows)), apart=True).collect()}) == 6
