"""Shingles against the JVM's n-grams, and how often features are moved and read."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import similarity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that similarity writes, by name."""
    plans, write = {}, similarity.materialize

    def kept(df, name):
        plans[name] = plan(df)
        return write(df, name)

    monkeypatch.setattr(similarity, "materialize", kept)
    return plans


def test_shingles_are_the_ngrams(spark):
    rows = ["a b c d", "", None, "a", "Ä b_1 Ä b_1 c", "漢字 かな ١٢٣ áb x", "😀 a 𝒜𝒷 c — d… e", "a b c " * 70_000, "x", "ab c d", "a bc d"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "id string, t string").repartition(1)
    for n in (1, 2, 3):
        want = {r.id: r.n for r in df.select("id", F.size(text.ngrams(text.tokens(F.col("t")), n)).alias("n")).collect() if r.n > 0}
        got = {r.id: r.s for r in similarity.word_sets(df, "id", F.col("t"), n).collect() if r.s}
        assert {i: len(s) for i, s in got.items()} == want and all(list(s) == sorted(set(s)) for s in got.values())
    assert not set(got["9"]) & set(got["10"]) and len(set(got["0"]) & set(got["7"])) == 1


def test_features_are_exchanged_once(spark, written):
    rows = spark.createDataFrame([(i, f"w{i % 3} a b c d e f g") for i in range(9)], "id long, t string")
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(similarity.word_sets(rows, "id", F.col("t"), 3), 0.6).collect()}
    assert got == {(a, b): 1.0 if a % 3 == b % 3 else 5 / 7 for a in range(9) for b in range(a + 1, 9)}
    assert written["prefixes"].count("Generate explode(s#") == 1


def test_texts_stay_where_copies_are_dropped(spark, tmp_path, written):
    from millrace.plans import catalog

    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "other a b c d e"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None), (5, "other a b c d e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in catalog._edges(spark, str(tmp_path)).collect())
    assert got == [(1, 2, "exact"), (1, 3, "exact"), (2, 5, "exact")]
    assert "Exchange hashpartitioning(doc_id" not in written["sets"].split("MapInArrow")[1].split("BroadcastExchange")[0]


def test_similar_to_reference_reads_each_side_once(spark):
    rows = [(1, "a b c d e"), (2, "a b c x y z"), (3, "q"), (4, None), (None, "a b c d e"), (5, "a b c d e")]
    df = spark.createDataFrame(rows, "id long, t string")
    sets = similarity.word_sets(df, "id", F.col("t"), 2)
    ref = similarity.word_sets(spark.createDataFrame([(7, "a b c d")], "id long, t string"), "id", F.col("t"), 2)
    out = similarity.similar_to_reference(sets, ref, 0.3)
    assert plan(out).count("Generate explode") == 2
    assert sorted((r.id, r.ref, round(r.similarity, 6)) for r in out.collect()) == [(1, 7, 0.75), (2, 7, 0.333333), (5, 7, 0.75)]
