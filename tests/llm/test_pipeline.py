import hashlib
import random

import pytest

from tests.llm.test_native import brute_leaks
from tests.llm.test_near import brute_similar
from tests.llm.test_repeats import brute

pytest.importorskip("tokenizers")


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from millrace.llm.bpe import default_path
    from tokenizers import Tokenizer

    r = random.Random(12)
    tongues = {"en": "etaoinshr", "es": "aeiouñlrj"}
    word = lambda g: "".join(r.choice(tongues[g]) for _ in range(r.randint(3, 8)))
    text = lambda g, n: " ".join(word(g) for _ in range(n))
    rows = [(i, text(g, r.randint(30, 90)), g) for i in range(120) for g in [r.choice(["en", "es"])]]
    items = [(i, text("en", 30)) for i in range(4)]
    passage = text("en", 60)
    for k in range(10):
        rows.append((200 + k, text("en", 40) + "\n" + passage + "  " + text("en", 20), "en"))
        rows.append((220 + k, rows[k][1] + " extra", rows[k][2]))
        rows.append((240 + k, text("en", 60) + " " + items[k % 4][1] + " " + text("en", 30), "en"))
        rows.append((260 + k, rows[k + 20][1], rows[k + 20][2]))
    rows += [(300, None, "en"), (301, "", "es"), (302, "12 34", "en"), (304, passage, "en"), (305, text("es", 50), None)]
    rows.append(rows[3])
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: (x.n_tokens, list(x.ids), x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = {i: t for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    groups = brute_similar(left)
    left = {i: t for i, t in left.items() if groups[i] == i}
    kept = brute(list(left.items()), bytes.split, 20, b" ".join)
    left = {i: t if kept[i][1] == 0 else kept[i][3].decode() for i, t in left.items() if kept[i][1] < kept[i][0]}
    bad = {d for d, _ in brute_leaks(list(left.items()), items)}
    assert {240, 241, 242, 243} <= bad and 260 not in left and 304 in groups
    left = {i: t for i, t in left.items() if i not in bad}
    lib = Tokenizer.from_file(default_path())
    want = {}
    for i, t in left.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), ids, hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want


def test_stages_with_other_columns_nulls_and_long_texts(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(3, 8))) for _ in range(n))
    long = text(30_000)
    rows = [(None, text(40), "en"), (None, text(40), None), (7, text(40), "en"), (7, text(40), "en"), (8, long, "en"), (9, long + " more", "en"), (10, None, None), (11, "", "en")]
    names = "doc_id long, text string, lang string, row string, language int, score string, id int, first long, kept string, n int, gone long"
    docs = spark.createDataFrame([(*x, "r", 1, "s", k, 2, "k", 3, 4) for k, x in enumerate(rows)], names).repartition(3)
    spark.createDataFrame([(1, text(30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), names)
    got = docs.collect()
    assert sorted(x.id for x in got) == [0, 1, 2, 3, 4]
    assert all((x.text, x.row, x.language, x.score, x.first, x.kept, x.n, x.gone) == (rows[x.id][1], "r", 1, "s", 2, "k", 3, 4) and x.lang == "en" for x in got)


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
