import random

import pyarrow as pa
import pytest

from millrace.llm.near import shingle_sets, similar_texts


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_similar(texts):
    sets, first = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if len(x | y) == 0 or len(x & y) / len(x | y) >= 0.8:
                r, s = sorted((root(a), root(b)))
                first[s] = r
    return {i: root(i) for i in ids}


def edited(r, words, n):
    out = list(words)
    for k in r.sample(range(len(out)), n):
        out[k] = f"new{r.randrange(10**6)}"
    return out


def planted(seed=5):
    """Originals of 50 to 300 words with copies of 1 to 9 scattered edits, over a line that all share."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    line, texts = [r.choice(vocab) for _ in range(12)], {}
    for k in range(40):
        words = [r.choice(vocab) for _ in range(r.randint(50, 300))] + line
        texts[k] = " ".join(words)
        for m in range(3):
            texts[100 + 3 * k + m] = " ".join(edited(r, words, r.randint(1, 9)))
    return texts | {900: "", 901: " \n", 902: "One two", 903: "one  TWO", 904: "one two three", 905: "a b c d e", 906: " ".join(["a"] * 30), 907: " ".join(["a"] * 9)}


def test_shingle_sets():
    texts = list(planted().values()) + [None]
    for t, s in zip(texts, shingle_sets(pa.array(texts))):
        assert len(s) == len(shingles(t or ""))


@pytest.mark.parametrize("seed", [5, 6])
def test_every_similar_text_is_found(spark, seed):
    texts = planted(seed)
    want = brute_similar(texts)
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    got = {x.id: x.first for x in similar_texts(docs).collect()}
    assert got == want
    assert sum(want[i] != i for i in range(100, 220)) > 40 and any(want[i] == i for i in range(100, 220))


def test_stage_drops_copies_with_scattered_edits(spark):
    import corpus_pipeline
    from millrace.llm.simhash import fingerprint

    r = random.Random(1)
    words = [f"w{r.randrange(900)}" for _ in range(300)]
    copies = [" ".join(edited(r, words, 6)) for _ in range(20)]
    far = [(fingerprint(" ".join(words).encode()) ^ fingerprint(c.encode())).bit_count() for c in copies]
    assert max(far) > 4
    rows = [(0, " ".join(words), "en")] + [(i + 1, c, "en") for i, c in enumerate(copies)]
    rows = [x for x in rows if len(shingles(x[1]) & shingles(rows[0][1])) / len(shingles(x[1]) | shingles(rows[0][1])) >= 0.8]
    assert len(rows) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [x.doc_id for x in corpus_pipeline.simhash_dedup(spark, docs, "").collect()] == [0]

