import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm.bpe import PairIndexBPE, array_worker, default_path, encode_documents, gathered, round_trip
from millrace.llm.token_store import Codes, TokenFile, stored_digests, write_file, write_store
from millrace.plans.scratch import scratch_path

TEXTS = ["", None, "a", "Hello <|endoftext|>World's ΣΑΣ aaaaaaaa it'll don't 12a", "a\x1cb\x0b  c\u0085d e", "é̀ <|startoftext| İstanbul ǅ 'S'T", "x" * 5000, "ab" * 3000 + " " + "ñ" * 700, "\n\t ", "the the the. the,the", "日本語 テキスト 123", "ﬁ ẛ̣ \U0001f600!!"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_every_code_point_as_the_library(library):
    bpe = PairIndexBPE(default_path())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or c % 211 == 0)]
    texts = ["".join(f"a{c}b{c}{c}" for c in chars[i : i + 50]) for i in range(0, len(chars), 50)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert want == [bpe.encode(t) for t in texts]
    texts += [t.replace("a", "Éx").replace("b", " É,ß'S 1Ab...à ") for t in texts]
    want += [e.ids for e in library.encode_batch(texts[len(want) :], add_special_tokens=False)]
    state, got = array_worker(bpe), []
    for index, cuts, values in state.blocks(pa.array(texts)):
        flat, n = gathered(index, cuts, [v[0] for v in values])
        got += [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    assert got == want


def random_texts(n):
    r = random.Random(7)
    return ["".join(r.choice("abcdefghijklmnop'sé  \n.,!1Ñ") for _ in range(r.randint(0, 300))) for _ in range(n)]


def test_round_trip_as_the_library(spark, library):
    rows = list(enumerate(TEXTS + random_texts(200))) + [(None, "null id"), (3, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n_tokens int").repartition(3)
    got = sorted(((-1 if x.doc_id is None else x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in round_trip(docs).collect())
    want = []
    for i, t in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    full = {x.doc_id: x for x in encode_documents(docs).collect()}
    assert full[9].ids == library.encode(TEXTS[9], add_special_tokens=False).ids
    assert round_trip(docs.limit(0)).collect() == []


def test_memory_of_a_worker_that_gives_ids():
    # a process of its own: the largest size of this one says nothing
    code = """
import random, resource
import pyarrow as pa
from millrace.llm.bpe import PairIndexBPE, array_worker, default_path, gathered, sentences
state, r = array_worker(PairIndexBPE(default_path())), random.Random(5)
texts = pa.array([" ".join("".join(r.choices("etaoinshrd", k=7)) for _ in range(500)) for _ in range(1000)])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
before, n = peak(), 0
for index, cuts, values in state.blocks(texts):
    flat, counts = gathered(index, cuts, [v[0] for v in values])
    n += len(sentences(index, cuts, [v[1] for v in values]))
print(n, peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300, cwd=Path(__file__).parents[2])
    n, grown = map(int, out.stdout.split())
    assert n == 1000 and grown < 250


@pytest.mark.parametrize("top", [1, 200, 256, 70_000, 2**40])
def test_codes_random_access(top):
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        v = r.integers(0, top, n)
        c = Codes.build(v)
        assert [c[i] for i in range(min(n, 600))] == v[:600].tolist()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert c.range(a, b).tolist() == v[a:b].tolist()
    with pytest.raises(IndexError):
        Codes.build(np.arange(3))[3]


def test_file_refuses_damage():
    data = write_file(np.arange(1000), np.array([5, 9]), np.array([0, 400, 1000]))
    f = TokenFile(data)
    assert f.document(1).tolist() == list(range(400, 1000)) and f.codes[777] == 777
    with pytest.raises(ValueError):
        TokenFile(data[:200] + b"\xff" + data[201:])


def test_store(spark, library):
    rows = [(i * 5 % 997, t) for i, t in enumerate(TEXTS + random_texts(150))] + [(None, "null id"), (1001, None)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, start int").repartition(4)
    got = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in stored_digests(docs).collect()}
    at, want = 0, {}
    for i, t in sorted(rows, key=lambda x: -1 if x[0] is None else x[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    assert stored_digests(docs.limit(0)).collect() == []
    many = write_store(docs, scratch_path(spark, "small"), file_tokens=50)
    assert many.count() > 20 and many.agg({"n_tokens": "sum"}).first()[0] == at
