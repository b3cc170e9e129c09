import hashlib
from collections import Counter

import pytest

from millrace.llm.placement import SLOTS, lookup_table, moved_share, place, write_shards


def brute(names, slots):
    num = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    prefs = [[(num(f"offset:{n}") % slots + j * (num(f"skip:{n}") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    owner = {}
    turn = 0
    while len(owner) < slots:
        i = turn % len(names)
        owner[next(s for s in prefs[i] if s not in owner)] = i
        turn += 1
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 7), (3, 7), (5, 101), (16, 499)])
def test_table_against_brute_force(n, slots):
    names = [f"shard-{i}" for i in range(n)]
    table = lookup_table(names, slots)
    assert table == brute(names, slots)
    load = Counter(table).values()
    assert max(load) - min(load) <= 1


def test_bad_tables():
    for names, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            lookup_table(names, slots)


def test_few_move():
    names = [f"shard-{i}" for i in range(16)]
    gone = names[:5] + names[6:]
    assert 1 / 16 <= moved_share(names, gone) < 1 / 16 + 0.06


def test_place(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x", 5) for i in range(3000)] + [(None, "x", 5), (7, "again", 5)], "doc_id long, text string, slot int")
    rows = place(docs).collect()
    table = lookup_table([f"shard-{i}" for i in range(16)])
    assert len(rows) == 3002
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])
    assert place(docs.limit(0)).collect() == []
    write_shards(docs, str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.shard) for r in rows}
    assert back.count() == 3002 and {(r.doc_id, r["__shard"]) for r in back.collect()} == want
