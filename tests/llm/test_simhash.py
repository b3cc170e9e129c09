import random

import numpy as np
import pytest
import xxhash

from millrace.llm.simhash import Forest, fingerprint, links, near_duplicates, shard_masks, vantage_links


def brute_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(points, radius):
    left, out = set(points), {}
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        seen = []
        while todo:
            x = todo.pop()
            seen.append(x)
            near = [y for y in left if bin(points[x] ^ points[y]).count("1") <= radius]
            left.difference_update(near)
            todo += near
        for s in seen:
            out[s] = min(seen)
    return out


def test_fingerprint():
    for t in ["", "a", "A B c", "Éa b C d e F g", "x " * 50, "one two three four five six seven"]:
        assert fingerprint(t.encode()) == brute_fingerprint(t)


@pytest.mark.parametrize("seed", range(4))
def test_vantage_trees_connect_exactly(seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(40)]
    vals = set(base)
    for b in base[:10]:  # dense groups and chains
        x = b
        for _ in range(60):
            x ^= 1 << r.randrange(64)
            vals.add(x)
    for _ in range(400):
        vals.add(r.getrandbits(8) * 0x0101010101010101 & 0x1F1F1F1F0F0F0F0F)
    points = dict(enumerate(sorted(vals)))
    f = Forest(len(points))
    p = np.array(list(points.values()), np.uint64)
    vantage_links(p, 4, f, np.arange(len(p)))
    want = brute_components(points, 4)
    got = f.roots(np.arange(len(p)))
    assert len(set(zip(got.tolist(), [want[i] for i in range(len(p))]))) == len(set(want.values())) == len(set(got.tolist()))
    assert len(f.edges) == len(p) - len(set(want.values()))


@pytest.mark.parametrize("points, tables", [(10**6, 5), (10**9, 15), (10**11, 35)])
def test_shards_grow_in_number_and_lose_no_pair(points, tables):
    masks, r = shard_masks(4, points), random.Random(points)
    assert len(masks) == tables and points >> min(m.bit_count() for m in masks) <= 4096
    for _ in range(2000):
        x = sum(1 << b for b in r.sample(range(64), 4))  # how two fingerprints differ
        assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("members", [4096, 1, 0.00001])
def test_links_connect_the_same_whatever_the_shards(spark, members):
    r = random.Random(4)
    vals = {r.getrandbits(64) for _ in range(60)}
    for b in sorted(vals)[:20]:
        for _ in range(12):
            b ^= 1 << r.randrange(64)
            b ^= 1 << r.randrange(64)
            vals.add(b)
    points = dict(enumerate(sorted(vals)))
    rows = [(i, int(np.array([v], np.uint64).view(np.int64)[0])) for i, v in points.items()]
    forest = Forest(len(points))
    for e in links(spark.createDataFrame(rows, "node long, fp long"), 4, members).collect():
        assert (points[e.src] ^ points[e.dst]).bit_count() <= 4
        forest.link(np.array([e.src]), np.array([e.dst]))
    want, got = brute_components(points, 4), forest.roots(np.arange(len(points))).tolist()
    assert len({(got[i], want[i]) for i in points}) == len(set(got)) == len(set(want.values()))


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(200)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 30, 300]))) for _ in range(80)]
    for i in range(40):
        w = texts[i].split()
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w).upper() if i % 2 else " ".join(w))
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(None, None), (5000, ""), (5001, None), (0, texts[0])]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, node int")
    got = {(x.doc_id, x.fingerprint, x.component_id) for x in near_duplicates(docs).collect()}
    key = {i: brute_fingerprint(t) for i, t in rows}
    comp = brute_components({-1 if i is None else i: f for i, f in key.items()}, 4)
    want = {(i, f"{f:016x}", None if comp[-1 if i is None else i] == -1 else comp[-1 if i is None else i]) for i, f in key.items()}
    assert got == want
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
