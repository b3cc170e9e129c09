"""SimHash near-duplicates: fingerprints, exact pairs by vantage-point trees, components."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keyed_text, materialize, outer_id, partitions, ship, tidied
from millrace.operators.graph import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Points that a leaf compares with one another, and shingles whose bits are counted at once.
LEAF, CHUNK = 128, 1 << 15
#: Points that a shard has at most where fingerprints are random.
MEMBERS = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the hashes of the word shingles; 0 without words."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, np.uint64)
    for at in range(0, len(h), CHUNK):
        counts += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for (id, text)."""

    def run(source):
        for batch in source:
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(lambda source: tidied(run(source)), "id long, fp long")


class Forest:
    """Union-find over arrays that remembers the unions that joined something."""

    def __init__(self, n: int):
        self.up, self.edges = np.arange(n), []

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while True:
            further = self.up[r]
            if (further == r).all():
                self.up[i] = r
                return r
            r = further

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        """Union pair by pair; pairs that are together already cost no loop."""
        for at in range(0, len(x), CHUNK):
            i, j = x[at : at + CHUNK], y[at : at + CHUNK]
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            if not apart.any():
                continue
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            _, once = np.unique(np.minimum(a, b) * np.int64(len(self.up)) + np.maximum(a, b), return_index=True)
            for k in once.tolist():
                r, t = self.root(a[k]), self.root(b[k])
                if r != t:
                    self.up[r] = t
                    self.edges.append((int(i[k]), int(j[k])))


def _compare(p: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """Every a against every b, in blocks."""
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(p[a[at : at + step], None] ^ p[b]) <= radius)
        forest.link(a[at + i], b[j])


def _attach(p: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """As _compare where all of a hang together: a point of b that has met one of them is done."""
    for at in range(0, len(a), LEAF):
        if not len(b):
            return
        part = a[at : at + LEAF]
        hit = np.bitwise_count(p[part, None] ^ p[b]) <= radius
        met = hit.any(axis=0)
        forest.link(part[hit.argmax(axis=0)[met]], b[met])
        b = b[~met]


def vantage_links(p: np.ndarray, radius: int, forest: Forest, members: np.ndarray) -> None:
    """Connect all of `members` that are within `radius` of one another, by vantage-point trees.

    A node takes one of its points as vantage and halves the others at the median
    distance. By the triangle inequality points on either side can only be close
    where both lie within `radius` of the boundary, so only those boundary strips
    are compared across. Points within `radius` of the vantage hang on it and thus
    together, and need no comparison among themselves.
    """
    jobs: list[tuple] = [(members, None)]
    while jobs:
        a, b = jobs.pop()
        if b is not None:
            if len(a) * len(b) <= LEAF * LEAF:
                _compare(p, a, b, radius, forest)
            else:
                _across(p, a, b, radius, forest)
            continue
        if len(a) <= LEAF:
            _compare(p, a, a, radius, forest)
            continue
        v = a[len(a) // 2]
        d = np.bitwise_count(p[a] ^ p[v]).astype(np.int64)
        near = d <= radius
        forest.link(a[near], np.full(int(near.sum()), v))
        strip = ~near & (d <= 2 * radius)
        outward = a[near][np.argsort(-d[near], kind="stable")]
        _attach(p, outward, a[strip], radius, forest)
        a, d = a[~near], d[~near]
        if not len(a):
            continue
        mid = int(np.median(d))
        inner = d <= mid
        if inner.all():
            inner = d < mid
        if not inner.any():  # all at one distance: this vantage can't tell them apart
            _compare(p, a, a, radius, forest)
            continue
        mid = int(d[inner].max())
        jobs += [(a[inner], None), (a[~inner], None), (a[inner & (d > mid - radius)], a[~inner & (d <= mid + radius)])]


def _across(p: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """Across two sets: each shell of a around a vantage against the shells of b that its triangle bounds reach."""
    v = p[a[len(a) // 2]]
    da, db = (np.bitwise_count(p[x] ^ v).astype(np.int64) for x in (a, b))
    order = np.argsort(db, kind="stable")
    b, db = b[order], db[order]
    for shell in np.unique(da).tolist():
        lo, hi = np.searchsorted(db, shell - radius), np.searchsorted(db, shell + radius, "right")
        if hi > lo:
            _compare(p, a[da == shell], b[lo:hi], radius, forest)


def shard_masks(radius: int, points: int, members: int = MEMBERS) -> list[int]:
    """Bit masks, one of which any two fingerprints within `radius` agree under.

    64 bits are cut into radius + t blocks; close fingerprints differ in at most
    `radius` of them and so agree in t. The masks are all choices of t blocks, for
    the least t with which random fingerprints have `members` in a shard at most:
    shards grow in number with the points, and not in size.
    """
    for t in range(1, radius + 4):
        m = radius + t
        cut = [64 * i // m for i in range(m + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
        masks = [sum(c) for c in itertools.combinations(blocks, t)]
        if points <= members * 2 ** min(k.bit_count() for k in masks):
            break
    return masks


def links(points: DataFrame, radius: int = RADIUS, members: int = MEMBERS) -> DataFrame:
    """(src, dst): edges among (node, fp) rows, distinct fps, that connect just those which links of `radius` connect.

    Shards are the values that fingerprints have under each of a few masks
    (`shard_masks`; a vantage shell at the top would have to go to nine in seventeen
    shards, at every level). In a shard, vantage-point trees find the pairs. A task
    keeps a spanning forest, so a dense group gives as many edges as points and not
    all pairs.
    """
    p = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = max(p, partitions(points))
    masks = np.array(shard_masks(radius, points.count(), members), np.uint64).view(np.int64).tolist()
    cells = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])
    spread = points.withColumn("c", F.explode(cells)).select("node", "fp", "c.band", "c.cell").repartition(p * -(-len(masks) // (radius + 1)), "band", "cell")

    def run(source):
        parts = [pa.Table.from_batches([b]) for b in source if b.num_rows]
        if not parts:
            return
        t = pa.concat_tables(parts)
        node, fp, band, cell = (t[c].to_numpy() for c in ("node", "fp", "band", "cell"))
        forest = Forest(len(node))
        _, home, index = np.unique(node, return_index=True, return_inverse=True)
        forest.up = home[index]  # a node's places in several shards are one node
        order = np.lexsort((fp, cell, band))
        cut = np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(band[order]) != 0)) + 1
        bits = fp.view(np.uint64)
        for group in np.split(order, cut):
            if len(group) > 1:
                vantage_links(bits, radius, forest, group)
        if forest.edges:
            e = np.array(forest.edges)
            yield pa.RecordBatch.from_pydict({"src": pa.array(node[e[:, 0]]), "dst": pa.array(node[e[:, 1]])})

    return spread.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint hex, component_id): each document with the least id that links of `radius` bits reach.

    Null and empty texts have fingerprint zero and link like any other. A null id
    sorts first. Repeated ids give a row each; all rows of one id are one document
    of the graph. Equal fingerprints are one point, so a group of copies costs as
    much as one of them. Other columns are ignored.
    """
    ship(docs.sparkSession)
    fps = materialize(fingerprints(keyed_text(docs, id_col, text_col), shingle), "fingerprints")
    points = fps.groupBy("fp").agg(F.min("id").alias("node"))
    ties = fps.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    nodes = materialize(points, "points")
    twice = fps.join(ties.select("id"), "id").join(nodes, "fp").select(F.col("id").alias("src"), F.col("node").alias("dst"))
    found = connected_components(links(nodes, radius).unionByName(twice))
    reached = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = fps.join(reached, "fp")
    return out.select(outer_id(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("component") != -(2**63), F.col("component")).alias("component_id"))
