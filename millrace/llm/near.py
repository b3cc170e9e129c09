"""Near duplicates by similarity: every pair of texts whose word shingles have a Jaccard similarity of `least` or more.

1. SimHash links of few bits (see `simhash`) propose pairs; those that verify join
   most copies at little cost.
2. The rest is found without loss by prefixes. Over any one order of all shingles,
   two sets of similarity 4/5 share one of the first n - ceil(4n/5) + 1 shingles of
   each. The order is rarest first by a count table of fixed size, which only
   decides how many candidates there are, so shingles that many texts share stay
   out of prefixes where a text has others. Pairs that hang together already, or
   whose sizes or places rule the similarity out, are no candidates.

Every link is verified on the whole sets of 64-bit shingle hashes. Sets that agree
in size and in a 64-bit digest count as equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Prefix, blocks, materialize, mix, partitions, ship, tidied, utf8
from millrace.llm.repeats import Words
from millrace.llm.simhash import RADIUS, fingerprint, links
from millrace.operators.graph import connected_components

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Buckets of the count table, text bytes hashed at once, and pairs a task holds.
COUNTS, BLOCK, HELD = 1 << 20, 1 << 20, 1 << 20


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; one of all words where they are fewer, none without words."""
    raw, offsets = utf8(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    codes, first = Words.codes(raw, offsets)
    prefix = Prefix(codes)
    every, out = prefix.all(shingle), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(every[a : b - shingle + 1]))
        else:
            out.append(prefix.ranges(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def digest(hashes: np.ndarray) -> int:
    total = np.array([mix(hashes.copy()).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64)
    return int(mix(total).view(np.int64)[0])


def needed(n):
    """Shingles of n that a similar set must share."""
    up, down = LEAST
    return -(-up * n // down)


def each_set(source):
    """(id, text, set) of (id, text) batches."""
    for block in blocks(source, BLOCK):
        yield from zip(block.column("id").to_pylist(), block.column("text"), shingle_sets(block.column("text")))


def records(docs: DataFrame) -> DataFrame:
    """(id, node: digest of the set, fp)."""

    def run(source):
        for block in blocks(source, BLOCK):
            nodes = [digest(s) for s in shingle_sets(block.column("text"))]
            fps = [fingerprint(t.as_buffer().to_pybytes(), SHINGLE) for t in block.column("text")]
            yield pa.RecordBatch.from_pydict({"id": block.column("id"), "node": pa.array(nodes, pa.int64()), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    return docs.mapInArrow(lambda source: tidied(run(source)), "id long, node long, fp long")


def count_table(docs: DataFrame) -> np.ndarray:
    """How many texts have a shingle of each bucket."""

    def run(source):
        table = np.zeros(COUNTS, np.int64)
        for _, _, s in each_set(source):
            np.add.at(table, (s % np.uint64(COUNTS)).astype(np.int64), 1)
        at = np.flatnonzero(table)
        if len(at):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(table[at])})

    found = docs.mapInArrow(lambda source: tidied(run(source)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(COUNTS, np.uint32)
    table[found["bucket"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**32 - 1)
    return table


def prefixes(docs: DataFrame) -> DataFrame:
    """(h, node, n, at): the rarest shingles of each set, its size, and their places in the order."""
    sent = docs.sparkSession.sparkContext.broadcast(count_table(docs))

    def run(source):
        table, seen, parts, held = sent.value, set(), [], 0

        def flush():
            h, node, n, at = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "node": pa.array(node), "n": pa.array(n), "at": pa.array(at)})

        for _, _, s in each_set(source):
            node, n = digest(s), len(s)
            if not n or node in seen:
                continue
            seen.add(node)
            order = np.lexsort((s, table[(s % np.uint64(COUNTS)).astype(np.int64)]))[: n - needed(n) + 1]
            parts.append((s[order], np.full(len(order), node), np.full(len(order), n, np.int32), np.arange(len(order), dtype=np.int32)))
            held += len(order)
            if held >= HELD // 8:
                yield flush()
                parts, held = [], 0
        if parts:
            yield flush()

    return docs.mapInArrow(lambda source: tidied(run(source)), "h long, node long, n int, at int")


def candidates(rows: DataFrame, p: int) -> DataFrame:
    """(a, b): nodes of one h whose sizes and places allow the similarity, unless their components are one."""
    up, down = LEAST

    def run(source):
        parts = [pa.Table.from_batches([b]) for b in source if b.num_rows]
        if not parts:
            return
        t = pa.concat_tables(parts)
        h, node, n, at, component = (t[c].to_numpy() for c in ("h", "node", "n", "at", "component"))
        order = np.lexsort((node, n, h))
        h, node, n, at, component = h[order], node[order], n[order].astype(np.int64), at[order].astype(np.int64), component[order]
        found, held = [], 0

        def flush():
            pairs = pa.table({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})
            return pairs.group_by(["a", "b"]).aggregate([]).combine_chunks().to_batches()

        def blocked():
            # starts in blocks, so that what is compared at once is bounded
            for begin in range(0, len(h), HELD):
                i, d = np.arange(begin, min(begin + HELD, len(h))), 1
                while len(i):
                    i = i[i + d < len(h)]
                    j = i + d
                    fits = (h[i] == h[j]) & (down * n[i] >= up * n[j])
                    i, j = i[fits], j[fits]
                    most = np.minimum(n[i] - at[i], n[j] - at[j])
                    # |both| / (n + n - |both|) >= up / down
                    good = ((up + down) * most >= up * (n[i] + n[j])) & (node[i] != node[j]) & (component[i] != component[j])
                    yield node[i[good]], node[j[good]]
                    d += 1

        for a, b in blocked():
            if len(a):
                found.append((np.minimum(a, b), np.maximum(a, b)))
                held += len(a)
                if held >= HELD:
                    yield from flush()
                    found, held = [], 0
        if found:
            yield from flush()

    return rows.repartition(p, "h").mapInArrow(lambda source: tidied(run(source)), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """(src, dst): the pairs of nodes that are similar, by the whole sets. `first` has a document (id) of each node."""
    up, down = LEAST

    def sets(source):
        for block in blocks(source, BLOCK):
            found = shingle_sets(block.column("text"))
            yield pa.RecordBatch.from_pydict({"node": block.column("node"), "s": pa.array([x.tobytes() for x in found], pa.binary())})

    def run(source):
        for batch in source:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            src, dst = [], []
            for i, (x, y) in enumerate(zip(batch.column("s"), batch.column("t"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                every = np.concatenate([x, y])
                every.sort(kind="stable")
                both = int((every[1:] == every[:-1]).sum())
                if down * both >= up * (len(every) - both):
                    src.append(a[i])
                    dst.append(b[i])
            yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(first, "node")
    texts = docs.join(wanted, "id").select("node", F.col("text").cast("binary").alias("text"))
    known = materialize(texts.mapInArrow(lambda source: tidied(sets(source)), "node long, s binary"), "sets")
    left = pairs.join(known.withColumnRenamed("node", "a"), "a")
    return left.join(known.select(F.col("node").alias("b"), F.col("s").alias("t")), "b").mapInArrow(lambda source: tidied(run(source)), "src long, dst long")


def similar_texts(docs: DataFrame) -> DataFrame:
    """(id, first) for (id, text) with one row an id: the least id that links of similar texts reach.

    Texts without words are similar to one another only.
    """
    ship(docs.sparkSession)
    p = partitions(docs)
    docs = docs.select("id", F.col("text").cast("binary").alias("text"))
    own = materialize(records(docs), "records")
    first = materialize(own.groupBy("node").agg(F.min("id").alias("id"), F.min("fp").alias("fp")), "nodes")
    points = materialize(first.groupBy("fp").agg(F.min("node").alias("node")), "points")
    same = first.select("fp", F.col("node").alias("a")).join(points.select("fp", F.col("node").alias("b")), "fp").where("a <> b").select("a", "b")
    near = links(points, RADIUS).select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(same)
    pairs = materialize(near.distinct(), "proposed")
    easy = materialize(verified(pairs, docs, first.select("node", "id")), "links")
    hung = connected_components(easy)
    rows = prefixes(docs).join(hung, "node", "left").withColumn("component", F.coalesce("component", "node"))
    pairs = materialize(candidates(rows, p), "candidates")
    rest = verified(pairs, docs, first.select("node", "id"))
    whole = connected_components(easy.unionByName(rest))
    reached = own.join(whole, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    reached = materialize(reached, "reached")
    return reached.join(reached.groupBy("component").agg(F.min("id").alias("first")), "component").select("id", "first")
