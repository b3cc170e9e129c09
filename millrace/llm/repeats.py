"""Exact removal of repeated windows, over bytes or over words.

A window of `width` consecutive tokens of one document is a repeat if the same
tokens also start earlier (smaller id, or the same document further left). Every
token that a repeat covers goes; the first copy stays.

Windows meet without being shuffled one by one:

1. Each window is keyed by the smallest hash of the `gram`-token grams in it, so
   equal windows have equal keys. Neighbouring windows with one key make a run
   (about width - gram of them), whose whole content has a digest.
2. Of each (key, digest) a task keeps its first run and marks the others as
   repeats at once. The rest goes, packed by key, to tasks that do the same over
   all input. A key whose runs all had one digest is settled without any text.
3. Only keys with different digests, or runs that may repeat themselves, need
   their text. It is cut out of the documents and sent by key to the matcher:
   a suffix array with longest-previous-factor values (`suffix`), or a suffix
   automaton with matching statistics (`automaton`).
4. A key with over `crowd` different digests (a short line that many documents
   share) isn't gathered: its windows go on one by one, keyed by their own hash,
   with the first of each kept in every task before the shuffle.

A key has the upper 44 bits of a hash and a digest 64 of another sum. Two runs are
taken as equal where both agree, without their text being compared: step 2 so
settles runs that are the same from end to end, and the matchers of step 3, which
compare the tokens themselves, all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import (
    BYTE_CODES,
    Prefix,
    blocks,
    materialize,
    packed,
    partitions,
    ship,
    tidied,
    unpacked,
    utf8,
    word_bounds,
)

#: Text bytes that are hashed at once, and the longest piece a document is hashed in.
BLOCK = 1 << 18
#: Runs a task holds before it reduces them.
HELD = 1 << 19
POSITION_BITS = np.uint64(20)
NEEDS, CROWDED, GONE = 0, 1, 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values, in log2(w) passes."""
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n]) if have < w else x[:n]


class Bytes:
    """Tokens are the bytes of the text."""

    @staticmethod
    def codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return BYTE_CODES[raw], offsets

    @staticmethod
    def tokens(text: bytes) -> bytes:
        return text

    @staticmethod
    def cut(tokens: bytes, start: int, end: int) -> bytes:
        return tokens[start:end]

    @staticmethod
    def join(tokens: bytes, keep: np.ndarray) -> bytes:
        return np.frombuffer(tokens, np.uint8)[keep].tobytes()


class Words:
    """Tokens are maximal runs of characters other than ASCII white space."""

    @staticmethod
    def codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = word_bounds(raw, offsets)
        return Prefix(BYTE_CODES[raw]).ranges(starts, ends), first

    @staticmethod
    def tokens(text: bytes) -> list[bytes]:
        return text.split()  # splits bytes at exactly 09 to 0D and 20

    @staticmethod
    def cut(tokens: list[bytes], start: int, end: int) -> bytes:
        return b" ".join(tokens[start:end])

    @staticmethod
    def join(tokens: list[bytes], keep: np.ndarray) -> bytes:
        return b" ".join([tokens[i] for i in np.flatnonzero(keep).tolist()])


def window_runs(codes: np.ndarray, starts: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows: text index, first and last window (from `starts`), key, digest, and whether it may repeat itself."""
    w, n = width - gram + 1, len(codes)
    empty = {k: np.zeros(0, t) for k, t in (("text", np.int64), ("s", np.int64), ("e", np.int64), ("key", np.uint64), ("digest", np.uint64), ("self", bool))}
    if n < width:
        return empty
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    prefix = Prefix(codes)
    grams = prefix.all(gram)
    windows = n - width + 1
    valid = owner[:windows] == owner[width - 1 :]
    if w == 1:
        s = e = np.flatnonzero(valid)
        may_repeat = np.zeros(len(s), bool)
        key = grams[s]
    else:
        # The position below the hash makes ties fall on the leftmost, or rightmost, gram.
        at = np.arange(len(grams), dtype=np.uint64)
        mask = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
        high = grams & ~mask
        left = sliding_min(high | at, w)
        same = (left[1:] ^ left[:-1]) <= mask
        same &= valid[1:] & valid[:-1] & (owner[1:windows] == owner[: windows - 1])
        edge = np.flatnonzero(~same) + 1
        s = np.concatenate([[0], edge])
        e = np.concatenate([edge, [windows]]) - 1
        s, e = s[valid[s]], e[valid[s]]
        first = (left[s] & mask).astype(np.int64)
        right = sliding_min(high | (mask - at), w)
        may_repeat = first != (mask - (right[e] & mask)).astype(np.int64)
        key = high[first]
    return {"text": owner[s], "s": s - starts[owner[s]], "e": e - starts[owner[s]], "key": key, "digest": prefix.ranges(s, e + width), "self": may_repeat}


def reduce_runs(runs: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The first run of each (key, digest) by (id, s), sorted; the others, which repeat it."""
    order = np.lexsort((runs["s"], runs["id"], runs["digest"], runs["key"]))
    runs = {k: v[order] for k, v in runs.items()}
    same = (runs["key"][1:] == runs["key"][:-1]) & (runs["digest"][1:] == runs["digest"][:-1])
    lead = np.concatenate([[True], ~same])[: len(order)]
    winner = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(order) else np.zeros(0, int)
    twin = ~lead & (runs["id"] == runs["id"][winner]) & (runs["s"] == runs["s"][winner])  # the same row again
    return {k: v[lead] for k, v in runs.items()}, {k: v[~lead & ~twin] for k, v in runs.items()}


RUN = ("key", "digest", "id", "s", "e", "self")


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def by_bucket(values: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, row numbers) for each bucket that occurs."""
    if not len(values):
        return []
    b = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order])) + 1
    return [(int(b[g[0]]), g) for g in np.split(order, cut)]


def sent(runs: dict[str, np.ndarray], buckets: int, kind: int) -> Iterator[dict]:
    for bucket, rows in by_bucket(runs["key"] >> np.uint64(24), buckets):
        part = {k: runs[k][rows] for k in RUN}
        order = np.lexsort((part["s"], part["id"]))
        part = {k: v[order] for k, v in part.items()}
        first, ids = part["id"][0], part.pop("id")
        part["id"] = np.diff(ids, prepend=first)
        part["first"] = np.full(1, first).repeat(len(ids))
        part["n"] = (part.pop("e") - part["s"]).astype(np.int32)
        part["s"] = part["s"].astype(np.int32)
        yield {"bucket": bucket, "kind": kind, "blob": packed(**part)}


def received(blob: bytes) -> dict[str, np.ndarray]:
    part = unpacked(blob)
    ids = part.pop("first") + np.cumsum(part.pop("id"))
    s = part["s"].astype(np.int64)
    return {"key": part["key"], "digest": part["digest"], "id": ids, "s": s, "e": s + part["n"], "self": np.asarray(part["self"], bool)}


def spans(runs: dict[str, np.ndarray], buckets: int) -> Iterator[dict]:
    """Windows [s, e] that repeat an earlier one."""
    for bucket, rows in by_bucket(runs["id"].astype(np.uint64), buckets):
        yield {"bucket": bucket, "kind": GONE, "blob": packed(id=runs["id"][rows], s=runs["s"][rows], e=runs["e"][rows])}


BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
BLOB_DDL = "bucket int, kind int, blob binary"


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    def run():
        held: list[dict] = []
        for row in rows:
            held.append(row)
            if len(held) >= size:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return tidied(run())


def slices(source: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made from one stays small."""
    for batch in source:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Repeats:
    """The steps above for one kind of token. `matcher(texts)` says for each list of runs which windows repeat."""

    def __init__(self, kind: type, width: int, gram: int, matcher: Callable, crowd: int = 512):
        if not 0 < gram <= width:
            raise ValueError("a gram is part of a window")
        self.kind, self.width, self.gram, self.matcher, self.crowd = kind, width, gram, matcher, crowd

    # step 1 and the local part of step 2

    def pieces(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(codes, starts, ids, offset in the document) for texts cut into pieces of at most BLOCK windows."""
        raw, offsets = utf8(batch.column("text"))
        ids = batch.column("id").to_numpy()
        codes, starts = self.kind.codes(raw, offsets)
        sizes = np.diff(starts)
        small = sizes <= BLOCK
        if small.all() and len(codes) <= 4 * BLOCK:
            yield codes, starts, ids, np.zeros(len(ids), np.int64)
            return
        for i in range(len(ids)):
            for at in range(0, max(1, int(sizes[i]) - self.width + 1), BLOCK):
                part = codes[starts[i] + at : min(starts[i + 1], starts[i] + at + BLOCK + self.width - 1)]
                yield part, np.array([0, len(part)]), ids[i : i + 1], np.array([at])

    def runs_of(self, batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        for codes, starts, ids, offset in self.pieces(batch):
            r = window_runs(codes, starts, self.width, self.gram)
            text = r.pop("text")
            yield r | {"id": ids[text], "s": r["s"] + offset[text], "e": r["e"] + offset[text]}

    def scan(self, buckets: int) -> Callable:
        def run(source):
            held, n = [], 0

            def out():
                keep, again = reduce_runs(joined(held))
                yield from spans(again, buckets)
                yield from sent(keep, buckets, NEEDS)

            for block in blocks(source, BLOCK):
                for r in self.runs_of(block):
                    held.append(r)
                    n += len(r["s"])
                if n > HELD:
                    yield from out()
                    held, n = [], 0
            if n:
                yield from out()

        return lambda source: batches(run(source), BLOB)

    # step 2 over all input

    def settle(self, buckets: int) -> Callable:
        """Blobs of one partition: repeats, and the runs whose text is needed."""

        def run(source):
            kept: dict[str, np.ndarray] | None = None
            crowded = np.zeros(0, np.uint64)
            fresh, n = [], 0

            def shrink(last: bool):
                nonlocal kept, crowded, fresh, n
                parts = ([kept] if kept is not None else []) + fresh
                fresh, n = [], 0
                if not parts:
                    return
                keep, again = reduce_runs(joined(parts))
                yield from spans(again, buckets)
                lead = np.flatnonzero(np.concatenate([[True], keep["key"][1:] != keep["key"][:-1]])[: len(keep["key"])])
                size = np.diff(np.append(lead, len(keep["key"])))
                many = size > self.crowd
                if many.any():
                    crowded = np.union1d(crowded, keep["key"][lead[many]])
                    off = np.repeat(many, size)
                    yield from needs({k: v[off] for k, v in keep.items()}, CROWDED)
                    keep = {k: v[~off] for k, v in keep.items()}
                    size = size[~many]
                if last:
                    wanted = np.repeat(size > 1, size) | keep["self"]
                    yield from needs({k: v[wanted] for k, v in keep.items()}, NEEDS)
                else:
                    kept = keep

            def needs(runs, kind):
                for bucket, rows in by_bucket(runs["id"].astype(np.uint64), buckets):
                    yield {"bucket": bucket, "kind": kind, "blob": packed(id=runs["id"][rows], s=runs["s"][rows], e=runs["e"][rows], key=runs["key"][rows])}

            for batch in source:
                for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob")):
                    if kind == GONE:
                        part = unpacked(blob.as_buffer())
                        for bucket, rows in by_bucket(part["id"].astype(np.uint64), buckets):
                            yield {"bucket": bucket, "kind": GONE, "blob": packed(**{k: v[rows] for k, v in part.items()})}
                        continue
                    part = received(blob.as_buffer())
                    hot = np.isin(part["key"], crowded)
                    if hot.any():
                        yield from needs({k: v[hot] for k, v in part.items()}, CROWDED)
                        part = {k: v[~hot] for k, v in part.items()}
                    fresh.append(part)
                    n += len(part["s"])
                    if n > HELD:
                        yield from shrink(False)
            yield from shrink(True)

        return lambda source: batches(run(source), BLOB)

    def by_document(self, table: DataFrame, columns: str) -> DataFrame:
        """Blobs to a row for each document with its intervals as one blob."""
        names = [c.split()[0] for c in columns.split(", ")]

        def rows(source):
            for batch in source:
                for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob")):
                    part = unpacked(blob.as_buffer())
                    if "key" not in part:
                        part["key"] = np.zeros(len(part["id"]), np.uint64)
                    part |= {"kind": np.full(len(part["id"]), kind, np.int32), "key": part["key"].view(np.int64), "s": part["s"].astype(np.int32), "e": part["e"].astype(np.int32)}
                    yield pa.RecordBatch.from_pydict({k: pa.array(part[k]) for k in names})

        return table.mapInArrow(lambda source: tidied(rows(source)), columns)

    # step 3 and 4

    def cut_out(self, buckets: int) -> Callable:
        """Documents with the runs wanted of them: the runs' text, or their windows one by one."""

        def run(source):
            alone = Repeats(self.kind, self.width, self.width, self.matcher)
            held, n = [], 0

            def out():
                keep, again = reduce_runs(joined(held))
                yield from spans(again, buckets)
                yield from sent(keep, buckets, CROWDED)

            for batch in source:
                for i, (doc, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("text"))):
                    body = text.as_buffer().to_pybytes()
                    tokens = self.kind.tokens(body)
                    codes = None
                    groups: dict[int, list[dict]] = {}
                    for run_ in batch.column("runs")[i].as_py():
                        s, e = run_["s"], run_["e"]
                        if run_["kind"] == NEEDS:
                            key = run_["key"] & (2**64 - 1)
                            groups.setdefault((key >> 24) % buckets, []).append({"key": run_["key"], "s": s, "e": e, "text": self.kind.cut(tokens, s, e + self.width)})
                            continue
                        if codes is None:
                            codes = self.kind.codes(np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0]
                        for at in range(s, e + 1, BLOCK):
                            r = window_runs(codes[at : min(e + 1, at + BLOCK) + self.width - 1], np.array([0, min(e + 1, at + BLOCK) + self.width - 1 - at]), alone.width, alone.gram)
                            r.pop("text")
                            held.append(r | {"id": np.full(len(r["s"]), doc, np.int64), "s": r["s"] + at, "e": r["e"] + at})
                            n += len(r["s"])
                    for bucket, rows in groups.items():
                        table = pa.Table.from_pylist([r | {"id": doc} for r in rows])
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, table.schema) as w:
                            w.write_table(table)
                        yield {"bucket": bucket, "kind": NEEDS, "blob": sink.getvalue().to_pybytes()}
                    if n > HELD:
                        yield from out()
                        held, n = [], 0
            if n:
                yield from out()

        return lambda source: batches(run(source), BLOB)

    def match(self) -> Callable:
        """Texts of runs, and windows one by one, of one partition: the windows that repeat."""

        def run(source):
            texts: dict[int, list] = {}
            kept, fresh, n = None, [], 0

            def shrink():
                nonlocal kept, fresh, n
                parts = ([kept] if kept is not None else []) + fresh
                fresh, n = [], 0
                if parts:
                    kept, again = reduce_runs(joined(parts))
                    yield again

            for batch in source:
                for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob")):
                    if kind == GONE:
                        yield unpacked(blob.as_buffer())
                    elif kind == NEEDS:
                        for r in pa.ipc.open_stream(blob.as_buffer()).read_all().to_pylist():
                            texts.setdefault(r["key"], []).append((r["id"], r["s"], r["e"], r["text"]))
                    else:
                        fresh.append(received(blob.as_buffer()))
                        n += len(fresh[-1]["s"])
                        if n > HELD:
                            yield from shrink()
            yield from shrink()
            ids, s, e = [], [], []
            for doc, first, last in self.matcher(texts, self.width):
                ids.append(doc)
                s.append(first)
                e.append(last)
            yield {"id": np.array(ids, np.int64), "s": np.array(s, np.int64), "e": np.array(e, np.int64)}

        def out(source):
            for gone in run(source):
                if len(gone["id"]):
                    yield pa.RecordBatch.from_pydict({"id": pa.array(gone["id"]), "s": pa.array(gone["s"].astype(np.int32)), "e": pa.array(gone["e"].astype(np.int32))})

        return lambda source: tidied(out(source))

    def repeated(self, docs: DataFrame) -> DataFrame:
        """(id, gone: array of (s, e)): the windows that repeat, in order; documents without any are left out."""
        ship(docs.sparkSession)
        p = partitions(docs)
        found = materialize(docs.mapInArrow(self.scan(p), BLOB_DDL).repartition(p, "bucket").mapInArrow(self.settle(p), BLOB_DDL), "runs")
        wanted = self.by_document(found.where(f"kind <> {GONE}"), "kind int, id long, s int, e int, key long")
        wanted = wanted.groupBy("id").agg(F.collect_list(F.struct("kind", "s", "e", "key")).alias("runs"))
        cut = docs.select("id", F.col("text").cast("binary").alias("text")).join(wanted.hint("shuffle_hash"), "id")
        matched = cut.mapInArrow(self.cut_out(p), BLOB_DDL).repartition(p, "bucket").mapInArrow(self.match(), "id long, s int, e int")
        gone = self.by_document(found.where(f"kind = {GONE}"), "id long, s int, e int").unionByName(matched)
        return gone.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("gone"))

    def cleaned(self, docs: DataFrame) -> DataFrame:
        """(id, n, n_removed, n_spans, kept): tokens, those removed, maximal removed stretches, and what is left; then other columns of docs as they are."""
        width, kind = self.width, self.kind
        extra = [c for c in docs.columns if c not in ("id", "text")]

        def run(source):
            for batch in slices(source):
                gone = batch.column("gone")
                n_, removed_, spans_, kept_ = [], [], [], []
                for i, text in enumerate(batch.column("text")):
                    tokens = kind.tokens(text.as_buffer().to_pybytes())
                    n = len(tokens)
                    n_.append(n)
                    if not gone[i].is_valid:
                        removed_.append(0)
                        spans_.append(0)
                        kept_.append(kind.cut(tokens, 0, n))
                        continue
                    pairs = gone[i].values.flatten()
                    s = np.minimum(pairs[0].to_numpy().astype(np.int64), n)
                    e = np.minimum(pairs[1].to_numpy().astype(np.int64) + width, n)
                    marks = np.zeros(n + 1, np.int64)
                    np.add.at(marks, s, 1)
                    np.add.at(marks, e, -1)
                    keep = np.cumsum(marks[:-1]) == 0
                    removed_.append(n - int(keep.sum()))
                    spans_.append(int((~keep[1:] & keep[:-1]).sum()) + int(n > 0 and not keep[0]))
                    kept_.append(kind.join(tokens, keep))
                made = [pa.array(x, pa.int64()) for x in (n_, removed_, spans_)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *made, pa.array(kept_, pa.binary()), *[batch.column(c) for c in extra]], ["id", "n", "n_removed", "n_spans", "kept", *extra])

        long = T.LongType()
        fields = [T.StructField(n, t) for n, t in (("id", long), ("n", long), ("n_removed", long), ("n_spans", long), ("kept", T.BinaryType()))]
        schema = T.StructType([*fields, *[docs.schema[c] for c in extra]])
        found = self.repeated(docs.select("id", "text"))
        pairs = docs.withColumn("text", F.col("text").cast("binary")).join(found.hint("shuffle_hash"), "id", "left")
        return pairs.mapInArrow(lambda source: tidied(run(source)), schema)
