"""Token ids in files of directly addressable codes."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.bpe import PairIndexBPE, Worker, default_path, gathered, worker
from millrace.llm.common import keyed_text, materialize, outer_id, partitions, ship
from millrace.plans.scratch import scratch_path

#: Bits of an id on each level, bits of a bitmap that one rank entry stands for, ids in a file.
CHUNK_BITS, RANK_BITS, FILE_TOKENS = 8, 512, 1 << 21
END_ID = 1
#: Words whose ids a worker remembers, about 200 bytes each.
REMEMBERED = 500_000
#: Text bytes that are cut into pieces at once.
STORE_BLOCK = 8 << 20
MAGIC = b"MRDAC\x00\x01\x00"


class Codes:
    """A sequence of unsigned integers as levels of eight-bit chunks.

    Level k has chunk k of the integers that reach so far, and a bitmap that says
    which go on; the number of ones before a place is its place on the next level.
    A rank directory keeps that number for every RANK_BITS bits, so any integer is
    read with a few look-ups and nothing before it is decoded.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels  # (chunks uint8, bitmap bytes, ranks uint64)

    @classmethod
    def build(cls, values: np.ndarray) -> Codes:
        rest, levels = np.asarray(values, np.uint64), []
        while len(rest) or not levels:
            later = rest >> np.uint64(CHUNK_BITS)
            more = later > 0
            bitmap = np.packbits(more, bitorder="little")
            padded = np.zeros(-(-max(1, len(bitmap)) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
            padded[: len(bitmap)] = bitmap
            ones = np.bitwise_count(padded.reshape(-1, RANK_BITS // 8)).sum(axis=1, dtype=np.uint64)
            levels.append(((rest & np.uint64(255)).astype(np.uint8), padded, np.cumsum(ones, dtype=np.uint64) - ones))
            rest = later[more]
            if not len(rest):
                break
        return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                break
            block = i // RANK_BITS
            whole = bitmap[block * RANK_BITS // 8 : byte]
            i = int(ranks[block]) + int(np.bitwise_count(whole).sum()) + int(bitmap[byte] & ((1 << bit) - 1)).bit_count()
        return value

    def range(self, start: int, end: int) -> np.ndarray:
        """Values start to end - 1, found on each level from one rank."""
        out = np.zeros(end - start, np.uint64)
        at = np.arange(end - start)
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            out[at] |= chunks[start:end].astype(np.uint64) << np.uint64(CHUNK_BITS * k)
            bits = np.unpackbits(bitmap[start // 8 : -(-end // 8)], bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            at = at[bits]
            if not len(at):
                break
            start, end = self.rank(k, start), self.rank(k, start) + len(at)
        return out

    def rank(self, k: int, i: int) -> int:
        """Ones before place i of level k."""
        _, bitmap, ranks = self.levels[k]
        block = i // RANK_BITS
        if block == len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bitmap[(block - 1) * RANK_BITS // 8 :]).sum())
        byte, bit = divmod(i, 8)
        part = int(np.bitwise_count(bitmap[block * RANK_BITS // 8 : byte]).sum())
        return int(ranks[block]) + part + (int(bitmap[byte] & ((1 << bit) - 1)).bit_count() if bit else 0)


def write_file(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """One file: header, document ids, their first tokens (n + 1), levels."""
    codes = Codes.build(ids)
    out = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(codes.levels)), doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    for chunks, bitmap, ranks in codes.levels:
        out += [struct.pack("<QQQ", len(chunks), len(bitmap), len(ranks)), chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u8").tobytes()]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


class TokenFile:
    """A file read back: `codes[i]` is token i, `document(k)` the ids of its k-th document."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole token file")
        n, self.n_tokens, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, count, at)
            at += a.nbytes
            return a

        self.doc_ids, self.starts = take("<i8", n), take("<u8", n + 1).astype(np.int64)
        levels = []
        for _ in range(n_levels):
            sizes = struct.unpack_from("<QQQ", data, at)
            at += 24
            levels.append((take("u1", sizes[0]), take("u1", sizes[1]), take("<u8", sizes[2])))
        self.codes = Codes(levels)

    def document(self, k: int) -> np.ndarray:
        return self.codes.range(int(self.starts[k]), int(self.starts[k + 1]))


def library_worker(bpe: PairIndexBPE) -> Worker:
    """Values are ids as little-endian 32-bit integers, by the library's model on single words."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    words = Tokenizer(Tokenizer.from_file(bpe.path).model)
    words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    last = np.array([p.endswith(bpe.suffix) for p in bpe.pieces])

    def encode(new: list[str]) -> list[bytes]:
        found = []
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = np.array(words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(last[ids]) + 1)).tolist()  # a word's last token says so
            if len(ends) != len(part):
                raise ValueError("words and word ends don't agree")
            data = ids.tobytes()
            found += [data[a:b] for a, b in zip([0, *ends], ends)]
        return found

    return Worker(bpe, encode, b"".join, lambda i: struct.pack("<I", i), REMEMBERED, STORE_BLOCK)


#: Encoders of this Python worker: tasks of one store follow each other, and words recur.
_kept: dict[str, Worker] = {}


def write_store(docs: DataFrame, uri: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode documents in ascending id order, an end id after each, into files under `uri`; returns the manifest.

    Manifest: (part, nth, n_docs, n_tokens, file), in file order (part, nth). A file
    is written whole under a name of its own and then renamed, so a task that runs
    twice leaves the same files. Words recur, and neither normalisation nor splitting
    looks across white space, so the library encodes each distinct word once while a
    worker remembers it.
    """
    path = path or default_path()
    ship(docs.sparkSession)
    p = partitions(docs)

    def run(source):
        from pyarrow.fs import FileSystem

        if path not in _kept:
            _kept[path] = worker(path, library_worker)
        state = _kept[path]
        fs, root = FileSystem.from_uri(uri)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        end = struct.pack("<I", end_id)
        ids: list[np.ndarray] = []
        doc_ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size, nth = 0, 0

        def flush() -> dict:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            docs_here = np.concatenate(doc_ids)
            data = write_file(np.concatenate(ids), docs_here, starts)
            name = f"{root}/part-{part:07d}-{nth:05d}.dac"
            with fs.open_output_stream(f"{name}.{attempt}") as f:
                f.write(data)
            fs.move(f"{name}.{attempt}", name)
            return {"part": part, "nth": nth, "n_docs": len(docs_here), "n_tokens": int(starts[-1]), "file": name}

        fs.create_dir(root, recursive=True)
        for batch in source:
            rows, seen = [], 0
            names = batch.column("id").to_numpy()
            for index, cuts, values in state.blocks(batch.column("text")):
                tokens, n = gathered(np.insert(index, cuts[1:], len(values)), cuts + np.arange(len(cuts)), [*values, end])
                after = np.cumsum(n)
                at = 0
                while at < len(n):  # cut the block where files are full
                    before = int(after[at - 1]) if at else 0
                    to = min(len(n), int(np.searchsorted(after, before + file_tokens - size)) + 1)
                    ids.append(tokens[before : after[to - 1]])
                    counts.append(n[at:to])
                    doc_ids.append(names[seen + at : seen + to])
                    size += int(after[to - 1]) - before
                    at = to
                    if size >= file_tokens:
                        rows.append(flush())
                        ids, doc_ids, counts, size, nth = [], [], [], 0, nth + 1
                seen += len(n)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, MANIFEST)
        if counts:
            yield pa.RecordBatch.from_pylist([flush()], MANIFEST)

    # the text's hash spreads a hot id, and puts rows of one id in one order
    order = ["id", F.xxhash64("text")]
    ordered = keyed_text(docs, id_col, text_col).repartitionByRange(p, *order).sortWithinPartitions(*order, "text")
    return materialize(ordered.mapInArrow(run, MANIFEST_DDL), "manifest")


MANIFEST = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.string())])
MANIFEST_DDL = "part int, nth int, n_docs long, n_tokens long, file string"


def read_store(manifest: DataFrame, uri: str) -> DataFrame:
    """(id, start, ids array<long>) of every document: start counts the ids of all documents before it."""
    return _read(manifest, uri, "id long, start long, ids array<long>", lambda ids: ids.astype(np.int64).tolist(), "ids", pa.list_(pa.int64()))


def _read(manifest: DataFrame, uri: str, ddl: str, value, name: str, kind: pa.DataType) -> DataFrame:
    ship(manifest.sparkSession)

    def run(source):
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(uri)
        for batch in source:
            for row in batch.to_pylist():
                with fs.open_input_stream(row["file"]) as f:
                    t = TokenFile(f.read())
                step = 1024
                for at in range(0, len(t.doc_ids), step):
                    ends = t.starts[at : at + step + 1]
                    ids = t.codes.range(int(ends[0]), int(ends[-1]))
                    cut = (ends - ends[0]).tolist()
                    got = [value(ids[a:b]) for a, b in zip(cut, cut[1:])]
                    n = np.diff(t.starts[at : at + len(got) + 1])
                    columns = {"id": pa.array(t.doc_ids[at : at + step]), "start": pa.array(row["base"] + t.starts[at : at + len(got)]), "n": pa.array(n)} | {name: pa.array(got, kind)}
                    yield pa.RecordBatch.from_pydict({c.split()[0]: columns[c.split()[0]] for c in ddl.split(", ")})

    # One row for each file of FILE_TOKENS ids: the only thing that is put in one order.
    before = W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return based.repartition(partitions(manifest), "file").mapInArrow(run, ddl)


def stored_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", uri: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from files written and read back.

    Null counts as empty: its only id is the end id. A null id sorts first; rows
    with one id follow each other in the order of their texts' hashes, with a row each. Other columns
    are ignored. No documents: no files and no rows.
    """
    uri = uri or scratch_path(docs.sparkSession, "tokens")
    manifest = write_store(docs, uri, path, id_col=id_col, text_col=text_col)
    out = _read(manifest, uri, "id long, start long, n long, crc long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "crc", pa.int64())
    return out.select(outer_id(id_col), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
