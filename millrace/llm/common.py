"""What the operators share: sizes, scratch tables, text buffers and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import io
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.hashes import BASE, BYTE_CODES, INVERSE, Prefix, mix, powers
from millrace.plans.scratch import materialize, partitions, ship

#: Stands for a null id inside operators: null sorts before every id.
NULL_ID = -(2**63)
__all__ = ["BASE", "BYTE_CODES", "INVERSE", "Prefix", "materialize", "mix", "partitions", "powers", "ship"]
WORD = r"[^\x20\x09-\x0D]+"

def tidied(rows):
    """What `rows` yields, in an executor's Python worker; then memory that was freed goes back, as workers live on idle."""
    yield from rows
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with null ids as NULL_ID and null texts empty; other columns, clashing names too, go."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def numbered(docs: DataFrame, apart: bool = False) -> DataFrame:
    """(id, text, …) with `id` a key of the row, in the order of ids, and `doc` for the id it had (NULL_ID: null) where that is another.

    Rows of one real id and one text are one document and share a key, unless
    `apart`; rows of null id never do. Where ids tell the rows apart they are the
    keys. Otherwise rows are sorted by id and text and numbered in a written table;
    a hot id is spread by the hash of the text.
    """
    if docs.groupBy("id").count().where("count > 1").isEmpty():
        return docs
    ship(docs.sparkSession)
    p = partitions(docs)
    names, schema = docs.columns, docs.schema

    def run(source):
        part, nth, last = TaskContext.get().partitionId() << 33, -1, (NULL_ID, None)
        for batch in source:
            keys, ids, texts = [], batch.column("id").to_pylist(), batch.column("text")
            for i, doc in enumerate(ids):
                # the text is looked at only where the id is the one before
                if apart or doc == NULL_ID or doc != last[0] or texts[i] != last[1]:
                    nth += 1
                    last = (doc, texts[i])
                keys.append(part | nth)
            columns = [pa.array(keys, pa.int64()) if c == "id" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("id")], [*names, "doc"])

    order = ["id", F.xxhash64("text")]
    rows = docs.repartitionByRange(p, *order).sortWithinPartitions(*order, "text")
    return materialize(rows.mapInArrow(lambda source: tidied(run(source)), T.StructType([*schema, T.StructField("doc", T.LongType())])), "numbered")


def outer_id(name: str = "doc_id", column: str = "id"):
    """NULL_ID back to null."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(name)


def given_id(numbered: DataFrame, name: str = "doc_id"):
    """The id a row of `numbered` had."""
    return outer_id(name, "doc" if "doc" in numbered.columns else "id")


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and its n + 1 offsets, without a copy where nothing is null."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) and not pa.types.is_large_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(array) + 1, array.offset * (8 if wide else 4)) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], (offs - offs[0]).astype(np.int64)


def text_bytes(array: pa.Array) -> list[bytes]:
    return [x.encode() if x else b"" for x in array.to_pylist()]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw, and the first word of each text (n + 1)."""
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_and(raw != 32, (raw - np.uint8(9)) > 4, out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] |= inside[1:-1][cuts]
    starts = np.flatnonzero(first)
    last = inside[1:-1] & ~inside[2:]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def packed(**columns: np.ndarray) -> bytes:
    """Arrays as one compressed Arrow file, small enough to be a cell."""
    sink = io.BytesIO()
    table = pa.table({k: pa.array(v) for k, v in columns.items()})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue()


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(blob).read_all()
    return {k: table[k].combine_chunks().to_numpy(zero_copy_only=False) for k in table.column_names}


def blocks(batches, limit: int):
    """(ids, texts) slices of Arrow batches with about `limit` bytes of text each, one text at least."""
    for batch in batches:
        texts = batch.column("text")
        if not len(texts):
            continue
        _, offsets = utf8(texts)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def in_dir(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
