"""Distinct hashes of the word n-grams of texts, as Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashes import BYTE_CODES, Prefix
from millrace.functions.text import TOKEN

#: Text bytes and texts that are hashed at once; a longer text is alone.
BLOCK, ROWS = 1 << 20, 1 << 15
_letters: dict[str, np.ndarray] = {}


def letters(spark: SparkSession) -> np.ndarray:
    """For each code point whether TOKEN takes it, as the JVM's regular expressions say."""
    app = spark.sparkContext.applicationId
    if app not in _letters:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        points = spark.range(0xD800).union(spark.range(0xE000, 0x110000)).where(char.rlike(f"^{TOKEN}$"))
        table = np.zeros(0x110000, bool)
        table[points.toArrow()["id"].to_numpy()] = True
        _letters[app] = np.packbits(table)
    return _letters[app]


def _inside(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 is of a character that a word may have."""
    inside = table[:128][raw & 127] & (raw < 128)
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        first = raw[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & np.where(size == 2, 31, np.where(size == 3, 15, 7))
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | raw[lead[more] + k] & 63
        taken = table[point]
        inside[lead] = taken
        for k in (1, 2, 3):
            more = size > k
            inside[lead[more] + k] = taken[more]
    return inside


def shingles(texts: pa.Array, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, hashes): the distinct hashes of each text's n-grams in ascending order, one text after the other."""
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _inside(raw, table)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = Prefix(BYTE_CODES[raw]).ranges(starts, stops)
    owner = np.searchsorted(offsets, starts, "right") - 1
    grams = Prefix(words).all(n)
    whole = owner[: len(grams)] == owner[n - 1 :][: len(grams)]
    grams, owner = grams[whole].view(np.int64), owner[: len(grams)][whole].astype(np.uint16)
    order = np.argsort(grams)
    order = order[np.argsort(owner[order], kind="stable")]
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return np.cumsum(np.bincount(owner[fresh], minlength=len(texts))), grams[fresh]


def shingled(n: int, packed: np.ndarray):
    """For mapInArrow: batches of (id, text) to (id, s), a row for each."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(packed).astype(bool)
        for batch in source:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            size = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
            at = 0
            while at < len(texts):
                end = min(at + ROWS, max(at + 1, int(np.searchsorted(size, size[at] + BLOCK, "right")) - 1), len(texts))
                ends, hashes = shingles(texts.slice(at, end - at), n, table)
                s = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at), s], ["id", "s"])
                at = end

    return run
