"""Substring deduplication over bytes with suffix arrays and longest-previous-factor values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import given_id, keyed_text, numbered
from millrace.llm.repeats import Bytes, Repeats

WIDTH, GRAM = 100, 32
#: Bytes that one suffix array covers, unless a single key has more.
ARRAY_BYTES = 1 << 20
#: Times that all links are followed at once.
ROUNDS = 64


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of `data` sorted by their first `depth` symbols, ties by position, and (length, rank class of each position) of each step.

    Doubling from six packed symbols: ranks of 2k symbols come from two ranks of
    k, so the work is a few sorts of integers however repetitive the data is.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), []
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = data.astype(np.uint64) + np.uint64(1)
    have = min(depth, 6)
    value = np.zeros(n, np.uint64)
    for i in range(have):
        value = value * np.uint64(1024) + wide[i : i + n]
    rank = np.unique(value, return_inverse=True)[1].astype(np.int64) + 1
    steps = [(have, rank.astype(np.int32))]
    while have < depth:
        step = min(have, depth - have)
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:]
        rank = np.unique(rank * np.int64(n + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        have += step
        steps.append((have, rank.astype(np.int32)))
    return np.argsort(rank, kind="stable"), steps


def lcp_array(data: np.ndarray, order: np.ndarray, steps: list[tuple[int, np.ndarray]], least: int = 0) -> np.ndarray:
    """Common prefix of each suffix in `order` with the one before it (0 for the first, and for less than `least`), up to the depth of the last step.

    `order` may leave suffixes out. Two suffixes agree in the length of a step where
    their classes do, so halving steps and then single symbols find the prefix.
    """
    out = np.zeros(len(order), np.int32)
    if len(order) < 2:
        return out
    n, depth = len(data), steps[-1][0]
    a, b, h = order[:-1], order[1:], np.zeros(len(order) - 1, np.int64)
    whole = steps[-1][1][a] == steps[-1][1][b]
    if least >= depth:
        out[1:] = depth * whole
        return out
    last = np.append(data.astype(np.int32), -1)  # past the end nothing agrees
    for size, rank in [*reversed(steps[:-1]), *[(1, None)] * 5]:
        i, j = a + h, b + h
        inside = np.maximum(i, j) < n
        i, j = np.minimum(i, n), np.minimum(j, n)
        if rank is None:
            agree = inside & (last[i] == last[j])
        else:
            inside &= np.maximum(i, j) + size <= n
            agree = inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        h += size * agree
    out[1:] = np.where(whole, depth, np.minimum(h, depth))
    out[out < least] = 0
    return out


def smaller_before(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the nearest place before it that holds a smaller position, and the common prefix with that.

    All places follow links at once, over places that hold greater positions; the
    least common prefix is carried along, and where none is left the search ends
    (such a place has 0, and -1 or wherever it was).
    """
    before, shared = np.arange(len(order)) - 1, lcp.copy()
    todo = np.flatnonzero((before >= 0) & (shared > 0))
    for _ in range(ROUNDS):
        todo = todo[order[before[todo]] > order[todo]]
        if not len(todo):
            return before, shared
        over = before[todo]
        shared[todo], before[todo] = np.where(before[over] < 0, 0, np.minimum(shared[todo], shared[over])), before[over]
        todo = todo[shared[todo] > 0]
    # long ascending chains: from the left, as links before are final
    for k in todo.tolist():
        j, least, own = int(before[k]), int(shared[k]), order[k]
        while j >= 0 and least and order[j] > own:
            j, least = int(before[j]), min(least, int(shared[j]))
        before[k], shared[k] = j, least if j >= 0 else 0
    return before, shared


def longest_previous_factor(data: np.ndarray, depth: int | None = None, starts: np.ndarray | None = None, least: int = 0) -> np.ndarray:
    """For each position, or each of `starts`, the longest prefix of its suffix that also starts earlier (at one of them), up to `depth`; 0 if it is shorter than `least`.

    The earlier suffix that shares most is the previous or the next in suffix
    order that holds a smaller position. Positions that aren't asked for have 0.
    """
    n = len(data)
    result = np.zeros(n, np.int32)
    if not n:
        return result
    order, steps = suffix_array(data, n if depth is None else depth)
    if starts is not None:
        order = order[starts[order]]
    lcp = lcp_array(data, order, steps, least)
    left = smaller_before(order, lcp)[1]
    right = smaller_before(order[::-1], np.concatenate([[0], lcp[1:][::-1]]).astype(np.int32))[1][::-1] if len(order) else left
    result[order] = np.maximum(left, right)
    return result


def array_matcher(texts: dict[int, list], width: int):
    """(id, first, last) of windows that repeat an earlier one, for runs grouped by key."""
    held, size = [], 0

    def matched():
        runs = sorted({(doc, s, e): text for key in held for doc, s, e, text in texts[key]}.items())
        lengths = np.array([len(t) for _, t in runs])
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        data = np.zeros(int(at[-1]), np.uint16)
        starts = np.zeros(len(data), bool)
        for (_, text), a in zip(runs, at.tolist()):
            data[a : a + len(text)] = np.frombuffer(text, np.uint8)
            data[a + len(text)] = 256
            starts[a : a + len(text) - width + 1] = True
        hits = np.flatnonzero(longest_previous_factor(data, width, starts, least=width))
        owner = np.searchsorted(at, hits, "right") - 1
        where = hits - at[owner] + np.array([s for (_, s, _), _ in runs])[owner]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (where[1:] != where[:-1] + 1)])[: len(hits)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hits)) - 1
        for a, b in zip(first.tolist(), last.tolist()):
            yield runs[owner[a]][0][0], int(where[a]), int(where[b])

    for key in texts:
        held.append(key)
        size += sum(len(t) + 1 for *_, t in texts[key])
        if size > ARRAY_BYTES:
            yield from matched()
            held, size = [], 0
    if held:
        yield from matched()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Remove every byte of a `width`-byte string that also starts earlier; the first copy stays.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept binary). Null texts count as
    empty. Matches never cross documents. Rows that repeat a document exactly
    (one id, not null, and one text) count as that document, each with the same
    result. All other rows are documents of their own, in the order of id and then
    of an order of texts; null ids sort first. Other columns are ignored.
    """
    own = numbered(keyed_text(docs, id_col, text_col))
    out = Repeats(Bytes, width, gram, array_matcher).cleaned(own)
    return out.select(given_id(own, id_col), F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept")
