"""Byte-pair encoding and decoding with an index of pair occurrences."""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import keyed_text, outer_id, ship, tidied, utf8

#: White space as Unicode's property has it; Python's str.split also takes 1C to 1F.
SPACE = "\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers of Unicode 16 and lower case of Unicode 17, which the interpreter's tables (15.1) lack.
NEW = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
LOWER = {c: c + 1 for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)} | {0xA7CB: 0x264, 0xA7DC: 0x19B, ord("Σ"): ord("σ")}
LOWER |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
_SPLIT = regex.compile(f"[{SPACE}]+")
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Text bytes whose new words are encoded together; words and other pieces that a worker remembers.
BLOCK, WORDS, OTHERS = 4 << 20, 200_000, 100_000
#: Text bytes at once where the ids themselves are given back: what their new words take while they are merged
#: is most of a worker's memory, and in a pipeline the executor still holds what earlier stages left.
ARRAY_BLOCK = 1 << 19
#: Marks that are one token behind a word of letters, whatever the word.
STOPS = frozenset(".,;:!?")


def default_path() -> str:
    """The public 49k word vocabulary of this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spaced(text: str) -> list[str]:
    """Maximal stretches without white space."""
    if any(c in text for c in _SEPARATORS):
        return [w for w in _SPLIT.split(text) if w]
    return text.split()


def category_ranges(initial: str) -> str:
    """Code points of a general category, as the inside of a character class.

    Spelled out, since regex libraries differ in what the newest code points are.
    """
    hits = sorted({c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == initial}.union(*[range(a, b + 1) for a, b in NEW[initial]]))
    out, begin = [], None
    for c, after in zip(hits, [*hits[1:], -1]):
        begin = c if begin is None else begin
        if after != c + 1:
            out.append(f"\\U{begin:08x}-\\U{c:08x}")
            begin = None
    return "".join(out)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


class Memory:
    """Two generations of a dict: bounded, and what is used stays."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size // 2, {}, {}

    def missing(self, keys: Iterable) -> list:
        """Keys that aren't here; those in the old generation become young."""
        out = []
        for k in keys:
            if k not in self.young:
                if k in self.old:
                    self.young[k] = self.old[k]
                else:
                    out.append(k)
        return out

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class PairIndexBPE:
    """Encoder and decoder for a vocabulary file of byte-level BPE with word ends."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("a BPE model with word ends, and neither decoder nor post-processor, is expected")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # Below U+0530 all tables agree; there the short classes serve.
        self.near_words = regex.compile(split.replace(r"\s", SPACE), regex.V0)
        for name, members in {r"\s": SPACE, r"\p{L}": category_ranges("L"), r"\p{N}": category_ranges("N")}.items():
            split = split.replace(name, members)
        self.far_words = regex.compile(split, regex.V0)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pieces = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.pieces[i] = s
        self.rank: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(self.vocab[a] << 32 | self.vocab[b], (r, self.vocab[a + b]))
        letters = byte_letters()
        self.inner = [self.vocab[letters[b]] for b in range(256)]
        self.final = [self.vocab[letters[b] + self.suffix] for b in range(256)]

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text or max(text) >= "\u0530":
                text = text.translate(LOWER)
        return text.lower()

    def words_of(self, stretch: str) -> list:
        """Words of a stretch without white space as the vocabulary splits it; a special token is its id."""
        if stretch.isascii():
            if stretch.isalpha():
                return [stretch.lower()]
            if stretch[-1] in STOPS and stretch[:-1].isalpha():
                return [stretch[:-1].lower(), stretch[-1]]
        out = []
        for part in self.parts.split(stretch) if "<" in stretch else (stretch,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                norm = self.normal(part)
                out += self.near_words.findall(norm) if max(norm) < "\u0530" else self.far_words.findall(norm)
        return out

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word: all words are one sequence whose pairs are indexed by rank.

        Active ranks are taken in ascending order; each visits its positions from
        the left, merges those that still hold the pair, and enters the two pairs
        that arise into the lists of their ranks. A word's next merge is always its
        pair of least rank, so the result is that of encoding it alone.
        """
        symbols: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        for w in words:
            at = len(symbols)
            starts.append(at)
            symbols += [self.inner[b] for b in w[:-1]]
            symbols.append(self.final[w[-1]])
            end = len(symbols)
            before += [-1, *range(at, end - 1)]
            after += [*range(at + 1, end), -1]
        rank = self.rank
        places: dict[int, list[int]] = {}
        made: dict[int, tuple[int, int, int]] = {}
        get = rank.get
        for i, j in enumerate(after):
            if j >= 0:
                pair = symbols[i] << 32 | symbols[j]
                hit = get(pair)
                if hit is not None:
                    r = hit[0]
                    if r in places:
                        places[r].append(i)
                    else:
                        places[r] = [i]
                        made[r] = (symbols[i], symbols[j], hit[1])
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = made[r]
            for i in sorted(places.pop(r)):
                if symbols[i] != a:
                    continue
                j = after[i]
                if j < 0 or symbols[j] != b:
                    continue
                k = after[j]
                symbols[i], symbols[j], after[i] = new, -1, k
                if k >= 0:
                    before[k] = i
                    pair = new << 32 | symbols[k]
                    hit = get(pair)
                    if hit is not None:
                        q = hit[0]
                        if q in places:
                            places[q].append(i)
                        else:
                            places[q] = [i]
                            made[q] = (new, symbols[k], hit[1])
                            heapq.heappush(active, q)
                h = before[i]
                if h >= 0:
                    pair = symbols[h] << 32 | new
                    hit = get(pair)
                    if hit is not None:
                        q = hit[0]
                        if q in places:
                            places[q].append(h)
                        else:
                            places[q] = [h]
                            made[q] = (symbols[h], new, hit[1])
                            heapq.heappush(active, q)
        out = []
        for i in starts:
            ids = []
            while i >= 0:
                ids.append(symbols[i])
                i = after[i]
            out.append(ids)
        return out

    def encode_stretches(self, stretches: list[str]) -> list[list[int]]:
        """Ids of texts without white space; words that recur are merged once."""
        plans = [self.words_of(s) for s in stretches]
        index = {w: i for i, w in enumerate({w for plan in plans for w in plan if isinstance(w, str)})}
        ids = self.merged([w.encode() for w in index])
        return [[t for w in plan for t in (ids[index[w]] if isinstance(w, str) else (w,))] for plan in plans]

    def encode(self, text: str) -> list[int]:
        return [t for ids in self.encode_stretches(spaced(text)) for t in ids]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, special ones included, as a vocabulary without decoder has it."""
        return " ".join([self.pieces[i] for i in ids])


@dataclass
class Worker:
    """A vocabulary with what a Python worker remembers of it.

    `encode` gives the values of new words, `join` the value of a piece from
    those of its words, `special` that of a special token.
    """

    bpe: PairIndexBPE
    encode: Callable[[list[str]], list]
    join: Callable[[list], object]
    special: Callable[[int], object]
    n_words: int = WORDS
    block: int = BLOCK

    def __post_init__(self):
        self.words, self.others = Memory(self.n_words), Memory(OTHERS)

    def blocks(self, texts: pa.Array) -> Iterable[tuple[np.ndarray, np.ndarray, list]]:
        """(index, cuts, values) for blocks of texts: text k is values[i] for i in index[cuts[k] : cuts[k + 1]].

        Pieces of the text are numbered by Arrow, so Python sees each distinct one
        of a block once; new words are encoded together. White space that isn't
        ASCII stays within a piece and is no part of any word.
        """
        raw, offsets = utf8(texts)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.block, "right")) - 1)
            index, cuts, names, plain = pieces(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            self.words.turn()
            self.others.turn()
            words, others = names[plain].tolist(), names[~plain].tolist()
            new = self.others.missing(others)
            plans = [self.bpe.words_of(s) for s in new]
            known = self.words.young
            for some in (words, {w for plan in plans for w in plan if isinstance(w, str)}):
                fresh = self.words.missing(some)
                known.update(zip(fresh, self.encode(fresh)))
            rest = self.others.young
            rest.update(zip(new, [self.join([known[w] if isinstance(w, str) else self.special(w) for w in plan]) for plan in plans]))
            values = np.empty(len(names), object)
            for which, have, of in ((plain, known, words), (~plain, rest, others)):
                values[which] = np.fromiter(map(have.__getitem__, of), object, len(of))
            yield index, cuts, values.tolist()
            at = end


#: Classes of bytes as the vocabulary splits: white space, letters (and whatever isn't ASCII), digits, marks.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each piece of text, the first piece of each text (n + 1), the distinct pieces, and which of them are words as they are.

    A stretch without white space is cut where ASCII letters, letters from À to ÿ,
    digits and marks meet, and lower-cased: the vocabulary does the same. Where
    that isn't sure (an apostrophe, the < of a special token, any other character
    that isn't ASCII) a stretch is one piece, left as it is.
    """
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), np.zeros(0, object), np.zeros(0, bool)
    kind, low = _KIND[raw], _LOWER[raw]
    unsure = (raw == 39) | (raw == 60)
    high = raw >= 128
    if high.any():
        lead = np.zeros(len(raw), bool)
        second = raw[1:]
        lead[:-1] = (raw[:-1] == 0xC3) & (second != 0x97) & (second != 0xB7)
        latin = lead.copy()
        latin[1:] |= lead[:-1]
        unsure |= high & ~latin
        upper = np.flatnonzero(lead[:-1] & (second < 0x9F)) + 1
        low[upper] += 32
    inside = kind != 0
    cut = np.zeros(len(raw), bool)
    cut[0] = True
    ends_of_texts = offsets[1:-1]
    cut[ends_of_texts[ends_of_texts < len(raw)]] = True
    first = inside.copy()
    first[1:] &= cut[1:] | (kind[1:] != kind[:-1])
    if unsure.any():
        whole = inside.copy()
        whole[1:] &= cut[1:] | ~inside[:-1]
        begin = np.flatnonzero(whole)
        bad = np.unique(np.searchsorted(begin, np.flatnonzero(unsure), "right") - 1)
        gap = np.flatnonzero(np.append(~inside | whole, True))  # where a stretch can end
        start = begin[bad]
        stop = np.minimum(gap[np.searchsorted(gap, start, "right")], len(raw))
        size = stop - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        low[at], first[at], kind[at] = raw[at], False, 4
        first[start] = True
    starts = np.flatnonzero(first)
    dense = low[inside]
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    where = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=where[1:])
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(dense)]).dictionary_encode()
    index = coded.indices.to_numpy()
    of = np.zeros(len(coded.dictionary), np.uint8)
    of[index] = kind[starts]
    return index, np.searchsorted(starts, offsets), coded.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False), (of == 1) | (of == 3)


_vocabularies: dict[str, PairIndexBPE] = {}


def worker(path: str, make: Callable[[PairIndexBPE], Worker]) -> Worker:
    """The vocabulary is kept while the Python worker lives; what is remembered of words goes with the task."""
    if path not in _vocabularies:
        _vocabularies[path] = PairIndexBPE(path)
    return make(_vocabularies[path])


def pair_worker(bpe: PairIndexBPE, show: Callable[[list[int]], object], join: Callable[[list], object], block: int = BLOCK) -> Worker:
    """Values are (show(ids), decoded text), by the pair index."""
    both = lambda ids: (show(ids), bpe.decode(ids))
    return Worker(bpe, lambda words: [both(ids) for ids in bpe.merged([w.encode() for w in words])], lambda pairs: (join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])), lambda i: both([i]), block=block)


def digest_worker(bpe: PairIndexBPE) -> Worker:
    """Values are (decimal ids, decoded text)."""
    return pair_worker(bpe, lambda ids: " ".join(map(str, ids)), " ".join)


def array_worker(bpe: PairIndexBPE) -> Worker:
    """Values are (ids as 32-bit integers, decoded text)."""
    return pair_worker(bpe, lambda ids: np.array(ids, "<i4").tobytes(), b"".join, ARRAY_BLOCK)


def gathered(index: np.ndarray, cuts: np.ndarray, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit ids of values[i] for i in index, one after the other, and how many there are from each cut to the next."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat = np.frombuffer(b"".join(values), "<u4")
    first = np.cumsum(sizes) - sizes
    each = sizes[index]
    total = np.cumsum(each)
    place = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first[index] - (total - each), each)
    sums = np.concatenate([[0], total])
    return flat[place], sums[cuts[1:]] - sums[cuts[:-1]]


def sentences(index: np.ndarray, cuts: np.ndarray, values: list[str]) -> pa.Array:
    """For each text its pieces' values, those that aren't empty, joined by one space."""
    full = np.fromiter(map(bool, values), bool, len(values))[index]
    at = np.concatenate([[0], np.cumsum(full)])[cuts]
    parts = pa.array(values, pa.large_string()).take(pa.array(index[full]))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), parts), pa.scalar(" ", pa.large_string()))


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the
    decoded text. Null counts as empty; texts without tokens give the hashes of
    nothing. Special tokens that stand in a text are their ids. Every row gives a
    row, repeated rows too; null ids stay null; other columns are ignored. The
    vocabulary file must lie at `path` on every executor.
    """
    path = path or default_path()
    ship(docs.sparkSession)

    def run(source):
        state = worker(path, digest_worker)
        for batch in source:
            done = 0
            for index, cuts, values in state.blocks(batch.column("text")):
                sha = lambda texts: pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())
                shown, decoded = zip(*values) if values else ((), ())
                ids = sentences(index, cuts, shown)
                n = pc.add(pc.count_substring(ids, " "), pc.greater(pc.binary_length(ids), 0).cast(pa.int64()))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(done, len(n)), "n_tokens": n.cast(pa.int64()), "ids_sha256": sha(ids), "decoded_sha256": sha(sentences(index, cuts, decoded))})
                done += len(n)

    out = keyed_text(docs, id_col, text_col).mapInArrow(lambda source: tidied(run(source)), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(outer_id(id_col), "n_tokens", "ids_sha256", "decoded_sha256")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded): the tokens themselves and the text they decode to; cases as in `round_trip`."""
    path = path or default_path()
    ship(docs.sparkSession)

    def run(source):
        state = worker(path, array_worker)
        for batch in source:
            done = 0
            for index, cuts, values in state.blocks(batch.column("text")):
                numbers, decoded = zip(*values) if values else ((), ())
                flat, n = gathered(index, cuts, numbers)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(done, len(n)), "ids": ids, "decoded": sentences(index, cuts, decoded).cast(pa.string())})
                done += len(n)

    out = keyed_text(docs, id_col, text_col).mapInArrow(lambda source: tidied(run(source)), "id long, ids array<int>, decoded string")
    return out.select(outer_id(id_col), "ids", "decoded")
