"""Substring deduplication over words with suffix automata and matching statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import given_id, keyed_text, numbered, outer_id, ship
from millrace.llm.repeats import Repeats, Words

WIDTH, GRAM = 20, 10
#: Words of reference text that are broadcast; beyond, `match_reference` refuses.
BROADCAST_WORDS = 200_000


class SuffixAutomaton:
    """All factors of the sequences fed so far, grown symbol by symbol."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def feed(self, symbol) -> int:
        """Append a symbol; the length of the longest suffix that also ended earlier."""
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        length.append(length[self.last] + 1)
        nxt.append({})
        link.append(0)
        p = self.last
        while p != -1 and symbol not in nxt[p]:
            nxt[p][symbol] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][symbol]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                length.append(length[p] + 1)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                while p != -1 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        return length[link[cur]]

    def statistics(self, symbols) -> list[int]:
        """For each place, the longest stretch ending there that the automaton holds."""
        out, state, size = [], 0, 0
        for x in symbols:
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                size += 1
            out.append(size)
        return out


def automaton_matcher(texts: dict[int, list], width: int):
    """(id, first, last) of windows that repeat an earlier one: each run streams past an automaton of those before it."""
    for runs in texts.values():
        shard = SuffixAutomaton()
        for i, (doc, s, _, text) in enumerate(sorted(set(runs))):
            if i:
                shard.feed(i)  # an integer equals no word: no match crosses runs
            begin = None
            for k, word in enumerate(text.split(b" ")):
                hit = shard.feed(word) >= width
                at = s + k - width + 1
                if hit and begin is None:
                    begin = at
                elif not hit and begin is not None:
                    yield doc, begin, at - 1
                    begin = None
            if begin is not None:
                yield doc, begin, s + k - width + 1


def dedup_word_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Remove every word of a window of `width` words that also starts earlier; the first copy stays.

    Returns (doc_id, n_words, n_removed, n_spans, kept: the other words joined by
    one space). The reference shards are the runs of one key (see `repeats`): a
    shard and the documents to match against it meet by key, so what an automaton
    holds is bounded and no shard is sent to documents that can't match it. Null
    texts have no words. Repeated rows, null ids and other columns: as in
    `suffix_dedup.dedup_substrings`.
    """
    own = numbered(keyed_text(docs, id_col, text_col))
    out = Repeats(Words, width, gram, automaton_matcher).cleaned(own)
    return out.select(given_id(own, id_col), F.col("n").alias("n_words"), "n_removed", "n_spans", F.col("kept").cast("string").alias("kept"))


def match_reference(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, start, end): maximal spans of words, `width` at least, of which every `width` occur in a small stated reference.

    The reference's automaton is broadcast, so the reference may have BROADCAST_WORDS
    words; a larger one is refused with ValueError (deduplicate by `dedup_word_spans`).
    """
    spark = docs.sparkSession
    ship(spark)
    size = reference.select(F.sum(F.size(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"))).alias("n")).first()["n"] or 0
    if size > BROADCAST_WORDS:
        raise ValueError(f"the reference has about {size} words; an automaton of {BROADCAST_WORDS} is broadcast at most")
    shard = SuffixAutomaton()
    for i, row in enumerate(reference.select(text_col).collect()):
        shard.feed(i)
        for word in (row[0] or "").encode().split():
            shard.feed(word)
    sent = spark.sparkContext.broadcast((shard.next, shard.link, shard.length))

    def find(text: str) -> list[tuple[int, int]]:
        s = SuffixAutomaton()
        s.next, s.link, s.length = sent.value
        found: list[list[int]] = []
        for k, n in enumerate(s.statistics((text or "").encode().split())):
            if n >= width:
                if found and k - width + 1 <= found[-1][1]:
                    found[-1][1] = k + 1
                else:
                    found.append([k - width + 1, k + 1])
        return [tuple(x) for x in found]

    spans = F.udf(find, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    return keyed_text(docs, id_col, text_col).select(outer_id(id_col), F.explode(spans("text")).alias("span")).select(id_col, "span.start", "span.end")
