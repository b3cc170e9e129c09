"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions only."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize
from millrace.llm.quality import let

#: A leak is a window of WINDOW tokens with at most SUBSTITUTIONS that differ.
WINDOW, SUBSTITUTIONS = 13, 2
#: Token positions that each mask compares; together they hit every such window (`lossless`).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Items with fewer tokens than WINDOW must occur as they are; those with fewer than this must be all of a document.
WITHIN_TOKENS = 4
#: Seeds of the benchmark that are broadcast at once (about 300 bytes each); a larger benchmark is joined block by block.
BLOCK_SEEDS = 100_000


def lossless(masks, window: int, substitutions: int) -> bool:
    """Whether in any window with so many substitutions some mask lies on unchanged tokens only."""
    places = [frozenset(o + x for x in m) for m in masks for o in range(window - max(m))]
    return all(any(not p & set(bad) for p in places) for bad in itertools.combinations(range(window), substitutions))


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed(mask: tuple[int, ...], at: Column, number: int) -> Column:
    """Hash of the tokens under the mask, null where it sticks out."""
    return F.when(at + max(mask) < F.size("tokens"), F.xxhash64(F.lit(number), *[F.get("tokens", at + o) for o in mask]))


def around(at: Column, before: Column, after: Column) -> Column:
    """Tokens from at - before to at + after, null beyond the text's ends."""
    return F.transform(F.sequence(at - before, at + after - 1), lambda i: F.when(i >= 0, F.get("tokens", F.greatest(i, F.lit(0)))))


def placed(df: DataFrame, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """A row for each token position and mask: (…, at, seed struct(mask, h))."""
    at = df.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)))  # 0, -1 without tokens: no seed fits
    hashes = F.array(*[F.struct(F.lit(n).alias("mask"), seed(m, F.col("at"), n).alias("h")) for n, m in masks])
    return at.withColumn("seed", F.explode(hashes)).where("seed.h IS NOT NULL")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, substitutions: int = SUBSTITUTIONS, masks=MASKS, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, item_id, best, doc_from, doc_to) for each document and item that share a window.

    Tokens are lower-cased runs of letters and digits. Two windows of `window`
    tokens overlap if they differ in at most `substitutions` places; `best` is the
    most tokens that agree in one, doc_from and doc_to the token range that such
    windows cover in the document. Masks that ignore fixed places find the
    candidates; they must be lossless for these figures, so nothing is missed.
    Shorter items must occur whole and unchanged, and those of fewer than
    WITHIN_TOKENS tokens match only documents that have no other token. Null texts
    and texts without a token never match. Rows with one id count as
    one document; null ids are kept. Other columns are ignored.

    Documents stream past broadcast seeds of the benchmark in blocks of a fixed
    size, so neither documents nor candidates are shuffled; only verified windows are.
    """
    if not lossless(masks, window, substitutions):
        raise ValueError("these masks miss windows with so many substitutions")
    items = benchmark.select(F.col(item_col).alias("item"), token_hashes(F.col(item_text)).alias("tokens")).withColumn("n", F.size("tokens")).where("n > 0")
    short = [r[0] for r in items.where(F.col("n") < window).select("n").distinct().orderBy("n").collect()]
    numbered = list(enumerate(masks)) + [(len(masks) + i, tuple(range(n))) for i, n in enumerate(short)]
    length = F.lit(window)
    for i, n in enumerate(short):
        length = F.when(F.col("seed.mask") == len(masks) + i, n).otherwise(length)
    fits = F.when(F.col("seed.mask") < len(masks), F.col("n") >= window).otherwise(F.col("n") == F.col("size"))
    table = placed(items, numbered).withColumn("size", length).where(fits)
    table = table.select(F.col("seed.h").alias("h"), "item", "size", F.col("at").alias("item_at"), around(F.col("at"), F.col("size"), F.col("size")).alias("theirs"), F.pmod(F.xxhash64("seed.h"), F.lit(1 << 30)).alias("part"))
    table = materialize(table, "seeds")
    seeds = table.count()
    blocks = max(1, -(-seeds // block_seeds))
    own = docs.select(F.col(id_col).alias("id"), token_hashes(F.col(text_col)).alias("tokens"))
    found = []
    for b in range(blocks):
        part = F.broadcast(table.where(F.col("part") % blocks == b).drop("part"))
        found.append(verified(placed(own, numbered).withColumn("h", F.col("seed.h")).join(part, "h"), substitutions))
    out = reduce(DataFrame.unionByName, found).groupBy("id", "item").agg(F.max("best").alias("best"), F.min("lo").alias("doc_from"), F.max("hi").alias("doc_to")).where("best IS NOT NULL")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best").cast("long").alias("best"), F.col("doc_from").cast("long").alias("doc_from"), F.col("doc_to").cast("long").alias("doc_to"))


def verified(hits: DataFrame, substitutions: int) -> DataFrame:
    """Windows around each hit that agree in all but `substitutions` places: their range and best agreement."""
    size = F.col("size")
    ours = around(F.col("at"), size, size)
    agree = F.zip_with(ours, F.col("theirs"), lambda x, y: F.when(x.isNull() | y.isNull(), -1000).when(x == y, 1).otherwise(0))
    allowed = F.when(size < WINDOW, 0).otherwise(substitutions)

    def windows(flags: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), size), lambda a: F.struct(F.aggregate(F.slice(flags, a + 1, size), F.lit(0), lambda s, x: s + x).alias("n"), (F.col("at") - size + a).alias("lo")))
        return F.filter(every, lambda w: w["n"] >= size - allowed)

    # No filter here: the optimiser would make it a condition of the join and so take the join out of generated code.
    alone = F.when((size >= WITHIN_TOKENS) | (size == F.size("tokens")), let(agree, windows))
    good = hits.select("id", "item", "size", alone.alias("good"))
    return good.select("id", "item", F.array_max("good")["n"].alias("best"), F.array_min(F.transform("good", lambda w: w["lo"])).alias("lo"), (F.array_max(F.transform("good", lambda w: w["lo"])) + F.col("size")).alias("hi"))
