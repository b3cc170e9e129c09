"""Picking training rows from scored candidates.

Candidates have an item `id`, a position `pos` that breaks ties as file order
does, and: parsed, valid_before, valid, kills, mutation_score, n_tests, n_tokens,
suite_unaided, suite. Missing values count as false or zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_TOKENS = 1024


def truth(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_wins(rows: DataFrame, *keys: str, pos: str = "pos") -> DataFrame:
    """The last row of each key by position."""
    return first_by(rows, list(keys), F.desc(pos))


def first_wins(rows: DataFrame, *keys: str, pos: str = "pos") -> DataFrame:
    return first_by(rows, list(keys), F.asc(pos))


def best_per_item(candidates: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Of the valid, killing candidates that fit: best score, then fewest tests, then the earliest."""
    fit = candidates.where(truth("valid") & (number("kills") > 0) & (number("n_tokens") <= max_tokens))
    return first_by(fit, ["id"], F.desc("mutation_score"), F.asc("n_tests"), F.asc("pos"))


def best_unaided(candidates: DataFrame) -> DataFrame:
    """Of the candidates valid before any repair that kill: best score, then the earliest."""
    fit = candidates.where(truth("parsed") & truth("valid_before") & (number("kills") > 0))
    return first_by(fit, ["id"], F.desc("mutation_score"), F.asc("pos"))


def best_of_first_valid(samples: DataFrame) -> DataFrame:
    """(id, pos, valid, tokens, seconds): the first valid sample of each item, else its last; tokens and seconds of all."""
    each = samples.groupBy("id").agg(
        F.min(F.when(truth("valid"), F.col("pos"))).alias("first"),
        F.max("pos").alias("last"),
        F.sum("tokens").alias("tokens"),
        F.sum("seconds").alias("seconds"),
    )
    return each.select("id", F.coalesce("first", "last").alias("pos"), F.col("first").isNotNull().alias("valid"), "tokens", "seconds")


def _paired(chosen: DataFrame, rejected: DataFrame, most: int) -> DataFrame:
    """i-th chosen with i-th rejected of each item, `most` pairs at most."""
    a = chosen.where(F.col("rn") <= most).select("id", "rn", *[F.col(c).alias(f"chosen_{c}") for c in ("pos", "kills", "suite_unaided")])
    b = rejected.where(F.col("rn") <= most).select("id", "rn", *[F.col(c).alias(f"rejected_{c}") for c in ("pos", "kills", "valid", "suite_unaided")])
    return a.join(b, ["id", "rn"]).withColumnRenamed("rn", "pair")


def unaided_pairs(candidates: DataFrame, most: int = 2, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(id, pair, chosen_*, rejected_*): valid, killing suites over invalid ones; those that repair made killing are the hardest and come first."""
    own = candidates.where(truth("parsed") & (number("n_tokens") <= max_tokens))
    chosen = own.where(truth("valid_before") & (number("kills") > 0))
    rejected = own.where(~truth("valid_before"))
    rescued = truth("valid") & (number("kills") > 0)
    by = W.partitionBy("id")
    chosen = chosen.withColumn("rn", F.row_number().over(by.orderBy(F.desc("mutation_score"), "n_tests", "pos")))
    rejected = rejected.withColumn("rn", F.row_number().over(by.orderBy(F.desc(rescued), F.desc(number("kills")), F.desc(number("n_tests")), "pos")))
    return _paired(chosen, rejected, most)


def rejected_kind() -> Column:
    """0 invalid after repair, 1 kills nothing, 2 weak."""
    return F.when(~truth("valid"), 0).when(number("kills") == 0, 1).otherwise(2)


def grounded_pairs(candidates: DataFrame, most: int = 2, gap: int = 2, max_tokens: int = MAX_TOKENS, parity: bool = False) -> DataFrame:
    """(id, pair, chosen_*, rejected_*): killing suites after repair over invalid, idle or weak ones.

    A weak suite trails the item's best by `gap` kills at least. With parity, only
    the best chosen is kept out of the rejected, so a lesser one can meet itself;
    by default such a pair is dropped.
    """
    own = candidates.where(truth("parsed") & (number("n_tokens") <= max_tokens))
    by = W.partitionBy("id")
    killing = truth("valid") & (number("kills") > 0)
    ranked = own.where(killing).withColumn("rn", F.row_number().over(by.orderBy(F.desc("kills"), "n_tests", "pos")))
    top = ranked.where("rn = 1").select("id", F.col("pos").alias("top_pos"), F.col("kills").alias("top_kills"))
    rejected = own.join(top, "id").where((F.col("pos") != F.col("top_pos")) & ((rejected_kind() < 2) | (F.col("kills") <= F.col("top_kills") - gap)))
    rejected = rejected.withColumn("rn", F.row_number().over(by.orderBy(rejected_kind(), number("kills"), "pos")))
    pairs = _paired(ranked, rejected, most)
    return pairs if parity else pairs.where("chosen_pos <> rejected_pos")


def pair_stats(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """One row: items, items with pairs, pairs, rejected by kind, kills on either side."""
    kind = F.when(~F.coalesce("rejected_valid", F.lit(False)), 0).when(F.coalesce("rejected_kills", F.lit(0)) == 0, 1).otherwise(2)
    figures = pairs.agg(
        F.countDistinct("id").alias("functions_with_pairs"),
        F.count("*").alias("pairs"),
        F.count_if(kind == 0).alias("rejected_invalid"),
        F.count_if(kind == 1).alias("rejected_idle"),
        F.count_if(kind == 2).alias("rejected_weak"),
        F.coalesce(F.sum("chosen_kills"), F.lit(0)).alias("chosen_kills"),
        F.coalesce(F.sum("rejected_kills"), F.lit(0)).alias("rejected_kills"),
    )
    return items.agg(F.countDistinct("id").alias("functions")).crossJoin(figures)


def top_quality(rows: DataFrame, keep: int) -> DataFrame:
    """Best score, then fewest tests, then id; `keep` rows, or all for 0."""
    ordered = rows.orderBy(F.desc("mutation_score"), "n_tests", "id")
    return ordered.limit(keep) if keep else ordered


def funnel(rows: DataFrame, **stages: Column) -> DataFrame:
    """One row of counts: how many rows reach each stage, every stage within the one before; null is no."""
    reached, counts = F.lit(True), []
    for name, condition in stages.items():
        reached = reached & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(reached).alias(name))
    return rows.agg(F.count("*").alias("rows"), *counts)


def counts_by(rows: DataFrame, key: Column, kept: Column) -> DataFrame:
    """(key, seen, kept)."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("seen"), F.count_if(kept).alias("kept"))


def map_sum(rows: DataFrame, maps: str) -> DataFrame:
    """(key, total): key by key over all maps."""
    return rows.select(F.explode(maps).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def best_checkpoint(curve: DataFrame, grounded: bool) -> DataFrame:
    """The best step: by grounded score (null: 0), else by validity and then mutation score; the first on ties."""
    keys = [F.desc(F.coalesce("grounded_score", F.lit(0.0)))] if grounded else [F.desc("validity"), F.desc("mutation_score")]
    return curve.orderBy(*keys, "step").limit(1)
