"""Two arms on the same items: exact McNemar tests and paired bootstraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.numeric import mcnemar_exact
from millrace.operators.score import grounded_score
from millrace.operators.split import ranked

REPS = 2000


def bootstrap_means(diffs: DataFrame, value: str = "d", reps: int = REPS, seed: int = 0) -> DataFrame:
    """(rep, mean): means of resamples with replacement, as many draws as items.

    Draw i of rep r takes the item whose number is the first 32 bits of
    md5(seed:(r * n + i)) mod n, so any engine draws alike. The n draws of a rep are
    n rows that meet the items by number; reps * n rows are aggregated where they
    arise, and only their sums are shuffled.
    """
    items = ranked(diffs.select("id", F.col(value).alias("d")), "id").select("d", F.col("__i").alias("k"))
    n = diffs.count()
    if not n:
        return diffs.sparkSession.createDataFrame([], "rep int, mean double")
    spark = diffs.sparkSession
    draws = spark.range(reps * n).select((F.col("id") / n).cast("int").alias("rep"), (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % n).alias("k"))
    return draws.join(items, "k").groupBy("rep").agg((F.sum("d") / n).alias("mean"))


def interval(means: DataFrame, reps: int = REPS) -> DataFrame:
    """One row (lo, hi): the means at 0-based places 2.5 % and 97.5 %, without interpolation."""
    ranked = means.select("mean", (F.row_number().over(W.orderBy("mean")) - 1).alias("k"))
    at = lambda k: F.max(F.when(F.col("k") == int(k * reps), F.col("mean")))
    return ranked.agg(at(0.025).alias("lo"), at(0.975).alias("hi"))


def paired_bootstrap(diffs: DataFrame, value: str = "d", reps: int = REPS, seed: int = 0) -> DataFrame:
    """One row (n, mean, lo, hi); nulls without items."""
    head = diffs.agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return head.crossJoin(interval(bootstrap_means(diffs, value, reps, seed), reps))


def arm_valid(score: Column) -> Column:
    """Whether a record counts as valid: parsed, with a score that is valid."""
    return F.coalesce(F.col("parsed") & score["valid"], F.lit(False))


def paired(a: DataFrame, b: DataFrame, grounded: bool = False) -> DataFrame:
    """(id, va, vb, sa, sb): validity and score of the items that both arms have."""

    def side(df: DataFrame, suffix: str) -> DataFrame:
        score = F.col("grounded.score") if grounded else F.col("score")
        ok = arm_valid(score)
        return df.select("id", ok.alias(f"v{suffix}"), F.when(ok, score["mutation_score"]).alias(f"s{suffix}"))

    return side(a, "a").join(side(b, "b"), "id")


def compare_arms(a: DataFrame, b: DataFrame, grounded: bool = False, reps: int = REPS, seed: int = 0) -> DataFrame:
    """One row: validity of both arms, discordants and their p-value, and differences with intervals.

    The score difference is over items where both are valid (null if there are
    none); with `grounded`, the difference of grounded scores is over all items.
    """
    both = paired(a, b, grounded)
    valid = both.select("id", (F.col("va").cast("double") - F.col("vb").cast("double")).alias("d"))
    scored = both.where("va AND vb").select("id", (F.col("sa") - F.col("sb")).alias("d"))
    counts = both.agg(
        F.avg(F.col("va").cast("double")).alias("validity_a"),
        F.avg(F.col("vb").cast("double")).alias("validity_b"),
        F.count_if(F.col("va") & ~F.col("vb")).alias("only_a"),
        F.count_if(F.col("vb") & ~F.col("va")).alias("only_b"),
        F.count_if(F.col("va") & F.col("vb")).alias("both_valid"),
    )
    out = counts.withColumn("mcnemar_p", mcnemar_exact(F.col("only_a"), F.col("only_b")))
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    out = out.crossJoin(named(paired_bootstrap(valid, "d", reps, seed), "validity_diff")).crossJoin(named(paired_bootstrap(scored, "d", reps, seed), "score_diff"))
    if grounded:
        ground = both.select("id", grounded_score(F.col("va"), F.col("sa")).alias("ga"), grounded_score(F.col("vb"), F.col("sb")).alias("gb"))
        means = ground.agg(F.avg("ga").alias("grounded_a"), F.avg("gb").alias("grounded_b"))
        out = out.crossJoin(means).crossJoin(named(paired_bootstrap(ground.select("id", (F.col("ga") - F.col("gb")).alias("d")), "d", reps, seed), "grounded_diff"))
    return out


def drifted(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, before, after): items whose validity differs when they are scored again; without a score an item isn't valid."""
    side = lambda df, name: df.select("id", F.coalesce(F.col("score.valid"), F.lit(False)).alias(name))
    return side(old, "before").join(side(new, "after"), "id").where("before <> after")
