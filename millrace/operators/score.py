"""Scores of test suites from execution outcomes, and the tables they make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_valid(status: Column, tests: Column) -> Column:
    """A run that ended, has a test, and fails none."""
    return (status == "ok") & (F.size(tests) > 0) & F.forall(tests, lambda t: t["outcome"] == "passed")


def killed(status: Column, tests: Column) -> Column:
    """A mutant is killed by a failing test, a crash or a timeout."""
    return (status != "ok") | F.exists(tests, lambda t: t["outcome"] != "passed")


def invalid_reason(status: Column, tests: Column) -> Column:
    failing = F.size(F.filter(tests, lambda t: t["outcome"] != "passed"))
    return F.when(status == "timeout", "reference_timeout").when(status == "crash", "reference_crash").when(F.size(tests) == 0, "no_tests").when(failing > 0, "false_failure")


def suite_scores(reference_runs: DataFrame, mutant_runs: DataFrame) -> DataFrame:
    """Score suites: (id, status, tests) of each on the reference, and (id, mutant, equivalent, status, tests) on its mutants.

    An invalid suite, or one without a live mutant, has a null score and kills
    nothing. Equivalent mutants count in the total but not in the denominator.
    """
    live = ~F.coalesce("equivalent", F.lit(False))
    dead = live & killed(F.col("status"), F.col("tests"))
    names = F.when(F.col("status") != "ok", F.array(F.concat(F.lit("<"), "status", F.lit(">")))).otherwise(F.transform(F.filter("tests", lambda t: t["outcome"] != "passed"), lambda t: t["name"]))
    per = mutant_runs.groupBy("id").agg(
        F.count("*").alias("total"),
        F.count_if(live).alias("live"),
        F.count_if(dead).alias("killed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(dead, F.struct("mutant", names.alias("by")))))).alias("kills"),
    )
    reason = invalid_reason(F.col("status"), F.col("tests"))
    ref = reference_runs.select("id", reason.alias("invalid_reason"), F.size("tests").cast("long").alias("n_tests"), F.size(F.filter("tests", lambda t: t["outcome"] != "passed")).cast("long").alias("false_failures"))
    joined = ref.join(per, "id", "left")
    scored = F.col("invalid_reason").isNull() & (F.coalesce("live", F.lit(0)) > 0)
    none = F.create_map().cast("map<string,array<string>>")
    return joined.select(
        "id",
        F.col("invalid_reason").isNull().alias("valid"),
        "invalid_reason",
        "n_tests",
        "false_failures",
        F.coalesce("total", F.lit(0)).cast("long").alias("mutants_total"),
        F.coalesce(F.col("total") - F.col("live"), F.lit(0)).cast("long").alias("mutants_equivalent"),
        F.when(scored, F.col("killed")).otherwise(0).cast("long").alias("mutants_killed"),
        F.when(scored, F.col("killed") / F.col("live")).alias("mutation_score"),
        F.when(scored, F.col("kills")).otherwise(none).alias("kills"),
    )


def grounded_score(valid: Column, score: Column) -> Column:
    """The score, 0 where the suite is invalid or has none."""
    return F.coalesce(F.when(valid, score), F.lit(0.0))


def headline(scores: DataFrame) -> DataFrame:
    """One row over suites: validity over all, mean score over those with one, grounded mean over all; no suites: zeros."""
    scored = F.col("valid") & F.col("mutation_score").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scores.agg(
        F.count("*").alias("suites"),
        F.count_if("valid").alias("valid"),
        zero(F.avg(F.col("valid").cast("double"))).alias("validity_rate"),
        F.count_if(F.coalesce(F.col("invalid_reason") == "false_failure", F.lit(False))).alias("false_failure_suites"),
        F.coalesce(F.sum(F.when(scored, F.col("mutants_killed"))), F.lit(0)).cast("long").alias("mutants_killed"),
        F.coalesce(F.sum(F.when(scored, F.col("mutants_total") - F.col("mutants_equivalent"))), F.lit(0)).cast("long").alias("mutants_live_total"),
        zero(F.avg(F.when(scored, F.col("mutation_score")))).alias("mean_mutation_score"),
        zero(F.avg(grounded_score(F.col("valid"), F.col("mutation_score")))).alias("mean_grounded_score"),
    )


def record_table(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Both denominators in one row, or one for each group: unaided rates over parsed records, grounded ones over all.

    Records: parsed, score struct(valid, mutation_score), grounded struct(score, oracle struct(replaced)); any may be null.
    """
    parsed = F.coalesce("parsed", F.lit(False))
    score, ground = F.col("score"), F.col("grounded.score")
    ok = lambda s: parsed & F.coalesce(s["valid"], F.lit(False))
    has = parsed & score.isNotNull()
    out = records.groupBy(*(by or [])).agg(
        F.count("*").alias("n_all"),
        F.count_if(has).alias("n_scored"),
        F.coalesce(F.count_if(ok(score)) / F.nullif(F.count_if(has), F.lit(0)), F.lit(0.0)).alias("validity"),
        F.coalesce(F.avg(F.when(ok(score), score["mutation_score"])), F.lit(0.0)).alias("mutation_score"),
        F.coalesce(F.avg(ok(ground).cast("double")), F.lit(0.0)).alias("grounded_validity"),
        F.coalesce(F.avg(grounded_score(ok(ground), ground["mutation_score"])), F.lit(0.0)).alias("grounded_score"),
        F.coalesce(F.sum("grounded.oracle.replaced"), F.lit(0)).cast("long").alias("replaced"),
    )
    return out


def condition_table(records: DataFrame) -> DataFrame:
    """(condition, n, unparsed, truncated, pytest_import, mean_tokens, mean_seconds)."""
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return records.groupBy("condition").agg(
        F.count("*").alias("n"),
        F.count_if(~no("parsed")).alias("unparsed"),
        F.count_if(no("truncated")).alias("truncated"),
        F.count_if(no("pytest_import")).alias("pytest_import"),
        F.avg("generation.completion_tokens").alias("mean_tokens"),
        F.avg("generation.seconds").alias("mean_seconds"),
    )


def oracle_roll_up(candidates: DataFrame) -> DataFrame:
    """One row: sums of the repair counters, and how many written values there are of each length, in order of length."""
    sums = [F.coalesce(F.sum(f"oracle.{c}"), F.lit(0)).cast("long").alias(c) for c in "sites recorded replaced already_correct too_long unliteral".split()]
    lengths = candidates.select(F.explode("oracle.repr_lengths").alias("length")).groupBy("length").agg(F.count("*").alias("n"))
    # a row for each distinct length, which are bounded by the longest value that is written
    return candidates.agg(*sums).crossJoin(lengths.agg(F.array_sort(F.collect_list(F.struct("length", "n"))).alias("repr_lengths")))


def most_common(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, n), the commonest first; of equally common ones that which came first by `pos`."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(pos).alias("__first")).orderBy(F.desc("n"), "__first").drop("__first")


def live_floor(scores: DataFrame, least: int) -> DataFrame:
    """Rows with at least so many mutants that aren't equivalent."""
    return scores.where(F.col("mutants_total") - F.col("mutants_equivalent") >= least)


def kill_difference(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """(id, gained): mutants that only the tuned arm's valid suite kills; `kills` are maps by mutant."""
    a = base.where("valid").select("id", F.map_keys("kills").alias("a"))
    b = tuned.where("valid").select("id", F.map_keys("kills").alias("b"))
    return a.join(b, "id").select("id", F.array_sort(F.array_except("b", "a")).alias("gained")).where(F.size("gained") > 0)


def coverage(candidates: DataFrame, strata: DataFrame, a: Column, b: Column) -> DataFrame:
    """(stratum, functions, covered_a, covered_b): items of a stratum with a candidate that meets either condition."""
    each = candidates.groupBy("id").agg(F.max(F.coalesce(a, F.lit(False))).alias("a"), F.max(F.coalesce(b, F.lit(False))).alias("b"))
    joined = strata.select("id", "stratum").join(each, "id", "left")
    return joined.groupBy("stratum").agg(F.count("*").alias("functions"), F.count_if(F.coalesce("a", F.lit(False))).alias("covered_a"), F.count_if(F.coalesce("b", F.lit(False))).alias("covered_b"))


def failure_table(failing: DataFrame) -> DataFrame:
    """(bucket, n, suites): failing tests by bucket."""
    return failing.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("id").alias("suites"))


def failure_summary(failing: DataFrame) -> DataFrame:
    """One row: failing tests, suites, tests where the function raised, unfilled asserts, suites that fail whole."""
    return failing.agg(
        F.count("*").alias("failing"),
        F.countDistinct("id").alias("suites"),
        F.count_if(F.col("bucket").startswith("function raised")).alias("raised"),
        F.count_if(F.col("bucket").startswith("assert")).alias("unfilled"),
        F.countDistinct(F.when(F.col("n_failing") == F.col("n_tests"), F.col("id"))).alias("all_failing"),
    )


def percent_shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, share): each value as a percentage of all, 0 if they add up to nothing."""
    total = rows.agg(F.sum(value).alias("__t"))
    share = F.coalesce(100.0 * F.col(value) / F.nullif(F.col("__t"), F.lit(0)), F.lit(0.0))
    return rows.crossJoin(F.broadcast(total)).select(key, share.alias("share"))
