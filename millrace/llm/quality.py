"""Quality rules as a short-circuit cascade, in DataFrame expressions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, materialize

#: Documents on which cost and selectivity are estimated (expected number).
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    """`reject` is true for a document to drop; `cost` estimates the work of finding out, and where it is None the time is measured."""

    name: str
    reject: Column
    cost: Column | None = None


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimiser inlines."""
    return F.transform(F.array(value), body)[0]


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern))


def with_features(docs: DataFrame) -> DataFrame:
    """The base columns, in two projections: words first, so that they are split once."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.withColumn("words", words).withColumn("lines", lines)

    def sorted_windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))
        return F.when(F.size(w) >= 3, hashed)

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]), F.lit(False)))
        return let(F.transform(twice, lambda x: x["at"]), lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))

    return (
        base.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", _count(r"[#*$%&|<>]").cast("long"))
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("windows", F.sort_array(sorted_windows(F.col("words"))))
        .withColumn("n_repeat_words", F.coalesce(let(F.col("windows"), covered), F.lit(0)).cast("long"))
        .drop("windows")
    )


def default_rules() -> list[Rule]:
    """Rules of the verdict; what each costs is measured."""
    c = F.col
    return [
        Rule("word_length", (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words"))),
        Rule("symbols", 10 * c("n_symbols") > c("n_words")),
        Rule("duplicate_lines", 2 * c("n_dup_lines") > c("n_lines")),
        Rule("repeated_words", 10 * c("n_repeat_words") > 3 * c("n_words")),
        Rule("exclamation", 10 * _count("!") > 3 * c("n_words")),
        Rule("capitals", 2 * _count(r"\p{Lu}") > _count(r"\p{L}")),
        Rule("letterless_words", 10 * F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))) < 7 * c("n_words")),
    ]


def seconds(df: DataFrame, value: Column) -> float:
    """Time of evaluating it on all rows; the lesser of two, as the first run compiles."""
    took = []
    for _ in range(2):
        began = time.perf_counter()
        df.agg(F.count_if(value)).first()
        took.append(time.perf_counter() - began)
    return min(took)


def cascade_order(features: DataFrame, rules: list[Rule], total: int, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost on a sample, greatest first; ties by name. Order changes the work, never the verdict."""
    return ordered(features.sample(min(1.0, sample_rows / max(1, total)), seed=11), rules)


def ordered(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    figures = [f for i, r in enumerate(rules) for f in (F.avg(r.reject.cast("double")).alias(f"r{i}"), *([F.avg(r.cost).alias(f"c{i}")] if r.cost is not None else []))]
    row = sample.agg(*figures).first()
    cost = {r.name: row[f"c{i}"] if r.cost is not None else seconds(sample, r.reject) for i, r in enumerate(rules)}
    gain = {r.name: (row[f"r{i}"] or 0.0) / max(cost[r.name] or 1.0, 1e-9) for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row.

    base_failed: fewer than 50 words, or over half of them in three-word windows
    that occur twice or more. kept: false where base_failed, else whether no rule
    rejects. Rules run as one lazy CASE in the order of the cascade, so a document
    pays for later rules only if earlier ones let it pass. A null text has no
    words and fails; every row gives a row, repeated rows too; null ids stay null
    and other columns are ignored. Three-word windows are compared by 64-bit hash
    within their document.
    """
    rules = default_rules() if rules is None else rules
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # sampled before anything is computed, and written, so that a rule's time holds no other's work
    sample = own.sample(min(1.0, sample_rows / max(1, docs.count())), seed=11).repartition(4)
    cascade = ordered(materialize(with_features(sample), "sample"), rules)
    features = with_features(own)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for r in cascade:
        verdict = verdict.when(r.reject, F.lit(False))
    return features.withColumn("base_failed", failed).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.otherwise(True).alias("kept")
    )
