"""Readers and writers of the pipeline's records. Schemas are explicit: optional keys must not change them."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POOL = "id string, function string, repo string, licence string, path string, head_sha string, introduced_sha string, introduced_at string, lines array<bigint>, live_mutants bigint, source_sha256 string, docstring string, source string, family string, split string"
EXTERNAL = tuple("subset question_id solution test gpt_difficulty gpt_pass_percentage".split())
STYLES = "struct<literal_eq bigint, approx bigint, relational bigint, membership bigint, expr_eq bigint, other bigint>"
ORACLE = "struct<sites bigint, recorded bigint, replaced bigint, already_correct bigint, too_long bigint, unliteral bigint, repr_lengths array<bigint>>"
SCORE = "struct<valid boolean, invalid_reason string, n_tests bigint, false_failures bigint, mutants_total bigint, mutants_equivalent bigint, mutants_killed bigint, mutation_score double, kills map<string,array<string>>>"
CANDIDATE = f"id string, sample bigint, completion_tokens bigint, parsed boolean, truncated boolean, pytest_import boolean, n_tests bigint, valid_before boolean, suite_unaided string, oracle {ORACLE}, valid boolean, kills bigint, mutation_score double, suite string, styles {STYLES}, n_tokens bigint"
OUTPUT = f"id string, condition string, model string, parsed boolean, truncated boolean, pytest_import boolean, suite string, n_tests_generated bigint, samples bigint, generation struct<text string, prompt_tokens bigint, completion_tokens bigint, seconds double, thinking_tokens bigint>, score {SCORE}, grounded struct<suite string, oracle {ORACLE}, score {SCORE}>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a broken one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def read_external(spark: SparkSession, path: str, subsets: list[str]) -> DataFrame:
    """The six columns of the external shards, only the subsets wanted: both reach the scan."""
    return spark.read.parquet(path).select(*EXTERNAL).where(F.col("subset").isin(subsets))


def read_reference(spark: SparkSession, path: str, prefix: str, key: str = "task_id", code: str = "code") -> tuple[DataFrame, DataFrame]:
    """((id, source, family) of a JSON-lines reference, (path, sha256) of its files as fetched)."""
    rows = spark.read.schema(f"{key} string, {code} string").option("mode", "FAILFAST").json(path)
    name = F.concat(F.lit(f"{prefix}:"), key)
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    return rows.select(name.alias("id"), F.col(code).alias("source"), name.alias("family")), files


def read_split(pool: DataFrame, split: str) -> DataFrame:
    return pool.where(F.col("split") == split).select("id", "source")


def read_source_files(spark: SparkSession, path: str, most_bytes: int = 200_000) -> DataFrame:
    """(path, source) of the Python files under a folder: of bounded size and in valid UTF-8; others are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(path)
    text = F.try_validate_utf8("content")
    return files.where(F.col("length") <= most_bytes).select("path", text.cast("string").alias("source")).where("source IS NOT NULL")


def read_junit(spark: SparkSession, path: str, most_chars: int = 500) -> DataFrame:
    """(file, name, outcome, message) of each test case of JUnit reports; a message is cut."""
    body = "struct<_message: string, _VALUE: string>"
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(f"_name string, failure {body}, error {body}").load(path)
    outcome = F.when(F.col("failure").isNotNull(), "failed").when(F.col("error").isNotNull(), "error").otherwise("passed")
    text = F.coalesce("failure._message", "error._message", F.lit(""))
    return cases.select(F.input_file_name().alias("file"), F.col("_name").alias("name"), outcome.alias("outcome"), F.substring(text, 1, most_chars).alias("message"))


def write_routed(rows: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each value of the split."""
    rows.write.mode("overwrite").partitionBy(split).json(path)


def notices(rows: DataFrame) -> DataFrame:
    """Distinct sources and licences, in order."""
    return rows.select("repo", "licence").distinct().orderBy("repo", "licence")


# driver-side files


def new_run(folder: str | Path, name: str, **fields) -> Path:
    """A run folder named by time, with a manifest of the code's revision and the given fields."""
    stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    run = Path(folder) / f"{name}-{stamp}"
    run.mkdir(parents=True)
    revision = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, cwd=folder, check=False).stdout.strip()
    (run / "manifest.json").write_text(json.dumps({"name": name, "created": stamp, "revision": revision or None} | fields, indent=1))
    return run


def update_run(run: Path, **fields) -> dict:
    """Merge fields into the manifest; a key given again replaces the old one."""
    path = run / "manifest.json"
    merged = json.loads(path.read_text()) | fields
    path.write_text(json.dumps(merged, indent=1))
    return merged


def latest_run(folder: str | Path, name: str) -> Path | None:
    return max(Path(folder).glob(f"{name}-*"), key=lambda p: p.name, default=None)


def write_report(path: Path, counts: dict, flagged: DataFrame) -> None:
    """Decontamination report: counts, then removed rows and rows for review, each with its first reasons. The flagged rows are read one partition at a time."""
    with path.open("w") as f:
        f.write("# Decontamination\n\n" + "".join(f"- {k}: {v}\n" for k, v in counts.items()))
        for hard, title in ((True, "Removed"), (False, "For review")):
            f.write(f"\n## {title}\n\n")
            for row in flagged.where(F.col("hard") == hard).orderBy("id").toLocalIterator():
                f.write(f"- {row['id']}: {'; '.join(row['reasons'])}\n")


def frozen(item: str, source: str, version: str, profile: str, categories: list[str], mutants: list[dict]) -> dict:
    """A mutant set with the versions that made it."""
    return {
        "function_id": item,
        "source_sha256": hashlib.sha256(source.encode()).hexdigest(),
        "operators_version": version,
        "profile": profile,
        "categories": categories,
        "mutants": mutants,
        "trivially_equivalent": sorted(m["mutant"] for m in mutants if m["equivalent"]),
        "live_count": sum(not m["equivalent"] for m in mutants),
    }


def write_frozen(path: Path, artifact: dict) -> None:
    os.makedirs(path.parent, exist_ok=True)
    with path.open("w") as f:
        json.dump(artifact, f, indent=1)


def read_frozen(path: Path, version: str) -> dict:
    """A frozen set, refused if other operators made it."""
    artifact = json.loads(path.read_text())
    if artifact["operators_version"] != version:
        raise ValueError(f"{path} was frozen by operators {artifact['operators_version']}, these are {version}")
    return artifact


def manifest_counts(candidates: DataFrame, flagged: DataFrame, kept: DataFrame, family: Column) -> DataFrame:
    """One row of the funnel: candidates, removed, kept, families and sources kept."""
    removed = flagged.where("hard").agg(F.count("*").alias("removed"))
    left = kept.agg(F.count("*").alias("kept"), F.countDistinct(family).alias("families"), F.countDistinct("repo").alias("repos"))
    return candidates.agg(F.count("*").alias("candidates")).crossJoin(removed).crossJoin(left)
