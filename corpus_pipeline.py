"""The corpus pipeline: five stages over `documents`, each on all that the one before kept."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_documents
from millrace.llm.common import NULL_ID, materialize, numbered
from millrace.llm.decontaminate import leaks
from millrace.llm.langid import UNDETERMINED, classify, learn
from millrace.llm.near import similar_texts
from millrace.llm.repeats import Repeats, Words
from millrace.llm.substring_dedup import GRAM, WIDTH, automaton_matcher

#: The least mean probability of the predicted language with which a document stays.
LEAST_LANGUAGE_SCORE = 0.3


def _rows(docs: DataFrame) -> DataFrame:
    """(id: a key of the row in the order of doc_id, text, row: all columns)."""
    return numbered(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*docs.columns).alias("row")), apart=True)


def _columns(docs: DataFrame) -> list:
    return [F.col("row")[c].alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter, or no language of LEAST_LANGUAGE_SCORE. A missing lang becomes the predicted one.

    Null and empty texts go. Every row is judged by its own text, repeated rows and
    null ids too. Without any labelled text all rows go.
    """
    seen = classify(docs.select("text", F.struct(*docs.columns).alias("row")), learn(docs), "text", "language", "score")
    kept = seen.where((F.col("language") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    made = {"lang": F.coalesce("row.lang", "language")}
    return kept.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, texts of similarity 0.8 or more in five-word shingles, the row of least id stays.

    A null id is less than any; rows of one id are told apart by a hash of the text.
    Texts without words, null ones too, are one group.
    """
    own = _rows(docs)
    again = similar_texts(own.select("id", "text")).where("id <> first").select("id")
    return own.join(again, "id", "left_anti").select(*_columns(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the words of repeated windows. Documents that lose none keep their text as it is; those that lose all go.

    Of repeated rows and of null ids each row is a document of its own, and the
    first copy stays; null and empty texts stay. n_chars, where there is one,
    follows the text.
    """
    out = Repeats(Words, WIDTH, GRAM, automaton_matcher).cleaned(_rows(docs)).where("n_removed < n OR n = 0")
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept").cast("string"))
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a window with a benchmark item; rows of one id or of none are told apart, null and empty texts stay."""
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    own = _rows(docs)
    bad = leaks(own, benchmark, id_col="id").select("id").distinct()
    return own.join(bad, "id", "left_anti").select(*_columns(docs))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row that is left; a null text has no tokens."""
    out = encode_documents(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("bpe_encode", bpe_encode)]
#: A trained network, fingerprints and merges: not for SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
