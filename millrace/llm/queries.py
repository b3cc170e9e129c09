"""One query for each operator over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import round_trip
from millrace.llm.common import in_dir
from millrace.llm.decontaminate import leaks
from millrace.llm.langid import identify
from millrace.llm.lm import score_documents
from millrace.llm.placement import place
from millrace.llm.quality import quality_report
from millrace.llm.simhash import near_duplicates
from millrace.llm.substring_dedup import dedup_word_spans
from millrace.llm.suffix_dedup import dedup_substrings
from millrace.llm.token_store import stored_digests


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(in_dir(sf_dir, "documents"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_word_spans(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(in_dir(sf_dir, "benchmark")))


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digests(documents(spark, sf_dir))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_pair_index_bpe": op3_pair_index_bpe,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_codes": op9_token_codes,
    "op10_lm_scores": op10_lm_scores,
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(0, length(x) // 2 - 99))) AS i FROM d),
w AS (SELECT doc_id, i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 200)) AS h FROM p JOIN d USING (doc_id)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT *, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 100 AS fresh FROM r),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY ALL),
kept AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM span),
cut AS (
  SELECT doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS tail,
         string_agg(substr(x, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a) AS front
  FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(x, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)""",
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(1, len(w) - 18))) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM p JOIN d USING (doc_id)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM h) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS g FROM r, range(20) t(k) GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n, coalesce(len(g), 0) AS gone, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS kept
      FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op7_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
t AS (SELECT doc_id, i, w[i:i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM t) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) s(k) GROUP BY doc_id),
b AS (
  SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR 10 * n_repeat_words > 3 * n_words OR 10 * len(regexp_extract_all(text, '!')) > 3 * n_words
            OR 2 * len(regexp_extract_all(text, '\\p{{Lu}}')) > len(regexp_extract_all(text, '\\p{{L}}'))
            OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) < 7 * n_words) AS kept
FROM f""",
    "op8_decontaminate": """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS v FROM benchmark),
dg AS (SELECT doc_id, i, w[i:i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2))) AS i FROM d)),
bg AS (SELECT item_id, j, v[j:j + 3] AS g FROM (SELECT item_id, v, unnest(range(1, greatest(1, len(v) - 2))) AS j FROM b)),
x AS (SELECT DISTINCT doc_id, item_id, i - j AS diag FROM dg JOIN bg USING (g)),
y AS (SELECT doc_id, item_id, diag, w, v, unnest(range(greatest(1, 1 - diag), least(len(v) - 12, len(w) - diag - 12) + 1)) AS j FROM x JOIN d USING (doc_id) JOIN b USING (item_id)),
z AS (SELECT doc_id, item_id, j + diag - 1 AS lo, list_sum(list_transform(range(0, 13), lambda k: CAST(w[j + diag + k] = v[j + k] AS INT))) AS n FROM y)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS best, CAST(min(lo) AS BIGINT) AS doc_from, CAST(max(lo) + 13 AS BIGINT) AS doc_to FROM z WHERE n >= 11 GROUP BY doc_id, item_id
UNION ALL
SELECT doc_id, item_id, CAST(len(v) AS BIGINT), CAST(min(j) - 1 AS BIGINT), CAST(max(j) - 1 + len(v) AS BIGINT)
FROM (SELECT doc_id, item_id, w, v, unnest(range(1, len(w) - len(v) + 2)) AS j FROM d, b WHERE len(v) BETWEEN 1 AND 12 AND len(w) >= len(v) AND (len(v) > 3 OR len(v) = len(w)))
WHERE w[j:j + len(v) - 1] = v GROUP BY doc_id, item_id, len(v)""",
    "op4_sharding": """
WITH RECURSIVE s AS (
  SELECT i, CAST('0x' || substr(md5('offset:shard-' || i), 1, 8) AS BIGINT) % 2039 AS off, CAST('0x' || substr(md5('skip:shard-' || i), 1, 8) AS BIGINT) % 2038 + 1 AS skip FROM range(16) t(i)),
p AS (SELECT i, list_transform(range(0, 2039), lambda j: CAST((off + j * skip) % 2039 AS INT)) AS prefs FROM s),
fill AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS INT[]) AS slots, list_transform(range(0, 2039), lambda k: false) AS taken, CAST([] AS BIGINT[]) AS owners
  UNION ALL
  SELECT turn + 1, list_append(slots, slot), list_concat(taken[1:slot], [true], taken[slot + 2:]), list_append(owners, i)
  FROM (SELECT f.turn, f.slots, f.taken, f.owners, p.i, list_filter(p.prefs, lambda x: NOT f.taken[x + 1])[1] AS slot FROM fill f JOIN p ON p.i = f.turn % 16 WHERE f.turn < 2039)),
t AS (SELECT unnest(slots) AS slot, unnest(owners) AS shard FROM fill WHERE turn = 2039),
d AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % 2039 AS slot FROM documents)
SELECT doc_id, CAST(slot AS BIGINT) AS slot, CAST(shard AS BIGINT) AS shard FROM d JOIN t USING (slot)""",
}
