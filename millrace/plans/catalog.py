"""Queries for the curation and evaluation operators over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import code, numeric, text
from millrace.operators import compare, curate, score, similarity, split
from millrace.operators.graph import connected_components
from millrace.plans import expected, fixtures
from millrace.plans.scratch import materialize, scratch_path, ship
from millrace.streaming import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def add(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def r6(c: Column) -> Column:
    return F.round(c, 6)


TOKENS_SQL = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"


def grams_sql(source: str, key: str, n: int) -> str:
    return f"(SELECT DISTINCT {key} AS id, array_to_string(w[i:i + {n - 1}], ' ') AS f FROM (SELECT {key}, w, unnest(range(1, greatest(1, len(w) - {n - 2}))) AS i FROM (SELECT {key}, {TOKENS_SQL} AS w FROM {source})))"


# decontamination


def _grams(spark, sf_dir, name, key, n):
    return similarity.word_features(table(spark, sf_dir, name), key, F.col("text"), n)


@query(f"SELECT d.id AS doc_id, b.id AS item_id, count(*) AS k FROM {grams_sql('documents', 'doc_id', 10)} d JOIN {grams_sql('benchmark', 'item_id', 10)} b USING (f) GROUP BY ALL")
def decontam_ngram(spark, sf_dir):
    """Documents and benchmark items with a common ten-gram, and how many."""
    out = similarity.shared_features(_grams(spark, sf_dir, "documents", "doc_id", 10), _grams(spark, sf_dir, "benchmark", "item_id", 10))
    return out.select(F.col("id").alias("doc_id"), F.col("ref").alias("item_id"), "k")


@query("SELECT doc_id, (SELECT max(b.doc_id) FROM documents b WHERE b.source = 'src0' AND sha256(b.text) = sha256(d.text)) AS ref_id FROM documents d WHERE source <> 'src0'")
def decontam_exact(spark, sf_dir):
    """Each document of the other sources with the last document of src0 that has the same text, or null."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("doc_id").alias("pos"), text.fingerprint(F.col("text")).alias("h"))
    rest = docs.where("source <> 'src0'").select("id", "h")
    hits = similarity.exact_matches(rest, docs.where("source = 'src0'"), "h")
    return rest.select("id").join(hits, "id", "left").select(F.col("id").alias("doc_id"), F.col("ref").alias("ref_id"))


def jaccard_sql(a: str, b: str, condition: str = "true") -> str:
    return f"(SELECT x.id AS a, y.id AS b, count(*) AS k FROM {a} x JOIN {b} y ON x.f = y.f AND {condition} GROUP BY ALL)"


_D5, _B5 = grams_sql("documents", "doc_id", 5), grams_sql("benchmark", "item_id", 5)


@query(f"""WITH d AS {_D5}, b AS {_B5}, p AS {jaccard_sql('d', 'b')},
na AS (SELECT id, count(*) AS n FROM d GROUP BY id), nb AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT a AS doc_id, b AS item_id, round(k / (na.n + nb.n - k), 6) AS similarity FROM p JOIN na ON na.id = a JOIN nb ON nb.id = b WHERE k / (na.n + nb.n - k) >= 0.2""")
def decontam_jaccard(spark, sf_dir):
    """Documents and items whose word five-grams have Jaccard similarity of 0.2 or more."""
    sets = lambda name, key: similarity.word_sets(table(spark, sf_dir, name), key, F.col("text"), 5)
    out = similarity.similar_to_reference(sets("documents", "doc_id"), sets("benchmark", "item_id"), 0.2)
    return out.select(F.col("id").alias("doc_id"), F.col("ref").alias("item_id"), r6(F.col("similarity")).alias("similarity"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, CASE WHEN list_cosine_similarity(a.e, b.e) >= 0.45 THEN 'hard' ELSE 'review' END AS band
FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.40""")
def decontam_cosine_bands(spark, sf_dir):
    """Pairs of vectors with cosine of 0.40 or more; hard from 0.45."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = similarity.cosine_bands(v, v, 0.45, 0.40).where("id < ref")
    return out.select(F.col("id").alias("a"), F.col("ref").alias("b"), r6(F.col("cosine")).alias("cosine"), "band")


def _flags(spark, sf_dir):
    ngram = QUERIES["decontam_ngram"](spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat(F.lit("ngram x"), "k", F.lit(" "), "item_id").alias("reason"))
    near = QUERIES["decontam_jaccard"](spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat(F.when(F.col("similarity") < 0.3, "REVIEW jaccard ").otherwise("jaccard "), "item_id").alias("reason"))
    return ngram.unionByName(near)


_FLAGS_SQL = f"""flags AS (SELECT doc_id AS id, 'ngram x' || k || ' ' || item_id AS reason FROM ({ORACLE_SQL['decontam_ngram']})
UNION ALL SELECT doc_id, CASE WHEN similarity < 0.3 THEN 'REVIEW jaccard ' ELSE 'jaccard ' END || item_id FROM ({ORACLE_SQL['decontam_jaccard']}))"""


@query(f"WITH {_FLAGS_SQL} SELECT id AS doc_id, bool_or(NOT starts_with(reason, 'REVIEW')) AS hard, count(*) AS n_reasons, array_to_string(list_sort(list(reason))[1:3], '; ') AS reasons FROM flags GROUP BY id")
def decontam_reasons(spark, sf_dir):
    """Flagged documents with their first three reasons; hard unless all are for review."""
    out = similarity.reasons(_flags(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "hard", "n_reasons", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""WITH {_FLAGS_SQL}, h AS (SELECT DISTINCT id FROM flags WHERE NOT starts_with(reason, 'REVIEW'))
SELECT (SELECT count(*) FROM documents) AS candidates, (SELECT count(*) FROM h) AS removed, count(*) AS kept, count(DISTINCT source) AS sources FROM documents WHERE doc_id NOT IN (SELECT id FROM h)""")
def decontam_summary(spark, sf_dir):
    """Candidates, removed, kept, and sources among the kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    kept = similarity.without_hard(docs, "doc_id", _flags(spark, sf_dir))
    left = kept.agg(F.count("*").alias("kept"), F.countDistinct("source").alias("sources"))
    return docs.agg(F.count("*").alias("candidates")).crossJoin(left).select("candidates", (F.col("candidates") - F.col("kept")).alias("removed"), "kept", "sources")


# duplicates, families, splits


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def dup_exact_first(spark, sf_dir):
    """The first document of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))


_PAIRS_SQL = f"""d5 AS {_D5}, n5 AS (SELECT id, count(*) AS n FROM d5 GROUP BY id),
near AS (SELECT a, b FROM {jaccard_sql('d5', 'd5', 'x.id < y.id')} JOIN n5 p ON p.id = a JOIN n5 q ON q.id = b WHERE k / (p.n + q.n - k) >= 0.85),
exact AS (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON sha256(x.text) = sha256(y.text) AND x.doc_id < y.doc_id),
edges AS (SELECT a, b, min(l) AS l FROM (SELECT a, b, 0 AS l FROM exact UNION ALL SELECT a, b, 1 FROM near) GROUP BY a, b)"""


def _edges(spark, sf_dir):
    """Pairs of documents: each copy with the first of its text, first texts with one another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text.fingerprint(F.col("text")).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    exact = materialize(docs.drop("text").join(first, "h").where("a <> doc_id").select("a", F.col("doc_id").alias("b")), "copies")
    # ids of copies travel to the texts, not the texts to the ids
    copies = exact.select(F.col("b").alias("doc_id")).distinct().join(first.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")
    firsts = docs.where("doc_id IS NOT NULL").join(similarity.few(copies), "doc_id", "left_anti")
    near = similarity.similar_pairs(similarity.word_sets(firsts, "doc_id", F.col("text"), 5), 0.85)
    return similarity.first_layer(("exact", exact), ("jaccard", near))


@query(f"""WITH {_PAIRS_SQL}, f AS (SELECT min(doc_id) AS id FROM documents GROUP BY sha256(text)),
star AS (SELECT f.id AS a, d.doc_id AS b FROM documents d JOIN (SELECT min(doc_id) AS id, sha256(text) AS h FROM documents GROUP BY 2) f ON f.h = sha256(d.text) WHERE d.doc_id <> f.id)
SELECT a, b, 'exact' AS layer FROM star UNION ALL SELECT a, b, 'jaccard' FROM edges WHERE l = 1 AND a IN (SELECT id FROM f) AND b IN (SELECT id FROM f)""")
def dup_pairs_priority(spark, sf_dir):
    """Near-duplicate pairs by the first layer that has them: copies with their first, and first texts of Jaccard 0.85 or more."""
    return _edges(spark, sf_dir)


_COMPONENTS_SQL = f"""WITH RECURSIVE {_PAIRS_SQL}, arcs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, arcs.b FROM reach JOIN arcs ON arcs.a = reach.r),
fam AS (SELECT id, min(r) AS family FROM reach GROUP BY id)"""


def _families(spark, sf_dir):
    return similarity.groups(table(spark, sf_dir, "documents"), "doc_id", _edges(spark, sf_dir))


@query(f"{_COMPONENTS_SQL} SELECT id AS doc_id, family, id = family AS kept FROM fam")
def dup_clusters(spark, sf_dir):
    """Each document with the least id of its cluster, which is the one kept."""
    return _families(spark, sf_dir).select(F.col("id").alias("doc_id"), "family", (F.col("id") == F.col("family")).alias("kept"))


@query(f"""WITH RECURSIVE {_PAIRS_SQL}, d AS (SELECT doc_id, source || ':' || doc_id // 100 AS owner FROM documents), own AS (SELECT min(doc_id) OVER (PARTITION BY owner) AS a, doc_id AS b FROM d),
e AS (SELECT a, b FROM edges UNION SELECT a, b FROM own), arcs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT min(doc_id) AS id, min(doc_id) AS r, owner FROM d GROUP BY owner UNION SELECT id, arcs.b, owner FROM reach JOIN arcs ON arcs.a = reach.r),
fam AS (SELECT owner, min(r) AS family FROM reach GROUP BY owner)
SELECT doc_id, family FROM d JOIN fam USING (owner)""")
def families(spark, sf_dir):
    """Families by common owner (a source and a hundred of ids) or similar text."""
    docs = table(spark, sf_dir, "documents")
    owner = F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / 100).cast("string"))
    edges = _edges(spark, sf_dir).select("a", "b").unionByName(similarity.same_owner_edges(docs, "doc_id", owner))
    return similarity.groups(docs, "doc_id", edges).select(F.col("id").alias("doc_id"), "family")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def source_cap(spark, sf_dir):
    """The first ten documents of each source."""
    return split.cap_per_key(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10)


@query(f"""{_COMPONENTS_SQL}, s AS (SELECT family, count(*) AS n, sha256('7:' || family) AS d FROM fam GROUP BY family),
t AS (SELECT family, coalesce(sum(n) OVER (ORDER BY d, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100 AS test FROM s)
SELECT id AS doc_id, family, CASE WHEN test THEN 'test' ELSE 'dev' END AS split FROM fam JOIN t USING (family)""")
def family_split(spark, sf_dir):
    """Whole families into a test split of 100 documents or a few more, the others into dev."""
    return split.family_split(_families(spark, sf_dir), "7", 100).withColumnRenamed("id", "doc_id")


@query(f"""{_COMPONENTS_SQL}, s AS (SELECT DISTINCT family, sha256('8:' || family) AS d FROM fam),
t AS (SELECT family, row_number() OVER (ORDER BY d, family) <= greatest(1, round_even(count(*) OVER () * 0.05, 0)) AS v FROM s)
SELECT id AS doc_id, family, CASE WHEN v THEN 'valid' ELSE 'train' END AS split FROM fam JOIN t USING (family)""")
def valid_split(spark, sf_dir):
    """Five percent of the families, half rounded to even, for validation."""
    return split.valid_split(_families(spark, sf_dir), "8").withColumnRenamed("id", "doc_id")


@query("""WITH s AS (SELECT doc_id, n_chars, (4 * (row_number() OVER (ORDER BY n_chars, doc_id) - 1) + 3) // count(*) OVER () AS stratum FROM documents)
SELECT doc_id, n_chars, stratum FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY sha256('9:' || doc_id)) <= 10""")
def strata_sample(spark, sf_dir):
    """Ten documents of each quarter by length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return split.stratified_sample(split.quantile_strata(docs, "doc_id", "n_chars"), "doc_id", "9", 10)


@query("SELECT doc_id FROM documents ORDER BY sha256('5:' || doc_id), doc_id LIMIT 50")
def seeded_draw(spark, sf_dir):
    """Fifty documents in the order of a seeded hash."""
    return split.drawn(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "5", 50)


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) % 7 = 0")
def every_nth(spark, sf_dir):
    """Every seventh document."""
    return split.every_nth(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


# filters and derivations


@query("SELECT DISTINCT source, lang FROM documents ORDER BY source, lang")
def notice_sources(spark, sf_dir):
    """Distinct sources with their languages."""
    return table(spark, sf_dir, "documents").select("source", "lang").distinct().orderBy("source", "lang")


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) >= 0.95 * greatest(1, length(text)) AS english FROM documents")
def ascii_filter(spark, sf_dir):
    """Whether 95 % of a document's characters are ASCII."""
    return table(spark, sf_dir, "documents").select("doc_id", text.is_english(F.col("text")).alias("english"))


_TEST_SQL = "list_has_any(string_split(lower(url), '/'), [{}]) OR starts_with(string_split(lower(url), '/')[-1], 'test_') OR ends_with(lower(url), '_test.py')".format(", ".join(f"'{p}'" for p in text.TEST_PARTS))


_URL_SQL = "(SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/tests/x.py' WHEN 1 THEN '/a/test_b.py' WHEN 2 THEN '/a/b_test.py' WHEN 3 THEN '/attest/b.py' ELSE '' END AS url FROM pages)"


@query(f"SELECT page_id, {_TEST_SQL} OR string_split(lower(url), '/')[-1] = 'conftest.py' AS test_code, CASE WHEN len(string_split(rtrim(url, '/'), '/')) > 4 THEN string_split(rtrim(url, '/'), '/')[4] ELSE url END AS owner FROM {_URL_SQL}")
def path_filter(spark, sf_dir):
    """Whether a file under a page's address looks like test code, and its owner part."""
    q = F.col("page_id") % 5
    end = F.when(q == 0, "/tests/x.py").when(q == 1, "/a/test_b.py").when(q == 2, "/a/b_test.py").when(q == 3, "/attest/b.py").otherwise("")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", end).alias("url"))
    return pages.select("page_id", text.is_test_code(F.col("url")).alias("test_code"), text.owner(F.col("url")).alias("owner"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01'")
def date_floor(spark, sf_dir):
    """Orders of a day from 1997 on, by the first ten characters of the date."""
    return table(spark, sf_dir, "orders").where(text.since(F.col("o_orderdate").cast("string"), "1997-01-01")).select("o_orderkey")


@query("""WITH d AS (SELECT doc_id, source, sha256(text) AS h FROM documents)
SELECT doc_id, h FROM d WHERE source <> 'src0' AND h NOT IN (SELECT h FROM d WHERE source = 'src0') QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1""")
def seen_anti(spark, sf_dir):
    """First documents of texts that source src0 doesn't have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text.fingerprint(F.col("text")).alias("h"), F.col("doc_id").alias("pos"))
    return split.unseen(docs.where("source <> 'src0'"), docs.where("source = 'src0'"), "h").select("doc_id", "h")


@query(r"""SELECT doc_id, regexp_replace(source || CASE WHEN doc_id % 3 = 0 THEN '_II' WHEN doc_id % 3 = 1 THEN '_VIII' ELSE '' END, '_(I|II|III|IV|V|VI|VII|VIII|IX|X)$', '') AS family, source || ':' || lang || '::' || doc_id AS id FROM documents""")
def derived_keys(spark, sf_dir):
    """Family keys without their roman number, and composite row ids."""
    variant = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "_II").when(F.col("doc_id") % 3 == 1, "_VIII").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.family_key(variant).alias("family"), text.row_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


# arms from the event log: a user is an item, an event type an arm, a purchase-sized value a valid suite

_ARM_SQL = "arms AS (SELECT event_type AS arm, user_id AS id, event_id, value, value > 10 AS valid FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1)"


def _arms(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.col("user_id").alias("id"), "event_id", "value")
    return curate.last_wins(log, "arm", "id", pos="event_id").withColumn("valid", F.col("value") > 10)


@query(f"WITH {_ARM_SQL} SELECT arm, id, event_id, value FROM arms")
def arm_last_wins(spark, sf_dir):
    """The last row of each arm and item."""
    return _arms(spark, sf_dir).select("arm", "id", "event_id", "value")


def _runs(spark, sf_dir):
    """Runs from events: a user and an hour make a mutant, or the reference at hour 0; the events are its tests."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 6).alias("h"), "event_id", "value")
    test = F.struct(F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("name"), F.when(F.col("value") > 5 * F.col("h"), "passed").otherwise("failed").alias("outcome"))
    runs = e.groupBy("id", "h").agg(F.min("event_id").alias("e"), F.transform(F.array_sort(F.collect_list(F.struct("event_id", test.alias("t")))), lambda x: x["t"]).alias("tests"))
    status = F.when(F.col("e") % 7 == 0, "timeout").when(F.col("e") % 11 == 0, "crash").otherwise("ok")
    return runs.select("id", "h", status.alias("status"), "tests")


def _scores(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    mutants = runs.where("h > 0").select("id", F.concat(F.lit("m"), F.col("h").cast("string")).alias("mutant"), (F.col("h") == 5).alias("equivalent"), "status", "tests")
    return score.suite_scores(runs.where("h = 0").select("id", "status", "tests"), mutants)


_SCORES_SQL = """e AS (SELECT user_id AS id, event_id % 6 AS h, event_id, value > 5 * (event_id % 6) AS ok FROM events),
r AS (SELECT id, h, min(event_id) AS e0, count(*) AS n, count(*) FILTER (NOT ok) AS bad FROM e GROUP BY id, h),
s AS (SELECT *, CASE WHEN e0 % 7 = 0 THEN 'timeout' WHEN e0 % 11 = 0 THEN 'crash' ELSE 'ok' END AS status FROM r),
m AS (SELECT id, count(*) AS total, count(*) FILTER (h < 5) AS live, count(*) FILTER (h < 5 AND (status <> 'ok' OR bad > 0)) AS killed FROM s WHERE h > 0 GROUP BY id),
q AS (SELECT id, CASE WHEN status = 'timeout' THEN 'reference_timeout' WHEN status = 'crash' THEN 'reference_crash' WHEN n = 0 THEN 'no_tests' WHEN bad > 0 THEN 'false_failure' END AS reason, n, bad FROM s WHERE h = 0),
scores AS (SELECT id, reason IS NULL AS valid, reason AS invalid_reason, n AS n_tests, bad AS false_failures, coalesce(total, 0) AS mutants_total, coalesce(total - live, 0) AS mutants_equivalent,
  CASE WHEN reason IS NULL AND live > 0 THEN killed ELSE 0 END AS mutants_killed, CASE WHEN reason IS NULL AND live > 0 THEN killed / live END AS mutation_score FROM q LEFT JOIN m USING (id))"""


@query(f"WITH {_SCORES_SQL} SELECT id, valid, invalid_reason, n_tests, false_failures, mutants_total, mutants_equivalent, mutants_killed, round(mutation_score, 6) AS mutation_score FROM scores")
def suite_score(spark, sf_dir):
    """Suites scored from their runs on the reference and on mutants."""
    return _scores(spark, sf_dir).drop("kills").withColumn("mutation_score", r6(F.col("mutation_score")))


@query(f"""WITH {_SCORES_SQL} SELECT count(*) AS suites, count(*) FILTER (valid) AS valid, round(avg(CAST(valid AS INT)), 6) AS validity_rate, count(*) FILTER (invalid_reason = 'false_failure') AS false_failure_suites,
CAST(coalesce(sum(mutants_killed) FILTER (valid AND mutation_score IS NOT NULL), 0) AS BIGINT) AS mutants_killed, CAST(coalesce(sum(mutants_total - mutants_equivalent) FILTER (valid AND mutation_score IS NOT NULL), 0) AS BIGINT) AS mutants_live_total,
round(coalesce(avg(mutation_score) FILTER (valid), 0), 6) AS mean_mutation_score, round(coalesce(avg(coalesce(mutation_score, 0)), 0), 6) AS mean_grounded_score FROM scores""")
def headline(spark, sf_dir):
    """The headline table over all suites."""
    out = score.headline(_scores(spark, sf_dir))
    return out.select(*[r6(F.col(c)).alias(c) if c in ("validity_rate", "mean_mutation_score", "mean_grounded_score") else c for c in out.columns])


@query("""WITH r AS (SELECT doc_id, source, n_chars > 100 AS parsed, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(*) AS n_all, count(*) FILTER (parsed AND quality IS NOT NULL) AS n_scored,
round(coalesce(count(*) FILTER (parsed AND quality = 1) / nullif(count(*) FILTER (parsed AND quality IS NOT NULL), 0), 0), 6) AS validity,
round(coalesce(avg((doc_id % 10) / 10) FILTER (parsed AND quality = 1), 0), 6) AS mutation_score,
round(avg(CASE WHEN parsed AND toxic = 0 THEN 1 ELSE 0 END), 6) AS grounded_validity,
round(avg(CASE WHEN parsed AND toxic = 0 THEN (doc_id % 7) / 7 ELSE 0 END), 6) AS grounded_score,
CAST(coalesce(sum(toxic), 0) AS BIGINT) AS replaced FROM r GROUP BY source""")
def mixed_denominators(spark, sf_dir):
    """Unaided rates over scored records, grounded ones over all, by source; labels stand for validity."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    s = F.when(F.col("quality").isNotNull(), F.struct((F.col("quality") == 1).alias("valid"), ((F.col("doc_id") % 10) / 10).alias("mutation_score")))
    g = F.when(F.col("toxic").isNotNull(), F.struct(F.struct((F.col("toxic") == 0).alias("valid"), ((F.col("doc_id") % 7) / 7).alias("mutation_score")).alias("score"), F.struct(F.col("toxic").alias("replaced")).alias("oracle")))
    out = score.record_table(docs.select("source", (F.col("n_chars") > 100).alias("parsed"), s.alias("score"), g.alias("grounded")), ["source"])
    return out.select(*[r6(F.col(c)).alias(c) if c in ("validity", "mutation_score", "grounded_validity", "grounded_score") else c for c in out.columns])


@query("""SELECT count(*) AS rows, count(*) FILTER (n_chars > 100) AS long_enough, count(*) FILTER (n_chars > 100 AND quality IS NOT NULL) AS labelled, count(*) FILTER (n_chars > 100 AND quality = 1) AS good,
count(*) FILTER (n_chars > 100 AND quality = 1 AND toxic = 0) AS clean FROM documents LEFT JOIN labels USING (doc_id)""")
def funnel_yield(spark, sf_dir):
    """How many documents reach each stage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return curate.funnel(docs, long_enough=F.col("n_chars") > 100, labelled=F.col("quality").isNotNull(), good=F.col("quality") == 1, clean=F.col("toxic") == 0)


@query("SELECT lang AS key, count(*) AS seen, count(*) FILTER (quality = 1) AS kept FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def kept_by_subset(spark, sf_dir):
    """Documents seen and kept by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return curate.counts_by(docs, F.col("lang"), F.coalesce(F.col("quality") == 1, F.lit(False)))


@query("""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[aeiou]')) AS key FROM documents) SELECT key, count(*) AS total FROM w GROUP BY key""")
def map_sum(spark, sf_dir):
    """Key-wise sum of a map of vowel counts in every document."""
    vowels = F.create_map(*[x for v in "aeiou" for x in (F.lit(v), F.regexp_count(F.lower("text"), F.lit(v)).cast("long"))])
    return curate.map_sum(table(spark, sf_dir, "documents").select(vowels.alias("m")), "m")


_CANDIDATES_SQL = """c AS (SELECT event_id AS pos, user_id AS id, event_id % 9 <> 0 AS parsed, event_type = 'purchase' OR event_id % 4 = 0 AS valid_before, event_id % 3 <> 0 AS valid,
CAST(floor(value) AS BIGINT) % 8 AS kills, (CAST(floor(value) AS BIGINT) % 8) / 8 AS mutation_score, event_id % 5 + 1 AS n_tests, event_id % 1300 AS n_tokens FROM events)"""


def _candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kills = F.floor("value") % 8
    return e.select(
        F.col("event_id").alias("pos"),
        F.col("user_id").alias("id"),
        (F.col("event_id") % 9 != 0).alias("parsed"),
        ((F.col("event_type") == "purchase") | (F.col("event_id") % 4 == 0)).alias("valid_before"),
        (F.col("event_id") % 3 != 0).alias("valid"),
        kills.alias("kills"),
        (kills / 8).alias("mutation_score"),
        (F.col("event_id") % 5 + 1).alias("n_tests"),
        (F.col("event_id") % 1300).alias("n_tokens"),
        F.concat(F.lit("suite "), F.col("event_id").cast("string")).alias("suite_unaided"),
    )


@query(f"WITH {_CANDIDATES_SQL} SELECT id, pos, mutation_score, n_tests FROM c WHERE valid AND kills > 0 AND n_tokens <= 1024 QUALIFY row_number() OVER (PARTITION BY id ORDER BY mutation_score DESC, n_tests, pos) = 1")
def best_of_k(spark, sf_dir):
    """The best candidate of each item."""
    return curate.best_per_item(_candidates(spark, sf_dir)).select("id", "pos", "mutation_score", "n_tests")


@query(f"WITH {_CANDIDATES_SQL} SELECT id, pos, mutation_score FROM c WHERE parsed AND valid_before AND kills > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY mutation_score DESC, pos) = 1")
def best_unaided(spark, sf_dir):
    """The best candidate of each item before repair."""
    return curate.best_unaided(_candidates(spark, sf_dir)).select("id", "pos", "mutation_score")


@query("""WITH g AS (SELECT user_id AS id, min(event_id) FILTER (value > 50) AS f, max(event_id) AS l, sum(event_id % 10) AS tokens, round(sum(value), 6) AS seconds FROM events GROUP BY user_id)
SELECT id, coalesce(f, l) AS pos, f IS NOT NULL AS valid, CAST(tokens AS BIGINT) AS tokens, seconds FROM g""")
def best_of_first_valid(spark, sf_dir):
    """The first valid sample of each item, else its last."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), (F.col("value") > 50).alias("valid"), (F.col("event_id") % 10).alias("tokens"), F.col("value").alias("seconds"))
    return curate.best_of_first_valid(e).withColumn("seconds", r6(F.col("seconds")))


_UNAIDED_SQL = f"""{_CANDIDATES_SQL}, own AS (SELECT * FROM c WHERE parsed AND n_tokens <= 1024),
ch AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mutation_score DESC, n_tests, pos) AS rn FROM own WHERE valid_before AND kills > 0),
rj AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY valid AND kills > 0 DESC, kills DESC, n_tests DESC, pos) AS rn FROM own WHERE NOT valid_before)"""
_GROUNDED_SQL = f"""{_CANDIDATES_SQL}, own AS (SELECT *, CASE WHEN NOT valid THEN 0 WHEN kills = 0 THEN 1 ELSE 2 END AS kind FROM c WHERE parsed AND n_tokens <= 1024),
ch AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kills DESC, n_tests, pos) AS rn FROM own WHERE valid AND kills > 0),
rj AS (SELECT own.*, row_number() OVER (PARTITION BY own.id ORDER BY own.kind, own.kills, own.pos) AS rn FROM own JOIN ch t ON t.id = own.id AND t.rn = 1 WHERE own.pos <> t.pos AND (own.kind < 2 OR own.kills <= t.kills - 2))"""
_PAIR_COLUMNS = "SELECT ch.id, ch.rn AS pair, ch.pos AS chosen_pos, rj.pos AS rejected_pos FROM ch JOIN rj USING (id, rn) WHERE rn <= 2"


@query(f"WITH {_UNAIDED_SQL} {_PAIR_COLUMNS}")
def preference_pairs(spark, sf_dir):
    """Two pairs of each item at most: best valid over hardest invalid."""
    return curate.unaided_pairs(_candidates(spark, sf_dir)).select("id", F.col("pair").cast("long").alias("pair"), "chosen_pos", "rejected_pos")


@query(f"WITH {_GROUNDED_SQL} {_PAIR_COLUMNS} AND ch.pos <> rj.pos")
def preference_pairs_grounded(spark, sf_dir):
    """Pairs after repair: best killing over invalid, idle or weak."""
    return curate.grounded_pairs(_candidates(spark, sf_dir)).select("id", F.col("pair").cast("long").alias("pair"), "chosen_pos", "rejected_pos")


@query(f"""WITH {_GROUNDED_SQL}, p AS (SELECT ch.id, ch.kills AS ck, rj.kills AS rk, rj.kind FROM ch JOIN rj USING (id, rn) WHERE rn <= 2 AND ch.pos <> rj.pos)
SELECT (SELECT count(DISTINCT id) FROM c) AS functions, count(DISTINCT id) AS functions_with_pairs, count(*) AS pairs, count(*) FILTER (kind = 0) AS rejected_invalid, count(*) FILTER (kind = 1) AS rejected_idle, count(*) FILTER (kind = 2) AS rejected_weak,
CAST(coalesce(sum(ck), 0) AS BIGINT) AS chosen_kills, CAST(coalesce(sum(rk), 0) AS BIGINT) AS rejected_kills FROM p""")
def preference_stats(spark, sf_dir):
    """Counts over the pairs."""
    rows = _candidates(spark, sf_dir)
    return curate.pair_stats(curate.grounded_pairs(rows), rows)


@query("SELECT doc_id AS id, quality, n_chars FROM documents JOIN labels USING (doc_id) ORDER BY quality DESC, n_chars, doc_id LIMIT 40")
def topk_curation(spark, sf_dir):
    """The forty best documents: a top-k report by quality, then length."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n_tests")).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("mutation_score")), "id")
    return curate.top_quality(docs, 40).select("id", F.col("mutation_score").alias("quality"), F.col("n_tests").alias("n_chars"))


@query("""WITH k AS (SELECT DISTINCT user_id AS id, event_type AS arm, CAST(floor(value) AS BIGINT) % 12 AS m FROM events)
SELECT id, count(*) AS n_gained, min(m) AS first_gained FROM (SELECT id, m FROM k WHERE arm = 'view' AND id IN (SELECT id FROM k WHERE arm = 'click') EXCEPT SELECT id, m FROM k WHERE arm = 'click') GROUP BY id""")
def kill_set_difference(spark, sf_dir):
    """Mutants that only one arm kills, by item."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", (F.floor("value") % 12).alias("m"))
    arm = lambda a: e.where(F.col("event_type") == a).groupBy("id").agg(F.map_from_arrays(F.array_distinct(F.collect_list("m")), F.transform(F.array_distinct(F.collect_list("m")), lambda x: F.array(F.lit("t")))).alias("kills")).withColumn("valid", F.lit(True))
    return score.kill_difference(arm("click"), arm("view")).select("id", F.size("gained").cast("long").alias("n_gained"), F.array_min("gained").alias("first_gained"))


@query(f"""WITH {_CANDIDATES_SQL}, l AS (SELECT id, count(*) AS n FROM c GROUP BY id), s AS (SELECT id, (4 * (row_number() OVER (ORDER BY n, id) - 1) + 3) // count(*) OVER () AS stratum FROM l),
k AS (SELECT id, bool_or(valid_before AND kills > 5) AS a, bool_or(valid AND kills > 6) AS b FROM c GROUP BY id)
SELECT stratum, count(*) AS functions, count(*) FILTER (a) AS covered_a, count(*) FILTER (b) AS covered_b FROM s JOIN k USING (id) GROUP BY stratum""")
def coverage_by_stratum(spark, sf_dir):
    """Items with a valid, killing candidate, before and after repair, by quarter."""
    c = _candidates(spark, sf_dir)
    strata = split.quantile_strata(c.groupBy("id").agg(F.count("*").alias("n")), "id", "n")
    return score.coverage(c, strata, F.col("valid_before") & (F.col("kills") > 5), F.col("valid") & (F.col("kills") > 6))


@query("""SELECT event_type AS key, round(100 * sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY event_type""")
def percent_shares(spark, sf_dir):
    """Each arm's share of the total value, in percent."""
    sums = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.sum("value").alias("v"))
    return score.percent_shares(sums, "key", "v").select("key", r6(F.col("share")).alias("share"))


# paired statistics


def _pair(spark, sf_dir):
    arms = _arms(spark, sf_dir)
    record = lambda a: arms.where(F.col("arm") == a).select("id", F.lit(True).alias("parsed"), F.struct("valid", (F.col("value") / 100).alias("mutation_score")).alias("score"), F.struct(F.struct("valid", (F.col("value") / 100).alias("mutation_score")).alias("score")).alias("grounded"))
    return record("click"), record("view")


_PAIR_SQL = f"{_ARM_SQL}, p AS (SELECT a.id, a.valid AS va, b.valid AS vb, a.value / 100 AS sa, b.value / 100 AS sb FROM arms a JOIN arms b ON a.id = b.id AND a.arm = 'click' AND b.arm = 'view')"


@query(f"""WITH RECURSIVE {_PAIR_SQL}, k AS (SELECT count(*) FILTER (va AND NOT vb) AS b, count(*) FILTER (vb AND NOT va) AS c FROM p),
t AS (SELECT 0 AS i, b + c AS n, least(b, c) AS k, pow(0.5, b + c) AS term, pow(0.5, b + c) AS s FROM k UNION ALL SELECT i + 1, n, k, term * (n - i) / (i + 1), s + term * (n - i) / (i + 1) FROM t WHERE i < k)
SELECT b AS only_a, c AS only_b, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT max(s) FROM t)) END, 6) AS p FROM k""")
def mcnemar(spark, sf_dir):
    """Exact McNemar test of two arms."""
    a, b = _pair(spark, sf_dir)
    both = compare.paired(a, b).agg(F.count_if(F.col("va") & ~F.col("vb")).alias("only_a"), F.count_if(F.col("vb") & ~F.col("va")).alias("only_b"))
    return both.withColumn("p", r6(numeric.mcnemar_exact(F.col("only_a"), F.col("only_b"))))


@query(f"WITH {_PAIR_SQL} SELECT count(*) AS n, round(avg(sa - sb), 6) AS mean FROM p")
def paired_difference(spark, sf_dir):
    """Mean score difference of two arms on their common items."""
    a, b = _pair(spark, sf_dir)
    d = compare.paired(a.withColumn("score", F.struct(F.lit(True).alias("valid"), F.col("score.mutation_score"))), b.withColumn("score", F.struct(F.lit(True).alias("valid"), F.col("score.mutation_score"))))
    return d.agg(F.count("*").alias("n"), r6(F.avg(F.col("sa") - F.col("sb"))).alias("mean"))


def bootstrap_sql(name: str, source: str) -> str:
    """A one-row table `name` (n, mean, lo, hi) of the column d of `source`, in the order of id."""
    return f"""{name}_i AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, d FROM {source}), {name}_n AS (SELECT count(*) AS n, avg(d) AS mean FROM {name}_i),
{name}_m AS (SELECT x.i // x.n AS rep, sum(d) / max(x.n) AS mean FROM (SELECT unnest(range(2000 * n)) AS i, n FROM {name}_n) x JOIN {name}_i y ON y.k = CAST('0x' || substr(md5('0:' || x.i), 1, 8) AS BIGINT) % x.n GROUP BY 1),
{name} AS (SELECT n, mean, (SELECT list_sort(list(mean))[51] FROM {name}_m) AS lo, (SELECT list_sort(list(mean))[1951] FROM {name}_m) AS hi FROM {name}_n)"""


@query(f"WITH {_PAIR_SQL}, d AS (SELECT id, CASE WHEN va THEN sa ELSE 0 END - CASE WHEN vb THEN sb ELSE 0 END AS d FROM p), {bootstrap_sql('b', 'd')} SELECT n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b")
def paired_bootstrap(spark, sf_dir):
    """Mean difference with a bootstrap interval."""
    a, b = _pair(spark, sf_dir)
    d = compare.paired(a, b).select("id", (F.coalesce("sa", F.lit(0.0)) - F.coalesce("sb", F.lit(0.0))).alias("d"))
    out = compare.paired_bootstrap(d)
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("mean", "lo", "hi")])


_BOOT_COLUMNS = ", ".join(f"{t}.n AS {t}_n, round({t}.mean, 6) AS {t}_mean, round({t}.lo, 6) AS {t}_lo, round({t}.hi, 6) AS {t}_hi" for t in ("validity_diff", "score_diff", "grounded_diff"))


@query(f"""WITH RECURSIVE {_PAIR_SQL}, k AS (SELECT count(*) FILTER (va AND NOT vb) AS b, count(*) FILTER (vb AND NOT va) AS c FROM p),
t AS (SELECT 0 AS i, b + c AS n, least(b, c) AS k, pow(0.5, b + c) AS term, pow(0.5, b + c) AS s FROM k UNION ALL SELECT i + 1, n, k, term * (n - i) / (i + 1), s + term * (n - i) / (i + 1) FROM t WHERE i < k),
dv AS (SELECT id, CAST(va AS INT) - CAST(vb AS INT) AS d FROM p), ds AS (SELECT id, sa - sb AS d FROM p WHERE va AND vb), dg AS (SELECT id, CASE WHEN va THEN sa ELSE 0 END - CASE WHEN vb THEN sb ELSE 0 END AS d FROM p),
{bootstrap_sql('validity_diff', 'dv')}, {bootstrap_sql('score_diff', 'ds')}, {bootstrap_sql('grounded_diff', 'dg')},
head AS (SELECT round(avg(CAST(va AS INT)), 6) AS validity_a, round(avg(CAST(vb AS INT)), 6) AS validity_b, count(*) FILTER (va AND vb) AS both_valid, round(avg(CASE WHEN va THEN sa ELSE 0 END), 6) AS grounded_a, round(avg(CASE WHEN vb THEN sb ELSE 0 END), 6) AS grounded_b FROM p)
SELECT head.*, k.b AS only_a, k.c AS only_b, round(CASE WHEN k.b + k.c = 0 THEN 1 ELSE least(1, 2 * (SELECT max(s) FROM t)) END, 6) AS mcnemar_p, {_BOOT_COLUMNS} FROM head, k, validity_diff, score_diff, grounded_diff""")
def compare_arms(spark, sf_dir):
    """The whole comparison of two arms, grounded."""
    a, b = _pair(spark, sf_dir)
    out = compare.compare_arms(a, b, grounded=True)
    return out.select(*[r6(F.col(c)).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("""WITH f AS (SELECT user_id AS id, arg_min(value, event_id) > 10 AS before, arg_max(value, event_id) > 10 AS after FROM events GROUP BY user_id) SELECT id, before, after FROM f WHERE before <> after""")
def validity_drift(spark, sf_dir):
    """Items whose first and last score differ in validity."""
    e = table(spark, sf_dir, "events")
    side = lambda f: e.groupBy(F.col("user_id").alias("id")).agg(f("value", "event_id").alias("v")).select("id", F.struct((F.col("v") > 10).alias("valid")).alias("score"))
    return compare.drifted(side(F.min_by), side(F.max_by))


@query("""WITH c AS (SELECT user_id AS step, avg(CAST(value > 20 AS INT)) AS validity, round(avg(value), 6) AS mutation_score FROM events GROUP BY user_id)
SELECT step, round(validity, 6) AS validity, mutation_score FROM c ORDER BY c.validity DESC, c.mutation_score DESC, step LIMIT 1""")
def best_checkpoint(spark, sf_dir):
    """The step of best validity, then score."""
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("step")).agg(F.avg((F.col("value") > 20).cast("int")).alias("validity"), r6(F.avg("value")).alias("mutation_score"))
    return curate.best_checkpoint(c, False).select("step", r6(F.col("validity")).alias("validity"), "mutation_score")


@query("""SELECT step, round(CASE WHEN step < 30 THEN 2e-4 * step / 30 ELSE 1e-6 + (2e-4 - 1e-6) * 0.5 * (1 + cos(pi() * least(step - 30, 400) / 400)) END, 12) AS rate FROM range(500) t(step)""")
def lr_schedule(spark, sf_dir):
    """Learning rates of a warm-up and a cosine fall."""
    return spark.range(500).select(F.col("id").alias("step"), F.round(numeric.learning_rate(F.col("id"), 2e-4, 30, 400, 1e-6), 12).alias("rate"))


# lookups, sets of rows, caps


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def pool_lookup(spark, sf_dir):
    """Each order with its customer; an order without one would be an error."""
    pool = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return split.looked_up(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), pool, "o_custkey").select("o_orderkey", "c_name")


@query("SELECT doc_id FROM documents WHERE octet_length(encode(text)) <= 2000 AND len(string_split(text, chr(10))) <= 5")
def size_caps(spark, sf_dir):
    """Documents of at most 2000 bytes and five lines."""
    return table(spark, sf_dir, "documents").where(text.within_size(F.col("text"), 2000, 5)).select("doc_id")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS span FROM documents")
def line_spans(spark, sf_dir):
    """Lines from the first to the last of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", text.line_span(F.lit(1), F.size(F.split("text", "\n"))).cast("long").alias("span"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 25")
def first_rows(spark, sf_dir):
    """The first 25 documents in a stated order: a head."""
    return split.head(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 25, "n_chars", "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (3, 5, 8)")
def without_exemplars(spark, sf_dir):
    """Documents that aren't examples of the prompt."""
    return split.without_exemplars(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", [3, 5, 8])


@query("SELECT user_id AS id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE value > 90 UNION SELECT item_id FROM benchmark")
def exclusion_union(spark, sf_dir):
    """Ids that any of three sources excludes."""
    e = table(spark, sf_dir, "events")
    return split.all_of(e.where("event_type = 'click'").select(F.col("user_id").alias("id")), e.where("value > 90").select(F.col("user_id").alias("id")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")))


@query("SELECT id, count(*) AS n FROM (SELECT user_id AS id FROM events WHERE value > 40 UNION ALL SELECT user_id FROM events WHERE value < 60) GROUP BY id")
def appended_runs(spark, sf_dir):
    """Rows of two runs, repeats included, counted by id."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "value")
    return split.appended(e.where("value > 40"), e.where("value < 60")).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY sha256('4:' || doc_id), doc_id LIMIT 30)")
def capped_draw(spark, sf_dir):
    """Thirty English documents by hash, back in their own order."""
    return split.capped_draw(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "4", 30, "doc_id")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def most_common(spark, sf_dir):
    """Languages, the commonest first."""
    return score.most_common(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id")


@query(f"WITH {_SCORES_SQL} SELECT id, mutants_total, mutants_equivalent FROM scores WHERE mutants_total - mutants_equivalent >= 3")
def live_floor(spark, sf_dir):
    """Suites with three mutants or more that aren't equivalent."""
    return score.live_floor(_scores(spark, sf_dir), 3).select("id", "mutants_total", "mutants_equivalent")


@query("""SELECT event_type AS condition, count(*) AS n, count(*) FILTER (event_id % 9 = 0) AS unparsed, count(*) FILTER (event_id % 4 = 1) AS truncated, count(*) FILTER (event_id % 10 = 3) AS pytest_import,
round(avg(event_id % 300), 6) AS mean_tokens, round(avg(value), 6) AS mean_seconds FROM events GROUP BY event_type""")
def condition_table(spark, sf_dir):
    """Counts and means of generations by condition."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), (k % 9 != 0).alias("parsed"), (k % 4 == 1).alias("truncated"), (k % 10 == 3).alias("pytest_import"), F.struct((k % 300).alias("completion_tokens"), F.col("value").alias("seconds")).alias("generation"))
    return score.condition_table(e).withColumns({c: r6(F.col(c)) for c in ("mean_tokens", "mean_seconds")})


@query("""WITH e AS (SELECT event_id AS k FROM events), l AS (SELECT k % 7 AS length FROM e UNION ALL SELECT k % 40 FROM e WHERE k % 3 = 0), c AS (SELECT length, count(*) AS n FROM l GROUP BY length)
SELECT CAST(sum(k % 5) AS BIGINT) AS sites, CAST(sum(k % 4) AS BIGINT) AS recorded, CAST(sum(k % 3) AS BIGINT) AS replaced, count(*) FILTER (k % 2 = 1) AS already_correct, CAST(0 AS BIGINT) AS too_long, count(*) AS unliteral,
(SELECT string_agg(length || 'x' || n, ' ' ORDER BY length) FROM c) AS lengths FROM e""")
def oracle_roll_up(spark, sf_dir):
    """Repair counters summed, and written values counted by length."""
    k = F.col("event_id")
    counters = {"sites": k % 5, "recorded": k % 4, "replaced": k % 3, "already_correct": k % 2, "too_long": F.lit(0), "unliteral": F.lit(1)}
    lengths = F.when(k % 3 == 0, F.array(k % 7, k % 40)).otherwise(F.array(k % 7))
    out = score.oracle_roll_up(table(spark, sf_dir, "events").select(F.struct(*[c.cast("long").alias(n) for n, c in counters.items()], lengths.alias("repr_lengths")).alias("oracle")))
    shown = F.array_join(F.transform("repr_lengths", lambda x: F.concat(x["length"].cast("string"), F.lit("x"), x["n"].cast("string"))), " ")
    return out.withColumn("lengths", shown).drop("repr_lengths")


_LAYERS_SQL = f"""l AS (SELECT d.doc_id, b.item_id, 0 AS i FROM documents d JOIN benchmark b ON sha256(d.text) = sha256(b.text)
UNION ALL SELECT doc_id, item_id, 1 FROM ({ORACLE_SQL['decontam_ngram']}) UNION ALL SELECT doc_id, item_id, 2 FROM ({ORACLE_SQL['decontam_jaccard']})
UNION ALL SELECT a.vec_id, b.vec_id, 3 FROM embeddings a JOIN embeddings b ON b.vec_id IN (SELECT item_id FROM benchmark) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) >= 0.40)"""


@query(f"WITH {_LAYERS_SQL} SELECT doc_id, item_id, CASE min(i) WHEN 0 THEN 'exact' WHEN 1 THEN 'ngram' WHEN 2 THEN 'jaccard' ELSE 'cosine' END AS layer FROM l GROUP BY doc_id, item_id")
def decontam_layers(spark, sf_dir):
    """Documents and items by the first of four layers that has them; vectors stand for the rows of their number."""
    docs, items = (table(spark, sf_dir, n).select(F.col(k).alias("id"), F.col(k).alias("pos"), text.fingerprint(F.col("text")).alias("h")) for n, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    named = lambda df, a, b: df.select(F.col(a).alias("a"), F.col(b).alias("b"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = similarity.cosine_bands(v, v.join(F.broadcast(items.select("id")), "id", "left_semi"), 0.45, 0.40).where("id <> ref")
    layers = (
        ("exact", named(docs.join(items.select(F.col("id").alias("ref"), "h"), "h"), "id", "ref")),
        ("ngram", named(QUERIES["decontam_ngram"](spark, sf_dir), "doc_id", "item_id")),
        ("jaccard", named(QUERIES["decontam_jaccard"](spark, sf_dir), "doc_id", "item_id")),
        ("cosine", named(near, "id", "ref")),
    )
    return similarity.first_layer(*layers).select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), "layer")


# chat rows and replies


@query(r"""SELECT conv_id, turn, 'system' AS first_role, 7 AS n, '```python' || chr(10) || 'b' || '```' AS shot, 'Answer: ' || text AS question, '```python' || chr(10) || text || '```' AS answer FROM conversations WHERE role = 'user'""")
def chat_assembly(spark, sf_dir):
    """Chat rows: system, two example pairs, question from a template, fenced answer."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    m = text.chat(F.lit("Be brief."), [("a?", "a"), ("b?", "b")], text.fill_template("Answer: {text}", text=F.col("text")), F.col("text"))
    rows = rows.select("conv_id", "turn", m.alias("m"))
    return rows.select("conv_id", "turn", F.col("m")[0]["role"].alias("first_role"), F.size("m").alias("n"), F.col("m")[4]["content"].alias("shot"), F.col("m")[5]["content"].alias("question"), F.element_at("m", -1)["content"].alias("answer"))


PROMPT = "Write tests. Use exact values. Cover the borders."
STYLES = {"plain": {}, "shape": {"Use exact values.": "Use what is sure without working it out."}, "short": {"Cover the borders.": "One call in each test."}}


@query("""SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'Write tests. Use exact values. Cover the borders.' WHEN 1 THEN 'Write tests. Use what is sure without working it out. Cover the borders.'
ELSE 'Write tests. Use exact values. One call in each test.' END AS prompt FROM conversations""")
def prompt_styles(spark, sf_dir):
    """The system prompt of each conversation's style."""
    style = F.element_at(F.array(*map(F.lit, STYLES)), (F.col("conv_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.styled_prompt(style, PROMPT, STYLES).alias("prompt"))


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, length(regexp_replace(html, '(?s)^.*?</head>\s*', '')) AS body_chars FROM pages""")
def html_extract(spark, sf_dir):
    """What lies between two marks, and a text without its head."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.length(F.regexp_replace("html", r"(?s)^.*?</head>\s*", "")).cast("long").alias("body_chars"))


@query("SELECT conv_id, turn, text AS code, conv_id % 4 = 1 AS truncated FROM conversations")
def reply_extract(spark, sf_dir):
    """Code of replies: fenced, cut off, behind a thinking block, or bare."""
    c, q = table(spark, sf_dir, "conversations"), F.col("conv_id") % 4
    made = F.when(q == 0, F.concat(F.lit("see ```python\n"), "text", F.lit("``` done"))).when(q == 1, F.concat(F.lit("<think>hm</think> ```\n"), "text")).when(q == 2, F.concat(F.lit("hm</think>\n"), "text")).otherwise(F.col("text"))
    return c.withColumn("r", text.fenced_code(text.without_thinking(made))).select("conv_id", "turn", F.col("r.code").alias("code"), F.col("r.truncated").alias("truncated"))


# source code, over fixtures


@query(expected.sql("code_mutants"))
def code_mutants(spark, sf_dir):
    """Mutants of the fixture functions."""
    return code.mutant_rows(fixtures.functions(spark))


@query(expected.sql("code_functions"))
def code_functions(spark, sf_dir):
    """Functions of the fixture modules and why they are rejected."""
    return code.function_rows(fixtures.functions(spark))


@query(expected.sql("code_structure"))
def code_structure(spark, sf_dir):
    """Classes of equal structure and the similarity of shingles with the first function."""
    rows = fixtures.functions(spark).select("id", code.udf_ast_hash()("source").alias("h"), code.udf_ast_shingles()("source").alias("s"), code.udf_single_function()("source").alias("single"))
    least = rows.groupBy("h").agg(F.min("id").alias("same_as"))
    first = rows.where("id = 1").select(F.col("s").alias("s1"))
    return rows.join(least, "h").crossJoin(F.broadcast(first)).select("id", "same_as", "single", r6(numeric.jaccard(F.col("s"), F.col("s1"))).alias("similarity"))


@query(expected.sql("code_matches"))
def code_matches(spark, sf_dir):
    """Fixture functions with the last reference of equal structure: renamed variables don't tell apart, other code does."""
    rows = fixtures.functions(spark).select("id", code.udf_ast_hash()("source").alias("h"), F.col("id").alias("pos"))
    hits = similarity.exact_matches(rows.select("id", "h"), rows.where("id IN (1, 2, 4)"), "h")
    return rows.select("id").join(hits, "id", "left").select("id", "ref")


@query(expected.sql("code_first_wins"))
def code_first_wins(spark, sf_dir):
    """Of fixture functions of equal structure the first; sources that can't be parsed go."""
    rows = fixtures.functions(spark).select("id", code.udf_ast_hash()("source").alias("h"), F.col("id").alias("pos"))
    return curate.first_wins(rows.where("h IS NOT NULL"), "h").select("id")


@query(expected.sql("code_suites"))
def code_suites(spark, sf_dir):
    """Suites cut from replies, within a budget, with the styles of their asserts."""
    replies = fixtures.replies(spark).withColumn("c", text.fenced_code(text.without_thinking(F.col("reply"))))
    suites = replies.withColumn("u", code.udf_suite()("c.code")).withColumn("b", code.udf_budget(2)("u.suite"))
    return suites.select("id", "c.truncated", "u.pytest_import", "b.n_tests", code.udf_styles()("b.suite").alias("y")).select("id", "truncated", "pytest_import", "n_tests", "y.*")


@query(expected.sql("failure_buckets"))
def failure_buckets(spark, sf_dir):
    """Failing tests of fixture suites by bucket."""
    rows = fixtures.failures(spark)
    shapes = code.udf_shapes()("suite")
    found = rows.withColumn("shapes", F.coalesce(shapes[F.col("test")], F.array().cast("array<string>")))
    return score.failure_table(found.withColumn("bucket", text.failure_bucket(F.col("message"), F.col("shapes"))))


# incremental runs


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_dedup(spark, sf_dir):
    """The first event of each user, through a stream that ends when all is read."""
    schema = table(spark, sf_dir, "events").schema
    new = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = scratch_path(spark, "stream")
    first = lambda batch: batch.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    logs.append_log(new, out, scratch_path(spark, "checkpoint"), first).awaitTermination()
    return spark.read.schema("user_id long, event_id long").parquet(out).groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 200)")
def stream_resume(spark, sf_dir):
    """Rows whose key earlier output doesn't have."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return logs.resume(e, e.where("event_id < 200"), "user_id").select("event_id")


@query("""SELECT user_id AS id, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id""")
def running_counters(spark, sf_dir):
    """Counters by key with the last row, upserted over an older state."""
    e = table(spark, sf_dir, "events")
    state = lambda df: df.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"))
    return logs.upsert(state(e.where("event_id < 500")), state(e), "id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 2 * o_custkey AS a, 2 * o_orderkey + 1 AS b FROM orders UNION SELECT 2 * c_custkey, 2 * (c_custkey // 3 * 3) FROM customer WHERE c_acctbal < 0), arcs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS r FROM arcs UNION SELECT node, b FROM reach JOIN arcs ON arcs.a = r) SELECT node, min(r) AS component FROM reach GROUP BY node""")
def components(spark, sf_dir):
    """Connected components of customers, their orders, and customers in debt with a neighbour."""
    orders = table(spark, sf_dir, "orders").select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("o_orderkey") + 1).alias("dst"))
    key = F.col("c_custkey")
    debt = table(spark, sf_dir, "customer").where("c_acctbal < 0").select((2 * key).alias("src"), (2 * (key - key % 3)).alias("dst"))
    return connected_components(orders.unionByName(debt))
