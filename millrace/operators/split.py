"""Caps, reproducible draws and splits that keep families whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.numeric import hash_draw
from millrace.plans.scratch import materialize, partitions


def ranked(rows: DataFrame, *order: str, size: str | None = None) -> DataFrame:
    """All rows with `__i`, their place (from 0) in one order over the table, and with `size` the sum of it over all rows before, `__before`.

    Rows are cut into ranges of the order and numbered within theirs; only one row
    for each range meets in one place, for the offsets. `order` must tell rows apart.
    """
    cut = rows.repartitionByRange(partitions(rows), *order).withColumn("__p", F.spark_partition_id())
    placed = materialize(cut, "ranges")
    sums = placed.groupBy("__p").agg(F.count("*").alias("__n"), F.sum(size if size else F.lit(1)).alias("__s"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"))
    own = W.partitionBy("__p").orderBy(*order)
    out = placed.join(F.broadcast(starts), "__p").withColumn("__i", F.row_number().over(own) - 1 + F.col("__n0"))
    if size:
        out = out.withColumn("__before", F.coalesce(F.sum(size).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("__s0"))
    return out.drop("__p", "__n0", "__s0")


def cap_per_key(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each key; Spark cuts a group as soon as it is ranked, on both sides of the shuffle."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("__n") <= most).drop("__n")


def drawn(rows: DataFrame, key: str, seed: str, most: int) -> DataFrame:
    """`most` rows in the order of a seeded hash."""
    return rows.withColumn("__d", hash_draw(F.col(key), seed)).orderBy("__d", key).limit(most).drop("__d")


def family_split(families: DataFrame, seed: str, target: int) -> DataFrame:
    """(id, family, split): whole families in hash order go to `test` until it has `target` rows, the others to `dev`; the last may overshoot."""
    sizes = families.groupBy("family").agg(F.count("*").alias("n")).withColumn("d", hash_draw(F.col("family"), seed))
    split = ranked(sizes, "d", "family", size="n").select("family", F.when(F.col("__before") < target, "test").otherwise("dev").alias("split"))
    return families.join(split, "family").select("id", "family", "split")


def valid_split(families: DataFrame, seed: str, share: float = 0.05) -> DataFrame:
    """(id, family, split): the first max(1, round half to even of share) families in hash order are `valid`, the others `train`."""
    each = families.select("family").distinct().withColumn("d", hash_draw(F.col("family"), seed))
    placed = ranked(each, "d", "family").crossJoin(F.broadcast(each.agg(F.count("*").alias("total"))))
    most = F.greatest(F.lit(1), F.bround(F.col("total") * share, 0))
    split = placed.select("family", F.when(F.col("__i") < most, "valid").otherwise("train").alias("split"))
    return families.join(split, "family").select("id", "family", "split")


def quantile_strata(rows: DataFrame, id_col: str, value: str, bins: int = 4) -> DataFrame:
    """All rows with `stratum`: rows [s*L/bins, (s+1)*L/bins) by value are stratum s, which `ntile` cuts otherwise."""
    total = rows.agg(F.count("*").alias("__t"))
    placed = ranked(rows, value, id_col).crossJoin(F.broadcast(total))
    return placed.withColumn("stratum", F.floor((bins * F.col("__i") + bins - 1) / F.col("__t"))).drop("__i", "__t")


def stratified_sample(strata: DataFrame, id_col: str, seed: str, each: int) -> DataFrame:
    """`each` rows of every stratum in hash order."""
    return cap_per_key(strata.withColumn("__d", hash_draw(F.col(id_col), seed)), "stratum", "__d", each).drop("__d")


def every_nth(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Rows n, 2n, ... in order."""
    return ranked(rows, order).where((F.col("__i") + 1) % n == 0).drop("__i")


def unseen(rows: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs in none of `seen`; of rows with one key the first by `pos`."""
    fresh = rows.join(seen.select(*keys).distinct(), list(keys), "left_anti")
    return cap_per_key(fresh, keys[0], "pos", 1) if "pos" in rows.columns else fresh


def head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of a stated order; all for 0."""
    return rows.orderBy(*order).limit(n) if n else rows.orderBy(*order)


def without_exemplars(rows: DataFrame, key: str, exemplars: list) -> DataFrame:
    """Rows that aren't themselves examples in the prompt; a null key is none of them."""
    return rows.where(F.coalesce(~F.col(key).isin(exemplars), F.lit(True))) if exemplars else rows


def all_of(*sets: DataFrame) -> DataFrame:
    """Distinct rows of any of the sets, e.g. exclusions from several sources."""
    return appended(*sets).distinct()


def appended(*runs: DataFrame) -> DataFrame:
    """The rows of all runs, repeats included."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def looked_up(rows: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Each row with its row of the pool; a key that the pool lacks, null too, ends the query with an error."""
    known = pool.withColumn("__known", F.lit(True))
    found = rows.join(known, key, "left")
    missing = F.raise_error(F.concat(F.lit("not in the pool: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    # a condition of its own columns, so that it can't move into the join
    return found.where(F.coalesce(F.col("__known"), missing.cast("boolean"))).drop("__known")


def capped_draw(rows: DataFrame, key: str, seed: str, most: int, pos: str) -> DataFrame:
    """At most `most` rows, drawn in the order of a seeded hash and then put back in their own order."""
    return drawn(rows, key, seed, most).orderBy(pos)
