"""Pairs of rows that share text, structure or direction; families; decontamination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.shingles import letters, shingled
from millrace.operators.graph import connected_components
from millrace.plans.scratch import materialize, partitions, ship

#: Rows of a reference feature table up to which it is broadcast; a row is two numbers, so 64 MB at most.
BROADCAST_ROWS = 2_000_000
#: Numbers of a block of reference vectors that is broadcast: 32 MB.
BLOCK_NUMBERS = 4 << 20
LAYERS = ("ast-exact", "ngram", "ast-jaccard", "cosine")


def word_sets(rows: DataFrame, id_col: str, text: Column, n: int) -> DataFrame:
    """(id, s): the distinct 64-bit hashes of a row's n-grams of words; equal hashes count as equal grams. A null text has none."""
    ship(rows.sparkSession)
    own = rows.select(F.col(id_col).alias("id"), text.alias("text"))
    return own.mapInArrow(shingled(n, letters(rows.sparkSession)), f"id {own.schema['id'].dataType.simpleString()}, s array<bigint>")


def word_features(rows: DataFrame, id_col: str, text: Column, n: int) -> DataFrame:
    """(id, f): a row for each distinct n-gram of words, as its 64-bit hash."""
    return word_sets(rows, id_col, text, n).select("id", F.explode("s").alias("f"))


def few(reference: DataFrame) -> DataFrame:
    """Broadcast a reference whose rows are numbers, counted and few; beyond, and where a column has no bounded size, the join shuffles."""
    if any(t not in ("bigint", "int", "double") for _, t in reference.dtypes):
        return reference
    return F.broadcast(reference) if reference.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else reference


def shared_features(features: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, ref, k): pairs with at least one common feature and how many; every reference that matches."""
    ref = few(reference.select(F.col("id").alias("ref"), "f"))
    return features.join(ref, "f").groupBy("id", "ref").agg(F.count("*").alias("k"))


def exact_matches(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(id, ref): rows with a reference of equal key; of several, the last by position `pos`."""
    last = reference.groupBy(key).agg(F.max_by("id", "pos").alias("ref"))
    return rows.join(last, key).select("id", "ref")


def similar_pairs(features: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of sets whose Jaccard similarity is at least `threshold`.

    Sets come as (id, f) rows or as (id, s) arrays of distinct hashes, and are
    written once. Only the rarest features of each set are joined, as many as are
    needed for such a pair to share one; features of one set alone fill these places
    without being joined. Candidates so unlike in size that they can't reach the
    threshold fall out, and the overlap of the others is counted on whole sets.
    """
    if "s" in features.columns:
        sets = features.where(F.size("s") > 0)
    else:
        hashed = F.col("f") if dict(features.dtypes)["f"] == "bigint" else F.xxhash64("f")
        sets = features.groupBy("id").agg(F.collect_set(hashed).alias("s"))
    sets = materialize(sets.select("id", "s", F.size("s").alias("n")), "sets")
    # all features are exchanged once: those of one partition are counted where they lie
    each = sets.select("id", F.explode("s").alias("f")).repartition(partitions(sets), "f")
    common = each.withColumn("df", F.count("*").over(W.partitionBy("f"))).where("df > 1")
    shared = common.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "f"))).alias("shared"))
    most = F.floor(F.size("shared") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int")
    prefix = materialize(shared.join(sets.select("id", "n"), "id").where(most > 0).select("id", "n", F.explode(F.slice("shared", F.lit(1), most)["f"]).alias("f")), "prefixes")
    a, b = prefix.select(F.col("id").alias("a"), "f", F.col("n").alias("na")), prefix.select(F.col("id").alias("b"), "f", F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    pairs = materialize(a.join(b, "f").where(fits).select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets.join(few(ends), "id", "left_semi")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    k = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("k"))
    return k.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("similarity")).where(F.col("similarity") >= threshold)


def similar_to_reference(sets: DataFrame, reference: DataFrame, threshold: float) -> DataFrame:
    """(id, ref, similarity) at least `threshold` between two collections of (id, s) sets, each row of `sets` by itself; sizes travel with the features, so each side is read once."""
    rows = sets.where("id IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "id", "s")
    each = rows.select("row", "id", F.size("s").alias("na"), F.explode("s").alias("f"))
    ref = few(reference.select(F.col("id").alias("ref"), F.size("s").alias("nb"), F.explode("s").alias("f")))
    shared = each.join(ref, "f").groupBy("row", "id", "na", "ref", "nb").agg(F.count("*").alias("k"))
    return shared.select("id", "ref", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("similarity")).where(F.col("similarity") >= threshold)


def cosine_bands(left: DataFrame, right: DataFrame, hard: float, review: float, block: int | None = None) -> DataFrame:
    """(id, ref, cosine, band): all pairs of (id, v) rows with cosine at least `review`; band `hard` from `hard` on.

    The reference side is cut into blocks of `block` vectors, or of BLOCK_NUMBERS
    numbers, that are broadcast one after the other; the left side is read once for
    each and never shuffled or copied, and products are matrix products. Rows
    without a vector match nothing. Equal ids in both sides are compared too; drop
    them if the sides are one table.
    """
    right = right.where("v IS NOT NULL").select(F.col("id").alias("ref"), F.col("v").cast("array<double>").alias("v"))
    left = left.where("v IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v"))
    size = right.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    per = block or max(1, BLOCK_NUMBERS // max(1, size["d"] or 1))
    blocks = max(1, -(-size["n"] // per))
    ddl = f"id {left.schema['id'].dataType.simpleString()}, ref {right.schema['ref'].dataType.simpleString()}, cosine double"

    def unit(v: pa.Array) -> np.ndarray:
        m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(n == 0, 1, n)

    found = None
    for b in range(blocks):
        part = right.where(F.pmod(F.xxhash64("ref"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        sent = left.sparkSession.sparkContext.broadcast((part["ref"].combine_chunks(), unit(part["v"].combine_chunks())))

        def run(source: Iterator[pa.RecordBatch], sent=sent):
            refs, y = sent.value
            step = max(1, BLOCK_NUMBERS // len(y))
            for batch in source:
                for at in range(0, batch.num_rows, step):
                    rows = batch.slice(at, step)
                    c = unit(rows.column("v")) @ y.T
                    r, q = np.nonzero(c >= review)
                    yield pa.RecordBatch.from_pydict({"id": rows.column("id").take(pa.array(r)), "ref": refs.take(pa.array(q)), "cosine": pa.array(c[r, q])})

        made = left.mapInArrow(run, ddl)
        found = made if found is None else found.unionByName(made)
    if found is None:
        found = left.sparkSession.createDataFrame([], ddl)
    return found.withColumn("band", F.when(F.col("cosine") >= hard, "hard").otherwise("review"))


def first_layer(*layers: tuple[str, DataFrame]) -> DataFrame:
    """(a, b, layer): each pair once, with the first of the layers that has it."""
    every = None
    for i, (name, pairs) in enumerate(layers):
        part = pairs.select("a", "b", F.lit(i).alias("i"))
        every = part if every is None else every.unionByName(part)
    names = F.array(*[F.lit(n) for n, _ in layers])
    return every.groupBy("a", "b").agg(F.min("i").alias("i")).select("a", "b", F.element_at(names, F.col("i") + 1).alias("layer"))


def same_owner_edges(rows: DataFrame, id_col: str, owner: Column) -> DataFrame:
    """(a, b): each row with the least id of its owner; a chain would say the same in more steps."""
    pairs = rows.select(F.col(id_col).alias("b"), owner.alias("o"))
    least = pairs.groupBy("o").agg(F.min("b").alias("a"))
    return pairs.join(least, "o").where("a <> b").select("a", "b")


def groups(rows: DataFrame, id_col: str, edges: DataFrame) -> DataFrame:
    """(id, family): every row with the least id it is connected to, itself if none."""
    found = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return rows.select(F.col(id_col).alias("id")).join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("family"))


def first_of_group(families: DataFrame) -> DataFrame:
    """The rows that stay: the least id of each family."""
    return families.groupBy("family").agg(F.min("id").alias("id")).select("id", "family")


def reasons(flags: DataFrame, most: int = 3) -> DataFrame:
    """(id, hard, n_reasons, reasons): reasons of each flagged row, hard if one isn't for review; the first `most` in text order."""
    return flags.groupBy("id").agg(
        F.max((~F.col("reason").startswith("REVIEW")).cast("int")).cast("boolean").alias("hard"),
        F.count("*").alias("n_reasons"),
        F.slice(F.array_sort(F.collect_list("reason")), 1, most).alias("reasons"),
    )


def without_hard(rows: DataFrame, id_col: str, flags: DataFrame) -> DataFrame:
    hard = flags.where(~F.col("reason").startswith("REVIEW")).select(F.col("id").alias(id_col)).distinct()
    return rows.join(hard, id_col, "left_anti")
