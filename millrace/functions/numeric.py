"""Column functions over numbers: vectors, exact tests, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Length of a vector, 1 for the zero vector."""
    n = F.sqrt(_dot(v, v))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; a zero vector gives 0. Vectors of other lengths raise."""
    same = F.size(a) == F.size(b)
    return F.when(same, _dot(a, b) / (norm(a) * norm(b))).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p-value of the discordant counts; 1 if there are none.

    The lower binomial tail is summed from log terms, so counts in the thousands
    don't underflow.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("long")
    log_choose = lambda i: F.log(n - i + 1) - F.log(i.cast("double"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct((-n * math.log(2)).alias("t"), F.exp(-n * math.log(2)).alias("s"))
    total = F.aggregate(steps, start, lambda acc, i: F.struct((acc["t"] + log_choose(i)).alias("t"), (acc["s"] + F.exp(acc["t"] + log_choose(i))).alias("s")), lambda acc: acc["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))


def learning_rate(step: Column, peak: float, warmup: int, decay: int, end: float = 0.0) -> Column:
    """Linear to the peak over the warm-up, then half a cosine to the end, which stays."""
    t = F.least(step - warmup, F.lit(decay)).cast("double")
    fall = end + (peak - end) * 0.5 * (1 + F.cos(math.pi * t / decay))
    return F.when(step < warmup, peak * step / warmup).otherwise(fall) if warmup else fall


def hash_draw(key: Column, seed: str = "0") -> Column:
    """A text whose order is a reproducible shuffle: the same in any engine with SHA-256."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
