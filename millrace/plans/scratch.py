"""Scratch tables in the folder that all executors share, and sizes of shuffles."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of stored input that one shuffle partition stands for.
BYTES_PER_PARTITION = 16 << 20

_shipped: set[str] = set()
_scratch: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / "millrace_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a local one is made only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of `materialize` that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path is not None:
        _delete(df.sparkSession, path)
        _scratch[:] = [x for x in _scratch if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def drop_scratch() -> None:
    """Delete the scratch tables of this process; results read from them must be written by then."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended, and its folder with it
            return


def input_bytes(df: DataFrame) -> int:
    """Stored bytes that the leaves of the plan read, 0 where Spark doesn't know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < 1 << 60 else 0


def partitions(df: DataFrame) -> int:
    """Shuffle partitions for this input: they follow its size, and the session's setting is the least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // BYTES_PER_PARTITION))
