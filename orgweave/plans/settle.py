"""Writing intermediate results to the folder that driver and executors share.

It cuts lineage: what follows neither recomputes a stage nor asks a provider twice, and a lost executor costs no finished stage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of texts that a Python worker is sent at once, at most.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in `spark.checkpoint.dir`. Where that is unset a fresh temporary folder is used and set, in local mode only: on a
    cluster no such folder is shared, so that raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="orgweave-shared-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


_cleaned: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver's Python ends with its session still up."""
    path = f"{shared_dir(spark)}/orgweave/{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(_clean, spark, path)
    return path


def _clean(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        discard(spark, path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back."""
    return materialise_at(df, tag)[0]


def materialise_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """`materialise`, and the path for `discard`."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _recorded:
        _recorded[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """`df` dealt by its columns to so many partitions that all cores have some: for few bytes of which much is made, as Spark joins partitions by their bytes."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in batches of at most `BATCH_ROWS` rows, as a row may hold a long text. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_recorded: list[list[str]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables that are written by `materialise` within go at the end: what is wanted from them must be written by then."""
    _recorded.append([])
    try:
        yield
    finally:
        for path in _recorded.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by `materialise_at` once nothing reads it any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
