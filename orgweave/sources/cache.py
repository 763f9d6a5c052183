"""Key-value caches as append-only tables: the latest value of a key counts, as long as it isn't too old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.plans.settle import materialise
from orgweave.sources.registry import exists

DAY = 86400


def latest(entries: DataFrame, now: Column | None = None, ttl_days: int | None = None) -> DataFrame:
    """(key, value, created_at): each key's latest entry that is at most ttl_days old. created_at: seconds since 1970."""
    if ttl_days is not None:
        now = now if now is not None else F.unix_timestamp().cast("double")
        entries = entries.where(now - F.col("created_at") <= ttl_days * DAY)
    return entries.groupBy("key").agg(F.max_by(F.struct("value", "created_at"), F.struct("created_at", "value")).alias("m")).select("key", "m.*")


class Cache:
    """A cache at a path. `ttl_days` None: entries never grow old."""

    def __init__(self, spark: SparkSession, path: str, ttl_days: int | None = 30):
        self.spark, self.path, self.ttl_days = spark, path, ttl_days

    def entries(self) -> DataFrame:
        schema = "key string, value string, created_at double"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def get(self, now: Column | None = None) -> DataFrame:
        return latest(self.entries(), now, self.ttl_days)

    def put(self, entries: DataFrame, now: Column | None = None) -> None:
        """Append (key, value)."""
        at = now if now is not None else F.unix_timestamp().cast("double")
        entries.select("key", "value", at.alias("created_at")).write.mode("append").parquet(self.path)

    def stats(self, now: Column | None = None) -> dict:
        now = now if now is not None else F.unix_timestamp().cast("double")
        ttl = (self.ttl_days or 1 << 30) * DAY
        row = latest(self.entries()).agg(F.count("*").alias("total"), F.count_if(now - F.col("created_at") > ttl).alias("expired")).first()
        return {"total": row["total"], "expired": row["expired"]}

    def compact(self) -> None:
        """Rewrite with only what `get` returns.

        The compacted entries are appended, and then the files they were read from go. What is put meanwhile is in other files and stays; if this ends halfway, entries
        are there twice, which `get` does not mind. Readers that listed the old files before must read anew.
        """
        if not exists(self.spark, self.path):
            return
        old = self.entries()
        files = old.inputFiles()
        latest(old, None, self.ttl_days).write.mode("append").parquet(self.path)
        for f in files:
            self._drop(f)

    def clear(self) -> None:
        self._drop(self.path)

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def read_through(queries: DataFrame, key: str, cached: DataFrame, provider, to_value: Column) -> tuple[DataFrame, DataFrame]:
    """Answers for the distinct `key`s of `queries`: from `cached` (key, value) where there, else from the provider.

    Returns (key, value) of all, and of the new ones, for `Cache.put`. provider: (query) → (query, …); to_value makes the value of its row.
    The new answers are written before anything reads them, so the provider is asked once for each key.
    """
    asked = queries.select(F.col(key).alias("key")).where("key is not null").distinct()
    hits = asked.join(cached.select("key", "value"), "key")
    misses = asked.join(cached.select("key"), "key", "left_anti")
    new = provider(misses.select(F.col("key").alias("query"))).select(F.col("query").alias("key"), to_value.alias("value"))
    new = materialise(new, "provider-answers")
    return hits.unionByName(new), new
