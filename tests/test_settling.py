"""Tables that stages write, and compaction of caches."""

from pyspark.sql import functions as F

from orgweave.plans.settle import materialise_at, released
from orgweave.sources.cache import Cache
from orgweave.sources.registry import exists


def test_released_tables_go_and_others_stay(spark):
    _, before = materialise_at(spark.range(3), "kept")
    with released(spark):
        table, path = materialise_at(spark.range(5), "gone")
        assert table.count() == 5 and exists(spark, path)
    assert not exists(spark, path) and exists(spark, before)
    try:
        with released(spark):
            _, path = materialise_at(spark.range(5), "gone")
            raise KeyError
    except KeyError:
        assert not exists(spark, path)


def test_compaction_keeps_what_is_put_meanwhile(spark, tmp_path):
    cache = Cache(spark, f"file://{tmp_path}/c", ttl_days=30)
    cache.compact()  # nothing yet
    put = lambda rows, at: cache.put(spark.createDataFrame(rows, "key string, value string"), F.lit(float(at)))
    now = spark.sql("select cast(unix_timestamp() as double) as t").first().t
    put([("a", "old"), ("b", "1"), ("x", "expired")], now - 40 * 86400)
    put([("a", "new"), ("c", "2")], now - 86400)
    seen = cache.entries()
    files = set(seen.inputFiles())
    cache.compact()
    assert {(r.key, r.value) for r in cache.entries().collect()} == {("a", "new"), ("c", "2")}
    assert not files & set(cache.entries().inputFiles())
    # a run that ended before it took the old files away left entries twice
    cache.entries().write.mode("append").parquet(f"file://{tmp_path}/c")
    put([("a", "newest")], now)
    assert {(r.key, r.value) for r in cache.get().collect()} == {("a", "newest"), ("c", "2")}
    cache.compact()
    assert cache.entries().count() == 2
