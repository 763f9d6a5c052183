"""Regrouping of spans on a stream: order, lateness, repetition, and the same result as over a table."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from orgweave.streaming.regroup import _texts, regroup_stream

SCHEMA = "source_index long, span_index int, span_count int, raw_text string, score double, time timestamp"
START = dt.datetime(2024, 1, 1, 12)


def span(text, number, count, minute):
    return (text, number, count, f"t{text}s{number}", number / 4, None if minute is None else START + dt.timedelta(minutes=minute))


def run(spark, tmp_path, batches, **kw):
    """Each batch as one micro-batch, in order, through one query that is started anew for each."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{source}")
        grouped = regroup_stream(stream, ["raw_text", "score"], late="5 minutes", wait_seconds=600)
        writer = grouped.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True)
        q = writer.foreachBatch(lambda df, n, i=i: df.write.mode("overwrite").parquet(f"file://{out}/run={i}/batch={n}")).start()
        q.awaitTermination(120)
        assert q.exception() is None
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"file://{out}").collect()
    return sorted((r.source_index, r.complete, tuple(o.raw_text for o in r.outputs)) for r in rows)


def test_stream_regroups_like_a_table(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        batches = [
            [span(1, 1, 2, 0), span(2, 0, 1, 0), span(3, 0, 3, 1), span(None, 0, 1, 0), span(9, 0, 1, None)],
            [span(1, 0, 2, 2), span(3, 2, 3, 2), span(2, 0, 1, 2), span(3, 2, 3, 2)],  # text 2 is repeated
            [span(4, 0, 2, 60)],  # the watermark passes what text 3 waits for
            [span(3, 1, 3, 1), span(4, 1, 2, 61)],  # too late for text 3
            [span(5, 0, 1, 200)],
        ]
        got = run(spark, tmp_path, batches)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == [(1, True, ("t1s0", "t1s1")), (2, True, ("t2s0",)), (3, False, ("t3s0", "t3s2")), (4, True, ("t4s0", "t4s1")), (5, True, ("t5s0",))]
    table = regroup_stream(spark.createDataFrame([s for b in batches for s in b], SCHEMA), ["raw_text", "score"])
    whole = {r.source_index: (r.complete, [o.raw_text for o in r.outputs], [o.score for o in r.outputs]) for r in table.collect()}
    assert whole == {1: (True, ["t1s0", "t1s1"], [0, 0.25]), 2: (True, ["t2s0"], [0]), 3: (True, ["t3s0", "t3s1", "t3s2"], [0, 0.25, 0.5]), 4: (True, ["t4s0", "t4s1"], [0, 0.25]), 5: (True, ["t5s0"], [0])}


def test_no_rows(spark):
    assert regroup_stream(spark.createDataFrame([], SCHEMA), ["raw_text"]).agg(F.count("*")).first()[0] == 0


class State:
    """A state as the operator is handed it, call by call."""

    held, timeout, watermark, hasTimedOut = None, None, 0, False
    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.held = value

    def remove(self):
        self.held = self.timeout = None

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.timeout = at


def test_neighbouring_texts_share_a_call_and_keep_their_own_times():
    state = State()

    def call(rows, watermark, timed_out=False):
        state.watermark, state.hasTimedOut = watermark, timed_out
        batches = [pd.DataFrame(rows, columns=["source_index", "span_index", "span_count", "payload", "at"])] if rows else []
        return [tuple(r) for pdf in _texts((0,), iter(batches), state, 100) for r in pdf.itertuples(index=False)]

    assert call([(1, 1, 2, "b", 10), (2, 0, 1, "c", 10), (3, 0, 2, "d", 50), (1, 0, 2, "a", 20)], 0) == [(1, ["a", "b"], True), (2, ["c"], True)]
    assert state.timeout == 110
    assert call([(2, 0, 1, "again", 90)], 80) == []  # text 2 stays known until 190, text 1 until 120, text 3 until 150
    assert state.timeout == 120
    assert call([(4, 0, 2, "e", 200), (5, 0, 1, "late", 100)], 160) == [(3, ["d"], False)]  # its time is up though its neighbour came
    assert state.timeout == 190
    assert call([], 200, timed_out=True) == [] and state.timeout == 300
    assert call([], 301, timed_out=True) == [(4, ["e"], False)] and not state.exists
