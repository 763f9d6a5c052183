"""Spans of a text put together again on a stream, whenever and in whatever order they come.

Each span says how many its text has. The state of a text holds its spans until all are there, which sends it out complete, or until the watermark passes
the time of its last span by the wait, which sends out what there is. A few neighbouring texts share a state; each keeps its own time in it. A text that went out stays known, without its spans, until the same moment, so that spans that are
repeated do not send it again; then its state goes. So the state is bounded by what comes in within the wait, and a text goes out once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Texts of neighbouring numbers share a state, 1 << `NEIGHBOURS` at most, as a call of Python for each text costs more than its spans do.
NEIGHBOURS = 5
_STATE = "texts string"
_OUT = "source_index long, spans array<string>, complete boolean"


def _texts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, wait_ms: int) -> Iterator[pd.DataFrame]:
    """Each text of the state: spans wanted, whether it is sent, until when it is known, its spans by number."""
    texts: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
    known, watermark = frozenset(texts), state.getCurrentWatermarkMs()
    if not state.hasTimedOut:
        for pdf in batches:
            for source, number, count, payload, at in zip(*[pdf[c].tolist() for c in ("source_index", "span_index", "span_count", "payload", "at")], strict=True):
                name = str(source)
                if at < watermark and name not in known:
                    continue  # later than the watermark and of a text that is over
                text = texts.setdefault(name, [0, False, 0, {}])
                text[2] = max(text[2], at + wait_ms, watermark + 1)
                text[0] = max(text[0], count)
                if not text[1]:
                    text[3].setdefault(str(number), payload)
    least = min((text[2] for text in texts.values()), default=0)
    over = max(watermark, least + 1) if state.hasTimedOut else watermark
    rows, left = [], {}
    for name, (wanted, sent, until, held) in texts.items():
        complete = bool(wanted) and len(held) >= wanted
        if not sent and (complete or until < over):
            rows.append((int(name), [held[i] for i in sorted(held, key=int)], complete))
            sent, held = True, {}
        if until >= over:
            left[name] = [wanted, sent, until, held]
    if left:
        state.update((json.dumps(left),))
        state.setTimeoutTimestamp(max(min(text[2] for text in left.values()), watermark + 1))
    elif state.exists:
        state.remove()
    if rows:
        yield pd.DataFrame(rows, columns=["source_index", "spans", "complete"])


def regroup_stream(spans: DataFrame, columns: list[str], time: str = "time", late: str = "10 minutes", wait_seconds: int = 600) -> DataFrame:
    """A stream (source_index, span_index, span_count, …columns, time) → (source_index, outputs array<struct(…columns)>, complete): a row per text, its spans in order.

    Of spans with the same number the first counts, and those without a source_index, a number or a time are left out. complete is false for a text of which spans
    were missing when the watermark, `late` behind the latest time, passed its last span's time by `wait_seconds`. Spans of a text that is over and that come later than the
    watermark change nothing. Over a table the same call gives each text at once, complete or not, as `spans.regroup` does.
    """
    kind = spans.select(F.struct(*columns).alias("s")).schema["s"].dataType.simpleString()
    known = spans.where(F.col("source_index").isNotNull() & F.col("span_index").isNotNull() & F.col(time).isNotNull())
    payload = F.to_json(F.struct(*columns)).alias("payload")
    if not spans.isStreaming:
        first = known.groupBy("source_index", "span_index").agg(F.max("span_count").alias("n"), F.min_by(F.struct(*columns), F.struct(time, F.to_json(F.struct(*columns)))).alias("s"))
        packed = first.groupBy("source_index").agg(F.array_sort(F.collect_list(F.struct("span_index", F.to_json("s").alias("s")))).alias("l"), F.max("n").alias("n"))
        return packed.select("source_index", F.transform("l", lambda x: F.from_json(x["s"], kind)).alias("outputs"), (F.size("l") >= F.col("n")).alias("complete"))
    # (the watermark's column has to reach the operator as a time)
    slim = known.withWatermark(time, late).select(F.col("source_index").cast("long").alias("source_index"), F.col("span_index").cast("int").alias("span_index"), F.coalesce("span_count", F.lit(0)).cast("int").alias("span_count"), payload, F.unix_millis(time).alias("at"), F.col(time).alias("event_time"))
    wait_ms = 1000 * wait_seconds
    done = slim.withColumn("neighbours", F.shiftright("source_index", NEIGHBOURS)).groupBy("neighbours").applyInPandasWithState(lambda key, batches, state: _texts(key, batches, state, wait_ms), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return done.select("source_index", F.transform("spans", lambda s: F.from_json(s, kind)).alias("outputs"), "complete")
