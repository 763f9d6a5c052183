"""Token counts of documents in flat token files that have no index.

A flat file is a run of 16-bit token ids in which an end-of-document id follows each document. It is stored in blocks of fixed length that
documents straddle. Each block is searched for separators in one vectorised comparison; a prefix scan over the blocks' figures then gives
every block the tokens that its first document has in earlier blocks. The scan has two levels, so a single huge file is scanned in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgweave.llm.shared import small_batches
from orgweave.llm.tokens import END_OF_DOCUMENT, Vocabulary, encoder_of

BLOCK_TOKENS = 1 << 18
#: Blocks that the first level of the scan takes together.
GROUP = 1024


def flat_blocks(docs: DataFrame, vocabulary: Vocabulary, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, payload, doc_ids): the documents of each partition as one flat file; doc_ids: whose separators lie in the block.

    Null texts count as empty: their separator follows the previous one at once. doc_ids serves to name
    the counts later; the scan itself reads only payload.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end, size = np.array([END_OF_DOCUMENT], "<u2").tobytes(), 2 * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(sent.value).encode
        file = TaskContext.get().partitionId()
        held, ids, block = bytearray(), [], 0

        def cut(n: int, mine: list) -> pa.RecordBatch:
            row = [[file], [block], [bytes(held[:n])], [mine]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["file", "block", "payload", "doc_ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held += encode(text.as_py()) + end
                while len(held) >= size:
                    done = len(held) == size
                    yield cut(size, ids + [doc] * done)
                    del held[:size]
                    ids, block = [], block + 1
                    if done:
                        break
                else:
                    ids.append(doc)
        if held:
            yield cut(len(held), ids)

    slim = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return slim.mapInArrow(run, "file long, block long, payload binary, doc_ids array<long>")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ends = [], []
        for payload in batch.column(2):
            x = np.frombuffer(payload.as_py() or b"", "<u2")
            sizes.append(len(x))
            ends.append(np.flatnonzero(x == END_OF_DOCUMENT).astype(np.int64))
        columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["file", "block", "size", "ends"])


def count_tokens(blocks: DataFrame) -> DataFrame:
    """(file, doc_no, n_tokens, closed, block, nth): each document's tokens without its separator, numbered from 0 in its file.

    blocks: (file, block, payload), blocks of a file numbered in order. Tokens after a file's last separator are a document that isn't closed;
    there is none if nothing follows. Null or empty payloads hold no tokens. block and nth say in which block a document ends and as the
    how-manieth (both null where it isn't closed).
    """
    found = blocks.select(F.col("`file`").alias("file"), F.col("`block`").cast("long").alias("block"), F.col("`payload`").alias("payload"))
    found = found.mapInArrow(_search, f"{blocks.select('file').schema[0].name} {blocks.select('file').schema[0].dataType.simpleString()}, block long, size long, ends array<long>")
    found = found.withColumn("group", F.floor(F.col("block") / GROUP)).withColumn("n_sep", F.size("ends").cast("long"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    local = local.withColumn("last", F.when(F.col("n_sep") > 0, F.col("at") + F.expr("get(ends, size(ends) - 1)") + 1))
    local = local.withColumn("before", F.coalesce(F.sum("n_sep").over(inside), F.lit(0))).withColumn("open_from", F.max("last").over(inside))

    groups = local.groupBy("file", "group").agg(F.sum("size").alias("g_size"), F.sum("n_sep").alias("g_sep"), F.max("last").alias("g_last"))
    over = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("g_at", F.coalesce(F.sum("g_size").over(over), F.lit(0))).withColumn("g_before", F.coalesce(F.sum("g_sep").over(over), F.lit(0)))
    groups = groups.withColumn("g_open", F.coalesce(F.max(F.col("g_at") + F.col("g_last")).over(over), F.lit(0)))

    placed = local.join(groups.select("file", "group", "g_at", "g_before", "g_open"), ["file", "group"])
    placed = placed.select("file", "block", "ends", (F.col("g_at") + F.col("at")).alias("at"), (F.col("g_before") + F.col("before")).alias("before"), F.coalesce(F.col("g_at") + F.col("open_from"), "g_open").alias("open_from"))
    lengths = F.expr("transform(ends, (e, i) -> if(i = 0, at + e - open_from, e - get(ends, i - 1) - 1))")
    closed = placed.select("file", "block", "before", F.posexplode(lengths).alias("nth", "n_tokens"))
    closed = closed.select("file", (F.col("before") + F.col("nth")).alias("doc_no"), "n_tokens", F.lit(True).alias("closed"), "block", "nth")
    tail = groups.groupBy("file").agg(F.sum("g_size").alias("all"), F.sum("g_sep").alias("doc_no"), F.max(F.col("g_at") + F.col("g_last")).alias("last"))
    tail = tail.select("file", "doc_no", (F.col("all") - F.coalesce("last", F.lit(0))).alias("n_tokens"), F.lit(False).alias("closed"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("nth"))
    return closed.union(tail.where("n_tokens > 0"))
