"""Training-order shards of token sequences.

Documents are encoded, closed by a separator and cut into sequences of `SEQUENCE` tokens. Sequences are numbered 0..N-1 by the files they are first
written to; a keyed Feistel permutation of that range, walking cycles until the value falls below N, gives each its global slot. A range
of `PER_SHARD` slots is a shard: records of one fixed length in slot order, so any slot's shard and its place in the shard's payload follow by division, and a
reader resumes anywhere without an index. A task writes a range of shards, so files follow each other in slot order too.

The permutation is of sequence numbers; which sequence has a number depends on how the input is split. A table once written keeps its order.

Record: doc_id int64, sequence number int32, tokens used int32, then `SEQUENCE` ids of 16 bits, filled up with separators; little-endian.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm.shared import discard, materialise, materialise_at, small_batches
from orgweave.llm.tokens import END_OF_DOCUMENT, Vocabulary, encoder_of

SEQUENCE = 1024
PER_SHARD = 2048
ROUNDS = 6
_HEAD = "<qii"
_HEAD_BYTES = struct.calcsize(_HEAD)
SHARDS = "shard long, first_slot long, n_records int, stride int, payload binary"
#: doc_id of a row that has none.
NO_ID = -(1 << 63)


def stride(sequence: int = SEQUENCE) -> int:
    return _HEAD_BYTES + 2 * sequence


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: int):
        self.n, half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.half, self.mask = np.uint64(half), np.uint64((1 << half) - 1)
        self.keys = [np.uint64(xxhash.xxh64_intdigest(struct.pack("<QI", key & ((1 << 64) - 1), r))) for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._round(right, key)
        return (left << self.half) | right

    def __call__(self, values: np.ndarray) -> np.ndarray:
        x = self._once(values.astype(np.uint64))
        while (out := x >= np.uint64(self.n)).any():  # cycle-walking: fewer than four steps expected
            x[out] = self._once(x[out])
        return x.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: Vocabulary, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, seq_no, n_tokens, tokens): each document's ids and separator in pieces of `sequence` tokens. Null texts count as empty: one separator."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end, size = np.array([END_OF_DOCUMENT], "<u2").tobytes(), 2 * sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(sent.value).encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                rows += [(doc, i // size, (len(ids[i : i + size])) // 2, ids[i : i + size]) for i in range(0, len(ids), size)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "seq_no", "n_tokens", "tokens"])

    slim = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, seq_no int, n_tokens int, tokens binary")


def with_slots(staged: DataFrame, key: int) -> DataFrame:
    """A written table of sequences plus `slot`. The number of a sequence is its row in its file after all rows of the files before."""
    spark = staged.sparkSession
    named = staged.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = {r["_file"]: r["count"] for r in named.groupBy("_file").count().collect()}  # a row per file
    starts, n = [], 0
    for file in sorted(counts):
        starts.append((file, n))
        n += counts[file]
    table = spark.createDataFrame(starts, "_file string, _start long")
    numbered = named.join(F.broadcast(table) if len(starts) <= 200_000 else table, "_file").select(*staged.columns, (F.col("_start") + F.col("_row")).alias("slot"))
    permute = Feistel(n, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("slot")
            yield batch.set_column(at, "slot", pa.array(permute(batch.column(at).to_numpy())))

    return numbered.mapInArrow(run, numbered.schema)


def shard_table(slotted: DataFrame, sequence: int = SEQUENCE, per_shard: int = PER_SHARD, n: int | None = None) -> DataFrame:
    """(shard, first_slot, n_records, stride, payload): the fixed-stride shards. n: the number of slots, counted if it isn't given."""
    size, fill = stride(sequence), np.array([END_OF_DOCUMENT], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []

        def cut() -> pa.RecordBatch:
            row = [[shard], [shard * per_shard], [len(parts)], [size], [b"".join(parts)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["shard", "first_slot", "n_records", "stride", "payload"])

        for batch in batches:
            for mine, doc, no, used, tokens in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if mine != shard:
                    if parts:
                        yield cut()
                    shard, parts = mine, []
                parts.append(struct.pack(_HEAD, NO_ID if doc is None else doc, no, used) + tokens + fill * (sequence - used))
        if parts:
            yield cut()

    spark = slotted.sparkSession
    last = slotted.agg(F.max("slot")).first()[0] if n is None else n - 1
    shards = (-1 if last is None else last) // per_shard + 1
    if not shards:
        return spark.createDataFrame([], SHARDS)
    ranges = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # slots are dense, so the ranges are known without a sample of them
    dealt = slotted.withColumn("shard", F.floor(F.col("slot") / per_shard)).repartitionById(ranges, F.expr(f"cast(shard * {ranges} div {shards} as int)")).sortWithinPartitions("shard", "slot")
    return dealt.select("shard", "doc_id", "seq_no", "n_tokens", "tokens").mapInArrow(run, SHARDS)


def write_training_order(docs: DataFrame, vocabulary: Vocabulary, key: int = 0, sequence: int = SEQUENCE, per_shard: int = PER_SHARD, path: str | None = None) -> DataFrame:
    """The shards of `docs`, written to `path`, to be read by later jobs too; by default to the shared folder, for this one.

    No documents: no shards. Rows that repeat or share a doc_id have sequences each; extra columns are ignored.
    """
    spark = docs.sparkSession
    staged, staged_path = materialise_at(sequences(docs, vocabulary, sequence), "sequences")
    shards = shard_table(with_slots(staged, key), sequence, per_shard, staged.count())
    if path is None:
        written = materialise(shards, "shards")
    else:
        shards.write.parquet(path)
        written = spark.read.parquet(path)
    discard(spark, staged_path)
    return written


def write_files(shards: DataFrame, path: str) -> None:
    """A file of its own for each shard, `path`/shards/shard=N/…, and a table of them, `path`/manifest (shard, first_slot, n_records, stride).

    A file is the shard's records and one newline, nothing else: the record of slot s begins at byte (s - first_slot) * stride, so a reader outside
    Spark maps or seeks it. Spark's text writer puts out the bytes of a string as they are, and a cast from binary leaves them as they are.
    """
    shards.select("shard", F.col("payload").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(f"{path.rstrip('/')}/shards")
    shards.select("shard", "first_slot", "n_records", "stride").write.parquet(f"{path.rstrip('/')}/manifest")


def read_files(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """The shards of `write_files` from the one that holds `first_slot` on, for `read_records`; the files of earlier ones are not opened."""
    manifest = spark.read.parquet(f"{path.rstrip('/')}/manifest").where((F.col("first_slot") + F.col("n_records")) > first_slot)
    first = manifest.agg(F.min("shard")).first()[0]
    if first is None:
        return spark.createDataFrame([], SHARDS)
    files = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/shards").where(F.col("shard") >= first)
    content = files.select(F.col("shard").cast("long").alias("shard"), F.expr("substring(content, 1, length(content) - 1)").alias("payload"))
    return manifest.join(content, "shard").select("shard", "first_slot", "n_records", "stride", "payload")


def read_records(shards: DataFrame, first_slot: int = 0) -> DataFrame:
    """One row per record from `first_slot` on: slot, shard, byte_offset, doc_id, seq_no, n_tokens, tokens, record_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "tokens", "record_sha256"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for shard, start, n, size, payload in zip(*[batch.column(i) for i in range(5)], strict=True):
                shard, start, n, size, payload = (x.as_py() for x in (shard, start, n, size, payload))
                rows = []
                for i in range(max(0, first_slot - start), n):
                    record = payload[i * size : (i + 1) * size]
                    doc, no, used = struct.unpack_from(_HEAD, record)
                    rows.append((start + i, shard, i * size, None if doc == NO_ID else doc, no, used, record[_HEAD_BYTES : _HEAD_BYTES + 2 * used], hashlib.sha256(record).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    wanted = shards.where((F.col("first_slot") + F.col("n_records")) > first_slot)
    return wanted.select("shard", "first_slot", "n_records", "stride", "payload").mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, seq_no int, n_tokens int, tokens binary, record_sha256 string")
