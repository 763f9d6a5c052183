"""Byte-level BPE encoding and decoding.

The merges are Spark higher-order functions: a word is the array of its bytes' ids, and `aggregate` folds the ranked merges over it, each step
merging the pair of least rank, looked up in a literal rank map. The map is two flat literal arrays, since a MapType lookup reads every key: the
row of a left id starts at its displacement, and a slot names the left id that owns it.

A word is folded once in a chunk of texts (`CHUNK_CHARS` characters or `CHUNK_WORDS` distinct words, whichever is reached first; a longer text is a
chunk of its own). A chunk is one row: its distinct words, and each text as the numbers of its words. So no text is shuffled,
no word is left to another encoder, and what a task holds has a bound whatever the corpus is.

Words that most chunks have would be folded again in each. The commonest words (`DICTIONARY_WORDS` at most) of a sample of texts (`SAMPLE_ROWS` expected,
chosen by a hash of the text) are therefore folded beforehand and sent out. That saves work and decides nothing: the ids of a word are the same either way.

Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm.shared import let, materialise, small_batches
from orgweave.llm.tokens import Vocabulary, word_splitter

CHUNK_CHARS, CHUNK_WORDS = 1 << 23, 1 << 18
SAMPLE_ROWS, DICTIONARY_WORDS = 1 << 14, 1 << 18
#: Tokens that decoding looks up at once.
PIECES_AT_ONCE = 1 << 20
#: Ranks from here on mean that a pair does not merge.
_NONE = 1 << 16
#: A part of a word is rank * 2^46 + place * 2^16 + id.
_RANK_BITS = 46
_RANK, _NO_RANK = 1 << _RANK_BITS, _NONE << _RANK_BITS
#: What free slots hold.
_FREE = 1 << 40
_TABLES_TYPE = "struct<rows:array<bigint>,slots:array<bigint>>"


@lru_cache(maxsize=2)
def _tables(vocabulary: Vocabulary) -> str:
    """The rank map as JSON of two flat arrays: rows, slots.

    A pair (a, b) of ids that merge to m lies in slot rows[a] + b, which holds a << 16 | m. Rows are laid over
    each other so that no slot has two owners, the fullest first; ids that begin no pair have row 0, where no slot is theirs. No id
    and its successor lead out of the arrays.
    """
    ranks = vocabulary.ranks()
    merges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for piece, merged in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                merges[a].append((b, merged))
    n, look = len(ranks), 4096
    free = np.ones(8 * sum(map(len, merges.values())) + n + look, bool)
    slots = np.full(len(free), _FREE, np.int64)
    rows = np.zeros(n, np.int64)
    first = 0  # no slot before it is free
    for a, row in sorted(merges.items(), key=lambda x: (-len(x[1]), x[0])):
        b = np.array([x[0] for x in row])
        at = max(0, first - int(b.min()))
        while not (fits := np.logical_and.reduce([free[at + x : at + x + look] for x in b.tolist()])).any():
            at += look
        at += int(np.argmax(fits))
        rows[a] = at
        free[at + b] = False
        slots[at + b] = [a << 16 | merged for _, merged in row]
        first += int(np.argmax(free[first:]))
    return json.dumps({"rows": rows.tolist(), "slots": slots[: int(rows.max(initial=0)) + n].tolist()})


def rank_map(spark: SparkSession, vocabulary: Vocabulary) -> tuple[Column, Column]:
    """The literal rank map: rows and slots.

    The parsed arrays are put in the plan in Spark's compact binary form: as arrays of objects they would be spelt out in
    every description of the plan and be rebuilt element by element in each task.
    """
    parsed = spark.range(1).select(F.from_json(F.concat(F.lit(_tables(vocabulary)), F.when(F.col("id") < 0, "x").otherwise("")), _TABLES_TYPE).alias("t")).select("t.*")
    execution = parsed._jdf.queryExecution()
    values, types, jvm = execution.executedPlan().executeTake(1)[0], execution.analyzed().schema(), spark._jvm
    literals = [jvm.org.apache.spark.sql.catalyst.expressions.Literal(values.getArray(i), types.apply(i).dataType()) for i in (0, 1)]
    rows, slots = (Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(x)) for x in literals)
    return rows, slots


def fold_words(words: Column, table: tuple[Column, Column]) -> Column:
    """array<array<int>>: the ids of each word after all ranked merges. words: arrays of the ids of their bytes.

    A part of a word is one number: the rank of its pair with the next part, its first byte's place, its id. So the least number is the leftmost
    pair of least rank. A step merges it; if that rank comes again, it merges all its places, from the left, as a merge leaves
    no pair of less or equal rank behind it. A word with nothing left to merge is marked by negative numbers, so that further steps leave
    it alone; they are taken in blocks, which are left out as a whole then.
    """
    rows, slots = table

    def rank(a: Column, b: Column) -> Column:
        # the pair's own slot leaves its merged id; another row's, or a free one, something of 65536 or more
        found = slots[rows[a] + b].bitwiseXOR(F.shiftleft(a, 16))
        return F.shiftleft(F.least(found, F.lit(_NONE).cast("long")), _RANK_BITS)

    def id_of(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_NONE - 1).cast("long"))

    def unranked(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_RANK - 1))

    def step(c: Column, _: Column) -> Column:
        def merge(least: Column) -> Column:
            new = F.shiftright(least, _RANK_BITS)  # the rank of a merge is the id it makes
            placed = F.shiftleft(F.shiftright(unranked(least), 16), 16).bitwiseOR(new)
            again = lambda x: x.bitwiseXOR(least) < _RANK

            def merge_one(before: Column) -> Column:  # before: number of the part before the pair, -1 without one
                def renewed(x: Column, i: Column) -> Column:
                    left = F.when(i == before, rank(id_of(x), new).bitwiseOR(unranked(x))).otherwise(x)
                    return F.when(x == least, rank(new, id_of(F.get(c, before + 3))).bitwiseOR(placed)).otherwise(left)

                return F.transform(F.array_remove(c, F.get(c, before + 2)), renewed)

            def merge_all() -> Column:
                marks = F.concat_ws("", F.transform(c, lambda x: F.when(again(x), "1").otherwise("0")))

                def merged(mark: Column) -> Column:
                    each = F.transform(c, lambda x, i: F.when(F.get(mark, i) == "1", F.shiftleft(F.shiftright(unranked(x), 16), 16).bitwiseOR(new)).otherwise(unranked(x)))
                    return F.filter(each, lambda _, i: (i == 0) | (F.get(mark, i - 1) != "1"))

                # of pairs that overlap every other one merges
                parts = let(F.split(F.regexp_replace(marks, "11", "10"), ""), merged)
                return let(parts, lambda p: F.transform(p, lambda x, i: rank(id_of(x), id_of(F.get(p, i + 1))).bitwiseOR(x)))

            several = F.exists(c, lambda x: again(x) & (x != least))
            merged = F.when(several, merge_all()).otherwise(let((F.array_position(c, least) - 2).cast("int"), merge_one))
            return F.when(least >= _NO_RANK, F.transform(c, lambda x: -1 - x)).otherwise(merged)

        return F.when(F.get(c, F.lit(0)) < 0, c).otherwise(let(F.array_min(c), merge))

    def one(word: Column) -> Column:
        start = F.transform(word, lambda a, i: rank(a.cast("long"), F.get(word, i + 1).cast("long")).bitwiseOR(i.cast("long") * _NONE + a))
        block = F.sequence(F.lit(1), F.ceil(F.sqrt(F.size(word))).cast("int"))
        steps = lambda c, _: F.when(F.get(c, F.lit(0)) < 0, c).otherwise(F.aggregate(block, c, step))
        return F.aggregate(block, start, steps, lambda c: F.transform(c, lambda x: id_of(F.greatest(x, -1 - x)).cast("int")))

    return F.transform(words, one)


_CHUNK = "doc_ids array<long>, sizes array<long>, numbers binary, words array<array<int>>"


def byte_arrays(words: list[bytes], byte_ids: np.ndarray) -> pa.ListArray:
    """Each word as the ids of its bytes."""
    ends = np.cumsum([0, *map(len, words)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(byte_ids[np.frombuffer(b"".join(words), np.uint8)]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, counts = word_splitter(), Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            counts.update(find(text.as_py() or ""))
        if len(counts) > CHUNK_WORDS:
            yield flush()
    if counts:
        yield flush()


@dataclass(frozen=True)
class Dictionary:
    """Words, and their ids one after the other: those of word i end at byte ends[i]."""

    words: pa.Array
    ids: bytes
    ends: np.ndarray

    @staticmethod
    def of(folded: list[tuple[pa.Array, pa.ListArray]]) -> "Dictionary":
        parts = [_packed(x) for _, x in folded]
        ends = np.concatenate([np.zeros(0, np.int64), *[x[1] for x in parts]]).cumsum()
        return Dictionary(pa.chunked_array([w for w, _ in folded], pa.string()).combine_chunks(), b"".join([x[0] for x in parts]), ends)


def _packed(folded: pa.ListArray) -> tuple[bytes, np.ndarray]:
    """The ids of words as 16-bit integers, and how many bytes each word has."""
    return folded.flatten().to_numpy().astype("<u2").tobytes(), folded.value_lengths().to_numpy().astype(np.int64) * 2


def dictionary(docs: DataFrame, byte_ids: np.ndarray, table: tuple[Column, Column]) -> Dictionary:
    """The commonest words of a sample of `docs` (text), folded; of words equally common all or none."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counted = materialise(sample.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "sample-words")
    held, least = 0, 1
    for row in counted.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        held += row["count"]
        if held > DICTIONARY_WORDS:
            least = row["n"] + 1
            break

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = byte_arrays([w.encode() for w in batch.column(0).to_pylist()], byte_ids)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, batch.num_rows], x) for x in (batch.column(0), words)], ["words", "spelt"])

    spelt = counted.where(F.col("n") >= least).select("word").mapInArrow(spell, "words array<string>, spelt array<array<int>>")
    folded = spelt.select("words", fold_words(F.col("spelt"), table).alias("ids")).toArrow()
    return Dictionary.of([(b.column(0).flatten().cast(pa.string()), b.column(1).flatten()) for b in folded.to_batches()])


def _chunks(byte_ids: np.ndarray, sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = word_splitter()
        number: defaultdict[str, int] = defaultdict(None, ((w, i) for i, w in enumerate(sent.value.words.to_pylist())))
        number.default_factory = number.__len__  # a new word gets the next number
        known = len(number)
        ids: list[int | None] = []
        sizes: list[int] = []
        numbers: list[bytes] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal chars
            words = byte_arrays([w.encode("utf-8", "replace") for w in islice(number, known, None)], byte_ids)
            row = [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(numbers)], pa.binary()), pa.ListArray.from_arrays([0, len(words)], words)]
            for held in (ids, sizes, numbers):
                held.clear()
            while len(number) > known:
                number.popitem()
            chars = 0
            return pa.RecordBatch.from_arrays(row, ["doc_ids", "sizes", "numbers", "words"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if ids and (chars + len(text) > CHUNK_CHARS or len(number) - known > CHUNK_WORDS):
                    yield flush()
                words = split(text)
                numbers.append(np.fromiter(map(number.__getitem__, words), "<u4", len(words)).tobytes())
                ids.append(doc)
                sizes.append(len(words))
                chars += len(text)
        if ids:
            yield flush()

    return run


def _data(taken: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
    """The bytes of an array's values one after the other, and where each begins and the last ends."""
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return memoryview(data or b"")[at[0] : at[-1]], at - at[0]


def _join_words(sent: Broadcast):
    """The ids of each text of a chunk, from those of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held_ends = sent.value.ids, sent.value.ends
        for batch in batches:
            for ids, sizes, numbers, folded in zip(*[batch.column(i) for i in range(4)], strict=True):
                new, lengths = _packed(folded.values)
                ends = np.concatenate([[0], held_ends, lengths.cumsum() + len(held_ids)]).astype(np.int64)
                of_word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(held_ids + new)])
                number = np.frombuffer(numbers.as_buffer(), "<u4")
                at, rows, docs, held = 0, [], [], 0
                for doc, size in zip(ids.values.to_pylist(), sizes.values.to_pylist(), strict=True):
                    docs.append(doc)
                    rows.append(bytes(_data(of_word.take(pa.array(number[at : at + size])))[0]))
                    at += size
                    held += len(rows[-1])
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "ids"])
                        rows, docs, held = [], [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids binary): each text's ids as little-endian 16-bit integers, one row per row of `docs`.

    A null or empty text has no ids; rows that repeat, or share a doc_id or have none, are encoded each for itself. Other
    columns are ignored, whatever their names; no rows give none.
    """
    small_batches(docs.sparkSession)
    ranks = vocabulary.ranks()
    byte_ids = np.array([ranks[bytes([x])] for x in range(256)], np.int32)
    slim = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    table = rank_map(docs.sparkSession, vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(dictionary(slim.where("text is not null"), byte_ids, table))
    folded = slim.mapInArrow(_chunks(byte_ids, sent), _CHUNK).select("doc_ids", "sizes", "numbers", fold_words(F.col("words"), table).alias("words"))
    return folded.mapInArrow(_join_words(sent), "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: Vocabulary, with_bytes: bool = True) -> DataFrame:
    """(doc_id, ids) → (doc_id, n_tokens, ids_sha256, decoded_sha256[, decoded]): the pieces of the ids, concatenated.

    Null ids count as none. Rows stay as they come; other columns are ignored.
    """
    names_out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["decoded"] * with_bytes]
    pieces_of_ids = vocabulary.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(pieces_of_ids, pa.large_binary())
        names = pa.array([f"{i} ".encode() for i in range(len(pieces))], pa.large_binary())
        for batch in batches:
            rows = []
            for packed in batch.column(1):
                ids = np.frombuffer(packed.as_buffer() if packed.is_valid else b"", "<u2")
                named, raw, parts = hashlib.sha256(), hashlib.sha256(), []
                for lo in range(0, len(ids), PIECES_AT_ONCE):
                    part = pa.array(ids[lo : lo + PIECES_AT_ONCE])
                    text = _data(names.take(part))[0]
                    named.update(text if lo + PIECES_AT_ONCE < len(ids) else text[:-1])  # no space after the last
                    piece = _data(pieces.take(part))[0]
                    raw.update(piece)
                    if with_bytes:
                        parts.append(bytes(piece))
                rows.append((len(ids), named.hexdigest(), raw.hexdigest(), b"".join(parts))[: 3 + with_bytes])
            columns = list(zip(*rows, strict=True)) or [()] * (3 + with_bytes)
            types = [pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=False)]], names_out)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded binary" * with_bytes)
