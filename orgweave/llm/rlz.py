"""Substring dedup by a relative Lempel-Ziv parse of documents against an indexed corpus.

A word is removed if a window of `WINDOW` consecutive words covers it whose word sequence also starts in a document
with a smaller doc_id. The parse that finds those windows without comparing documents in pairs:

1. Factors. Each window belongs to the least hash of the `GRAM`-word grams in it, its anchor. Consecutive windows
   with one anchor form a factor; equal windows have equal anchors at equal places, so factors are cut alike
   wherever a passage occurs.
2. Reference blocks. The factors of the whole corpus, dealt out by hash, are the reference: each block
   is an index from factor to the least doc_id that has it. Anchors that a single document has drop out first.
3. Whole factors. A factor that an earlier document has is a duplicate span at once.
4. Factor boundaries. A factor that is new as a whole but shares its anchor with another one
   may still agree with it over a part; only there each single window is looked up.

Adjacent spans merge, which gives the maximal repeated stretches. Keys are two sums of 64-bit hashes of the words: 64 bits a word, so two windows of other words are taken as equal only if words' hashes collide or both sums do.
Every step is an aggregate or an equi-join on factor or window keys, linear in the input; long groups of copies collapse to one
factor before anything else is done with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.shared import MembershipFilter, materialise, small_batches

WINDOW = 50
GRAM = 25
_C1, _C2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MIX = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; null: none."""
    return (text or "").encode("utf-8", "replace").split()


class _Powers:
    """Powers of an odd constant modulo 2^64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 4096)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                values = np.full(n, factor, np.uint64)
                values[0] = 1
                setattr(self, name, np.cumprod(values))
        return self.up, self.down


_P1, _P2 = _Powers(_C1), _Powers(_C2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(32))


class _Rolling:
    """Hashes of any range of a document's words from prefix sums."""

    def __init__(self, words: list[bytes]):
        digest = xxhash.xxh64_intdigest
        n = len(words)
        h = np.fromiter(map(digest, words), np.uint64, n)
        self.n = n
        self.up1, self.down1 = _P1.get(n + 1)
        self.up2, self.down2 = _P2.get(n + 1)
        self.s1 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up1[:n])])
        self.s2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h) * self.up2[:n])])

    def first(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.s1[hi] - self.s1[lo]) * self.down1[lo]

    def second(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.s2[hi] - self.s2[lo]) * self.down2[lo]


def _factors(words: list[bytes]) -> tuple[np.ndarray, ...] | None:
    """anchor hash, first window, number of windows, and the two range hashes of each factor."""
    n = len(words)
    if n < WINDOW:
        return None
    roll = _Rolling(words)
    at = np.arange(n - GRAM + 1)
    gram = _mix(roll.first(at, at + GRAM))
    span = WINDOW - GRAM + 1
    anchor = np.empty(n - WINDOW + 1, np.int64)
    for lo in range(0, len(anchor), 1 << 16):
        hi = min(lo + (1 << 16), len(anchor))
        anchor[lo:hi] = np.lib.stride_tricks.sliding_window_view(gram[lo : hi + span - 1], span).argmin(axis=1) + np.arange(lo, hi)
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    counts = np.diff(np.append(starts, len(anchor)))
    ends = starts + counts - 1 + WINDOW
    a = anchor[starts]
    # the anchor's place in the factor is part of the key, so equal keys mean equal windows at equal places
    shape = ((a - starts) * 64 + counts).astype(np.uint64)
    return gram[a], starts, counts, _mix(roll.first(starts, ends) + shape), _mix(roll.second(starts, ends) ^ shape)


_FACTOR_SCHEMA = "doc_id long, text_key long, g long, w0 int, nw int, s1 long, s2 long"


def _emit_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "g", "w0", "nw", "s1", "s2"]
    for batch in batches:
        got: list[tuple] = []
        ids: list[np.ndarray] = []
        text_keys: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            g, w0, nw, s1, s2 = (np.concatenate(x) for x in zip(*got, strict=True))
            columns = [np.concatenate(ids), np.concatenate(text_keys), g.view(np.int64), w0.astype(np.int32), nw.astype(np.int32), s1.view(np.int64), s2.view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (f := _factors(words_of(text.as_py()))) is not None:
                got.append(f)
                ids.append(np.full(len(f[0]), doc, np.int64))
                text_keys.append(np.full(len(f[0]), key, np.int64))
                held += len(f[0])
                if held > 200_000:
                    yield flush()
                    got, ids, text_keys, held = [], [], [], 0
        if got:
            yield flush()


_TEXTS = "doc_id long, text_key long, text string"


def _slim(docs: DataFrame) -> DataFrame:
    """A row is known by its doc_id and a hash of its text."""
    text = F.col("`text`").cast("string")
    return docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


def _only(members: MembershipFilter, column: int, wanted: bool = True):
    """An Arrow filter: rows whose key in `column` may be (or surely isn't) a member."""
    shared = (members.bits, members.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = MembershipFilter(*shared).test
        for batch in batches:
            keys = batch.column(column).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(test(keys) == wanted))

    return run


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, lo, hi): word ranges, overlapping ones included, that a document of smaller doc_id also has.

    Rows with a null doc_id are never compared; null and short texts have no windows. Rows with the same doc_id don't remove each
    other's words; those of another text have spans of their own.
    """
    small_batches(docs.sparkSession)
    slim = _slim(docs).where("doc_id is not null")
    factors = materialise(slim.mapInArrow(_emit_factors, _FACTOR_SCHEMA), "factors")
    spread = factors.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("g")
    repeated = MembershipFilter.build(materialise(spread, "anchors"), "g")
    kept = materialise(factors.mapInArrow(_only(repeated, 2), _FACTOR_SCHEMA), "kept-factors")

    known = kept.groupBy("s1", "s2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("g").alias("g"))
    known = materialise(known, "known-factors")
    variants = known.groupBy("g").agg(F.min("first_doc").alias("lo"), F.max("first_doc").alias("hi")).where("lo < hi").select("g", F.col("lo").alias("g_first"))
    # (written, here and below, so that a join has two plain exchanges and a very common anchor or factor can be split)
    variants = materialise(variants, "variants")
    checked = known.join(variants, "g", "left").select("s1", "s2", "first_doc", "last_doc", F.col("g_first").isNotNull().alias("open"))
    checked = materialise(checked.where("open or first_doc < last_doc"), "checked-factors")
    seen = kept.join(checked, ["s1", "s2"]).select("doc_id", "text_key", "w0", "nw", "first_doc", "open")
    seen = materialise(seen, "seen-factors")
    whole = seen.where("doc_id > first_doc").select("doc_id", "text_key", F.col("w0").alias("lo"), F.expr(f"w0 + nw - 1 + {WINDOW}").alias("hi"))

    asked = seen.where("doc_id = first_doc and open").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("w0", "nw")).alias("asked"))
    asked = materialise(asked, "asked")
    members = MembershipFilter.build(asked.select("doc_id"), "doc_id")
    texts = slim.mapInArrow(_only(members, 0), _TEXTS)
    windows = texts.join(asked, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "asked").mapInArrow(_emit_windows, "doc_id long, text_key long, pos int, k1 long, k2 long")
    windows = materialise(windows, "windows")
    earlier = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("k1", "k2", "m")
    earlier = materialise(earlier, "earlier-windows")
    single = windows.join(earlier, ["k1", "k2"]).where("doc_id > m").select("doc_id", "text_key", F.col("pos").alias("lo"), F.expr(f"pos + {WINDOW}").alias("hi"))
    return whole.union(single)


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, key, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            roll = _Rolling(words_of(text.as_py()))
            ranges = sorted((x["w0"], x["nw"]) for x in asked.as_py())
            pos = np.unique(np.concatenate([np.arange(w, w + k) for w, k in ranges]))
            pos = pos[pos + WINDOW <= roll.n]
            k1, k2 = _mix(roll.first(pos, pos + WINDOW)), _mix(roll.second(pos, pos + WINDOW))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pos), doc, np.int64)), pa.array(np.full(len(pos), key, np.int64)), pa.array(pos.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))],
                ["doc_id", "text_key", "pos", "k1", "k2"],
            )


def _cut(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = words_of(text)
    if not spans:
        return len(words), 0, b" ".join(words).decode("utf-8", "replace")
    gone = np.zeros(len(words) + 1, np.int64)
    for lo, hi in spans:
        gone[lo] += 1
        gone[min(hi, len(words))] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return len(words), int((~keep).sum()), b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]).decode("utf-8", "replace")


def _cutter(with_text: bool):
    schema = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2) if batch.num_columns > 2 else [None] * batch.num_rows
            rows = []
            for text, s in zip(batch.column(1), spans, strict=True):
                s = s.as_py() if s is not None else None
                n, removed, kept = _cut(text.as_py(), [(x["lo"], x["hi"]) for x in s or ()])
                rows.append((n, removed, hashlib.sha256(kept.encode()).hexdigest(), kept)[: 3 + with_text])
            columns = list(zip(*rows, strict=True)) or [()] * (3 + with_text)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=False)]], schema)

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text


def remove_duplicate_spans(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256 and, `with_text`, the kept words joined by one space.

    Null or empty texts have no words and keep none (the hash of the empty string). A null doc_id keeps all its words. Rows with
    the same doc_id and text are one document given again and lose the same words; with another text they are cut each for itself.
    Extra columns are ignored; an empty table gives no rows.
    """
    merged = duplicate_spans(docs).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    merged = materialise(merged, "spans")
    members = MembershipFilter.build(merged.select("doc_id"), "doc_id")
    run, schema = _cutter(with_text)
    slim = _slim(docs)
    # only documents that may have a span are shuffled to meet it
    untouched = slim.mapInArrow(_only(members, 0, wanted=False), _TEXTS).select("doc_id", "text").mapInArrow(run, schema)
    maybe = slim.mapInArrow(_only(members, 0), _TEXTS).join(merged, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return untouched.union(maybe.mapInArrow(run, schema))
