"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint's bit is 1 where over half of its 3-word shingle hashes (XXH64, seed 42) have it.
Two fingerprints link at `RADIUS` or fewer differing bits. The 64 bits are cut in two segments of 32:
if at most three bits differ, one segment differs in at most one, so the 33 values of its
Hamming ball find every partner in the segment table; the full distance is verified in the join.

Only distinct fingerprints take part, so copies cost nothing. Fingerprints one bit apart are
joined first through 64 masked keys each (a star to the least member: linear however large
the group), and the segment tables are then only asked for links between different groups.
So a dense cloud of near copies yields no list of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.llm.components import connected_components
from orgweave.llm.shared import keep_columns, materialise, small_batches

RADIUS = 3
SHINGLE = 3
SEED = 42
_SEGMENT_BITS = 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text, unsigned. No words: zero."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, len(starts)
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): a hash of the text, and its fingerprint as a signed long. A null text counts as empty; rows stay as they come."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    slim = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.col("`text`").cast("string").alias("text"))
    return slim.mapInArrow(compute, "doc_id long, text_key long, fp long")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("`text`").cast("string"), F.lit("")))


def _adjacent_links(fps: DataFrame) -> DataFrame:
    """A star of links for each set of fingerprints that agree but for one masked bit."""
    masked = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    masked = masked.select("fp", "bit", F.expr("fp & ~shiftleft(1L, bit)").alias("rest"))
    # two members at most can share (bit, rest): the value with the bit and the one without
    pairs = masked.groupBy("bit", "rest").agg(F.min("fp").alias("b"), F.max("fp").alias("a"))
    return pairs.where("a <> b").select("a", "b")


def _segment(fp: str, seg: int) -> str:
    return f"({fp} & 4294967295L)" if seg == 0 else f"shiftrightunsigned({fp}, {_SEGMENT_BITS})"


def _ball_links(groups: DataFrame) -> DataFrame:
    """Links within `RADIUS` between different groups. groups: (fp, grp)."""
    ball = "concat(array(v), transform(sequence(0, 31), i -> v ^ shiftleft(1L, i)))"
    out = None
    for seg in (0, 1):
        table = groups.select(F.expr(_segment("fp", seg)).alias("v"), F.col("fp").alias("b"), F.col("grp").alias("gb"))
        probe = groups.select(F.expr(_segment("fp", seg)).alias("v"), F.col("fp").alias("a"), F.col("grp").alias("ga"))
        probe = probe.select("a", "ga", F.expr(f"explode({ball})").alias("v"))
        found = probe.join(table, "v").where(f"a > b and ga <> gb and bit_count(a ^ b) <= {RADIUS}")
        found = found.select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
        out = found if out is None else out.union(found)
    return out.distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, first): each row's group by its first member, struct(no_id, doc_id, text_key); members without an id come last."""
    small_batches(docs.sparkSession)
    each = materialise(fingerprints(keep_columns(docs, "doc_id", "text")), "fingerprints")
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    distinct = each.groupBy("fp").agg(F.min(member).alias("least"))
    distinct = materialise(distinct, "distinct-fps")
    first = connected_components(_adjacent_links(distinct))
    grouped = distinct.join(first, distinct.fp == first.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("grp"))
    grouped = materialise(grouped, "fp-groups")
    second = connected_components(_ball_links(grouped)).select(F.col("node").alias("grp"), F.col("component").alias("root"))
    final = grouped.join(second, "grp", "left").select("fp", "least", F.coalesce("root", "grp").alias("root"))
    # the group's first member, pre-aggregated by fingerprint already
    ids = final.groupBy("root").agg(F.min("least").alias("first"))
    ids = final.join(ids, "root").select("fp", "first")
    return each.join(ids, "fp").select("doc_id", "text_key", "fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text, …): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id reachable over links. Null or empty texts have fingerprint
    zero and link like any other. A null doc_id keeps its row and is never chosen as a group's id unless the
    group has no other. Rows that share a doc_id are fingerprinted each for itself. Extra columns are ignored; an empty table gives no rows.
    """
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with only the document of least doc_id of each near-duplicate group, all columns kept.

    Of documents with the same doc_id in a group the one whose text has the least hash stays; rows with the same doc_id and text are one document
    given again, and stay or go together. Rows without a doc_id stay.
    """
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    gone = _grouped(docs).where(F.col("doc_id").isNotNull() & (member > F.col("first")))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (_text_key() == gone["gone_key"]), "left_anti")
