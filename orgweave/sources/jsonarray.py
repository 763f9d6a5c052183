"""The entries of one large JSON array of objects, read in as many tasks as the file has ranges.

The file is read as text cut at each `}`, which Spark splits by byte ranges wherever lines end. A piece changes two things: whether the scan is within a string, by
the parity of its quotes, and how deep in braces it is, by those outside strings. What a range does to the depth has the form max(depth + a, b), for
either state of the string it may begin in, and such functions compose. So a first pass sums up each range in one row, a scan over these rows says in which
state each range begins, and a second pass cuts the entries. Of an entry that crosses ranges each range returns its part, and the parts meet by a small group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_SUMMARY = "path string, start long, quoted int, ends_quoted int, a long, b long"
_PARTS = "owner string, part long, whole boolean, ends boolean, text string"


@dataclass(frozen=True)
class Change:
    """What a stretch of text does: the string state it ends in, and depth → max(depth + a, b)."""

    quoted: bool
    a: int
    b: int

    def then(self, other: "Change") -> "Change":
        return Change(other.quoted, self.a + other.a, max(self.b + other.a, other.b))


def _outside(piece: str, quoted: bool) -> list[str]:
    """The stretches of a piece that are outside strings, escapes gone."""
    return _ESCAPED.sub("", piece).split('"')[quoted::2]


def change(piece: str, quoted: bool) -> Change:
    """What a piece and the brace it was cut at do."""
    plain = _ESCAPED.sub("", piece)
    ends = quoted != plain.count('"') % 2
    opened = sum(s.count("{") for s in _outside(piece, quoted))
    return Change(ends, opened, 0) if ends else Change(ends, opened - 1, 0)


def first_brace(piece: str, quoted: bool) -> int:
    """Where the first brace outside strings is; -1 without one."""
    i = 0
    while i < len(piece):
        c = piece[i]
        if c == "\\":
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "{" and not quoted:
            return i
        i += 1
    return -1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        yield from zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows per range: what it does if it begins outside a string, and if within one."""
    sums: dict[tuple[str, int], dict[bool, Change]] = {}
    for where, piece in _ranges(batches):
        now = sums.setdefault(where, {q: Change(q, 0, 0) for q in (False, True)})
        for q in (False, True):
            now[q] = now[q].then(change(piece, now[q].quoted))
    rows = [(*where, int(q), int(c.quoted), c.a, c.b) for where, both in sums.items() for q, c in both.items()]
    if rows:
        types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", "start", "quoted", "ends_quoted", "a", "b"])


@dataclass(frozen=True)
class Begin:
    """How a range begins: within a string or not, how deep, in which range the open entry began, and the range's number in its file."""

    quoted: bool
    depth: int
    owner: str | None
    number: int


def begins(rows: list) -> dict[tuple[str, int], Begin]:
    """The scan over the ranges of all files, each file by itself."""
    known = {(r["path"], r["start"], bool(r["quoted"])): Change(bool(r["ends_quoted"]), r["a"], r["b"]) for r in rows}
    out: dict[tuple[str, int], Begin] = {}
    quoted, depth, owner, number, last = False, 0, None, 0, None
    for path, start in sorted({(r["path"], r["start"]) for r in rows}):
        if path != last:
            quoted, depth, owner, number, last = False, 0, None, 0, path
        out[path, start] = Begin(quoted, depth, owner, number)
        c = known[path, start, quoted]
        after = max(depth + c.a, c.b)
        # the depth falls to 0 on the way if it is the second part that counts, or both alike
        if depth == 0 or depth + c.a <= c.b:
            owner = f"{path}#{start}"
        quoted, depth, number = c.quoted, after, number + 1
    return out


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(entry): the text of each object in the array, in no order. path: a file, or several by pattern.

    Entries that are no objects are left out, and so is an unfinished last one. Braces and quotes within strings, escapes and empty files are
    no special case; an entry may be of any form, as long as its braces and quotes are balanced.
    """
    pieces = _pieces(spark, path)
    # a row or two for each range of the file
    sent = spark.sparkContext.broadcast(begins(pieces.mapInArrow(_sums, _SUMMARY).collect()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, bool, bool, str]] = []
        here, quoted, depth, owner, number, whole, held = None, False, 0, None, 0, False, []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()), strict=True)], ["owner", "part", "whole", "ends", "text"])
            rows.clear()
            return out

        for where, piece in _ranges(batches):
            if where != here:
                if held:
                    rows.append((owner, number, False, False, "".join(held)))
                begin = sent.value[where]
                here, quoted, depth, owner, number, whole, held = where, begin.quoted, begin.depth, begin.owner, begin.number, False, []
            at = 0 if depth else first_brace(piece, quoted)
            if not depth and at >= 0:
                owner, whole = f"{where[0]}#{where[1]}", True
            did = change(piece, quoted)
            quoted = did.quoted
            if depth or at >= 0:
                held += [piece[at:], "}"]
                depth = max(depth + did.a, did.b)
                if depth == 0:
                    rows.append((owner, number, whole, True, "".join(held)))
                    held, whole = [], False
            if len(rows) >= 1_000:
                yield batch()
        if held:
            rows.append((owner, number, False, False, "".join(held)))
        if rows:
            yield batch()

    parts = pieces.mapInArrow(cut, _PARTS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "")
    stitched = parts.where("not whole").groupBy("owner").agg(joined.alias("entry"), F.max("ends").alias("ends"))
    return parts.where("whole").select(F.col("text").alias("entry")).unionByName(stitched.where("ends").select("entry"))
