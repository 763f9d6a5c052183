"""Line dedup over overlapping windows of three lines (DataFrame functions only).

Lines are what newlines separate. Each run of three consecutive lines is a window; of equal windows,
in the order of (doc_id, text, line), all but the first are repeats. A line is removed if a repeat covers it.
Texts of fewer than three lines have no window and stay as they are. A document is known by its doc_id and text, so that rows
which share a doc_id but not the text are documents of their own; texts are ordered by `text_key`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.llm.shared import keep_columns, let, materialise, spare

LINES = 3


def text_key(text: str = "text") -> Column:
    return F.substring(F.md5(F.col(f"`{text}`").cast("binary")), 1, 16)


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, k1, k2): each window's first line (from 0) and its two 64-bit keys."""

    def keys(lines: Column) -> Column:
        def pair(i: Column) -> Column:
            one, two, three = (F.get(lines, i + j) for j in range(LINES))
            return F.struct(F.xxhash64(one, two, three).alias("k1"), F.xxhash64(F.lit("second"), three, F.length(two), two, one).alias("k2"))

        none = F.array().cast("array<struct<k1:bigint,k2:bigint>>")
        return F.when(F.size(lines) >= LINES, F.transform(F.sequence(F.lit(0), F.size(lines) - LINES), pair)).otherwise(none)

    split = keep_columns(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    out = split.select("doc_id", text_key().alias("text_key"), F.posexplode(let(F.split("text", "\n", -1), keys)).alias("pos", "k"))
    return out.select("doc_id", "text_key", "pos", "k.k1", "k.k2")


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, gone): the sorted, distinct numbers (from 0) of the lines that repeats cover; documents with any."""
    table = materialise(windows(docs), "line-windows")
    place = F.struct("doc_id", "text_key", "pos")
    first = table.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("k1", "k2", "first")
    # (written, so that the join has two plain exchanges and a very common window can be split)
    first = materialise(first, "repeated-windows")
    later = table.join(first, ["k1", "k2"]).where(place > F.col("first"))
    lines = F.expr(f"flatten(transform(collect_set(pos), p -> sequence(p, p + {LINES - 1})))")
    return later.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(lines)).alias("gone"))


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated lines taken out of `text`, plus n_lines and n_removed.

    Every row stays, a text whose lines all go becomes empty. Null texts stay null (0 lines); rows with a
    null doc_id are neither compared nor changed. Rows with the same doc_id and text are one document given again, and all lose what
    it loses; rows with the same doc_id and other texts are compared like any two documents. Other columns pass through, but for
    any called n_lines or n_removed, which are replaced.
    """
    base = docs.drop("n_lines", "n_removed")
    name = spare("gone", base)
    gone = covered_lines(docs).select(F.struct("doc_id", "text_key", "gone").alias(name))
    joined = base.join(gone, (base["doc_id"] == gone[name]["doc_id"]) & (text_key() == gone[name]["text_key"]), "left")
    found = F.col(name)["gone"]
    lines = F.split(F.col("text"), "\n", -1)

    def cut(x: Column) -> Column:
        # the kept lines are the stretches between removed ones
        def stretch(i: Column) -> Column:
            start = F.coalesce(F.get(found, i - 1) + 1, F.lit(0))
            end = F.coalesce(F.get(found, i), F.size(x))
            return F.slice(x, start + 1, end - start)

        return F.concat_ws("\n", F.flatten(F.transform(F.sequence(F.lit(0), F.size(found)), stretch)))

    return joined.select(
        *[F.col(f"`{c}`") if c != "text" else F.when(found.isNull(), F.col("text")).otherwise(let(lines, cut)).alias("text") for c in base.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_removed"),
    )
