"""Benchmark decontamination (DataFrame functions only).

A document leaks an item if one of its windows, as many words long as the item, is similar to the item:
multiset Jaccard similarity of their 5-word shingles at `SIMILARITY` or more, over lower-cased words of letters and digits.

1. A similar window shares a shingle with its item. The items' shingles (broadcast if small, else a hash
   join) mark the places of a document where one starts. If a window is similar, so is the one
   that starts at its first marked place, or the last one that the document has room for: these are the windows tried.
2. Each window and item gets a 64-bit SimHash of its shingles. Cut in 4 blocks of 16 bits, two fingerprints within `RADIUS`
   bits differ in at most three bits in one block, so the 697 values of that block's Hamming ball, kept per item,
   find every item of the window's length within the radius. Of unrelated fingerprints some 4 % meet in a block. These values are 2,788 rows an
   item, so they are shuffled, not broadcast, unless they are few; each fingerprint of a window's length looks them up once, however many windows have it.
3. Candidates are verified by their exact weighted shingles.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.llm.shared import keep_columns, let, materialise
from orgweave.plans.settle import spread

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BALL = 4, 16, 3
#: BLOCKS * (BALL + 1) - 1: some block of two fingerprints no further apart than this differs in BALL bits or fewer.
RADIUS = BLOCKS * (BALL + 1) - 1
#: Rows (of some 160 bytes as a hash table) of the items' tables up to which they are broadcast; ten times as many array elements (of 8 bytes) in tables of arrays.
BROADCAST_ROWS = 100_000
#: Distinct shingles of items up to which the documents' shingles are looked up in a literal table.
LITERAL_ROWS = 200_000
LITERAL_BUCKETS = 1 << 14


def word_array(text: Column) -> Column:
    """Lower-cased words of letters and digits; null: none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingled(text: Column) -> Column:
    """struct(n, hashes): the number of words, and the hash of the shingle that starts at each; fewer words are one shingle."""

    def hashes(words: Column) -> Column:
        n = F.size(words)
        each = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
        short = F.when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(n.alias("n"), F.when(n >= SHINGLE, each).otherwise(short).alias("hashes"))

    return let(word_array(text), hashes)


def _literal(marks: DataFrame) -> Callable[[Column], Column]:
    """Whether a hash is among the collected `h` of `marks`, by a literal hash table."""
    buckets: list[list[int]] = [[] for _ in range(LITERAL_BUCKETS)]
    for row in marks.collect():
        buckets[row["h"] % LITERAL_BUCKETS].append(row["h"])
    literal = F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")
    return lambda h: F.array_contains(F.get(literal, F.pmod(h, F.lit(LITERAL_BUCKETS)).cast("int")), h)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): a row is known by its doc_id and a hash of its text."""
    slim = keep_columns(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    return slim.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _hit_documents(docs: DataFrame, item_shingles: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, hashes, places array<struct(p, h)>): the documents in which an item's shingle starts, with the places of all such starts.

    Up to `LITERAL_ROWS` distinct shingles of items are looked up within the row, in a literal hash table, so that no text is shuffled;
    more are joined.
    """
    marks = item_shingles.select("h").distinct()
    if marks.count() <= LITERAL_ROWS:
        known = _literal(marks)

        def placed(x: Column) -> Column:
            each = F.transform(x["hashes"], lambda h, i: F.struct(i.alias("p"), h.alias("h")))
            found = F.filter(each, lambda e: known(e["h"]))
            return F.struct(x["n"].alias("n"), x["hashes"].alias("hashes"), found.alias("places"))

        # (a filter on a projected column would be pushed below it and compute the hashes twice)
        rows = F.filter(F.array(let(shingled(F.col("text")), placed)), lambda x: F.size(x["places"]) > 0)
        return docs.select("doc_id", "text_key", F.explode(rows).alias("x")).select("doc_id", "text_key", "x.*")
    each = docs.select("doc_id", "text_key", F.posexplode(let(shingled(F.col("text")), lambda x: x["hashes"])).alias("p", "h"))
    places = each.join(_small(marks), "h").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("p", "h")).alias("places"))
    rows = docs.join(places, ["doc_id", "text_key"]).select("doc_id", "text_key", shingled(F.col("text")).alias("x"), "places")
    return rows.select("doc_id", "text_key", "x.n", "x.hashes", "places")


def _simhash(rows: DataFrame, keys: list[str], h: str) -> DataFrame:
    """One row per key: sim, the SimHash of the hashes `h`, repeats counted."""
    bits = [F.expr(f"sum(shiftrightunsigned({h}, {i}) & 1)").alias(f"_b{i}") for i in range(64)]
    summed = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *bits)
    sim = " | ".join(f"if(2 * _b{i} > _n, shiftleft(1L, {i}), 0L)" for i in range(64))
    return summed.select(*keys, F.expr(sim).alias("sim"))


def _blocks(sim: str) -> Column:
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> named_struct('no', b, 'value', cast(shiftrightunsigned({sim}, b * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1} as int)))")


def _small(df: DataFrame, arrays: str | None = None) -> DataFrame:
    """Marked for broadcast only if its counted rows, or the elements of its column `arrays`, allow it; else joins shuffle."""
    size = df.count() if arrays is None else df.agg(F.coalesce(F.sum(F.size(arrays) + 5), F.lit(0))).first()[0] / 10
    # (unhinted, Spark would broadcast a table that is exploded from few rows by the size of those)
    return F.broadcast(df) if size <= BROADCAST_ROWS else df.hint("merge")


def _meetings(sims: DataFrame, item_sims: DataFrame) -> DataFrame:
    """sims (len, sim) × item_sims (item_id, len, sim) → (len, sim, item_id): the items of that length within `RADIUS` of each fingerprint."""
    # all values of a block with at most BALL bits set
    near = F.expr(f"filter(sequence(0, {(1 << BLOCK_BITS) - 1}), v -> bit_count(v) <= {BALL})")
    table = spread(item_sims, "item_id", "len").select("item_id", "len", F.col("sim").alias("item_sim"), F.explode(_blocks("sim")).alias("b"))
    table = table.select("item_id", "len", "item_sim", "b.no", F.explode(F.transform(near, lambda v: v.bitwiseXOR(F.col("b.value")))).alias("value"))
    probes = sims.select("len", "sim").distinct().select("len", "sim", F.explode(_blocks("sim")).alias("b")).select("len", "sim", "b.no", "b.value")
    found = probes.join(_small(table), ["len", "no", "value"]).where(f"bit_count(sim ^ item_sim) <= {RADIUS}")
    return found.select("len", "sim", "item_id").distinct()


def _numbered(hashes: Column) -> Column:
    """The hashes with each repeat replaced by a hash of it and its number, so that the intersection of two such arrays counts repeats. Linear but for the sort."""

    def by_runs(x: Column) -> Column:
        def spelt(starts: Column) -> Column:
            def run(b: Column, j: Column) -> Column:
                last = F.coalesce(F.get(starts, j + 1), F.size(x)) - 1
                return F.transform(F.sequence(b, last), lambda i: F.when(i == b, F.get(x, b)).otherwise(F.xxhash64(F.get(x, b), i - b)))

            return F.flatten(F.transform(starts, run))

        return let(F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i - 1) != F.get(x, i))), spelt)

    return F.when(F.size(hashes) == 0, hashes).otherwise(let(F.array_sort(hashes), by_runs))


def _short_leaks(docs: DataFrame, short: DataFrame) -> DataFrame | None:
    """The rows of `find_leaks` for items of fewer words than a shingle: windows of the item's own length that equal it. None without such items."""
    lengths = sorted(r["len"] for r in short.select("len").distinct().collect())
    if not lengths:
        return None
    marks = short.select("h").distinct()
    known = _literal(marks) if marks.count() <= LITERAL_ROWS else None

    def of_length(words: Column, k: int) -> Column:
        hashed = lambda i: F.struct(i.alias("p"), F.lit(k).alias("len"), F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, k))).alias("h"))
        each = F.transform(F.sequence(F.lit(0), F.size(words) - k), hashed)
        return F.when(F.size(words) >= k, each).otherwise(F.array().cast("array<struct<p:int,len:int,h:bigint>>"))

    def windows(words: Column) -> Column:
        each = F.concat(*[of_length(words, k) for k in lengths])
        return each if known is None else F.filter(each, lambda e: known(e["h"]))

    each = docs.select("doc_id", "text_key", F.explode(let(word_array(F.col("text")), windows)).alias("w")).select("doc_id", "text_key", "w.*")
    found = each.join(_small(short), ["len", "h"]).groupBy("doc_id", "text_key", "item_id", "len").agg(F.min("p").alias("s"))
    # an id may have several texts; the main search keeps one row too, the first of its equals
    best = found.groupBy("doc_id", "text_key", "item_id").agg(F.min(F.struct("s", "len")).alias("m"))
    return best.select("doc_id", "text_key", "item_id", F.col("m.s").cast("long").alias("window_start"), F.col("m.len").cast("long").alias("window_words"), F.lit(1.0).alias("similarity"))


def find_leaks(docs: DataFrame, items: DataFrame, short_items: bool = False) -> DataFrame:
    """(doc_id, item_id, window_start, window_words, similarity): of each leaked item its most similar window in each document, the first of equals.

    Null ids and texts without words are not compared; a document shorter than the item is one window. An item of fewer words than a
    shingle is one shingle of all its words, which only a document of just these words has; with `short_items`, as in the registered
    query and the pipeline, it is found wherever these words follow each other. Rows that share a doc_id
    are searched each for itself, and the best of their windows is returned; items with the same item_id and text count once. Extra columns
    are ignored, empty tables give no rows.
    """
    fields = F.struct("similarity", (-F.col("window_start")).alias("order"), "window_words")
    best = _text_leaks(docs, items, short_items).groupBy("doc_id", "item_id").agg(F.max(fields).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.order")).alias("window_start"), F.col("m.window_words").alias("window_words"), F.col("m.similarity").alias("similarity"))


def _text_leaks(docs: DataFrame, items: DataFrame, short_items: bool) -> DataFrame:
    """`find_leaks` with text_key beside doc_id: rows of one item may come twice, from its longer and its shorter text."""
    item_words = keep_columns(items, "item_id", "text").where("item_id is not null").distinct()
    item_words = item_words.select("item_id", shingled(F.col("text")).alias("x"))
    item_words = materialise(item_words.select("item_id", F.col("x.n").alias("len"), "x.hashes").where("len > 0"), "items")
    slim = _keyed(docs)
    short = None
    if short_items:
        short = _short_leaks(slim, item_words.where(f"len < {SHINGLE}").select("item_id", "len", F.col("hashes")[0].alias("h")))
        item_words = item_words.where(f"len >= {SHINGLE}")
    item_shingles = item_words.select("item_id", "len", F.explode("hashes").alias("h"))

    # 1. places where an item's shingle starts, in the documents that have any
    hit = materialise(_hit_documents(slim, item_shingles), "hit-documents")
    lengths = item_shingles.groupBy("h").agg(F.collect_set("len").alias("lens"))
    places = hit.select("doc_id", "text_key", "n", F.explode("places").alias("x")).select("doc_id", "text_key", "n", "x.p", "x.h").join(_small(lengths), "h")
    starts = places.select("doc_id", "text_key", "n", "p", F.explode("lens").alias("len")).select("doc_id", "text_key", "len", F.expr("greatest(0, least(p, n - len))").alias("s")).distinct()
    wanted = starts.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("len", "s")).alias("wanted"))

    def cut(w: Column) -> Column:
        part = F.slice("hashes", w["s"] + 1, F.greatest(F.lit(1), w["len"] - (SHINGLE - 1)))
        return F.struct(w["len"].alias("len"), w["s"].alias("s"), part.alias("hashes"), F.least(w["len"], F.col("n") - w["s"]).alias("words"))

    window = hit.dropDuplicates(["doc_id", "text_key"]).join(wanted, ["doc_id", "text_key"]).select("doc_id", "text_key", F.explode(F.transform("wanted", cut)).alias("w"))
    window = materialise(window.select("doc_id", "text_key", "w.*"), "leak-windows")

    # 2. fingerprints and blocks
    keys = ["doc_id", "text_key", "len", "s"]
    window_sims = materialise(_simhash(window.select(*keys, F.explode("hashes").alias("h")), keys, "h"), "window-sims")
    item_sims = _simhash(item_shingles, ["item_id", "len"], "h")
    found = window_sims.join(_meetings(window_sims, item_sims), ["len", "sim"]).select(*keys, "item_id")

    # 3. exact weighted shingles: sum of the smaller over sum of the larger counts
    candidates = found.join(window, keys).join(_small(item_words.select("item_id", F.col("hashes").alias("item_hashes")), "item_hashes"), "item_id")
    both = candidates.withColumn("both", F.size(F.array_intersect(_numbered(F.col("hashes")), _numbered(F.col("item_hashes")))))
    scored = both.withColumn("similarity", F.expr("both / cast(size(hashes) + size(item_hashes) - both as double)")).where(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("s")).alias("order"), F.col("words"))).alias("m"))
    out = best.select(
        "doc_id",
        "text_key",
        "item_id",
        (-F.col("m.order")).cast("long").alias("window_start"),
        F.col("m.words").cast("long").alias("window_words"),
        F.round("m.similarity", 6).alias("similarity"),
    )
    return out if short is None else out.unionByName(short)


def remove_leaks(docs: DataFrame, items: DataFrame, short_items: bool = False) -> DataFrame:
    """`docs` without the rows whose text leaks an item; all columns kept. Rows without a doc_id or a text stay."""
    bad = _text_leaks(docs, items, short_items).select(F.col("doc_id").alias("_leak_id"), F.col("text_key").alias("_leak_key")).distinct()
    return docs.join(bad, (docs["doc_id"] == bad["_leak_id"]) & (F.xxhash64(docs["text"]) == bad["_leak_key"]), "left_anti")
