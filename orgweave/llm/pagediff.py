"""Main text of web pages by differencing each page with its nearest neighbour by URL.

The pages of a host in the order of their URL paths have those of the longest common path beginnings next to each other. Each page is paired with the
nearer of its two neighbours, passing over pages with the same longest line, which are copies or near copies of it and tell nothing of the template.
The two pages' lines are aligned by longest common subsequence, and lines that the two share are deleted. Furniture that HTML's vocabulary names (see
`pages`) is compared by the slot that it fills, anything else by its text: a menu with other links is still the same menu.

Two checks follow. A shared line inside an `<article>` stays, as it is a passage that two articles share; furniture that the neighbour lacks, and
open lines beside an article, go. On a page without an article, and in a `<main>` outside it, differencing alone decides.

Only hashes of lines are dealt out by ranges of URLs, so that a host may have any number of pages. Neighbours across the border of two
ranges meet by a table of the ranges' outermost pages, four to a range.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from orgweave.llm.hostrep import url_host, url_path
from orgweave.llm.pages import ARTICLE, FURNITURE, MAIN, OPEN, Block, aligned, blocks
from orgweave.llm.shared import materialise, small_batches

_SIDE = "struct<path:string,tokens:array<long>>"
_PLACED = (
    f"k1 long, k2 long, part int, host string, path string, longest long, tokens array<long>, free array<boolean>, before {_SIDE}, after {_SIDE}, opens boolean, closes boolean, edge int"
)
#: Rows beside the pages: a range's first and last page, and those next to its first and before its last run of equal pages.
FIRST, SECOND, LAST, LAST_BUT = 1, 2, 3, 4
#: Pages that a batch of placed pages has.
BATCH = 200


def _hash(kind: str, value: str | int) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {value}".encode("utf-8", "replace")) - (1 << 63)


def token(block: Block) -> int:
    """What two aligned lines have in common: the slot of furniture, the text of any other line."""
    return _hash("slot", block.slot) if block.kind == FURNITURE else _hash("text", block.text)


def page_key() -> tuple[Column, Column]:
    url, page = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    return F.xxhash64(url, page).alias("k1"), F.xxhash64(F.lit("second"), page, url).alias("k2")


def line_tokens(pages: DataFrame) -> DataFrame:
    """pages (url, html) → (host, path, k1, k2, longest, tokens, free): the lines' hashes, the longest text line's, and whether a line may be deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest, tokens, free = [], [], []
            for page in batch.column(4):
                lines = blocks(page.as_py())
                tokens.append([token(b) for b in lines])
                free.append([b.kind != ARTICLE for b in lines])
                text = max((b.text for b in lines if b.kind != FURNITURE), key=lambda t: (len(t), t), default=None)
                longest.append(0 if text is None else _hash("text", text))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(longest, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(free, pa.list_(pa.bool_()))], [*batch.schema.names[:4], "longest", "tokens", "free"]
            )

    small_batches(pages.sparkSession)
    slim = pages.select(url_host("url").alias("host"), url_path("url").alias("path"), *page_key(), "html").where("host <> ''")
    return slim.mapInArrow(run, "host string, path string, k1 long, k2 long, longest long, tokens array<long>, free array<boolean>")


def _run(page: dict) -> tuple[str, int]:
    return page["host"], page["longest"]


def _side(page: dict | None, host: str) -> dict | None:
    return None if page is None or page["host"] != host else {"path": page["path"], "tokens": page["tokens"]}


def _neighbours(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The pages of a range in order, each with its neighbours within the range: the pages next to its run of equal pages. Then the range's outermost pages."""
    run: list[dict] = []  # the run of equal pages that isn't over
    outer: dict | None = None  # the last page before that run
    edges: dict[int, dict] = {}
    out: list[dict] = []

    def over(after: dict | None) -> None:
        for page in run:
            out.append(page | {"before": _side(outer, page["host"]), "after": _side(after, page["host"]), "opens": outer is None, "closes": after is None, "edge": 0})

    for batch in batches:
        for page in batch.to_pylist():
            edges.setdefault(FIRST, page)
            if run and _run(page) != _run(run[0]):
                edges.setdefault(SECOND, page)
                over(page)
                outer, run = run[-1], []
            run.append(page)
        while len(out) >= BATCH:
            yield pa.RecordBatch.from_pylist(out[:BATCH], schema)
            del out[:BATCH]
    if run:
        over(None)
        edges[LAST] = run[-1]
        if outer is not None:
            edges[LAST_BUT] = outer
    out += [page | {"edge": edge} for edge, page in edges.items()]
    for i in range(0, len(out), BATCH):
        yield pa.RecordBatch.from_pylist(out[i : i + BATCH], schema)


def _across(edges: list[Row]) -> dict[int, tuple[dict | None, dict | None]]:
    """For each range what lies before its first run and after its last one, in whatever range that is."""
    ranges: dict[int, dict[int, Row]] = {}
    for e in edges:
        ranges.setdefault(e["part"], {})[e["edge"]] = e
    order = sorted(ranges)

    def beyond(i: int, step: int, mine: int, near: int, far: int) -> dict | None:
        page = ranges[order[i]][mine]
        i += step
        while 0 <= i < len(order):
            there = ranges[order[i]]
            for edge in (near, far):
                if edge in there and _run(there[edge]) != _run(page):
                    return _side(there[edge], page["host"])
            i += step  # a range of nothing but this run
        return None

    return {part: (beyond(i, -1, FIRST, LAST, LAST_BUT), beyond(i, 1, LAST, FIRST, SECOND)) for i, part in enumerate(order)}


def shared_lines(pages: DataFrame) -> DataFrame:
    """pages (url, html) → (k1, k2, shared): for each url and page that has a neighbour, the positions of the lines to delete."""
    spark = pages.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = line_tokens(pages).repartitionByRange(n, "host", "path", "k1", "k2").sortWithinPartitions("host", "path", "k1", "k2").withColumn("part", F.spark_partition_id())
    schema = to_arrow_schema(_parse_datatype_string(_PLACED))
    placed = materialise(dealt.mapInArrow(lambda batches: _neighbours(batches, schema), _PLACED), "page-neighbours")
    # four pages of each range
    sent = spark.sparkContext.broadcast(_across(placed.where("edge > 0").collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.to_pylist():
                before, after = sent.value[page["part"]]
                before = before if page["opens"] else page["before"]
                after = after if page["closes"] else page["after"]
                sides = [x for x in (before, after) if x is not None]
                if sides:
                    # the nearer one; of equals the one before
                    partner = max(sides, key=lambda x: len(commonprefix([x["path"], page["path"]])))
                    rows.append((page["k1"], page["k2"], [i for i in aligned(page["tokens"], partner["tokens"]) if page["free"][i]]))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["k1", "k2", "shared"])

    found = placed.where("edge = 0").mapInArrow(run, "k1 long, k2 long, shared array<int>")
    return found.dropDuplicates(["k1", "k2"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared: the main text of each row of `pages` (page_id, url, html), its length, and how many lines differencing deleted.

    Blocks of the article are joined by an empty line. A null or empty page, and one of furniture only, has an empty text. A page whose URL
    has no host, or that has no other page on its host, has no neighbour: only its furniture goes. Rows that repeat have equal texts; the same page
    under another URL of the host is a copy. Empty tables give no rows, extra columns are ignored.
    """
    small_batches(pages.sparkSession)
    slim = pages.select(F.col("`page_id`").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.col("`html`").cast("string").alias("html"))
    joined = slim.select("page_id", "url", "html", *page_key()).join(shared_lines(slim), ["k1", "k2"], "left").select("page_id", "url", "shared", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, deleted = [], []
            for shared, page in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                lines, gone = blocks(page.as_py()), frozenset(shared or ())
                article = any(b.kind == ARTICLE for b in lines)
                kept = (ARTICLE, MAIN) if article else (MAIN, OPEN)
                texts.append("\n\n".join(b.text for i, b in enumerate(lines) if i not in gone and b.kind in kept))
                deleted.append(len(gone))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(deleted, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_shared"])

    return joined.mapInArrow(run, f"page_id {slim.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_shared long")
