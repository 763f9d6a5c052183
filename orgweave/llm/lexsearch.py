"""Ranked lexical search by Block-Max WAND.

The index is a table of segments. A segment holds the postings of at most `SEGMENT_DOCS` documents and some `SEGMENT_POSTINGS` postings, made by
the task that reads these documents, so that no posting is shuffled. A term's list is cut in blocks of `BLOCK` postings; a block's document gaps
and frequencies are packed in the fewest bytes of one width. Beside it stand its first and last document and its competitive pairs (frequency,
length): those that no other posting of the block beats in both. As an impact grows with the frequency and falls with the length, the greatest
impact of the pairs is the block's maximum under any corpus statistics, and the index needs none to be built.

A search walks each segment for each item:

1. Shallow moves: the maxima of the blocks above a document bound its score; a list of one block counts for the documents it names only. Documents
   whose bound is below the threshold, the worst of the item's best so far, are passed over, and blocks of theirs alone are never unpacked.
2. The documents of the greatest bounds go first and raise the threshold, the others follow in document order, a run of pivots at a time. In a run the
   lists are opened from the greatest impact down, each maximum being replaced by the true impact; documents that fall below the threshold leave.
3. A task keeps each item's best over all its segments; a window over what the tasks kept ranks them.

Scores are integers, so results are exact and don't depend on how documents are split.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orgweave.llm.shared import materialise, small_batches

BLOCK = 128
SEGMENT_DOCS = 1 << 16
SEGMENT_POSTINGS = 1_000_000
#: Pivots of a run.
RUN = 2_048
#: Items whose terms are sent to executors together; more are searched in turns.
ITEMS_PER_TURN = 5_000
#: Stands for a null doc_id, which comes last among equals.
NO_ID = (1 << 63) - 1

#: A-Z to a-z, other bytes below 128 but a-z and 0-9 to a blank.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, digits and all that is not ASCII; only A-Z are lower-cased."""
    return (text or b"").translate(_FOLD).split()


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document of n terms."""
    m = 50 + (50 * n * docs) // max(total, 1)
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _width(values: np.ndarray) -> int:
    return 1 if values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_INDEX = pa.schema(
    [
        ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", _LONGS), ("lengths", _INTS), ("terms", pa.list_(pa.binary())), ("df", _INTS), ("blocks", _INTS),
        ("first", _INTS), ("last", _INTS), ("gap_width", _INTS), ("tf_width", _INTS), ("size", _INTS), ("pairs", _INTS), ("pair_tf", _INTS), ("pair_n", _INTS), ("payload", pa.binary()),
    ]
)
INDEX_SCHEMA = (
    "n_docs long, n_terms long, doc_ids array<long>, lengths array<int>, terms array<binary>, df array<int>, blocks array<int>, first array<int>, last array<int>, "
    "gap_width array<int>, tf_width array<int>, size array<int>, pairs array<int>, pair_tf array<int>, pair_n array<int>, payload binary"
)


class _Builder:
    """The documents of a segment in the making. n_docs and n_terms count all of them, the table of documents those with an indexed term."""

    def __init__(self) -> None:
        self.n_docs = self.n_terms = self.postings = 0
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.lists: dict[bytes, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))

    def add(self, doc_id: int, words: list[bytes], wanted: frozenset[bytes] | None) -> None:
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        found = [(t, c) for t, c in Counter(words).items() if wanted is None or t in wanted]
        if not found:
            return
        no = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.postings += len(found)
        for t, c in found:
            docs, tfs = self.lists[t]
            docs.append(no)
            tfs.append(c)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.postings >= SEGMENT_POSTINGS

    def row(self) -> pa.RecordBatch:
        lengths = np.array(self.lengths, np.int64)
        out: dict[str, list] = {k: [] for k in _INDEX.names[4:-1]}
        payload = []
        for term in sorted(self.lists):
            docs, tfs = (np.array(x, np.int64) for x in self.lists[term])
            out["terms"].append(term)
            out["df"].append(len(docs))
            out["blocks"].append(-(-len(docs) // BLOCK))
            for i in range(0, len(docs), BLOCK):
                d, f = docs[i : i + BLOCK], tfs[i : i + BLOCK]
                gaps = np.diff(d, prepend=d[0])
                n = lengths[d]
                order = np.lexsort((n, -f))
                least = np.minimum.accumulate(n[order])
                best = order[np.r_[True, least[1:] < least[:-1]]]
                widths = _width(gaps), _width(f)
                for key, value in zip(("first", "last", "gap_width", "tf_width", "size", "pairs"), (d[0], d[-1], *widths, len(d), len(best)), strict=True):
                    out[key].append(int(value))
                out["pair_tf"] += f[best].tolist()
                out["pair_n"] += n[best].tolist()
                payload += [gaps.astype(f"<u{widths[0]}").tobytes(), f.astype(f"<u{widths[1]}").tobytes()]
        values = [self.n_docs, self.n_terms, self.ids, self.lengths, *out.values(), b"".join(payload)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _INDEX.types, strict=True)], schema=_INDEX)


def build_index(docs: DataFrame, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """The segments of `docs` (doc_id, text); with `wanted`, postings of these terms only, while documents and lengths count all terms."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Builder()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.add(NO_ID if doc is None else doc, terms_of(text.as_py()), sent.value)
                if held.full():
                    yield held.row()
                    held = _Builder()
        if held.n_docs:
            yield held.row()

    slim = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(run, INDEX_SCHEMA)


class Segment:
    """A segment opened for search: blocks are unpacked when a search needs them, and then kept for the segment's other items."""

    def __init__(self, row: dict[str, pa.Scalar], docs: int, total: int):
        get = lambda name: row[name].values.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids, self.lengths = get("doc_ids"), get("lengths")
        self.first, self.last, self.size = get("first"), get("last"), get("size")
        self.widths = get("gap_width"), get("tf_width")
        ends = np.cumsum(get("blocks"))
        self.lists = {t: (int(e - b), int(e)) for t, b, e in zip(row["terms"].as_py(), get("blocks"), ends, strict=True)}
        self.at = np.r_[0, np.cumsum(self.size * (self.widths[0] + self.widths[1]))]
        self.payload = row["payload"].as_buffer()
        self.docs, self.total = docs, total
        pairs = get("pairs")
        each = impact(get("pair_tf"), get("pair_n"), docs, total)
        self.most = np.maximum.reduceat(each, np.cumsum(pairs) - pairs) if len(pairs) else each
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def open(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        known = self.opened.get(block)
        if known is None:
            at, n = int(self.at[block]), int(self.size[block])
            wide, high = int(self.widths[0][block]), int(self.widths[1][block])
            docs = self.first[block] + np.cumsum(np.frombuffer(self.payload, f"<u{wide}", n, at).astype(np.int64))
            tf = np.frombuffer(self.payload, f"<u{high}", n, at + n * wide).astype(np.int64)
            known = self.opened[block] = docs, impact(tf, self.lengths[docs], self.docs, self.total)
        return known


class Best:
    """The k best (score, doc_id) of an item so far: higher scores first, then lower ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        """What a score must reach; documents that reach it may still be later among equals."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _open_lists(segment: Segment, lists: list[tuple[int, int, int]], bounds: np.ndarray, pivots: np.ndarray, best: Best) -> None:
    """Score a run of pivots (ascending), whose bounds are given, and keep the best."""
    now = bounds[pivots]
    for begin, end, w in lists:
        stay = now >= best.threshold
        pivots, now = pivots[stay], now[stay]
        if not len(pivots):
            return
        block = begin + np.searchsorted(segment.last[begin:end], pivots)
        above = np.flatnonzero(block < end)
        above = above[segment.first[block[above]] <= pivots[above]]
        block = block[above]
        change = np.zeros(len(pivots), np.int64)
        if end - begin > 1:  # a list of one block has bound its own documents only
            change[above] = -w * segment.most[block]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        for i, j in zip(cuts, np.append(cuts, len(block))[1:], strict=True):
            docs, impacts = segment.open(int(block[i]))
            mine = above[i:j]
            place = np.searchsorted(docs, pivots[mine])
            has = docs[place] == pivots[mine]
            change[mine[has]] += w * impacts[place[has]]
            if end - begin == 1:
                change[mine[has]] -= w * segment.most[block[i]]
        now = now + change
    stay = now >= best.threshold
    best.add(now[stay], segment.ids[pivots[stay]])


def search_segment(segment: Segment, weights: dict[bytes, int], best: Best) -> None:
    """Let the documents of a segment into the best of an item with these weighted terms."""
    lists = [(*segment.lists[t], w) for t, w in weights.items() if w > 0 and t in segment.lists]
    if not lists:
        return
    steps, named = np.zeros(len(segment.ids) + 1, np.int64), np.zeros(len(segment.ids), np.int64)
    for begin, end, w in lists:
        if end - begin == 1:
            named[segment.open(begin)[0]] += w * segment.most[begin]
        else:
            most = w * segment.most[begin:end]
            steps[segment.first[begin:end]] += most
            steps[segment.last[begin:end] + 1] -= most
    bounds = np.cumsum(steps[:-1]) + named
    # the lists that tell most come first: short ones, then those of the greatest impact
    lists.sort(key=lambda x: (x[1] - x[0] > 1, -x[2] * int(segment.most[x[0] : x[1]].max())))
    todo = np.flatnonzero(bounds >= best.threshold)
    lead = min(2 * best.k, len(todo))
    if not lead:
        return
    first = np.sort(todo[np.argpartition(-bounds[todo], lead - 1)[:lead]])
    _open_lists(segment, lists, bounds, first, best)
    todo = np.setdiff1d(todo[bounds[todo] >= best.threshold], first, assume_unique=True)
    for i in range(0, len(todo), RUN):
        run = todo[i : i + RUN]
        run = run[bounds[run] >= best.threshold]
        if len(run):
            _open_lists(segment, lists, bounds, run, best)


def _search_turn(index: DataFrame, items: list[tuple[object, dict[bytes, int]]], id_type: pa.DataType, id_name: str, docs: int, total: int, k: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in sent.value]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment({n: batch.column(n)[i] for n in batch.schema.names}, docs, total)
                for (_, weights), mine in zip(sent.value, best, strict=True):
                    search_segment(segment, weights, mine)
        for (item, _), mine in zip(sent.value, best, strict=True):
            if len(mine.ids):
                ids = pa.array(mine.ids, mask=mine.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), id_type), ids, pa.array(mine.scores)], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, f"item_id {id_name}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0, equal scores by ascending doc_id.

    docs: doc_id, text; items: item_id, text. The index is built for the items' terms; corpus counts cover all terms of all documents.
    Null texts have no terms. Rows that repeat or share a doc_id are documents each, and a null doc_id comes last among equals; rows that share
    an item_id are one item of all their terms. An item without a term that documents hold has no rows; empty tables give none. Extra columns
    are ignored. The items are the query set: their terms are held by the driver and sent out, `ITEMS_PER_TURN` items at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = items.schema["item_id"].dataType
    terms: dict[object, set[bytes]] = defaultdict(set)
    for row in items.select(F.col("`item_id`").alias("item_id"), F.col("`text`").cast("string").cast("binary").alias("text")).toLocalIterator():
        terms[row["item_id"]].update(terms_of(row["text"] and bytes(row["text"])))
    index = materialise(build_index(docs, frozenset().union(*terms.values())), "lexical-index")
    sums = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, total = int(sums[0] or 0), int(sums[1] or 0)
    # one row per term of the items
    counted = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    weights = {bytes(r["term"]): weight(n_docs, r["df"]) for r in counted.toLocalIterator()}
    # ids in a fixed order; terms that no document holds score nothing
    known = [(item, {t: weights[t] for t in sorted(words) if t in weights}) for item, words in sorted(terms.items(), key=lambda x: (x[0] is not None, x[0]))]
    known = [x for x in known if x[1]]
    turns = [known[i : i + ITEMS_PER_TURN] for i in range(0, len(known), ITEMS_PER_TURN)] or [[]]
    found = None
    for turn in turns:
        part = _search_turn(index, turn, to_arrow_type(kind), kind.simpleString(), n_docs, total, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
