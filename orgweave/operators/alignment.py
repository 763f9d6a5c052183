"""A reranker that aligns words: a query's words are assigned to a document's by greatest total similarity, and what is left over counts against the pair.

Two words are as similar as their letters: 1 minus the edit distance over the longer length, nothing below `LEAST`; a word that begins the other, as an abbreviation does,
counts `PREFIX` at least. The best assignment is found exactly (Kuhn-Munkres with potentials). A pair's features are the weighted similarity of assigned words, the
weight of words left over on either side, and how far the order of words is kept; a word's weight is its inverse document frequency among the registry's names.
The features' weights are learned by pairwise logistic loss: of a query's documents the right one should come before the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.providers import Provider

LEAST = 0.45
PREFIX = 0.75
#: Words of a text that are aligned at most with each other by the exact assignment; what is longer is cut off at this many words of the greatest weight.
MAX_WORDS = 40
#: Pairs that the weights are learned from at most.
MAX_PAIRS = 20_000
#: Words whose document frequency is kept, the commonest; the others count as seen once.
MAX_FREQUENCIES = 200_000
STEPS = 400
_WORD = regex.compile(r"[\p{L}\p{N}]+")
FEATURES = ("assigned", "query left over", "document left over", "order", "exact")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def edits(a: str, b: str) -> int:
    """Edit distance."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    s = 1 - edits(a, b) / max(len(a), len(b))
    if min(len(a), len(b)) >= 2 and (a.startswith(b) or b.startswith(a)):
        s = max(s, PREFIX)
    return s if s >= LEAST else 0.0


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of greatest total gain, each row and column once; pairs that gain nothing are left out. Gains are not negative."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    row_of = np.zeros(m + 1, int)  # of each column, from 1; 0 is free
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[at] = True
            row = row_of[at]
            open_ = np.flatnonzero(~done[1:]) + 1
            reduced = cost[row - 1, open_ - 1] - u[row] - v[open_]
            better = reduced < least[open_]
            least[open_[better]], came[open_[better]] = reduced[better], at
            nearest = open_[least[open_].argmin()]
            step = least[nearest]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            at = nearest
            if row_of[at] == 0:
                break
        while at:
            row_of[at] = row_of[came[at]]
            at = came[at]
    pairs = [(row_of[j] - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return sorted((int(b), int(a)) if turned else (int(a), int(b)) for a, b in pairs if cost[a, b] < 0)


@dataclass(frozen=True)
class Aligner:
    texts: int = 0
    frequencies: dict[str, int] = field(default_factory=dict)
    #: Of the features, then the bias; by hand until learned.
    weights: tuple[float, ...] = (6.0, -3.0, -1.5, 0.5, 1.0, -2.0)

    def weight(self, word: str) -> float:
        return math.log((1 + self.texts) / (1 + self.frequencies.get(word, 1))) + 1

    def features(self, query: str | None, document: str | None) -> np.ndarray:
        """See `FEATURES`; all between 0 and 1."""
        a, b = words_of(query), words_of(document)
        pick = lambda ws: ws if len(ws) <= MAX_WORDS else [ws[i] for i in sorted(sorted(range(len(ws)), key=lambda i: (-self.weight(ws[i]), i))[:MAX_WORDS])]
        a, b = pick(a), pick(b)
        if not a or not b:
            return np.array([0.0, 1.0 if a else 0.0, 1.0 if b else 0.0, 0.0, 0.0])
        wa, wb = np.array([self.weight(w) for w in a]), np.array([self.weight(w) for w in b])
        alike = np.array([[similarity(x, y) for y in b] for x in a])
        pairs = assign(alike * np.minimum(wa[:, None], wb[None, :]))
        rows, cols = [i for i, _ in pairs], [j for _, j in pairs]
        total = wa.sum()
        assigned = sum(alike[i, j] * wa[i] for i, j in pairs) / total
        left_a = 1 - wa[rows].sum() / total
        left_b = 1 - wb[cols].sum() / wb.sum()
        order = np.mean([x < y for x, y in zip(cols, cols[1:], strict=False)]) if len(cols) > 1 else float(bool(cols))
        exact = sum(wa[i] for i, j in pairs if alike[i, j] == 1.0) / total
        return np.array([assigned, left_a, left_b, float(order), exact])

    def score(self, query: str | None, document: str | None) -> float:
        z = float(self.features(query, document) @ np.array(self.weights[:-1]) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def provider(self) -> Provider:
        """(query, document) → + rerank_score, as `linking.rerank` asks for."""

        def provide(df: DataFrame) -> DataFrame:
            sent = df.sparkSession.sparkContext.broadcast(self)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    scores = [round(sent.value.score(q, d), 9) for q, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["query", "document", "rerank_score"])

            return df.select(F.col("query").cast("string").alias("query"), F.col("document").cast("string").alias("document")).mapInArrow(run, "query string, document string, rerank_score double")

        return provide


def frequencies(names: DataFrame) -> tuple[int, dict[str, int]]:
    """How many (text) there are, and in how many of them a word is, for the `MAX_FREQUENCIES` commonest words."""
    known = names.where("text is not null").select("text").distinct()
    each = known.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1))).alias("word"))
    top = each.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(MAX_FREQUENCIES)
    return known.count(), {r["word"]: r["n"] for r in top.toLocalIterator()}


def fit(differences: np.ndarray, steps: int = STEPS, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Weights from differences of features, the right document's minus a wrong one's: the least mean logistic loss, held near 0 by `l2`."""
    w = np.zeros(differences.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -40, 40)))
        w += rate * (differences.T @ p / max(1, len(differences)) - l2 * w)
    return w


def train(names: DataFrame, pairs: DataFrame, max_pairs: int = MAX_PAIRS) -> Aligner:
    """An aligner from names (text), for the words' weights, and pairs (query, right, wrong), for the features'.

    At most `max_pairs` distinct pairs are learned from, those of the least hashes; nulls are left out. Without any the weights given by hand stay.
    The bias is such that a pair of features halfway between right and wrong ones scores a half.
    """
    texts, known = frequencies(names)
    base = Aligner(texts, known)
    rows = pairs.where("query is not null and right is not null and wrong is not null").select("query", "right", "wrong").distinct()
    rows = rows.orderBy(F.xxhash64("query", "right", "wrong"), "query", "right", "wrong").limit(max_pairs).collect()
    if not rows:
        return base
    right, wrong = (np.array([base.features(r["query"], r[c]) for r in rows]) for c in ("right", "wrong"))
    w = fit(right - wrong)
    return Aligner(texts, known, (*map(float, w), -float((right.mean(axis=0) + wrong.mean(axis=0)) @ w / 2)))
