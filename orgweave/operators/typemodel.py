"""Types of organisations by two softmax regressions over hashed n-grams of their names, trained from labelled names.

The second level is conditioned on the first: its model sees the first level as a feature, and only types that occur under the first one's choice, and agree with its
prefix, may follow, so the two levels are consistent by construction. Training is full-batch descent with momentum over a bounded sample; scoring runs over distinct names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions import lexicons as L
from orgweave.providers import Provider

#: Labelled names that are learned from at most, those of the least hashes.
MAX_NAMES = 20_000
BUCKETS = 1 << 14
STEPS = 120
#: A first level that is less likely than this is `Unknown`.
LEAST = 0.35
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def columns(name: str, lvl1: str | None = None) -> np.ndarray:
    """The hashed words and n-grams of a name, and its first level if that is known."""
    parts = set()
    words = _WORD.findall(name.lower())
    for w in words:
        padded = f" {w} "
        parts.update([f"w {w}", *[padded[i : i + k] for k in (3, 4, 5) for i in range(len(padded) - k + 1)]])
    parts.update(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
    if lvl1 is not None:
        parts.add(f"1 {lvl1}")
    return np.unique(np.array([zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts] or [0], np.int64))


@dataclass(frozen=True)
class Softmax:
    classes: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, cols: np.ndarray) -> np.ndarray:
        z = self.weights[cols].sum(axis=0) / math.sqrt(len(cols)) + self.bias
        p = np.exp(z - z.max())
        return p / p.sum()


def fit(rows: list[np.ndarray], labels: list[str], steps: int = STEPS, rate: float = 2.0, l2: float = 1e-4) -> Softmax:
    """A softmax regression on rows of columns, each row of unit length."""
    classes = tuple(sorted(set(labels)))
    y = np.array([classes.index(x) for x in labels])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.zeros(0, np.int64)])
    value = np.repeat([1 / math.sqrt(len(r)) for r in rows], [len(r) for r in rows])
    by_col = np.argsort(col, kind="stable")
    used, starts = np.unique(col[by_col], return_index=True)
    row_starts = np.searchsorted(row, np.arange(len(rows)))
    w, b = np.zeros((BUCKETS, len(classes))), np.zeros(len(classes))
    vw, vb = np.zeros_like(w[used]), np.zeros_like(b)
    for _ in range(steps):
        z = np.add.reduceat(value[:, None] * w[col], row_starts, axis=0) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        grad = np.add.reduceat(value[by_col, None] * p[row[by_col]], starts, axis=0) / len(rows) + l2 * w[used]
        vw, vb = 0.9 * vw - rate * grad, 0.9 * vb - rate * p.mean(axis=0)
        w[used] += vw
        b += vb
    return Softmax(classes, w, b)


@dataclass(frozen=True)
class TypeModel:
    first: Softmax | None
    second: Softmax | None
    #: The second levels that occur under each first one.
    under: dict[str, tuple[str, ...]]

    def classify(self, name: str | None) -> tuple[str, str | None]:
        if self.first is None or not (name or "").strip():
            return "Unknown", None
        p = self.first.probabilities(columns(name))
        best = int(p.argmax())
        if p[best] < LEAST:
            return "Unknown", None
        lvl1 = self.first.classes[best]
        allowed = self.under.get(lvl1, ())
        if self.second is None or not allowed:
            return lvl1, None
        q = self.second.probabilities(columns(name, lvl1))
        return lvl1, max(allowed, key=lambda c: (q[self.second.classes.index(c)], c))

    def provider(self) -> Provider:
        """(name, country) → (name, country, lvl1, lvl2), as `orgtype.classify` asks for; a name is looked at once, whatever its countries."""

        def provide(df: DataFrame) -> DataFrame:
            sent = df.sparkSession.sparkContext.broadcast(self)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    known: dict[str | None, tuple[str, str | None]] = {}
                    names = batch.column(0).to_pylist()
                    for n in set(names):
                        known[n] = sent.value.classify(n)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([known[n][0] for n in names]), pa.array([known[n][1] for n in names], pa.string())], ["name", "country", "lvl1", "lvl2"])

            return df.select("name", "country").mapInArrow(run, "name string, country string, lvl1 string, lvl2 string")

        return provide


def train(labelled: DataFrame, max_names: int = MAX_NAMES) -> TypeModel:
    """A model from (name, lvl1, lvl2). Null and blank names and names without a lvl1 are left out, a null lvl2 says nothing of the second level.

    Of a name with several labels the least counts. Second levels that contradict the first one's prefix are not learned. Without a labelled name all is `Unknown`.
    """
    known = labelled.where("trim(name) <> '' and trim(lvl1) <> ''").groupBy("name").agg(F.min(F.struct("lvl1", "lvl2")).alias("t"))
    rows = known.orderBy(F.xxhash64("name"), "name").limit(max_names).select("name", "t.*").collect()
    if not rows:
        return TypeModel(None, None, {})
    first = fit([columns(r["name"]) for r in rows], [r["lvl1"] for r in rows])
    fits = lambda r: r["lvl2"] is not None and r["lvl2"].startswith(L.ORG_TYPE_PREFIX.get(r["lvl1"], ""))
    deep = [r for r in rows if fits(r)]
    under: dict[str, set[str]] = {}
    for r in deep:
        under.setdefault(r["lvl1"], set()).add(r["lvl2"])
    second = fit([columns(r["name"], r["lvl1"]) for r in deep], [r["lvl2"] for r in deep]) if deep else None
    return TypeModel(first, second, {k: tuple(sorted(v)) for k, v in under.items()})
