"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, the rest of the evidence is unlabelled text. With class prior π the classifier minimises

    π R_p⁺(g) + max(0, R_u⁻(g) - π R_p⁻(g))

with the logistic loss; whenever the second term falls below zero, its gradient is turned round (Kiryo et al. 2017), so that
the fit does not profit from calling the toxic part of the unlabelled text harmless. Training is full-batch Adam in numpy.

Features of a text are the words it has and their prefixes of 4 and 5 letters, so that inflected and compounded forms of
a known term count. Those that `MIN_COUNT` confirmed toxic documents have, and have more often than unlabelled ones (`MIN_Z` standard deviations), enter
the model if toxic texts are `MIN_RATIO` times as likely to have them as clean ones. What that means against unlabelled texts, of which a share π
is toxic, is a lift of MIN_RATIO / (1 - π + MIN_RATIO π): always less than the 1/π that a purely toxic feature reaches, whatever π is.

Bounds of the training sample (chosen by hash, so alike for each run): `MAX_POSITIVE` and `MAX_UNLABELLED` documents at most, be they of
many ids or of one, `MAX_FEATURES` features. Scoring covers every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.llm.shared import materialise, small_batches

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 12_000
MAX_FEATURES = 50_000
SAMPLE_FILES = 16
MIN_Z = 4.0
#: Confirmed toxic documents that have a feature at least, near copies counted once.
MIN_COUNT = 5
#: How many times as often toxic texts have a feature as clean ones do.
MIN_RATIO = 6.0
#: Features of the highest z by whose greatest lift the share of toxic texts among the unlabelled is first estimated.
PEAK = 20
#: An estimated prior is raised by this factor, as too low a prior holds the scores of clear cases down while too high a one meets the risk's floor.
PRIOR_MARGIN = 1.1
THRESHOLD = 0.7
PREFIXES = (4, 5)
_WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """Words of a text, and `<prefix>~` for each prefix of a longer word."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for k in PREFIXES:
        out.update([w[:k] + "~" for w in words if len(w) > k])
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        words = set(_WORD.findall((text or "").lower()))
        known = self.weights
        hits = [known[w] for w in words if w in known]
        for k in PREFIXES:
            hits += [known[p] for p in {w[:k] + "~" for w in words if len(w) > k} if p in known]
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + sum(sorted(hits)), -40, 40))))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class _Rows:
    """Documents as the numbers of the features they have."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def logits(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + b

    def pull(self, g: np.ndarray, dim: int) -> np.ndarray:
        """Gradient by weights and bias from that by logits."""
        return np.append(np.bincount(self.col, g[self.row], dim), g.sum())


def risk_parts(pos: _Rows, unl: _Rows, w: np.ndarray, b: float, prior: float) -> tuple[float, float]:
    """π R_p⁺ and R_u⁻ - π R_p⁻; the risk is the first plus what the second has above 0."""
    softplus = lambda z: np.logaddexp(0, z)
    zp, zu = pos.logits(w, b), unl.logits(w, b)
    return float(prior * softplus(-zp).mean()), float(softplus(zu).mean() - prior * softplus(zp).mean())


def descent(pos: _Rows, unl: _Rows, w: np.ndarray, b: float, prior: float) -> np.ndarray:
    """The gradient to follow: of the risk where the second part isn't negative, else of minus the second part alone, as it is below what any classifier can have."""
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
    up, uu = sigmoid(pos.logits(w, b)), sigmoid(unl.logits(w, b))
    second = unl.pull(uu / unl.n, len(w)) - pos.pull(prior * up / pos.n, len(w))
    if risk_parts(pos, unl, w, b, prior)[1] < 0:
        return -second
    return pos.pull(prior * (up - 1) / pos.n, len(w)) + second


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], dim: int, prior: float, steps: int = 800, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from the feature numbers of positive and of unlabelled documents."""
    p, u = _Rows(pos), _Rows(unl)
    w, b = np.zeros(dim), -1.0
    m, v = np.zeros(dim + 1), np.zeros(dim + 1)
    for t in range(1, steps + 1):
        grad = descent(p, u, w, b, prior)
        grad[:dim] += l2 * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:dim], b - step[dim]
    return w, float(b)


def _emit_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = list(features(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(found), pa.int32()), pa.array(found, pa.string())], ["positive", "feature"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of a text's three-word shingles, which near copies mostly share and other texts don't."""
    for batch in batches:
        keys = []
        for text in batch.column(1):
            w = (text.as_py() or "").encode("utf-8", "replace").split()
            keys.append(min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(keys, pa.int64())], ["positive", "doc_id", "text_key", "sketch"])


def _bounded(taken: DataFrame) -> DataFrame:
    """At most `MAX_POSITIVE` and `MAX_UNLABELLED` rows, those of the least hashes: an id may have any number of texts."""
    parts = [taken.where(F.col("positive") == kind).orderBy(F.xxhash64("doc_id", "text_key"), "doc_id", "text_key").limit(bound) for kind, bound in ((1, MAX_POSITIVE), (0, MAX_UNLABELLED))]
    return parts[0].union(parts[1])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> ToxicityModel:
    """A model from the documents that are not held out. docs: doc_id, text; labels: doc_id, toxic (0/1).

    prior: the share of toxic documents; by default how often unlabelled texts show a feature of the model relative to toxic
    ones, times `PRIOR_MARGIN`, within 0.7 to 1.3 times the range of two first guesses: the share of toxic rows among the labelled ones used, and
    the inverse of the greatest lift among the `PEAK` clearest features. Labels that are null, held out or of no document are not used.
    Rows that repeat, or whose texts are near copies of another's, count once. Without a confirmed toxic document the model knows no
    feature and scores every text low.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    slim = docs.select(F.col("`doc_id`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).where("doc_id is not null")
    known = labels.select(F.col("`doc_id`").alias("doc_id"), F.col("`toxic`").alias("toxic")).where(~held_out()).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    n_labelled, n_toxic = counts["n"], counts["k"] or 0
    if not n_toxic:
        return ToxicityModel({}, -4.0, 0.0)
    given = prior
    prior = prior if prior is not None else min(0.9, max(0.001, n_toxic / n_labelled))
    free = slim.where(~held_out())
    n_free = free.select("doc_id").distinct().count()

    def share(bound: int, n: int, salt: int) -> Column:
        """A share of the ids by hash that holds `bound` of n expected, all if there are fewer."""
        return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, bound / max(n, 1))) + (n <= bound)

    positives = known.where((F.col("toxic") == 1) & share(MAX_POSITIVE, n_toxic, 1)).select("doc_id", F.lit(1).alias("positive"))
    unlabelled = free.select("doc_id").where(share(MAX_UNLABELLED, n_free, 2)).distinct().select("doc_id", F.lit(0).alias("positive"))
    chosen = positives.union(unlabelled)
    # the bounded sample of ids meets the texts: a broadcast of at most 18,000 ids expected
    sample = free.join(F.broadcast(chosen), "doc_id")
    # copies and near copies would count one document's words many times: one of each is taken, and only then its text
    sketches = sample.select("positive", "text", "doc_id", "text_key").mapInArrow(_sketch, f"positive int, doc_id {slim.schema['doc_id'].dataType.simpleString()}, text_key long, sketch long")
    taken = materialise(sketches.groupBy("positive", "sketch").agg(F.min(F.struct("doc_id", "text_key")).alias("m")).select("positive", "m.*"), "toxicity-sketches")
    sample = free.join(F.broadcast(materialise(_bounded(taken).repartition(1), "toxicity-sample-ids")), ["doc_id", "text_key"])
    # (the sample has a bound, so a few files hold it however many partitions the texts have)
    sample = materialise(sample.dropDuplicates(["positive", "doc_id", "text_key"]).select("positive", "text").repartition(SAMPLE_FILES), "toxicity-sample")
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return ToxicityModel({}, -4.0, prior)
    stats = sample.mapInArrow(_emit_features, "positive int, feature string").groupBy("feature").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    expected = F.col("u") * (n_p / n_u)
    z = (F.col("p") - expected) / F.sqrt(expected + 0.5)
    clear = stats.withColumn("z", z).where((F.col("p") >= min(MIN_COUNT, max(2, n_p // 4))) & (F.col("z") >= MIN_Z))
    clear = materialise(clear.repartition(1), "toxicity-features")
    top = clear.orderBy(F.desc("z"), "feature").limit(PEAK).collect()
    # a feature that only toxic texts have lifts by the inverse of their share
    peak = min((min(0.9, (r["u"] + 1) * (n_p / n_u) / r["p"]) for r in top), default=prior)
    share_toxic = peak if given is None else given
    min_lift = MIN_RATIO / (1 - share_toxic + MIN_RATIO * share_toxic)
    chosen_features = clear.where(F.col("p") >= min_lift * expected).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature").collect()
    names = {r["feature"]: i for i, r in enumerate(chosen_features)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(names[f] for f in features(t.as_py()) if f in names) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["positive", "ids"])

    rows = sample.mapInArrow(encode, "positive int, ids array<int>").collect()
    rows.sort(key=lambda r: (r["positive"], r["ids"]))  # sums don't depend on how rows came
    split = {k: [np.array(r["ids"], np.int64) for r in rows if r["positive"] == k] for k in (0, 1)}
    if given is None:
        # the share of unlabelled texts with a telling feature over that of toxic ones: what the features can see of the prior
        seen = [np.mean([len(x) > 0 for x in split[k]]) for k in (0, 1)]
        prior = float(np.clip(PRIOR_MARGIN * seen[0] / max(seen[1], 1e-9), 0.7 * min(prior, peak), 1.3 * max(prior, peak)))
    weights, bias = fit_nnpu(split[1], split[0], max(1, len(names)), prior)
    return ToxicityModel({f: float(round(weights[i], 9)) for f, i in names.items()}, round(bias, 9), prior)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 at `threshold` or more).

    Only `text` enters the score; a null or empty text scores the model's bias. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [known.value.score(t.as_py()) for t in batch.column(2)]
            predicted = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), predicted], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("`text`").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that the trained model predicts toxic, all columns kept."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([known.value.score(t.as_py()) < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
