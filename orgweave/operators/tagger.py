"""A sequence tagger of its own: an averaged structured perceptron over tokens, decoded by Viterbi's algorithm.

Tokens are runs of letters or digits, and single other characters. A token's features are its small form, shape, beginning and ending, those of its neighbours,
and whether they are in a dictionary of given terms. Only those that training gave a weight count, by name: one it hasn't seen never takes the weight of another, as it would
by a hash. Tags are O, and B and I of each label, where I follows only B or I of its label. Training walks all labelled texts `EPOCHS` times, in shards whose weights are mixed after
each (iterative parameter mixing), adds the features of the gold path, takes those of the best path away where they differ, and averages the weights of all steps. In training wrong
tags are ahead by `LEAD`, so the gold path has to win by that much for each. Tagging runs within each text's row.

An entity's score is the least, over its tokens, of the forward-backward probability of the token's tag, with path scores divided by the size of a typical margin.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.plans.settle import materialise, spread
from orgweave.providers import Provider

#: Labelled texts that one shard learns from, and shards at most: more texts make shards larger, not more.
SHARD_TEXTS = 4_000
MOST_SHARDS = 64
EPOCHS = 6
LEAD = 2.0
#: Tokens of texts that are checked together by the same weights, about.
_CHECKED_TOKENS = 1 << 11
#: Parts of one in which margins are counted.
_MARGIN_PARTS = 256
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_SCHEMA = "text_key string, pos int, label string, word string, score double, start int, end int"


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _shape(word: str) -> str:
    out = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def features(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """The names of each token's features, each once."""
    words = [text[a:b].lower() for a, b in spans]
    shapes = [_shape(text[a:b]) for a, b in spans]
    at = lambda values, i: values[i] if 0 <= i < len(values) else "|"
    out = []
    for i, w in enumerate(words):
        out.append([
            "bias", f"w {w}", f"s {shapes[i]}", f"p {w[:3]}", f"e {w[-3:]}", f"e2 {w[-2:]}", f"l {min(len(w), 8)}",
            f"-1 {at(words, i - 1)}", f"+1 {at(words, i + 1)}", f"-2 {at(words, i - 2)}", f"+2 {at(words, i + 2)}", f"-1s {at(shapes, i - 1)}", f"+1s {at(shapes, i + 1)}",
            f"-1w {at(words, i - 1)} {w}", f"w+1 {w} {at(words, i + 1)}", f"n {min(i, 4)}", f"m {min(len(words) - i, 4)}",
        ])
    return out


@dataclass(frozen=True)
class TagSet:
    """O, then B and I of each label; `allowed[a, b]` says whether tag b may follow a, the last row what may come first."""

    labels: tuple[str, ...]

    @property
    def size(self) -> int:
        return 1 + 2 * len(self.labels)

    @property
    def allowed(self) -> np.ndarray:
        out = np.ones((self.size + 1, self.size), bool)
        for i in range(len(self.labels)):
            inside = 2 + 2 * i
            out[:, inside] = False
            out[[inside - 1, inside], inside] = True
        return out

    def encode(self, spans: list[tuple[int, int]], entities: Iterable[tuple[int, int, str]]) -> list[int]:
        """A tag for each token; of entities that overlap the first counts, labels that aren't in the set are O."""
        tags = [0] * len(spans)
        for start, end, label in sorted(entities, key=lambda e: (e[0], -e[1])):
            mine = [i for i, (a, b) in enumerate(spans) if a >= start and b <= end]
            if mine and label in self.labels and not any(tags[i] for i in mine):
                begin = 1 + 2 * self.labels.index(label)
                for i in mine:
                    tags[i] = begin + (i != mine[0])
        return tags

    def decode(self, tags: list[int]) -> list[tuple[int, int, str]]:
        """(first token, last token, label) of each entity."""
        out: list[tuple[int, int, str]] = []
        for i, tag in enumerate(tags):
            if tag % 2:
                out.append((i, i, self.labels[tag // 2]))
            elif tag:
                out[-1] = out[-1][0], i, out[-1][2]
        return out


def viterbi(emissions: np.ndarray, transitions: np.ndarray) -> list[int]:
    """The best path: emissions (tokens × tags), transitions (tags + 1 × tags), whose last row is how a path may begin. Of equal paths that of the least tags from the end."""
    if not len(emissions):
        return []
    best, back = transitions[-1] + emissions[0], []
    for row in emissions[1:]:
        through = best[:, None] + transitions[:-1]
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def marginals(emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward probabilities of each token's tags."""
    n = len(emissions)
    forward, backward = np.empty_like(emissions), np.zeros_like(emissions)
    forward[0] = transitions[-1] + emissions[0]
    for i in range(1, n):
        forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + transitions[:-1], axis=0) + emissions[i]
    for i in range(n - 2, -1, -1):
        backward[i] = np.logaddexp.reduce(transitions[:-1] + (emissions[i + 1] + backward[i + 1])[None, :], axis=1)
    both = forward + backward
    both -= np.logaddexp.reduce(both, axis=1)[:, None]
    return np.exp(both)


#: Stands for minus infinity where tags may not follow each other, without making differences undefined.
_NEVER = -1e9


@dataclass(frozen=True)
class Tagger:
    tags: TagSet
    #: A feature's row of `weights`; row 0 is all zeros, for what isn't known.
    known: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    margin: float

    def _scores(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        rows = np.array([[self.known.get(f, 0) for f in token] for token in features(text, spans)])
        return self.weights[rows].sum(axis=1)

    def entities(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) in the order of the text."""
        spans = tokens(text or "")
        if not spans or not self.tags.labels:
            return []
        scores = self._scores(text, spans)
        path = viterbi(scores, self.transitions)
        found = self.tags.decode(path)
        if not found:
            return []
        sure = marginals(scores / self.margin, np.where(self.transitions <= _NEVER, _NEVER, self.transitions / self.margin))[np.arange(len(path)), path]
        return [(spans[i][0], spans[j][1], label, round(float(sure[i : j + 1].min()), 6)) for i, j, label in found]

    def ner(self) -> Provider:
        """(text_key, text) → (text_key, pos, label, word, score, start, end), as `spans.tag_mentions` asks for."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(key, i, label, text[a:b], score, a, b) for i, (a, b, label, score) in enumerate(model.entities(text))]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["text_key", "pos", "label", "word", "score", "start", "end"])

        return lambda df: spread(df.select(F.col("text_key").cast("string").alias("text_key"), "text"), "text_key").mapInArrow(run, _SCHEMA)

    def span_model(self) -> Provider:
        """(source_index, raw_text) → (source_index, entities), as `spans.expand_spans` asks for: each entity is a span."""

        def provide(df: DataFrame) -> DataFrame:
            texts = df.select("raw_text").where("raw_text is not null").distinct().select(F.sha2("raw_text", 256).alias("text_key"), F.col("raw_text").alias("text"))
            each = self.ner()(texts).select("text_key", F.struct("pos", F.col("label").alias("entity_group"), "score", "word", "start", "end").alias("e"))
            shown = F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(*[e[c].alias(c) for c in ("entity_group", "score", "word", "start", "end")]))
            found = each.groupBy("text_key").agg(shown.alias("entities"))
            return df.select("source_index", F.sha2("raw_text", 256).alias("text_key")).join(found, "text_key").select("source_index", "entities")

        return provide


class _Weights:
    """The weights of a shard's walk, or of the driver's mix: a row per name, row 0 for what isn't known, then those of the tag before."""

    def __init__(self, tags: TagSet) -> None:
        self.tags, self.blocked = tags, ~tags.allowed
        self.names = ["", *(f"> {a}" for a in range(tags.size + 1))]
        self.known = {f: i for i, f in enumerate(self.names) if i}
        self.rows = np.zeros((len(self.names), tags.size))

    def row(self, name: str) -> int:
        at = self.known.setdefault(name, len(self.names))
        if at == len(self.names):
            self.names.append(name)
            if at == len(self.rows):
                self.grow(2 * at)
        return at

    def grow(self, n: int) -> None:
        self.rows = np.concatenate([self.rows, np.zeros((n - len(self.rows), self.tags.size))])

    @property
    def moves(self) -> np.ndarray:
        return np.where(self.blocked, _NEVER, self.rows[1 : self.tags.size + 2])

    def found(self, named: list[list[str]]) -> np.ndarray:
        get = self.known.get
        return np.array([[get(f, 0) for f in token] for token in named])

    def scores(self, at: np.ndarray) -> np.ndarray:
        out = self.rows[at[:, 0]]
        for column in at.T[1:]:
            out += self.rows[column]
        return out


class _Walk(_Weights):
    """A walk through labelled texts from given weights: what it changed, as whole numbers, so that sums over shards don't depend on an order."""

    def __init__(self, start: _Weights) -> None:
        self.tags, self.blocked = start.tags, start.blocked
        self.names, self.known, self.rows = list(start.names), dict(start.known), start.rows.copy()
        self.changed, self.late = np.zeros(self.rows.shape, np.int64), np.zeros(self.rows.shape, np.int64)
        self.step, self.wrong = 1, 0

    def grow(self, n: int) -> None:
        super().grow(n)
        more = np.zeros((n - len(self.changed), self.tags.size), np.int64)
        self.changed, self.late = np.concatenate([self.changed, more]), np.concatenate([self.late, more])

    def walk(self, texts: Iterable[tuple[str, list[tuple[int, int, str]]]]) -> None:
        held, n = [], 0
        for text, entities in texts:
            spans = tokens(text or "")
            if spans:
                held.append((features(text, spans), self.tags.encode(spans, entities)))
                n += len(spans)
            if n >= _CHECKED_TOKENS:
                self._together(held)
                held, n = [], 0
        self._together(held)

    def _together(self, held: list[tuple[list[list[str]], list[int]]]) -> None:
        """Texts whose best paths by the weights before all of them are right by the lead need no change; the others are walked one by one."""
        if not held:
            return
        scores = self._behind(self.scores(self.found([token for named, _ in held for token in named])), [t for _, gold in held for t in gold])
        lengths = np.array([len(gold) for _, gold in held])
        starts, moves, wrong = np.cumsum(lengths) - lengths, self.moves, []
        for n in np.unique(lengths):
            mine = np.flatnonzero(lengths == n)
            paths = _paths(scores[starts[mine][:, None] + np.arange(n)], moves)
            wrong += [i for i, path in zip(mine.tolist(), paths.tolist(), strict=True) if path != held[i][1]]
        for i in sorted(wrong):
            self._learn(*held[i], self.step + i)
        self.step += len(held)

    def _behind(self, scores: np.ndarray, gold: list[int]) -> np.ndarray:
        scores += LEAD
        scores[np.arange(len(gold)), gold] -= LEAD
        return scores

    def _learn(self, named: list[list[str]], gold: list[int], step: int) -> None:
        guess = viterbi(self._behind(self.scores(self.found(named)), gold), self.moves)
        if guess == gold:
            return
        self.wrong += 1
        size = self.tags.size
        for j, (g, w) in enumerate(zip(gold, guess, strict=True)):
            if g != w:
                at = [self.row(f) for f in named[j]]
                self._move(at, g, 1, step)
                self._move(at, w, -1, step)
            a, b = (gold[j - 1], guess[j - 1]) if j else (size, size)
            if (a, g) != (b, w):
                self._move(1 + a, g, 1, step)
                self._move(1 + b, w, -1, step)

    def _move(self, at: list[int] | int, tag: int, by: int, step: int) -> None:
        self.rows[at, tag] += by
        self.changed[at, tag] += by
        # (the average as a sum weighted by when a change came)
        self.late[at, tag] += by * step

    def batch(self) -> pa.RecordBatch:
        """(name, tag, changed, area): each weight's change, and what it adds to the sum of the weights of all steps; under no name the texts walked wrong and the steps."""
        area = self.changed * self.step - self.late
        row, tag = np.nonzero((self.changed != 0) | (area != 0))
        names = [self.names[i] for i in row.tolist()]
        columns = [pa.array([*names, None], pa.string()), pa.array(np.r_[tag, 0], pa.int32()), pa.array(np.r_[self.changed[row, tag], self.wrong]), pa.array(np.r_[area[row, tag], self.step])]
        return pa.RecordBatch.from_arrays(columns, ["name", "tag", "changed", "area"])


class _Mix(_Weights):
    """The mean of the shards' weights, after each epoch, and the sum of the epochs' averages."""

    def __init__(self, tags: TagSet) -> None:
        super().__init__(tags)
        self.summed = np.zeros(self.rows.shape)

    def grow(self, n: int) -> None:
        super().grow(n)
        self.summed = np.concatenate([self.summed, np.zeros((n - len(self.summed), self.tags.size))])

    def add(self, changes: pa.Table | pa.RecordBatch, shards: int) -> int:
        """An epoch's changes, summed over its shards; the number of texts that it walked wrong."""
        names, tag, changed, area = (changes.column(i) for i in range(4))
        tag, changed, area = tag.to_numpy(), changed.to_numpy(), area.to_numpy()
        listed = names.to_pylist()
        total = listed.index(None)
        at = np.array([0 if f is None else self.row(f) for f in listed])
        real = np.arange(len(at)) != total
        self.summed += self.rows
        self.summed[at[real], tag[real]] += area[real] / area[total]
        self.rows[at[real], tag[real]] += changed[real] / shards
        return int(changed[total])

    def tagger(self, epochs: int, done: int, margin: float = 1.0) -> Tagger:
        # (once no text is wrong, further epochs change nothing)
        average = (self.summed + (epochs - done) * self.rows) / max(1, epochs)
        first = self.tags.size + 2
        used = [i for i in range(first, len(self.names)) if average[i].any()]
        weights = np.vstack([np.zeros((1, self.tags.size)), average[used]])
        return Tagger(self.tags, {self.names[i]: n for n, i in enumerate(used, 1)}, weights, np.where(self.blocked, _NEVER, average[1:first]), margin)


def _paths(emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """`viterbi` for texts of the same number of tokens: (texts × tokens × tags) → (texts × tokens)."""
    best, back = transitions[-1] + emissions[:, 0], []
    for i in range(1, emissions.shape[1]):
        through = best[:, :, None] + transitions[None, :-1]
        back.append(through.argmax(axis=1))
        best = through.max(axis=1) + emissions[:, i]
    path = [best.argmax(axis=1)]
    for step in reversed(back):
        path.append(step[np.arange(len(step)), path[-1]])
    return np.stack(path[::-1], axis=1)


def _margins(model: Tagger, texts: Iterable[str]) -> Counter[int]:
    """How often the best tag of a token is ahead of the second by so many `_MARGIN_PARTS`-ths."""
    out: Counter[int] = Counter()
    for text in texts:
        spans = tokens(text or "")
        if spans and model.tags.labels:
            ordered = np.sort(model._scores(text, spans), axis=1)
            out.update(np.rint((ordered[:, -1] - ordered[:, -2]) * _MARGIN_PARTS).astype(np.int64).tolist())
    return out


def _with_margin(model: Tagger, counts: dict[int, int]) -> Tagger:
    if not counts:
        return model
    values = np.array(sorted(counts))
    upto = np.cumsum([counts[v] for v in values.tolist()])
    middle = [values[np.searchsorted(upto, at, side="right")] for at in ((upto[-1] - 1) // 2, upto[-1] // 2)]
    # at a typical margin the likelier of two tags has odds of e^4
    return replace(model, margin=max(1e-6, float(np.mean(middle)) / _MARGIN_PARTS / 4))


def fit(rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS) -> Tagger:
    """A tagger from texts and their entities (start, end, label), in one shard on the driver."""
    mix = _Mix(TagSet(tuple(sorted({label for _, entities in rows for _, _, label in entities}))))
    order, done = np.random.default_rng(11), 0
    while done < epochs:
        mine = _Walk(mix)
        mine.walk(rows[i] for i in order.permutation(len(rows)))
        done += 1
        if not mix.add(mine.batch(), 1):
            break
    model = mix.tagger(epochs, done)
    return _with_margin(model, _margins(model, (text for text, _ in rows)))


def _labelled(text: str, entities: list[dict] | None) -> tuple[str, list[tuple[int, int, str]]]:
    return text, [(e["start"], e["end"], e["label"]) for e in entities or () if e and None not in (e["start"], e["end"], e["label"])]


def train(labelled: DataFrame, shard_texts: int = SHARD_TEXTS, epochs: int = EPOCHS) -> Tagger:
    """A tagger from all distinct texts of labelled (text, entities array<struct(start, end, label)>).

    Null texts are left out, null entities are none; of a text with several labellings the least counts. Offsets are in characters from 0, the end after the last one.
    Without an entity the tagger finds none. More than `shard_texts` texts are dealt to shards by hash, `MOST_SHARDS` at most: each epoch every shard streams all its texts,
    starting from the mean of the shards' weights after the epoch before. The driver holds weights only, those of texts that were walked wrong.
    """
    entity = lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["label"].cast("string").alias("label"))
    known = labelled.where("text is not null").select(F.col("text").cast("string").alias("text"), F.transform("entities", entity).alias("entities"))
    texts = materialise(known.groupBy("text").agg(F.min("entities").alias("entities")), "labelled-texts")
    n = texts.count()
    if n <= shard_texts:
        rows = texts.orderBy(F.xxhash64("text"), "text").collect()
        return fit([_labelled(r["text"], r["entities"]) for r in rows], epochs)
    shards = min(MOST_SHARDS, -(-n // shard_texts))
    each = texts.select(F.explode("entities").alias("e")).where("e.start is not null and e.end is not null and e.label is not null")
    mix = _Mix(TagSet(tuple(sorted(r["label"] for r in each.select("e.label").distinct().collect()))))
    sc, done = labelled.sparkSession.sparkContext, 0
    while done < epochs:
        sent = sc.broadcast(mix)

        def walk(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            mine = _Walk(sent.value)
            mine.walk(_labelled(*x) for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield mine.batch()

        # a shard is a partition; the order within it is another each epoch
        dealt = texts.repartitionById(shards, F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")).sortWithinPartitions(F.xxhash64("text", F.lit(done)), "text")
        changes = dealt.mapInArrow(walk, "name string, tag int, changed long, area long").groupBy("name", "tag").agg(F.sum("changed").alias("changed"), F.sum("area").alias("area"))
        wrong = mix.add(changes.toArrow(), shards)
        sent.unpersist()
        done += 1
        if not wrong:
            break
    model = mix.tagger(epochs, done)
    sent = sc.broadcast(model)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _margins(sent.value, (t for batch in batches for t in batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["margin", "n"])

    counted = spread(texts.select("text"), "text").mapInArrow(margins, "margin long, n long").groupBy("margin").agg(F.sum("n").alias("n")).collect()
    sent.unpersist()
    return _with_margin(model, {r["margin"]: r["n"] for r in counted})


def score_entities(found: DataFrame, gold: DataFrame) -> DataFrame:
    """found and gold (text_key, start, end, label) → one row: found, gold, right, precision, recall, f1 of entities with the same offsets and label."""
    keys = ["text_key", "start", "end", "label"]
    a, b = found.select(*keys).distinct(), gold.select(*keys).distinct()
    counts = a.agg(F.count("*").alias("found")).crossJoin(b.agg(F.count("*").alias("gold"))).crossJoin(a.join(b, keys).agg(F.count("*").alias("right")))
    share = lambda x, y: F.coalesce(F.col(x) / F.nullif(F.col(y), F.lit(0)), F.lit(0.0))
    return counts.withColumn("precision", share("right", "found")).withColumn("recall", share("right", "gold")).withColumn("f1", F.expr("coalesce(2.0 * right / nullif(found + gold, 0), 0.0)"))
