"""A language detector of its own: naive Bayes over character n-grams, counted in Spark from labelled texts.

Words of letters, in small letters, give their letters and, with a blank at either end, their windows of two and three characters. Words are counted
first, so that a frequent word's n-grams are made once per language, whatever the number of texts. The `MAX_GRAMS` n-grams that occur most stay; a
language's log-likelihood of each is smoothed by `ALPHA`. A text's score for a language is the sum over all its n-grams, and its
probability the softmax of the scores. Languages are alike a priori, as the share of a language among the labelled texts says nothing of a text.

The model is a table of at most `MAX_GRAMS` rows of one number per language, and goes to executors whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.providers import Provider

MAX_GRAMS = 20_000
MAX_LANGUAGES = 250
ALPHA = 0.5
#: Words whose scores a worker remembers.
REMEMBERED = 200_000
_WORDS = regex.compile(r"\p{L}+")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def grams(word: Column) -> Column:
    """Letters, and windows of two and three characters of the word between blanks."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    windows = lambda text, k: F.transform(F.sequence(F.lit(1), F.char_length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))
    return F.concat(windows(word, 1), windows(padded, 2), windows(padded, 3))


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [*word, *[padded[i : i + 2] for i in range(len(padded) - 1)], *[padded[i : i + 3] for i in range(len(padded) - 2)]]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(text, lang) → (lang, gram, n) over all texts. Null or blank languages and null texts are left out."""
    known = labelled.where("text is not null and trim(lang) <> ''").select(F.col("lang"), F.explode(words(F.col("text"))).alias("word"))
    counted = known.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counted.select("lang", "n", F.explode(grams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Detector:
    """Log-likelihoods of n-grams by language; `languages` in alphabetical order."""

    languages: tuple[str, ...]
    table: dict[str, np.ndarray]

    def word(self, word: str) -> np.ndarray:
        out = np.zeros(len(self.languages))
        for g in _grams(word):
            row = self.table.get(g)
            if row is not None:
                out += row
        return out

    def likeliest(self, text: str | None, known: dict[str, np.ndarray]) -> tuple[str | None, float | None, str | None, float | None]:
        """Two codes with their probabilities, the likelier first, of equals the first by alphabet; null where no n-gram is known."""
        score, any_known = np.zeros(len(self.languages)), False
        for word, n in Counter(_WORDS.findall((text or "").lower())).items():
            mine = known.get(word)
            if mine is None:
                mine = self.word(word)
                if len(known) < REMEMBERED:
                    known[word] = mine
            if mine.any():
                score, any_known = score + n * mine, True
        if not any_known:
            return None, None, None, None
        p = np.exp(score - score.max())
        p /= p.sum()
        order = np.argsort(-score, kind="stable")[:2]
        first, second = int(order[0]), int(order[1]) if len(order) > 1 else None
        return self.languages[first], float(p[first]), None if second is None else self.languages[second], None if second is None else float(p[second])

    def provider(self) -> Provider:
        """(text) → (text, first, first_p, second, second_p), as `language.detect` asks for."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, np.ndarray] = {}
            for batch in batches:
                rows = [model.likeliest(t.as_py(), known) for t in batch.column(0)]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                types = (pa.string(), pa.float64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["text", "first", "first_p", "second", "second_p"])

        return lambda df: df.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "text string, first string, first_p double, second string, second_p double")


def train(labelled: DataFrame, max_grams: int = MAX_GRAMS) -> Detector:
    """A detector from all of `labelled` (text, lang). Without a labelled text it knows no language and answers null.

    More than `MAX_LANGUAGES` languages raise. Of n-grams that occur equally often, the first by their bytes stay.
    """
    counts = gram_counts(labelled).persist()
    total = counts.groupBy("gram").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "gram").limit(max_grams)
    by_gram = counts.join(F.broadcast(total.select("gram")), "gram").groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    languages = tuple(sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = {r["gram"]: r["by_lang"] for r in by_gram.collect()}
    counts.unpersist()
    names = sorted(rows)
    n = np.array([[rows[g].get(code, 0) for code in languages] for g in names], np.float64).reshape(len(names), len(languages))
    logs = np.log(n + ALPHA) - np.log(n.sum(axis=0) + ALPHA * len(names))
    return Detector(languages, dict(zip(names, logs, strict=True)))
