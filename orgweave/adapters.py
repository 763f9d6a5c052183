"""Models and services as providers: what a client or a loaded model needs around it.

A model is loaded once per Python worker and kept until `release`; a service is asked in the order of its fallbacks. Loaders and clients
are plain callables given by the caller, so no model library is imported here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions.text import blank_to_null
from orgweave.operators.prompts import LETTERS, judge_prompts, translation_chats
from orgweave.providers import Provider, rate_limited

#: Stands in a cache for a search that found nothing, so that it isn't repeated.
NOTHING = "__NONE__"

_loaded: dict[str, object] = {}


def _model(name: str, load: Callable[[], object]) -> object:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def release(name: str | None = None) -> list[str]:
    """Let go of this process's models, all or one, closing those that can be closed; the names let go of."""
    gone = [n for n in list(_loaded) if name in (None, n)]
    for n in gone:
        close = getattr(_loaded.pop(n), "close", None)
        if close is not None:
            close()
    return gone


def model_provider(name: str, load: Callable[[], object], run: Callable[[object, pd.DataFrame], dict], schema: str, batch: int = 64) -> Provider:
    """A provider out of a model: (…columns) → + the columns of `schema`, from run(model, rows) for at most `batch` rows at a time.

    A batch that the model fails on is asked again row by row, and a row that still fails has nulls: one bad text costs no other its answer.
    """
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]

    def answer(model: object, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            found = run(model, rows)
            return rows.assign(**{n: pd.Series(list(found[n]), index=rows.index, dtype=object) for n in names})
        except Exception:
            if len(rows) == 1:
                return rows.assign(**{n: pd.Series([None], index=rows.index, dtype=object) for n in names})
            return pd.concat([answer(model, rows.iloc[i : i + 1]) for i in range(len(rows))])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(name, load)
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                yield answer(model, pdf.iloc[lo : lo + batch])

    return lambda df: df.mapInPandas(apply, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {schema}")


def encoder(name: str, load: Callable[[], object], encode: Callable[[object, list[str]], np.ndarray], batch: int = 64) -> Provider:
    """(text) → (text, embedding), vectors scaled to length 1; a zero vector stays."""

    def run(model: object, rows: pd.DataFrame) -> dict:
        x = np.asarray(encode(model, rows["text"].tolist()), np.float32)
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return {"embedding": (x / np.where(norms > 0, norms, 1)).tolist()}

    return model_provider(name, load, run, "embedding array<float>", batch)


def cross_encoder(name: str, load: Callable[[], object], score: Callable[[object, list[tuple[str, str]]], Sequence[float]], batch: int = 64) -> Provider:
    """(query, document) → + rerank_score; a pair without a document scores 0."""

    def run(model: object, rows: pd.DataFrame) -> dict:
        return {"rerank_score": [float(s) for s in score(model, list(zip(rows["query"], rows["document"].fillna(""), strict=True)))]}

    ask = model_provider(name, load, run, "rerank_score double", batch)
    return lambda df: ask(df).withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))


def letter_judge(name: str, load: Callable[[], object], logits: Callable[[object, list[str]], Sequence[Sequence[float]]], mentions: DataFrame, registry: DataFrame, most: int = 10) -> Provider:
    """A judge for `linking.judge`: (mention_key, record_id, score) → (mention_key, record_id, score, logit), a row with null record_id for none of them.

    logits(model, prompts): one number per letter of `LETTERS` and a last one for N. Letters that a prompt doesn't offer are not read.
    """

    def run(model: object, rows: pd.DataFrame) -> dict:
        return {"logits": [[float(z) for z in row] for row in logits(model, rows["prompt"].tolist())]}

    ask = model_provider(name, load, run, "logits array<double>", 8)

    def judge(candidates: DataFrame) -> DataFrame:
        asked, lettered = judge_prompts(candidates, mentions, registry, most)
        answers = ask(asked.select("mention_key", "prompt")).where("logits is not null")
        place = F.instr(F.lit(LETTERS), F.col("letter")) - 1
        scores = candidates.select("mention_key", "record_id", "score")
        offered = lettered.select("mention_key", "letter", "record_id").join(answers, "mention_key").select("mention_key", "record_id", F.get("logits", place).alias("logit")).join(scores, ["mention_key", "record_id"])
        none = answers.select("mention_key", F.lit(None).cast("string").alias("record_id"), F.element_at("logits", -1).alias("logit"), F.lit(None).cast(scores.schema["score"].dataType).alias("score"))
        return offered.unionByName(none).select("mention_key", "record_id", "score", "logit")

    return judge


def translator(name: str, load: Callable[[], object], chat: Callable[[object, list[list[dict]]], Sequence[str]]) -> Provider:
    """(text) → (text, translation) by a chat model; a text that fails, or an empty answer, has none."""

    def run(model: object, rows: pd.DataFrame) -> dict:
        chats = [[{"role": m["role"], "content": m["content"]} for m in c] for c in rows["chat"]]
        return {"translation": [(t or "").strip() or None for t in chat(model, chats)]}

    ask = model_provider(name, load, run, "translation string", 8)
    return lambda df: ask(translation_chats(df)).select("text", "translation")


def typed_geocoder(lookup: Callable[[str, str | None], dict | None], schema: str, per_second: float = 1.0, tries: int = 3) -> Provider:
    """A geocoder over a client lookup(words, kind): a query `city:Oslo, Norway` is asked with its kind first, and without one if that finds nothing."""

    def ask(query: str) -> dict | None:
        kind, found, words = query.partition(":")
        if not found:
            return lookup(query, None)
        return lookup(words, kind) or lookup(words, None)

    return rate_limited(ask, schema, per_second, tries)


def web_context(backends: Sequence[Callable[[str, str, int], list[str]]], results: int = 10, per_second: float = 1.0) -> Provider:
    """(query, region) → (query, region, context): the snippets of the first search backend that has any; `NOTHING` if none has, to be cached like an answer."""

    def ask(key: str) -> dict | None:
        query, _, region = key.rpartition("\x1f")
        for search in backends:
            try:
                found = [s for s in search(query, region, results) if s]
            except Exception:  # the next backend may answer
                continue
            if found:
                return {"context": "\n".join(found[:results])}
        return {"context": NOTHING}

    limited = rate_limited(ask, "context string", per_second, 1)

    def run(df: DataFrame) -> DataFrame:
        keyed = df.select("query", "region", F.concat("query", F.lit("\x1f"), F.coalesce("region", F.lit(""))).alias("_key"))
        answers = limited(keyed.select(F.col("_key").alias("query")).distinct()).select(F.col("query").alias("_key"), "context")
        return keyed.join(answers, "_key").select("query", "region", "context")

    return run


def known_context(context: DataFrame) -> DataFrame:
    """Answers of `web_context` or its cache, a search that found nothing as null."""
    return context.withColumn("context", F.when(F.col("context") != NOTHING, blank_to_null(F.col("context"))))


def converted_aliases(names: DataFrame, aliases: DataFrame, convert: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """`aliases` (key, …) plus rows for the names (name) that it lacks and a converter turns into one of its keys: the last step of a country's lookup.

    convert: names → their ISO code or short name, None where it knows none; asked once for each distinct name.
    """
    missing = names.select(F.trim("name").alias("key")).where("key <> ''").distinct().join(aliases.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(known=pd.Series(convert(pdf["key"].tolist()), dtype=object))

    facts = [c for c in aliases.columns if c != "key"]
    found = missing.mapInPandas(run, "key string, known string").where("known is not null").join(aliases.withColumnRenamed("key", "known"), "known")
    return aliases.unionByName(found.select("key", *facts))
