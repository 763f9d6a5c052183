"""Span expansion, entities and their repairs, and what is grouped from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions import lexicons as L
from orgweave.plans.settle import spread
from orgweave.providers import Provider

#: Between an open parenthesis' end and the next closing one.
_CLOSE = r"^[^ ,;:.\n\t)]*\)"


def expand_spans(inputs: DataFrame, strategy: str = "delimiter", delimiter: str = ";", model: Provider | None = None) -> DataFrame:
    """(source_index, span_index, raw_text): the affiliations of each text, trimmed, blank ones left out; a text without any is one span as it is.

    `model`: provider (source_index, raw_text) → (source_index, entities array<struct(start, end, score, word)>); its entities are sliced, merged and filtered.
    """
    if strategy == "none":
        return inputs.select("source_index", F.lit(0).alias("span_index"), "raw_text")
    if strategy == "model":
        if model is None:
            raise ValueError("the model strategy takes a provider")
        found = model(inputs).select("source_index", F.col("entities").alias("_e"))
        joined = inputs.join(found, "source_index", "left")
        pieces = F.transform(merge_adjacent(F.coalesce("_e", F.array().cast(_ENTITIES)), "raw_text", digits=False), lambda e: F.trim(e["word"]))
    else:
        joined = inputs
        pieces = F.transform(F.split("raw_text", "\\Q" + delimiter + "\\E"), lambda p: F.trim(p))
    kept = F.filter(pieces, lambda p: p != "")
    spans = F.when(F.size(kept) > 0, kept).otherwise(F.array(F.coalesce("raw_text", F.lit(""))))
    return joined.select("source_index", F.posexplode(F.coalesce(spans, F.array(F.lit("")))).alias("span_index", "raw_text"))


_ENTITIES = "array<struct<entity_group:string,score:double,word:string,start:int,end:int>>"


def merge_adjacent(entities: Column, text: str, min_score: float = 0.0, digits: bool = True) -> Column:
    """Join an entity with the next one if it ends where that starts and that starts with a small letter (or a digit).

    Greedy from the left and in pairs only: an entity that was joined to its predecessor starts no further pair. The first's label, the lower score and both words count.
    Words are cut from the text where offsets are known. Of entities that could all join one after the other, so, every other one does.
    """
    whole = F.col(text)
    cut = lambda e: F.when(e["start"].isNotNull() & e["end"].isNotNull(), F.substring(whole, e["start"] + 1, e["end"] - e["start"])).otherwise(e["word"])
    shape = lambda group, score, word, start, end: F.struct(group.alias("entity_group"), score.cast("double").alias("score"), word.alias("word"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    good = F.filter(entities, lambda e: F.coalesce(e["score"], F.lit(0.0)) >= min_score)
    sliced = F.transform(good, lambda e: shape(e["entity_group"], e["score"], cut(e), e["start"], e["end"]))
    starts = r"^[\p{Ll}\p{Nd}]" if digits else r"^\p{Ll}"
    bound = lambda value, body: F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)

    def joined(e: Column) -> Column:
        joins = lambda x, i: F.coalesce((x["end"] == F.get(e, i + 1)["start"]) & F.get(e, i + 1)["word"].rlike(starts), F.lit(False))
        marks = F.split(F.regexp_replace(F.concat_ws("", F.transform(e, lambda x, i: F.when(joins(x, i), "1").otherwise("0"))), "11", "10"), "")

        def by_marks(mark: Column) -> Column:
            def both(x: Column, i: Column) -> Column:
                after = F.get(e, i + 1)
                pair = shape(x["entity_group"], F.least(x["score"], after["score"]), F.concat(x["word"], after["word"]), x["start"], after["end"])
                return F.when(F.get(mark, i) == "1", pair).otherwise(x)

            return F.filter(F.transform(e, both), lambda _, i: (i == 0) | F.coalesce(F.get(mark, i - 1) != "1", F.lit(True)))

        return bound(marks, by_marks)

    return bound(sliced, joined)


def close_parenthesis(word: Column, text: Column, end: Column) -> Column:
    """Extend a word whose last `(` is open to the next `)`, if nothing but a run without spaces and `, ; : .` lies between."""
    rest = F.substring(text, end + 1, F.length(text))
    tail = F.regexp_extract(rest, _CLOSE, 0)
    opened = F.length(F.substring_index(word, "(", -1)) < F.length(word)
    is_open = opened & ~F.contains(F.substring_index(word, "(", -1), F.lit(")"))
    return F.when(is_open & (tail != ""), F.concat(word, tail)).otherwise(word)


def tag_mentions(spans: DataFrame, ner: Provider, min_score: float = 0.0) -> DataFrame:
    """mentions (source_index, span_index, pos, label, word, score, start, end). The provider sees each distinct text once."""
    # dealt out: short texts are few bytes, which Spark would give to a task or two, but much is made of them
    texts = spread(spans.select("raw_text").where("trim(raw_text) <> ''").distinct(), "raw_text")
    keyed = texts.select(F.sha2("raw_text", 256).alias("text_key"), F.col("raw_text").alias("text"))
    raw = ner(keyed).where(F.coalesce("score", F.lit(0.0)) >= min_score)
    grouped = raw.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "score", "word", "start", "end"))).alias("e"))
    named = F.transform("e", lambda x: F.struct(x["label"].alias("entity_group"), x["score"].alias("score"), x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end")))
    merged = keyed.join(grouped, "text_key").select("text_key", "text", merge_adjacent(named, "text", min_score).alias("e"))
    rows = merged.select("text_key", "text", F.posexplode("e").alias("pos", "x"))
    rows = rows.select("text_key", "pos", F.col("x.entity_group").alias("label"), F.trim(close_parenthesis(F.col("x.word"), F.col("text"), F.col("x.end"))).alias("word"), "x.score", "x.start", "x.end")
    return spans.select("source_index", "span_index", F.sha2("raw_text", 256).alias("text_key")).join(rows, "text_key").drop("text_key")


def group_by_label(mentions: DataFrame) -> DataFrame:
    """(source_index, span_index, ner map<label, words>): words in the order they came, repeats kept."""
    each = mentions.groupBy("source_index", "span_index", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    return each.groupBy("source_index", "span_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "words")))).alias("ner"))


def regroup(spans: DataFrame, inputs: DataFrame, columns: list[str]) -> DataFrame:
    """(source_index, raw_text, outputs): the spans of each text in order; a text without spans has none."""
    packed = spans.groupBy("source_index").agg(F.array_sort(F.collect_list(F.struct("span_index", *columns)), lambda a, b: a["span_index"] - b["span_index"]).alias("_s"))
    outputs = F.transform("_s", lambda s: F.struct(*[s[c].alias(c) for c in columns]))
    return inputs.join(packed, "source_index", "left").select("source_index", "raw_text", F.coalesce(outputs, F.array()).alias("outputs"))


def translate(spans: DataFrame, provider: Provider, extra: tuple[str, ...] = ()) -> DataFrame:
    """Translate spans whose language asks for it: raw_text becomes the translation, original_text keeps what it was, translated is set.

    provider: (text) → (text, translation), asked for distinct texts. Entities are looked for in the translation.
    """
    wanted = [*L.TRANSLATED_LANGUAGES, *extra]
    routed = F.col("language_info.language").isin(wanted) & (F.trim("raw_text") != "")
    asked = spans.where(routed).select(F.col("raw_text").alias("text")).distinct()
    answers = provider(asked).select(F.col("text").alias("_t"), F.col("translation").alias("_tr"))
    joined = spans.join(answers, (spans["raw_text"] == F.col("_t")) & routed, "left")
    done = F.col("_tr").isNotNull()
    return joined.select(
        *[c for c in spans.columns if c != "raw_text"],
        F.coalesce("_tr", "raw_text").alias("raw_text"),
        F.when(done, F.col("raw_text")).alias("original_text"),
        F.when(done, F.lit(True)).alias("translated"),
    )


def default_ner(names: pd.DataFrame | DataFrame, spark=None) -> Provider:
    """An offline NER over a table (word, label)."""
    from orgweave.providers import gazetteer_ner

    return gazetteer_ner(names if isinstance(names, DataFrame) else spark.createDataFrame(names))
