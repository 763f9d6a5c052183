"""What models are asked: candidates with their other names, the lettered choice of a judge, the chat of a translator.

The texts are made in Spark, so a provider only runs its model: one row per mention or text, with the prompt beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweave.functions.text import blank_to_null
from orgweave.sources.registry import _strings

#: Candidates that a judge can be shown, one per letter; N says none of them.
LETTERS = "ABCDEFGHIJKLMOPQRSTU"
#: Other names of a candidate: aliases taken over beside all acronyms, and how many of them a prompt names.
ALIASES, SHOWN_NAMES = 5, 3

TRANSLATOR = "Translate organisation affiliations to English. Keep names of people and addresses as they are. Answer with the translation only."


def enrich(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """candidates (mention_key, record_id, …) plus name, other_names, city and country; other_names: the first aliases, then all acronyms.

    A record that the registry lacks keeps its row, named by its id.
    """
    names = F.concat(F.slice(_strings(F.col("aliases")), 1, ALIASES), _strings(F.col("acronyms")))
    facts = registry.select(F.col("id").alias("record_id"), "name", names.alias("other_names"), "city", "country")
    out = candidates.join(facts, "record_id", "left")
    return out.withColumn("name", F.coalesce(blank_to_null(F.col("name")), "record_id")).withColumn("other_names", _strings(F.col("other_names")))


def choice_line(letter: Column, name: Column, other_names: Column, city: Column, country: Column) -> Column:
    """`A) name — a.k.a. x, y — city — country`, empty parts left out."""
    known_as = F.concat(F.lit("a.k.a. "), F.nullif(F.array_join(F.slice(other_names, 1, SHOWN_NAMES), ", "), F.lit("")))
    return F.concat(letter, F.lit(") "), F.concat_ws(" — ", name, known_as, blank_to_null(city), blank_to_null(country)))


def judge_prompts(candidates: DataFrame, mentions: DataFrame, registry: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """((mention_key, prompt, n_choices), (mention_key, letter, record_id)) for mentions (mention_key, word[, raw_text]) and their candidates (…, score).

    The best candidates, `most` at most and never more than there are letters, are lettered by score, ties by record. A mention without
    candidates has no prompt. Without raw_text the word stands for the whole string.
    """
    order = Window.partitionBy("mention_key").orderBy(F.desc("score"), "record_id")
    ranked = candidates.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= min(most, len(LETTERS)))
    lettered = enrich(ranked, registry).withColumn("letter", F.substring(F.lit(LETTERS), F.col("_no"), F.lit(1)))
    lines = lettered.select("mention_key", "letter", choice_line(F.col("letter"), F.col("name"), F.col("other_names"), F.col("city"), F.col("country")).alias("line"))
    lists = lines.groupBy("mention_key").agg(F.array_sort(F.collect_list(F.struct("letter", "line"))).alias("l"))
    text = F.col("raw_text") if "raw_text" in mentions.columns else F.col("word")
    n = F.size("l")
    letters = F.concat(F.lit("A"), F.when(n > 1, F.concat(F.lit("–"), F.element_at("l", -1)["letter"])).otherwise(""))
    asked = F.concat(
        F.lit('Affiliation: "'), text, F.lit('"\nWhich entry is "'), F.col("word"), F.lit('"?\n\n'), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n\nAnswer with one letter ("), letters, F.lit("), or N if none is."),
    )
    prompts = lists.join(mentions.withColumn("_text", text), "mention_key").select("mention_key", asked.alias("prompt"), n.alias("n_choices"))
    return prompts, lettered.select("mention_key", "letter", "record_id")


def translation_chats(texts: DataFrame, system: str = TRANSLATOR) -> DataFrame:
    """(text) → (text, chat array<struct(role, content)>): the instruction, then the text. Null and blank texts are not asked."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return texts.where(blank_to_null(F.col("text")).isNotNull()).select("text", F.array(message("system", F.lit(system)), message("user", F.col("text"))).alias("chat"))
