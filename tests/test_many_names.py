"""Large dictionaries, and short texts that come in one partition."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_detector_and_terms import slow_terms

from orgweave import providers
from orgweave.operators import spans
from orgweave.plans import pipeline
from orgweave.plans.config import PipelineConfig
from orgweave.plans.pipeline import Engine


@pytest.mark.parametrize("limit", [None, 2])
def test_joined_terms_equal_slow_n_grams(spark, monkeypatch, limit):
    monkeypatch.setattr(providers, "_RUN", 16)
    r = random.Random(3)
    pool = ["new", "york", "university", "of", "the", "straße", "İzmir", "ΟΔΟΣ", "a", "b-c", "st."]
    texts = [(str(i), r.choice([" ", ", ", "-"]).join(r.choices(pool, k=r.randint(0, 12)))) for i in range(120)] + [("n", None), ("e", ""), ("l", "new york " * 300), (None, "new york")]
    terms = list({(" ".join(r.choices(pool, k=r.randint(1, 4))).lower(), r.choice(["ORG", "CITY"])) for _ in range(40)} | {("new york", "CITY"), ("new york", "ORG"), ("york university", "ORG")})
    got = providers.join_terms(spark.createDataFrame(texts, "text_key string, text string").repartition(3), spark.createDataFrame(terms, "gram string, label string"), len(terms), limit)
    rows = sorted([(x.text_key, x.pos, x.label, x.word, x.start, x.end) for x in got.collect()], key=str)
    longest = max(len(re.findall(r"\w+", g)) for g, _ in terms)
    assert len(rows) > 300 and rows == slow_terms(texts, terms, longest if limit is None else limit)


def test_large_dictionaries_are_not_sent_to_the_texts(spark, monkeypatch):
    """No term comes to the driver or to every worker once there are more than `SENT_TERMS`."""
    names = spark.range(300).selectExpr("concat('Works ', id) as word", "'ORG' as label")
    texts = spark.range(300).selectExpr("cast(id as string) as text_key", "concat('at works ', id, ', works 999') as text")
    found = lambda: sorted((r.text_key, r.word) for r in providers.gazetteer_ner(names)(texts).collect())
    by_automata = found()
    monkeypatch.setattr(providers, "SENT_TERMS", 50)
    monkeypatch.setattr(providers, "_finder", None)
    assert found() == by_automata == sorted((str(i), f"works {i}") for i in range(300))


def test_short_texts_are_dealt_to_all_cores(spark, monkeypatch):
    """One partition of texts, and one of names: neither the spans' stage nor the entities' runs in a single task."""
    parts = {}

    def settled(df, tag):
        parts[tag] = df.select(F.spark_partition_id().alias("p")).distinct().count()
        return kept(df, tag)

    kept = pipeline.materialise
    monkeypatch.setattr(pipeline, "materialise", settled)
    names = spark.range(200).coalesce(1).selectExpr("concat('Works ', id) as word", "'ORG' as label")

    def ner(df):
        parts["entities"] = df.select(F.spark_partition_id().alias("p")).distinct().count()
        return providers.gazetteer_ner(names)(df)

    texts = spark.range(200).coalesce(1).selectExpr("id as source_index", "concat('Works ', id, '; Works ', id + 1) as raw_text")
    out = Engine(spark, PipelineConfig(enable_language_detect=True), ner=ner).process(texts)
    assert out.where("size(outputs) = 2").count() == 200
    assert min(parts["spans"], parts["entities"]) >= spark.sparkContext.defaultParallelism


def test_no_mentions_of_blank_texts(spark):
    """Blank spans have no mentions, and equal ones the same."""
    names = spark.createDataFrame([("Works 1", "ORG")], "word string, label string")
    rows = spark.createDataFrame([(0, 0, " "), (1, 0, "Works 1"), (2, 0, "Works 1")], "source_index long, span_index int, raw_text string")
    assert sorted((r.source_index, r.word) for r in spans.tag_mentions(rows, providers.gazetteer_ner(names)).collect()) == [(1, "Works 1"), (2, "Works 1")]
