"""The trained language detector and the dictionary automaton against slow forms."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orgweave import providers
from orgweave.functions import detector
from orgweave.functions import language as lang
from orgweave.plans.config import PipelineConfig
from orgweave.plans.pipeline import Engine

LABELLED = [
    ("the quick brown fox and the lazy dog", "en"), ("the university of the north", "en"), ("der schnelle braune Fuchs und die Hündin", "de"), ("die Universität für Ärzte", "de"),
    ("le renard brun et le chien", "fr"), ("université de la région", "fr"), (None, "fr"), ("lost", None), ("blank", " "), ("", "en"), ("123 !?", "de"),
]


def slow_model(rows, max_grams):
    counts = defaultdict(Counter)
    for text, code in rows:
        if text is not None and code and code.strip():
            for w in re.findall(r"[^\W\d_]+", text.lower()):
                padded = f" {w} "
                for k, t in ((1, w), (2, padded), (3, padded)):
                    counts[code].update(t[i : i + k] for i in range(len(t) - k + 1))
    total = Counter()
    for c in counts.values():
        total.update(c)
    kept = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0].encode()))[:max_grams]]
    return {code: {g: math.log((c[g] + 0.5) / (sum(c[x] for x in kept) + 0.5 * len(kept))) for g in kept} for code, c in counts.items()}


@pytest.mark.parametrize("max_grams", [20_000, 40])
def test_detector_equals_slow_counts(spark, max_grams):
    labelled = spark.createDataFrame([(t, c, 1) for t, c in LABELLED], "text string, lang string, gram int").repartition(3)
    model = detector.train(labelled, max_grams)
    slow = slow_model(LABELLED, max_grams)
    assert model.languages == tuple(sorted(slow))
    assert set(model.table) == set(next(iter(slow.values())))
    for g, row in model.table.items():
        assert row.tolist() == pytest.approx([slow[code][g] for code in model.languages])


def test_detector_answers(spark):
    model = detector.train(spark.createDataFrame(LABELLED, "text string, lang string"))
    texts = ["the dog of the university", "die Ärzte und der Hund", "le chien de la région", None, "", "漢字", "77"]
    got = {r.text: r for r in model.provider()(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert [got[t].first for t in texts] == ["en", "de", "fr", None, None, None, None]
    assert got[texts[0]].first_p > 0.9 and got[texts[0]].second in ("de", "fr") and got[texts[0]].first_p + got[texts[0]].second_p <= 1 + 1e-9
    none = detector.train(spark.createDataFrame([], "text string, lang string"))
    assert none.languages == () and none.likeliest("the", {}) == (None, None, None, None)
    one = detector.train(spark.createDataFrame([("the", "en")], "text string, lang string"))
    assert one.likeliest("the", {}) == ("en", 1.0, None, None)


def test_detector_tells_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = detector.train(docs.where("doc_id % 2 = 0").select("text", "lang"))
    held = docs.where("doc_id % 2 = 1 and trim(text) <> ''").select("text", "lang")
    joined = held.join(model.provider()(held.select("text").distinct()), "text")
    right = joined.agg(F.avg((F.col("first") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.95


@pytest.mark.parametrize("method", ["langdetect", "combined_langdetect", "combined_e5"])
def test_engine_trains_a_detector(spark, method):
    labelled = spark.createDataFrame(LABELLED, "text string, lang string")
    engine = Engine(spark, PipelineConfig(enable_language_detect=True, language_method=method, enable_entity_linking=False), language_texts=labelled)
    info = [r.language_info for r in engine.get_language(engine.get_spans(spark.createDataFrame([(0, "le chien de la région et le renard"), (1, "77")], "source_index long, raw_text string"))).orderBy("source_index").collect()]
    assert info[0].language == "fr"
    assert set(lang.METHODS) == {"heuristic", "langdetect", "e5", "fasttext", "combined_langdetect", "combined_e5"}


def slow_terms(texts, terms, limit):
    labels = defaultdict(set)
    for g, label in terms:
        labels[g].add(label)
    out = []
    for key, text in texts:
        text = text or ""
        spans = [m.span() for m in re.finditer(r"\w+", text)]
        hits = []
        for i in range(len(spans)):
            for j in range(i, min(i + limit, len(spans))):
                a, b = spans[i][0], spans[j][1]
                hits += [(a - b, a, label or "", label, b) for label in labels.get(text[a:b].lower(), ())]
        taken = []
        for _, a, _, label, b in sorted(hits, key=lambda h: h[:3]):
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, label))
        out += [(key, i, label, text[a:b], a, b) for i, (a, b, label) in enumerate(sorted(taken, key=lambda t: t[:2]))]
    return sorted(out, key=str)


@pytest.mark.parametrize(("piece", "limit"), [(200_000, None), (7, None), (7, 2)])
def test_terms_equal_slow_n_grams(spark, monkeypatch, piece, limit):
    monkeypatch.setattr(providers, "PIECE_TERMS", piece)
    r = random.Random(piece)
    pool = ["new", "york", "university", "of", "the", "straße", "İzmir", "ΟΔΟΣ", "a", "b-c", "st."]
    texts = [(str(i), r.choice([" ", ", ", "-"]).join(r.choices(pool, k=r.randint(0, 12)))) for i in range(120)] + [("n", None), ("e", ""), ("l", "new york " * 300)]
    terms = [(" ".join(r.choices(pool, k=r.randint(1, 4))).lower(), r.choice(["ORG", "CITY"])) for _ in range(40)] + [("new york", "CITY"), ("new york", "ORG"), ("york university", "ORG"), ("", "X")]
    table = spark.createDataFrame([*terms, (None, "X")], "gram string, label string")
    got = providers.match_terms(spark.createDataFrame(texts, "text_key string, text string").repartition(3), table, limit)
    rows = sorted([(x.text_key, x.pos, x.label, x.word, x.start, x.end) for x in got.collect()], key=str)
    longest = max(len(re.findall(r"\w+", g)) for g, _ in terms)
    assert rows == slow_terms(texts, [t for t in terms if t[0]], longest if limit is None else limit)
    plan = got._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[-1].replace("Exchange RoundRobinPartitioning", "").replace("REPARTITION_BY_NUM", "")


def test_no_terms(spark):
    texts = spark.createDataFrame([("1", "some text")], "text_key string, text string")
    assert providers.match_terms(texts, spark.createDataFrame([], "gram string, label string")).count() == 0
