"""The sequence tagger: best paths and probabilities against enumeration, training, and the stages that use it."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgweave.operators import spans, tagger
from orgweave.plans.config import PipelineConfig
from orgweave.plans.pipeline import Engine

ORGS = ["University of {c}", "Institute for {x}", "{c} General Hospital", "{x} Research Center", "Academy of {x}"]
CITIES = ["Aden", "Bern", "Cork", "Dijon", "Essen", "Faro", "Graz", "Hull"]
FIELDS = ["Physics", "Marine Biology", "Law", "Applied Arts"]
COUNTRIES = ["Spain", "France", "United Kingdom", "Peru"]


def affiliation(r):
    parts = [("Dept. of " + r.choice(FIELDS), "SUB")] if r.random() < 0.5 else []
    parts.append((r.choice(ORGS).format(c=r.choice(CITIES), x=r.choice(FIELDS)), "ORG"))
    parts += [(r.choice(CITIES), "CITY")] if r.random() < 0.7 else []
    parts.append((r.choice(COUNTRIES), "COUNTRY"))
    text, entities = "", []
    for word, label in parts:
        text += ", " if text else ""
        entities.append((len(text), len(text) + len(word), label))
        text += word
    return text, entities


def table(spark, rows):
    return spark.createDataFrame([(t, e, 1) for t, e in rows], "text string, entities array<struct<start:int,end:int,label:string>>, pos int")


def test_paths_and_probabilities_equal_enumeration():
    rng = np.random.default_rng(7)
    tags = tagger.TagSet(("A", "B"))
    for n in range(1, 6):
        for _ in range(15):
            emissions, moves = rng.normal(size=(n, tags.size)), rng.normal(size=(tags.size + 1, tags.size))
            moves = np.where(tags.allowed, moves, tagger._NEVER)
            score = lambda p: sum(emissions[i, t] + moves[p[i - 1] if i else -1, t] for i, t in enumerate(p))  # noqa: B023, E731
            paths = list(itertools.product(range(tags.size), repeat=n))
            values = np.array([score(p) for p in paths])
            best = tagger.viterbi(emissions, moves)
            assert score(best) == pytest.approx(values.max())
            assert all(tags.allowed[best[i - 1] if i else -1, t] for i, t in enumerate(best))
            p = np.exp(values - values.max())
            slow = np.zeros((n, tags.size))
            for path, v in zip(paths, p / p.sum(), strict=True):
                slow[np.arange(n), list(path)] += v
            assert tagger.marginals(emissions, moves) == pytest.approx(slow, abs=1e-9)


def test_tags_of_entities():
    text = "A b, (C-d) e"
    at = tagger.tokens(text)
    assert [text[a:b] for a, b in at] == ["A", "b", ",", "(", "C", "-", "d", ")", "e"]
    tags = tagger.TagSet(("X", "Y"))
    coded = tags.encode(at, [(0, 3, "X"), (6, 9, "Y"), (2, 3, "Y"), (11, 12, "Z")])
    assert coded == [1, 2, 0, 0, 3, 4, 4, 0, 0]
    assert tags.decode(coded) == [(0, 1, "X"), (4, 6, "Y")]
    assert tags.decode([1, 1, 2, 3]) == [(0, 0, "X"), (1, 2, "X"), (3, 3, "Y")]


def test_held_out_affiliations(spark):
    r = random.Random(1)
    rows = [affiliation(r) for _ in range(420)]
    model = tagger.train(table(spark, [*rows[:300], (None, None), ("nothing here", None), (rows[0][0], None)]).limit(302))
    held = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(rows[300:])] + [("n", None), ("e", "")], "text_key string, text string")
    gold = spark.createDataFrame([(str(i), a, b, label) for i, (_, e) in enumerate(rows[300:]) for a, b, label in e], "text_key string, start int, end int, label string")
    found = model.ner()(held).persist()
    assert tagger.score_entities(found, gold).first().f1 > 0.95
    assert found.where("score < 0 or score > 1").count() == 0
    texts = dict(enumerate(t for t, _ in rows[300:]))
    assert all(x.word == texts[int(x.text_key)][x.start : x.end] for x in found.collect())
    again = tagger.train(table(spark, rows[:300]).repartition(3)).ner()(held)
    assert tagger.train(table(spark, rows[:300]).repartition(2)).ner()(held).exceptAll(again).count() == 0  # the order of rows doesn't matter


def test_what_was_not_seen_has_no_weight():
    name = lambda n: f"Customer#000{n:06d}"
    rows = [(f"{name(n * 977)}, NATION_{n % 25}", [(0, 18, "ORG"), (20, 27 + len(str(n % 25)), "COUNTRY")]) for n in range(300)]
    model = tagger.fit(rows)
    # names whose parts that were seen are the same, so they differ only in what was not
    found = {tuple(model.entities(f"{name(1000 * n + 455)}, NATION_3")) for n in range(1, 900)}
    assert len(found) == 1


def test_no_entities(spark):
    model = tagger.train(table(spark, []))
    assert model.entities("some text") == []
    assert tagger.train(table(spark, [("some text", [])])).entities("some text") == []
    assert model.ner()(spark.createDataFrame([("1", "x")], "text_key string, text string")).count() == 0


def test_engine_trains_its_own_models(spark):
    r = random.Random(2)
    rows = [affiliation(r) for _ in range(250)]
    pairs = [(f"{a[0]} / {b[0]}", [(0, len(a[0]), "AFF"), (len(a[0]) + 3, len(a[0]) + 3 + len(b[0]), "AFF")]) for a, b in itertools.pairwise(rows)]
    engine = Engine(spark, PipelineConfig(span_strategy="model", enable_entity_linking=False), entity_texts=table(spark, rows), span_texts=table(spark, pairs))
    inputs = spark.createDataFrame([(7, "University of Bern, Bern, Spain / Institute for Law, Peru"), (8, None)], "source_index long, raw_text string")
    parts = engine.get_spans(inputs)
    assert [(x.source_index, x.raw_text) for x in parts.orderBy("source_index", "span_index").collect()][:2] == [(7, "University of Bern, Bern, Spain"), (7, "Institute for Law, Peru")]
    mentions = engine.get_ner(parts).orderBy("span_index", "pos").select("span_index", "label", "word").collect()
    assert [tuple(x) for x in mentions] == [(0, "ORG", "University of Bern"), (0, "CITY", "Bern"), (0, "COUNTRY", "Spain"), (1, "ORG", "Institute for Law"), (1, "COUNTRY", "Peru")]
    assert spans.group_by_label(engine.get_ner(parts)).agg(F.count("*")).first()[0] == 2


def test_all_texts_are_learned_from_in_shards(spark):
    r = random.Random(4)
    rows = {f"{t} {i}": e for i, (t, e) in enumerate(affiliation(r) for _ in range(5_000))}
    # one text alone has this label, and of 5,000 texts it has the greatest hash
    each = spark.createDataFrame([(t,) for t in rows], "text string")
    last = each.orderBy(F.xxhash64("text").desc(), F.desc("text")).first().text
    rows[last] = [(a, b, "RARE") for a, b, _ in rows[last]]
    model = tagger.train(table(spark, rows.items()))
    assert model.tags.labels == ("CITY", "COUNTRY", "ORG", "RARE", "SUB")
    wrong = sum([x[:3] for x in model.entities(t)] != e for t, e in list(rows.items())[:500] if t != last)
    assert wrong < 10
    # neither the order of rows nor how they are dealt matters
    again = tagger.train(table(spark, list(rows.items())[::-1]).repartition(7))
    order = [model.known[f] for f in sorted(model.known)]
    assert sorted(model.known) == sorted(again.known) and (model.weights[order] == again.weights[[again.known[f] for f in sorted(again.known)]]).all()
    assert (model.transitions == again.transitions).all() and model.margin == again.margin


def test_paths_of_many_texts_equal_those_of_each():
    rng = np.random.default_rng(8)
    emissions, moves = rng.integers(0, 3, (40, 6, 5)).astype(float), rng.integers(0, 2, (6, 5)).astype(float)
    assert tagger._paths(emissions, moves).tolist() == [tagger.viterbi(e, moves) for e in emissions]
