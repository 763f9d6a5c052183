"""The trained classifier of organisation types."""

import random

import numpy as np
import pytest

from orgweave.functions import lexicons as L
from orgweave.operators import orgtype, typemodel
from orgweave.plans.config import PipelineConfig
from orgweave.plans.pipeline import Engine

KINDS = [
    ("University of {}", "Higher Education", "HEI.institution"), ("{} University College", "Higher Education", "HEI.college"), ("{} General Hospital", "Healthcare", "HEA.hospital"), ("{} Eye Clinic", "Healthcare", "HEA.clinic"),
    ("{} Trading Ltd", "Company", "PRC.sme"), ("Ministry of {}", "Public Administration", "PUB.national"), ("{} Cancer Institute", "Research Organization", "REC.institute"),
]
SYLLABLES = ["ba", "den", "ko", "lin", "mar", "to", "vi", "sen", "gra", "pol", "ne", "rus"]


def rows(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        form, one, two = r.choice(KINDS)
        out.append((form.format("".join(r.choices(SYLLABLES, k=3)).title()), one, two))
    return out


def labelled(spark, data):
    return spark.createDataFrame([(*x, 1) for x in data], "name string, lvl1 string, lvl2 string, pos int")


def test_held_out_names(spark):
    model = typemodel.train(labelled(spark, [*rows(600, 1), (None, "Company", None), (" ", "Company", None), ("x", None, "PRC.sme"), ("Odd", "Company", "HEA.hospital")]))
    held = rows(300, 2)
    got = [model.classify(n) for n, _, _ in held]
    assert np.mean([g == (a, b) for g, (_, a, b) in zip(got, held, strict=True)]) > 0.97
    assert all(b is None or b.startswith(L.ORG_TYPE_PREFIX[a]) for a, b in got)
    assert "HEA.hospital" not in model.under["Company"]
    assert model.classify(None) == model.classify("  ") == ("Unknown", None)
    table = orgtype.classify(spark.createDataFrame([(n, "X") for n, _, _ in held[:20]], "name string, country string"), model.provider()).collect()
    assert {(r["name"], r.lvl1, r.lvl2) for r in table} == {(n, *g) for (n, _, _), g in list(zip(held, got, strict=True))[:20]}


def test_gradient_by_differences():
    r = np.random.default_rng(3)
    feats = [np.unique(r.integers(0, 40, 5)) for _ in range(30)]
    labels = [str(x) for x in r.integers(0, 3, 30)]
    model = typemodel.fit(feats, labels, steps=3000, rate=1.0, l2=1e-2)

    def loss(w, b):
        m = typemodel.Softmax(model.classes, w, b)
        return -np.mean([np.log(m.probabilities(f)[model.classes.index(y)]) for f, y in zip(feats, labels, strict=True)]) + 0.5e-2 * (w**2).sum()

    best = loss(model.weights, model.bias)
    for _ in range(20):  # no direction leads down from where it ended
        i, j = r.integers(0, 40), r.integers(0, 3)
        for step in (1e-3, -1e-3):
            w = model.weights.copy()
            w[i, j] += step
            assert loss(w, model.bias) > best - 1e-7


def test_no_labels_and_the_order_of_rows(spark):
    assert typemodel.train(labelled(spark, [])).classify("University of X") == ("Unknown", None)
    one, other = (typemodel.train(labelled(spark, rows(80, 4)).repartition(k)) for k in (1, 3))
    assert one.first.weights == pytest.approx(other.first.weights)
    assert typemodel.train(labelled(spark, [("A b", "Company", None)])).classify("A b") == ("Company", None)


def test_engine_trains_a_classifier(spark):
    engine = Engine(spark, PipelineConfig(enable_org_types=True), type_names=labelled(spark, rows(200, 5)))
    assert engine.org_types is not None
    with pytest.raises(ValueError, match="enable_org_types"):
        Engine(spark, PipelineConfig(enable_org_types=True))
