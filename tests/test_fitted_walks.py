"""The beam grows until walks find the share of the nearest that is wanted."""

import numpy as np

from orgweave.operators import hnsw, linking
from orgweave.plans.settle import materialise


def test_beam_is_fitted_to_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "BEAM", 2)
    x = np.random.default_rng(4).normal(size=(4_100, 64))
    every = materialise(spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "iid long, embedding array<float>"), "hard")
    items, queries = every.where("iid < 4000"), every.where("iid >= 4000").withColumnRenamed("iid", "qid")
    graphs = materialise(hnsw.build(items), "graphs")
    exact = {(r.qid, r.iid) for r in linking.knn(queries, items, 2).collect()}
    share = lambda **how: len(exact & {(r.qid, r.iid) for r in hnsw.search(queries, graphs, 2, **how).collect()}) / len(exact)
    assert share(beam=2) < 0.9
    assert hnsw.fitted_beam(queries, graphs, 2) > 2
    assert share() >= hnsw.RECALL
