"""Checked walks give what the exact search gives, and equal scores go by id."""

import numpy as np
import pytest

from orgweave.operators import hnsw, linking
from orgweave.plans.settle import materialise


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(4).normal(size=(3_000, 48))
    x[100:160] = x[7]  # more equal ones than are asked for
    return materialise(spark.createDataFrame([(str(i), (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "iid string, embedding array<float>"), "hard")


def test_checked_walks_are_exact(vectors):
    queries = vectors.where("iid in ('7', '150') or iid like '%50'").withColumnRenamed("iid", "qid")
    exact = {(r.qid, r.iid, r["rank"]) for r in linking.knn(queries, vectors, 10).collect()}
    graphs = materialise(hnsw.build(vectors, shard_rows=1_000), "graphs")
    found = {(r.qid, r.iid, r["rank"]) for r in hnsw.search(queries, graphs, 10, beam=10, exact=True).collect()}
    assert found == exact
