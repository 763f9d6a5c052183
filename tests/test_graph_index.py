"""The graph and cell indexes against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgweave.operators import hnsw, ivf, linking
from orgweave.plans.config import LinkConfig
from orgweave.providers import hashed_encoder
from orgweave.sources import registry as reg
from orgweave.sources.tables import build_index


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "iid long, embedding array<float>")


def unit(rng, n, dim=24):
    x = rng.normal(size=(n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def share_found(exact, near):
    a, b = ({(r.qid, r.iid) for r in df.select("qid", "iid").collect()} for df in (exact, near))
    return len(a & b) / len(a)


def test_walks_over_shards_find_the_neighbours(spark):
    rng = np.random.default_rng(3)
    x = unit(rng, 3_000)
    x[:900] = x[0]  # a third of all rows are copies
    items = vectors(spark, x)
    graphs = hnsw.build(items, shard_rows=1_000).persist()
    assert graphs.count() == 3 and graphs.agg(F.sum("n")).first()[0] == 3_000
    queries = items.where("iid % 30 = 1 and iid > 900").withColumnRenamed("iid", "qid")
    near = hnsw.search(queries, graphs, 10)
    assert share_found(linking.knn(queries, items, 10), near) >= 0.95
    assert near.groupBy("qid").count().where("count <> 10").count() == 0
    scores = {(r.qid, r["rank"]): r.score for r in near.collect()}
    assert all(scores[q, 1] >= scores[q, 10] and abs(scores[q, 1] - 1) < 1e-5 for q, rank in scores if rank == 1)
    assert hnsw.compared_pairs(queries, graphs, 10).agg(F.avg("compared")).first()[0] < 0.5 * 3_000  # shards this small are searched in good part
    # copies are no dead end: from among them the others are found too, and of equals any
    copies = hnsw.search(items.where("iid = 5").withColumnRenamed("iid", "qid"), graphs, 10)
    assert all(abs(r.score - 1) < 1e-5 for r in copies.collect())


def test_graphs_do_not_depend_on_the_order_of_rows(spark):
    items = vectors(spark, unit(np.random.default_rng(4), 300))
    one, other = (hnsw.build(df).select("ids", "layers").collect() for df in (items.repartition(1), items.orderBy(F.desc("iid")).repartition(5)))
    assert one == other


@pytest.mark.parametrize("n", [0, 1, 2, 3, 12])
def test_tiny_tables(spark, n):
    x = unit(np.random.default_rng(n), n) if n else np.zeros((0, 24), np.float32)
    items = vectors(spark, x).union(spark.createDataFrame([(99, None), (None, None)], "iid long, embedding array<float>"))
    queries = vectors(spark, unit(np.random.default_rng(9), 2)).withColumnRenamed("iid", "qid")
    got = hnsw.search(queries, hnsw.build(items), 5).collect()
    exact = linking.knn(queries, items, 5).collect()
    assert {(r.qid, r.iid, r["rank"]) for r in got} == {(r.qid, r.iid, r["rank"]) for r in exact}


def test_links_of_a_layer():
    x = unit(np.random.default_rng(1), 400)
    starts, targets = hnsw.links(x, degree=6)
    degree = np.diff(starts)
    assert degree.max() <= 12 and degree.min() >= 1 and len(targets) == starts[-1]
    nearest = np.argsort(-(x @ x.T), axis=1)[:, 1]
    linked = [nearest[i] in targets[starts[i] : starts[i + 1]] for i in range(400)]
    assert np.mean(linked) > 0.99


def test_cells_probed_all_are_exact(spark):
    x = unit(np.random.default_rng(5), 600)
    x[100:300] = x[100]
    items = vectors(spark, x)
    queries = items.where("iid % 40 = 0").withColumnRenamed("iid", "qid")
    centres = ivf.train_cells(items)
    row = lambda df: sorted((r.qid, r["rank"], r.iid) for r in df.collect())
    assert row(ivf.search(queries, items, 7, centres, probes=len(centres))) == row(linking.knn(queries, items, 7))


def test_index_of_type_hnsw_links_like_the_exact_one(spark, tmp_path):
    names = [f"{a} {b} of {c}" for a in ("University", "Institute", "Hospital", "Academy") for b in ("Physics", "Law", "Arts", "Medicine") for c in ("Aden", "Bern", "Cork", "Dijon", "Essen")]
    registry = reg.from_table(spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "id string, name string"), {"id": "id", "name": "name"}, "test").persist()
    flat = build_index(registry, hashed_encoder(), "hashed", f"file://{tmp_path}/flat", "flat")
    graph = build_index(registry, hashed_encoder(), "hashed", f"file://{tmp_path}/graph", "hnsw")
    assert "layers" in graph.columns
    again = build_index(registry, hashed_encoder(), "hashed", f"file://{tmp_path}/graph", "hnsw")
    assert again.count() == graph.count()
    mentions = spark.createDataFrame([(str(i), n.replace("i", "y", 1), None, None, None) for i, n in enumerate(names[::7])], "mention_key string, word string, country string, city string, region string")
    found = []
    for index, config in ((flat, LinkConfig()), (graph, LinkConfig()), (flat, LinkConfig(graph_from=10))):
        links = linking.link_mentions(mentions, registry, config, vectors=index, encoder=hashed_encoder())
        found.append(sorted((r.mention_key, r.record_id, r.score) for r in links.collect()))
    assert found[0] and found[0] == found[1] == found[2]
    with pytest.raises(ValueError, match="index type"):
        build_index(registry, hashed_encoder(), "hashed", f"file://{tmp_path}/x", "tree")
