"""Approximate nearest neighbours by walks over hierarchical navigable small-world graphs, one per hash shard of the items.

A shard holds at most `SHARD_ROWS` vectors and `SHARD_BYTES` bytes of them, whatever the table's size, and one task builds its graph. A vector is on layer l
with probability `DEGREE`^-l, by a hash of its id. On each layer a vector is linked to those of its nearest `WIDE` neighbours that no closer link already
stands for, then to the nearest others, up to `DEGREE`, and to one vector by chance, so that groups of copies stay reachable; links go both
ways, and a vector keeps its 2 × `DEGREE` best. Neighbours within a shard are found by blocked matrix products, which for a bounded shard is faster than
inserting one vector after another, and leaves no order of insertion to depend on.

The graphs are a table, a row per shard: ids, vectors, and the layers' adjacency in compressed rows. A search sends blocks of queries to every shard.
There a block walks as one: each query opens the best vector of its beam that isn't opened yet, and the block's unseen neighbours are scored
in one product. A walk ends when the beam holds nothing left to open. The k best of each shard go on and are merged by a window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orgweave.operators.packed import greatest, packed
from orgweave.plans.settle import materialise

SHARD_ROWS = 1 << 15
SHARD_BYTES = 32 << 20
DEGREE = 12
WIDE = 48
#: Vectors that a walk holds at least; k, if that is more.
BEAM = 24
#: The share of the nearest that walks are to find, by queries that are searched exactly too, and how many of these there are at most; vectors that a walk holds at most for it.
RECALL = 0.95
PROBES = 512
MOST_BEAM = 2_048
#: Queries that walk together.
BLOCK = 256
_PRODUCT_ROWS = 512

GRAPH = "shard int, n int, dim int, data binary, layers array<struct<nodes:binary,starts:binary,links:binary>>"


def _near(x: np.ndarray, wide: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, neighbours, scores) for blocks of rows: the `wide` nearest others of each row, nearest first."""
    n = len(x)
    for lo in range(0, n, _PRODUCT_ROWS):
        scores = x[lo : lo + _PRODUCT_ROWS] @ x.T
        rows = np.arange(len(scores))
        scores[rows, rows + lo] = -np.inf
        near = np.argpartition(-scores, wide - 1, axis=1)[:, :wide]
        near.sort(axis=1)
        mine = np.take_along_axis(scores, near, axis=1)
        order = np.argsort(-mine, axis=1, kind="stable")
        yield lo, np.take_along_axis(near, order, axis=1), np.take_along_axis(mine, order, axis=1)


def links(x: np.ndarray, degree: int = DEGREE, wide: int = WIDE, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency of one layer's vectors in compressed rows: (starts, links)."""
    n = len(x)
    if n < 2:
        return np.zeros(n + 1, np.int32), np.zeros(0, np.int32)
    wide, sources, targets = min(wide, n - 1), [], []
    for lo, near, scores in _near(x, wide):
        among = np.matmul(x[near], x[near].transpose(0, 2, 1))
        chosen = np.zeros(near.shape, bool)
        for j in range(wide):
            # a neighbour counts if no chosen one is closer to it than the vector itself
            closest = np.where(chosen, among[:, j, :], -np.inf).max(axis=1)
            chosen[:, j] = (closest < scores[:, j]) & (chosen.sum(axis=1) < degree)
        filled = np.cumsum(~chosen, axis=1) <= (degree - chosen.sum(axis=1))[:, None]
        row, col = np.nonzero(chosen | filled)
        sources.append(row + lo)
        targets.append(near[row, col])
    chance = np.random.default_rng(seed).permutation(n)
    a, b = np.concatenate([*sources, np.arange(n)]), np.concatenate([*targets, chance])
    by_chance = np.arange(len(a)) >= len(a) - n
    # both ways, each pair once; links by chance are kept whatever their score
    a, b, first = np.r_[a, b], np.r_[b, a], np.r_[by_chance, by_chance]
    real = a != b
    a, b, first = a[real], b[real], first[real]
    order = np.lexsort((~first, b, a))
    a, b, first = a[order], b[order], first[order]
    once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    a, b, first = a[once], b[once], first[once]
    score = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65_536]], x[b[i : i + 65_536]]) for i in range(0, len(a), 65_536)])
    order = np.lexsort((b, -score, ~first, a))
    a, b = a[order], b[order]
    begins = np.searchsorted(a, np.arange(n))
    kept = np.arange(len(a)) - begins[a] < 2 * degree
    return np.searchsorted(a[kept], np.arange(n + 1)).astype(np.int32), b[kept].astype(np.int32)


class Layer:
    """A layer's adjacency as a table of rows of equal width, filled up with -1; nodes are numbers of vectors in the shard."""

    def __init__(self, nodes: np.ndarray, starts: np.ndarray, targets: np.ndarray, n: int):
        self.nodes = nodes
        degree = np.diff(starts)
        table = np.full((len(nodes), max(1, int(degree.max(initial=0)))), -1, np.int32)
        table[np.repeat(np.arange(len(nodes)), degree), np.arange(len(targets)) - np.repeat(starts[:-1], degree)] = nodes[targets]
        if len(nodes) == n:
            self.row, self.table = None, table
        else:
            self.row = np.full(n, -1, np.int32)
            self.row[nodes] = np.arange(len(nodes))
            self.table = table

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return self.table[vectors if self.row is None else self.row[vectors]]


def walk(x: np.ndarray, layers: list[Layer], q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(vectors, scores, compared): for each query the best `beam` vectors that its walk met, best first, -1 where there are none; and how many pairs were compared."""
    entries = layers[-1].nodes
    scores = q @ x[entries].T
    compared = scores.size
    hold = min(len(entries), 2)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :hold]
    ids, kept = entries[best], np.take_along_axis(scores, best, axis=1)
    for layer in reversed(layers[:-1]):
        ids, kept, more = _walk_layer(x, layer, q, ids, kept, beam if layer is layers[0] else 2)
        compared += more
    if len(layers) == 1:  # all vectors are entries
        best = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
        ids, kept = entries[best], np.take_along_axis(scores, best, axis=1)
    order = np.argsort(-kept, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(kept, order, axis=1), compared


def _walk_layer(x: np.ndarray, layer: Layer, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    m, start = len(q), ids.shape[1]
    seen = np.zeros((m, len(x)), bool)
    np.put_along_axis(seen, ids, True, axis=1)
    held = np.full((m, max(beam, start)), -1, np.int32)
    value = np.full(held.shape, -np.inf, np.float32)
    held[:, :start], value[:, :start] = ids, scores
    opened = held < 0
    compared, active = 0, np.arange(m)
    while len(active):
        at = np.where(opened[active], -np.inf, value[active]).argmax(axis=1)
        going = ~opened[active, at]
        active, at = active[going], at[going]
        if not len(active):
            break
        opened[active, at] = True
        near = layer.of(held[active, at])
        row, col = np.nonzero(near >= 0)
        who, met = active[row], near[row, col]
        new = ~seen[who, met]
        row, col, who, met = row[new], col[new], who[new], met[new]
        seen[who, met] = True
        compared += len(met)
        fresh = np.full(near.shape, -np.inf, np.float32)
        fresh[row, col] = np.einsum("ij,ij->i", q[who], x[met])
        every = np.concatenate([value[active], fresh], axis=1)
        keep = np.argpartition(-every, held.shape[1] - 1, axis=1)[:, : held.shape[1]]
        value[active] = np.take_along_axis(every, keep, axis=1)
        names = np.concatenate([held[active], near], axis=1)
        done = np.concatenate([opened[active], ~np.isfinite(fresh)], axis=1)
        held[active] = np.take_along_axis(names, keep, axis=1)
        opened[active] = np.take_along_axis(done, keep, axis=1)
    return held, value, compared


def _levels(ids: list, degree: int = DEGREE) -> np.ndarray:
    """The top layer of each vector, by a hash of its id; the first vector is on top of all."""
    spread = np.array([zlib.crc32(repr(i).encode()) for i in ids], np.float64)
    levels = np.floor(-np.log((spread + 1) / (2**32 + 1)) / np.log(degree)).astype(int)
    # no layer of fewer than a handful: its vectors are compared one by one
    while levels.max() > 0 and (levels >= levels.max()).sum() < 2:
        levels = np.minimum(levels, levels.max() - 1)
    return levels


def build(items: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """items (iid, embedding) → a row per shard: shard, n, dim, ids, data, layers. Null ids and null vectors are left out; no items give no rows.

    Vectors have one length; equal ones are items each. `search` takes the greatest inner products: for cosines give unit vectors.
    """
    known = items.where("iid is not null and embedding is not null").select("iid", F.col("embedding").cast("array<float>").alias("embedding"))
    kind = items.schema["iid"].dataType
    size = known.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    rows = max(1, min(shard_rows, SHARD_BYTES // (4 * max(1, size["dim"] or 1))))
    shards = max(1, -(-size["n"] // rows))
    sharded = known.withColumn("shard", F.pmod(F.xxhash64("iid"), F.lit(shards)).cast("int"))
    id_type = to_arrow_type(kind)

    def graph(table: pa.Table) -> pa.Table:
        # an order that doesn't depend on how rows came
        ids = table.column("iid").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: repr(ids[i]))
        ids = [ids[i] for i in order]
        flat = table.column("embedding").combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), -1)[order]
        levels, layers = _levels(ids), []
        for level in range(int(levels.max(initial=0)) + 1):
            nodes = np.flatnonzero(levels >= level).astype(np.int32)
            starts, targets = links(x[nodes])
            layers.append({"nodes": nodes.tobytes(), "starts": starts.tobytes(), "links": targets.tobytes()})
        shape = pa.list_(pa.struct([("nodes", pa.binary()), ("starts", pa.binary()), ("links", pa.binary())]))
        columns = [
            pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary()),
            pa.array([layers], shape), pa.array([ids], pa.list_(id_type)),
        ]
        return pa.Table.from_arrays(columns, ["shard", "n", "dim", "data", "layers", "ids"])

    return sharded.groupBy("shard").applyInArrow(graph, f"{GRAPH}, ids array<{kind.simpleString()}>")


def search(queries: DataFrame, graphs: DataFrame, k: int, beam: int | None = None, exact: bool = False) -> DataFrame:
    """queries (qid, embedding) × graphs of `build` → (qid, iid, score, rank): k items of great inner product, nearly always the k greatest, ties by iid.

    beam: how many vectors a walk holds; None: what `fitted_beam` says. With exact each walk is checked against its shard: what scores above the least it found takes
    part too, so that the k greatest come out, for the price of a product with every vector.
    """
    if beam is None:
        beam = BEAM if exact else fitted_beam(queries, graphs, k)
    return _ranked(_walked(queries, graphs, k, beam, exact).drop("compared"), k)


def fitted_beam(queries: DataFrame, graphs: DataFrame, k: int, recall: float = RECALL) -> int:
    """The beam, doubled from `BEAM` on, by which walks find that share of the k nearest of a sample of the queries: at most `PROBES`, those of the least hashes.

    A beam that is enough for few vectors is not for many. Where `MOST_BEAM` isn't enough, as among many equal vectors, it stands.
    """
    probes = materialise(queries.where("embedding is not null").orderBy(F.xxhash64("qid"), "qid").limit(PROBES), "probes")
    nearest = materialise(search(probes, graphs, k, exact=True).select("qid", "iid"), "nearest")
    wanted, beam = nearest.count(), max(BEAM, k)
    while beam < MOST_BEAM and nearest.join(search(probes, graphs, k, beam).select("qid", "iid"), ["qid", "iid"], "left_semi").count() < recall * wanted:
        beam = min(MOST_BEAM, 2 * beam)
    return beam


def compared_pairs(queries: DataFrame, graphs: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(qid, compared): with how many vectors each query's walks compared it, on average over the block that walked together."""
    return _walked(queries, graphs, k, beam).groupBy("qid", "shard").agg(F.first("compared").alias("c")).groupBy("qid").agg(F.sum("c").alias("compared"))


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "iid")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "iid", "score", "rank")


def _walked(queries: DataFrame, graphs: DataFrame, k: int, beam: int, exact_too: bool = False) -> DataFrame:
    q_kind, kind = queries.schema["qid"].dataType, graphs.schema["ids"].dataType.elementType
    schema = f"qid {q_kind.simpleString()}, iid {kind.simpleString()}, score double, compared double, shard int"
    blocks = packed(queries.select(F.col("qid").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")), 8 * BLOCK, "block")
    # every block is sent to every shard: the stated query set against the graphs of all items, in blocks
    blocks = blocks.select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "block")
    pairs = blocks.crossJoin(graphs.select("shard")).join(graphs, "shard")
    q_type, id_type = to_arrow_type(q_kind), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x, layers, ids = None, None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[i]  # noqa: B023, E731
                shard, n = get("shard").as_py(), get("n").as_py()
                if shard != last:
                    x = np.frombuffer(get("data").as_buffer(), np.float32).reshape(n, -1)
                    read = lambda buffer: np.frombuffer(buffer, np.int32)
                    layers = [Layer(read(v["nodes"]), read(v["starts"]), read(v["links"]), n) for v in get("layers").as_py()]
                    last, ids = shard, get("ids").values
                    # ties go by id, in whose order the vectors aren't
                    place = np.arange(n) if pa.types.is_nested(ids.type) else pc.rank(ids, tiebreaker="first").to_numpy().astype(np.int64) - 1
                    if exact_too:
                        by_id = np.argsort(place)
                        x_by_id, longest = x[by_id], float(np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64).max(initial=0)))
                q_ids = get("q_ids").values
                q = np.frombuffer(get("q_data").as_buffer(), np.float32).reshape(len(q_ids), -1)
                for lo in range(0, len(q), BLOCK):
                    mine = q[lo : lo + BLOCK]
                    found, _, compared = walk(x, layers, mine, max(beam, k))
                    row, col = np.nonzero(found >= 0)
                    met = found[row, col]
                    exact = np.einsum("ij,ij->i", mine[row].astype(np.float64), x[met].astype(np.float64))
                    order = np.lexsort((place[met], -np.round(exact, 12), row))
                    row, met, exact = row[order], met[order], exact[order]
                    top = np.arange(len(row)) - np.searchsorted(row, np.arange(len(mine)))[row] < k
                    row, met, exact = row[top], met[top], exact[top]
                    if exact_too:
                        reached = np.full(len(mine), np.inf)
                        np.minimum.at(reached, row, exact)
                        reached[np.bincount(row, minlength=len(mine)) < k] = -np.inf
                        row, at, exact = greatest(mine, x_by_id, k, longest, reached)
                        met = by_id[at]
                    columns = [q_ids.take(pa.array(row + lo)).cast(q_type), ids.take(pa.array(met)).cast(id_type), pa.array(exact)]
                    share = pa.array(np.full(len(row), compared / len(mine)))
                    yield pa.RecordBatch.from_arrays([*columns, share, pa.array(np.full(len(row), shard, np.int32))], ["qid", "iid", "score", "compared", "shard"])

    return pairs.select("shard", "n", "data", "layers", "ids", "q_ids", "q_data").mapInArrow(run, schema)
