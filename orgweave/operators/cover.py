"""Polygons as quadtree cells, so that points meet them by an equi-join and no row carries a whole polygon.

A cell of level z is a square of `ROOT` / 2^z degrees. A polygon's covering starts with the cells as large as its box and divides each that more than
`MAX_EDGES` edges touch, down to `DEEPEST`. A cell that no edge touches is inner (a point in it is in the polygon, without a test) or left out; a border cell
holds the edges that touch it, and whether its reference point is inside. A point of a border cell is inside or not as the reference point is, changed by each edge
that crosses the way there, first along the parallel, then along the meridian: even-odd over all rings, so holes and several parts need no special case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = 512.0
DEEPEST = 24
MAX_EDGES = 32
#: Where in a cell the reference point is: no fraction that corners are likely to have.
_REFERENCE = (0.500317, 0.499171)
CELLS = "z int, cx long, cy long, inner boolean, rx double, ry double, odd boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"
_EDGES = pa.list_(pa.struct([(n, pa.float64()) for n in ("x1", "y1", "x2", "y2")]))


def edges_of(rings: list[list[dict]]) -> np.ndarray:
    """(edges × x1, y1, x2, y2) of all rings of three points or more, each closed; edges without length are left out."""
    out = [np.zeros((0, 4))]
    for ring in rings or ():
        if ring is not None and len(ring) >= 3:
            p = np.array([(q["x"], q["y"]) for q in ring], np.float64)
            out.append(np.hstack([p, np.roll(p, -1, axis=0)]))
    edges = np.concatenate(out)
    return edges[(edges[:, :2] != edges[:, 2:]).any(axis=1) & np.isfinite(edges).all(axis=1)]


def _odd(x: float, y: float, e: np.ndarray) -> bool:
    """Whether a ray from the point to the east crosses an odd number of edges."""
    spans = (e[:, 1] > y) != (e[:, 3] > y)
    e = e[spans]
    return bool(np.count_nonzero(x < e[:, 0] + (y - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])) % 2)


def _touching(e: np.ndarray, x: float, y: float, size: float) -> np.ndarray:
    """The edges that touch a cell, and perhaps some that pass it by a hair."""
    slack = size * 1e-9 + 1e-12
    x0, y0, x1, y1 = x - slack, y - slack, x + size + slack, y + size + slack
    box = (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0)
    e = e[box]
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    sides = np.array([dx * (cy - e[:, 1]) - dy * (cx - e[:, 0]) for cx in (x0, x1) for cy in (y0, y1)])
    return e[(sides.min(axis=0) <= 0) & (sides.max(axis=0) >= 0)] if len(e) else e


def cells_of(edges: np.ndarray) -> Iterator[tuple]:
    """The covering of a polygon: rows of `CELLS`."""
    if not len(edges):
        return
    x, y = edges[:, [0, 2]], edges[:, [1, 3]]
    extent = max(x.max() - x.min(), y.max() - y.min(), ROOT / 2**DEEPEST)
    z = int(np.clip(np.floor(np.log2(ROOT / extent)), 0, DEEPEST))
    size = ROOT / 2**z
    todo = [(z, i, j, edges) for i in range(int(x.min() // size), int(x.max() // size) + 1) for j in range(int(y.min() // size), int(y.max() // size) + 1)]
    while todo:
        z, i, j, near = todo.pop()
        size = ROOT / 2**z
        mine = _touching(near, i * size, j * size, size)
        if len(mine) > MAX_EDGES and z < DEEPEST:
            todo += [(z + 1, 2 * i + a, 2 * j + b, mine) for a in (0, 1) for b in (0, 1)]
            continue
        rx, ry = (i + _REFERENCE[0]) * size, (j + _REFERENCE[1]) * size
        odd = _odd(rx, ry, edges)
        if len(mine) or odd:
            yield z, i, j, not len(mine), rx, ry, odd, [dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in mine.tolist()]


def cover(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Polygons (…keys, rings array<array<struct<x, y>>>) → keys and the columns of `CELLS`. A polygon without an edge has no cell."""
    slim = polygons.select(*keys, "rings")
    kinds = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys)
    types = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.bool_(), _EDGES)
    names = [c.split(" ")[0] for c in CELLS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cells = list(cells_of(edges_of(batch.column(len(keys))[row].as_py())))
                if cells:
                    mine = [batch.column(k).take(pa.array([row] * len(cells))) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*mine, *[pa.array(c, t) for c, t in zip(zip(*cells, strict=True), types, strict=True)]], [*keys, *names])

    return slim.mapInArrow(run, f"{kinds}, {CELLS}")


def _inside(x: Column, y: Column) -> Column:
    """Whether the point lies in the polygon of its border cell, the edges excepted."""
    rx, ry = F.col("rx"), F.col("ry")

    def crossed(e: Column) -> Column:
        along = ((e["y1"] > y) != (e["y2"] > y)) & (
            (x < e["x1"] + (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) * (e["x2"] - e["x1"])) != (rx < e["x1"] + (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) * (e["x2"] - e["x1"]))
        )
        at = e["y1"] + (rx - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)) * (e["y2"] - e["y1"])
        up = ((e["x1"] > rx) != (e["x2"] > rx)) & ((y < at) != (ry < at))
        return F.coalesce(along.cast("int"), F.lit(0)) + F.coalesce(up.cast("int"), F.lit(0))

    def on(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    changes = F.aggregate("edges", F.lit(0), lambda s, e: s + crossed(e))
    return (F.col("odd") != (changes % 2 == 1)) & ~F.exists("edges", on)


def points_in(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (px, py, …) and a covering → their joined rows where the point lies in the polygon; points on an edge lie in none."""
    levels = sorted(r["z"] for r in cells.select("z").distinct().collect())  # DEEPEST + 1 at most
    if not levels:
        return points.join(cells, F.lit(False))
    size = F.lit(ROOT) / F.pow(F.lit(2.0), F.col("z"))
    spots = points.withColumn("z", F.explode(F.array(*[F.lit(z) for z in levels])))
    spots = spots.withColumn("cx", F.floor(F.col("px") / size).cast("long")).withColumn("cy", F.floor(F.col("py") / size).cast("long"))
    met = spots.join(cells, ["z", "cx", "cy"])
    return met.where(F.col("inner") | _inside(F.col("px"), F.col("py")))
