"""Quadtree coverings against the even-odd rule over whole polygons."""

import math
import random

import numpy as np
import pytest

from orgweave import schemas
from orgweave.operators import cover, geocode


def star(r, cx, cy, size, n):
    return [{"x": cx + size * r.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), "y": cy + size * r.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)} for i in range(n)]


def slow_inside(x, y, rings):
    odd = False
    for ring in rings:
        if len(ring) < 3:
            continue
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
            if cross == 0 and min(a["x"], b["x"]) <= x <= max(a["x"], b["x"]) and min(a["y"], b["y"]) <= y <= max(a["y"], b["y"]):
                return False
            if (a["y"] > y) != (b["y"] > y) and x < a["x"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"]):
                odd = not odd
    return odd


def test_coverings_equal_the_even_odd_rule(spark):
    r = random.Random(3)
    square = lambda x, y, s: [{"x": x + a * s, "y": y + b * s} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    polygons = [("A", [square(0.0, 0.0, 8.0), square(2.0, 2.0, 4.0)]), ("B", [star(r, -120.0, 40.0, 9.0, 700), star(r, -120.0, 40.0, 2.0, 90)]), ("C", [star(r, 1.0, 1.0, 0.01, 300), square(5.0, 5.0, 1.0)])]
    polygons += [("D", []), ("E", [[{"x": 1.0, "y": 1.0}]]), ("F", [square(170.0, -89.0, 9.0)]), ("G", [square(3.0, 3.0, 1.0) + [{"x": 3.0, "y": 3.0}]])]
    polygons += [("H", [[{"x": 4 + 3 * math.cos(i / 300), "y": 4 + 3 * math.sin(i / 300)} for i in range(1884)]])]
    table = spark.createDataFrame([(i, i.lower(), k % 4, rings) for k, (i, rings) in enumerate(polygons)], schemas.NUTS).repartition(3)
    points = [(r.uniform(-1, 9), r.uniform(-1, 9)) for _ in range(300)] + [(r.uniform(-130, -110), r.uniform(30, 50)) for _ in range(500)] + [(1 + r.uniform(-0.011, 0.011), 1 + r.uniform(-0.011, 0.011)) for _ in range(300)]
    points += [(float(x), float(y)) for x in range(9) for y in range(9)] + [(175.0, -85.0), (8.0, 4.0), (4.0, 4.0)]
    spots = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "n int, px double, py double")
    cells = cover.cover(table, ["nuts_id", "name"]).persist()
    got = sorted((x.n, x.nuts_id) for x in cover.points_in(spots, cells).collect())
    assert got == sorted((i, name) for i, (x, y) in enumerate(points) for name, rings in polygons if slow_inside(x, y, rings))
    assert cells.where(f"size(edges) > {cover.MAX_EDGES}").count() == 0 and cells.where("inner").count() > 0
    assert cells.where("nuts_id in ('D', 'E')").count() == 0


def test_edges_that_meet_in_one_point_end_at_the_deepest_cell():
    n = 2 * cover.MAX_EDGES
    ring = [p for i in range(n) for p in ({"x": 1.0, "y": 1.0}, {"x": 1 + math.cos(i / n), "y": 1 + math.sin(i / n)}, {"x": 1 + math.cos((i + 0.5) / n), "y": 1 + math.sin((i + 0.5) / n)})]
    cells = list(cover.cells_of(cover.edges_of([ring])))
    assert max(c[0] for c in cells) == cover.DEEPEST and len(cells) < 20_000
    assert list(cover.cells_of(np.zeros((0, 4)))) == []


@pytest.mark.parametrize("rows", [0, 1])
def test_regions_without_polygons_or_points(spark, rows):
    none = spark.createDataFrame([], schemas.NUTS)
    points = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0)][:rows], "point_id string, lat double, lon double")
    assert geocode.regions_of(points, none).count() == 0
