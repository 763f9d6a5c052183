"""Adapters of models and services, with small stand-ins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgweave import adapters, schemas
from orgweave.operators import linking
from orgweave.plans.config import LinkConfig


class Model:
    def __init__(self):
        self.closed = False

    def close(self):
        self.closed = True


def test_encoder_scales_and_bad_texts_cost_only_themselves(spark):
    def encode(model, texts):
        if any(t == "bad" for t in texts):
            raise ValueError("bad")
        return np.array([[len(t), 0.0] for t in texts])

    df = spark.createDataFrame([("abc",), ("bad",), ("",)], "text string").coalesce(1)
    got = {r.text: r.embedding for r in adapters.encoder("e", object, encode)(df).collect()}
    assert got == {"abc": [1.0, 0.0], "bad": None, "": [0.0, 0.0]}


def test_cross_encoder(spark):
    df = spark.createDataFrame([("a", "abc"), ("b", None)], "query string, document string")
    score = lambda model, pairs: [float(len(d)) for _, d in pairs]
    assert {r["query"]: r.rerank_score for r in adapters.cross_encoder("c", object, score)(df).collect()} == {"a": 3.0, "b": 0.0}


def test_letter_judge_in_the_cascade(spark):
    registry = spark.createDataFrame([], schemas.REGISTRY)
    mentions = spark.createDataFrame([(1, "x"), (2, "y")], "mention_key int, word string")
    found = spark.createDataFrame([(1, "r1", 0.4), (1, "r2", 0.3), (2, "r1", 0.2), (2, "r3", 0.1)], "mention_key int, record_id string, score double")

    def logits(model, prompts):
        """Mention x: the second entry; mention y: none of them."""
        rows = []
        for p in prompts:
            row = [0.0] * 21
            row[1 if 'entry is "x"' in p else 20] = 5.0
            rows.append(row)
        return rows

    judged = linking.judge(found, adapters.letter_judge("j", object, logits, mentions, registry), LinkConfig(llm_threshold=0.5))
    rows = sorted((r.mention_key, r.record_id, r.score) for r in judged.collect())
    assert [r[:2] for r in rows] == [(1, "r1"), (1, "r2")] and rows[1][2] > 0.9


def test_translator(spark):
    df = spark.createDataFrame([("東京",), (" ",), ("x",)], "text string")
    chat = lambda model, chats: ["Tokyo " if c[1]["content"] == "東京" else "" for c in chats]
    assert {r.text: r.translation for r in adapters.translator("t", object, chat)(df).collect()} == {"東京": "Tokyo", "x": None}


def test_release_closes(spark):
    held = adapters._model("own", Model)
    assert adapters._model("own", Model) is held
    assert adapters.release("own") == ["own"] and held.closed
    assert adapters.release("own") == []


def test_typed_lookup_falls_back(spark):
    def lookup(words, kind):
        return {"city": f"{words}/{kind}"} if (words, kind) in {("Oslo, Norway", "city"), ("Bergen, Norway", None), ("plain", None)} else None

    df = spark.createDataFrame([("city:Oslo, Norway",), ("state:Bergen, Norway",), ("plain",), ("city:Nowhere",)], "query string")
    got = {r["query"]: r.city for r in adapters.typed_geocoder(lookup, "city string", per_second=1000.0)(df).collect()}
    assert got == {"city:Oslo, Norway": "Oslo, Norway/city", "state:Bergen, Norway": "Bergen, Norway/None", "plain": "plain/None", "city:Nowhere": None}


def test_web_context_takes_the_next_backend_and_remembers_nothing(spark):
    def broken(query, region, n):
        raise OSError("down")

    second = lambda query, region, n: [f"{query} in {region}", "", "more"] if query == "a" else []
    df = spark.createDataFrame([("a", "no-no"), ("b", None), ("a", "no-no")], "query string, region string")
    found = adapters.web_context([broken, second], per_second=1000.0)(df)
    assert sorted((r["query"], r.context) for r in found.collect()) == [("a", "a in no-no\nmore"), ("a", "a in no-no\nmore"), ("b", adapters.NOTHING)]
    assert {r["query"]: r.context for r in adapters.known_context(found).collect()}["b"] is None


def test_converter_adds_names_that_the_aliases_lack(spark):
    aliases = spark.createDataFrame([("Norway", "Norway", "NOR"), ("NO", "Norway", "NOR")], "key string, name_short string, iso3 string")
    names = spark.createDataFrame([("Norge",), ("Norway",), ("?",), (None,), (" Norge",)], "name string")
    convert = lambda batch: ["NO" if n == "Norge" else None for n in batch]
    assert sorted(tuple(r) for r in adapters.converted_aliases(names, aliases, convert).collect()) == [("NO", "Norway", "NOR"), ("Norge", "Norway", "NOR"), ("Norway", "Norway", "NOR")]


@pytest.mark.parametrize("n", [0, 3])
def test_model_provider_on_any_rows(spark, n):
    df = spark.createDataFrame([(i, None) for i in range(n)], "i int, text string")
    out = adapters.model_provider("m", object, lambda model, rows: {"size": [0] * len(rows)}, "size int")(df)
    assert out.columns == ["i", "text", "size"] and out.count() == n
    assert out.agg(F.sum("size")).first()[0] in (0, None)


def shapefile(records, prj):
    """Bytes of .shp and .dbf: records are (id, name, level, rings)."""
    import struct

    shp, dbf = b"\0" * 100, b""
    for no, (_, _, _, rings) in enumerate(records, 1):
        points = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
        body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body = body if rings else struct.pack("<i", 0)
        shp += struct.pack(">2i", no, len(body) // 2) + body
    fields = [("NUTS_ID", 5), ("LEVL_CODE", 2), ("NUTS_NAME", 12)]
    for name, size in fields:
        dbf += name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([size]) + b"\0" * 15
    rows = b"".join(b" " + i.encode().ljust(5) + str(level).encode().ljust(2) + name.encode().ljust(12) for i, name, level, _ in records)
    head = struct.pack("<B3BIHH", 3, 0, 0, 0, len(records), 32 + len(dbf) + 1, 20) + b"\0" * 20
    return shp, head + dbf + b"\x0d" + rows, prj


def test_shapefile_in_degrees_and_on_the_grid(spark, tmp_path):
    from orgweave.sources import shapes

    assert np.allclose(shapes.from_european_grid(np.array([[4321000.0, 3210000.0], [3962799.45, 2999718.85]])), [[10, 52], [5, 50]], atol=1e-6)
    assert np.allclose(shapes.from_web_map(np.array([[0.0, 0.0], [1113194.9079327357, 6446275.841017158]])), [[0, 0], [10, 50]], atol=1e-9)
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    hole = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]
    shp, dbf, _ = shapefile([("AA", "Ångland", 0, [square, hole]), ("BB1", "none", 1, [])], "")
    folder = tmp_path / "data"
    folder.mkdir()
    assert shapes.find_shapes(spark, str(tmp_path)) is None
    (folder / "x.shp").write_bytes(shp)
    (folder / "x.dbf").write_bytes(dbf)
    rows = shapes.nuts_from_shapefile(spark, shapes.find_shapes(spark, str(tmp_path))).collect()
    assert [(r.nuts_id, r.name, r.level) for r in rows] == [("AA", "Ångland", 0)]
    assert [[(p.x, p.y) for p in ring] for ring in rows[0].rings] == [square, hole]
    grid = [(3962799.45, 2999718.85), (4321000.0, 3210000.0), (4321000.0, 2999718.85), (3962799.45, 2999718.85)]
    shp, dbf, prj = shapefile([("CC", "Grid", 3, [grid])], 'PROJCS["ETRS89_LAEA_Europe"]')
    nearer = tmp_path / "cache" / "nuts"
    nearer.mkdir(parents=True)
    for end, content in (("shp", shp), ("dbf", dbf), ("prj", prj.encode())):
        (nearer / f"y.{end}").write_bytes(content)
    at = shapes.find_shapes(spark, str(tmp_path))
    assert at.endswith("cache/nuts/y.shp")
    ring = shapes.nuts_from_shapefile(spark, at).first().rings[0]
    assert np.allclose([(p.x, p.y) for p in ring[:2]], [(5, 50), (10, 52)], atol=1e-6)
    with pytest.raises(ValueError):
        shapes.to_degrees('PROJCS["Transverse_Mercator"]')


def test_predictions_join_gold(spark):
    from orgweave.operators import evaluate

    gold = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "i int, gold array<string>")
    predicted = spark.createDataFrame([(1, ["a"]), (1, ["c"]), (4, ["a"]), (None, ["x"])], "i int, predicted array<string>")
    got = {r.i: (r.p, r.r) for r in evaluate.join_predictions(gold, predicted, "i").collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0), 3: (0.0, 1.0)}
