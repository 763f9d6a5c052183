"""The scan of a JSON array in ranges against the json module."""

import json
import random

import pytest

from orgweave.sources import jsonarray
from orgweave.sources import registry as reg


def entry(r, i):
    texts = ["plain", 'quote " and brace { }', "back\\slash", "}}{{", "\\", 'ends with \\"', "é漢🙂", "new\nline", ""]
    out = {"id": f"r{i}", "a": r.choice(texts), "b": [{"x": r.choice(texts)}, {}, {"deep": {"er": r.choice(texts)}}][: r.randint(0, 3)], r.choice(texts) or "k": None}
    return out | ({"long": r.choice(texts) * 200} if r.random() < 0.2 else {})


@pytest.mark.parametrize("size", [61, 400, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_entries_equal_the_json_modules(spark, tmp_path, size, indent):
    r = random.Random(size)
    rows = [entry(r, i) for i in range(60)]
    broken = rows[:10] + [7, "a { string", None, ["list", {"id": "nested"}], True] + rows[10:]
    (tmp_path / "dump.json").write_text("﻿" * (indent is None) + json.dumps(broken, ensure_ascii=False, indent=indent), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        out = jsonarray.entries(spark, str(tmp_path / "dump.json"))
        tasks = jsonarray._pieces(spark, str(tmp_path / "dump.json")).rdd.getNumPartitions()
        got = [json.loads(x.entry) for x in out.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, [*rows, {"id": "nested"}]))
    assert tasks > 1 or size > 1_000


def test_changes_compose():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(['{', '"', '\\"', "x", "}", "}", "{"]) for _ in range(r.randint(0, 30)))
        for quoted in (False, True):
            depth, state, i = r.randint(0, 3), quoted, 0
            began = depth
            while i < len(text + "}"):
                c = (text + "}")[i]
                if c == "\\":
                    i += 1
                elif c == '"':
                    state = not state
                elif not state:
                    depth = max(0, depth + (c == "{") - (c == "}"))
                i += 1
            whole = jsonarray.Change(quoted, 0, 0)
            for piece in text.split("}"):
                whole = whole.then(jsonarray.change(piece, whole.quoted))
            assert (whole.quoted, max(began + whole.a, whole.b)) == (state, depth)


def test_files_without_entries(spark, tmp_path):
    for name, text in (("empty", ""), ("none", "[]"), ("cut", '[{"id": "a"}, {"id": "b", "x": {')):
        (tmp_path / name).write_text(text)
    assert jsonarray.entries(spark, str(tmp_path / "empty")).count() == 0
    assert jsonarray.entries(spark, str(tmp_path / "none")).count() == 0
    assert [x.entry for x in jsonarray.entries(spark, str(tmp_path / "cut")).collect()] == ['{"id": "a"}']


def test_a_dump_with_entries_that_do_not_parse(spark, tmp_path):
    good = {"id": "r1", "names": [{"value": "One", "types": ["ror_display"]}], "status": "active"}
    (tmp_path / "d.json").write_text("[" + ",".join([json.dumps(good), '{"id": nonsense}', '{"id": "r2", "name": "Two"}', "{}"]) + "]")
    assert sorted((x.id, x.name) for x in reg.read_dump(spark, str(tmp_path / "d.json")).collect()) == [("r1", "One"), ("r2", "Two")]
