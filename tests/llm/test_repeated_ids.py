"""Rows that share a doc_id, and the registered SQL, on a table with every odd row: against brute force and DuckDB."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest

from orgweave.llm import decontaminate, linededup, rlz, simhash
from orgweave.llm import queries as training

SCHEMA = "doc_id long, text string"


def words(seed, n):
    r = random.Random(seed)
    return [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randrange(50)) for _ in range(n)]


def odd_rows():
    shared, own = words(1, 80), words(2, 60)
    lines = ["one line", "two line", "three line", "four", "five"]
    rows = [
        (1, " ".join(shared)), (2, " ".join(words(3, 30) + shared)), (2, "short text"), (2, " ".join(own)), (3, " ".join(own)), (3, " ".join(shared[:60] + own)),
        (3, " ".join(own)), (None, " ".join(shared)), (None, None), (4, None), (4, ""), (5, "  "), (6, " ".join(shared)), (6, " ".join(shared)),
        (7, "\n".join(lines)), (8, "\n".join(["x", *lines[:3]])), (8, "p\nq\nr\ns\nt"), (8, "\n".join(lines[1:])), (9, "\n".join(["same"] * 9)), (9, "\n".join(["same"] * 4)),
        (10, "x " * 30_000), (11, "\n".join(["long line"] * 20_000)),
    ]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "if(doc_id = 3, null, if(doc_id < 6, 'en', 'de')) as lang", "if(doc_id = 4, null, 'web') as source", "cast(char_length(text) as int) as n_chars").coalesce(1).write.parquet(f"{path}/documents.parquet")
    urls = ["https://a.co.uk/en/1", "https://b.co.uk/en/2", "http://10.0.0.1:80/en/3", "http://10.0.0.2/en/4", "https://A.Example.com:8080/en/5?x", None, "no host", "http:///en/6", "https://[::1]/en/1"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls * 3)], "page_id long, url string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    labels = [(1, 1, None), (2, 0, None), (3, None, 0), (4, None, 1), (5, 1, 0), (6, None, None), (1, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(words(1, 20))), (2, "one LINE x"), (3, None), (4, "nowhere"), (5, "Long line long"), (6, "x")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(training.oracle_sql()))
def test_sql_says_the_same(spark, folder, sf_dir, name):
    for at in (folder, sf_dir):
        con = duckdb.connect()
        for t in ("documents", "pages", "labels", "benchmark"):
            con.execute(f"create view {t} as select * from read_parquet('{at}/{t}.parquet{'/*.parquet' if at == folder else ''}')")
        df = training.queries()[name](spark, at)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
        found = con.execute(training.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_substrings_of_rows_that_share_an_id(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    first = {}
    cut = [(i, rlz.words_of(t)) for i, t in rows]
    for i, ws in cut:
        for p in range(len(ws) - rlz.WINDOW + 1):
            k = tuple(ws[p : p + rlz.WINDOW])
            first[k] = min(first.get(k, i), i)
    want = []
    for i, ws in cut:
        gone = set()
        for p in range(len(ws) - rlz.WINDOW + 1):
            if first[tuple(ws[p : p + rlz.WINDOW])] < i:
                gone.update(range(p, p + rlz.WINDOW))
        want.append((i, len(ws), len(gone), hashlib.sha256(b" ".join(w for p, w in enumerate(ws) if p not in gone)).hexdigest()))
    got = rlz.remove_duplicate_spans(spark.createDataFrame(rows, SCHEMA).repartition(3), with_text=False).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "a\nb\nc"), (2, "x\na\nb\nc"), (2, "p\nq\nr\ns\nt"), (2, "x\na\nb\nc"), (3, "p\nq\nr")]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in linededup.remove_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, "a\nb\nc", 0), (2, "p\nq\nr\ns\nt", 0), (2, "x", 3), (2, "x", 3), (3, "", 3)]


def test_keep_one_keeps_other_texts_of_an_id(spark):
    same, other = " ".join(words(5, 60)), " ".join(words(6, 60))
    rows = [(1, same), (2, same), (2, other), (None, same), (3, other), (1, same)]
    got = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(1, same), (1, same), (2, other), (0, same)])


@pytest.mark.parametrize("literal", [decontaminate.LITERAL_ROWS, 0])
def test_leaks_of_rows_that_share_an_id(spark, monkeypatch, literal):
    monkeypatch.setattr(decontaminate, "LITERAL_ROWS", literal)
    item, repeated = " ".join(words(7, 20)), "one two three four five " * 6
    docs = [(1, " ".join(words(8, 30)) + " " + item), (1, " ".join(words(9, 50))), (2, " ".join(words(9, 50))), (None, item), (3, None), (3, repeated), (1, " ".join(words(8, 30)) + " " + item)]
    items = spark.createDataFrame([(10, item), (11, repeated), (12, None)], "item_id long, text string")
    table = spark.createDataFrame(docs, SCHEMA)
    got = {(r.doc_id, r.item_id, r.window_start, r.similarity) for r in decontaminate.find_leaks(table, items).collect()}
    assert got == {(1, 10, 30, 1.0), (3, 11, 0, 1.0)}
    kept = sorted((r.doc_id or 0, r.text or "") for r in decontaminate.remove_leaks(table, items).collect())
    assert kept == sorted([(1, docs[1][1]), (2, docs[2][1]), (0, item), (3, "")])


def test_repeats_count_in_the_intersection(spark):
    r = random.Random(3)
    rows = [([r.randrange(6) for _ in range(r.randrange(12))], [r.randrange(6) for _ in range(r.randrange(12))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    from pyspark.sql import functions as F

    got = df.select("a", "b", F.size(F.array_intersect(decontaminate._numbered(F.col("a")), decontaminate._numbered(F.col("b")))).alias("n")).collect()
    for x in got:
        assert x.n == sum(min(x.a.count(v), x.b.count(v)) for v in range(6))


def test_pipeline_stages_on_odd_tables(spark, folder, sf_dir, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, " ".join(words(1, 30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/documents.parquet").where("false")):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= n
        coded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
        assert len(coded) == n and isinstance(coded, pd.DataFrame)
