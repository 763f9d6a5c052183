"""Spans, linking, places, output and the whole engine."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from orgweave import schemas
from orgweave.operators import evaluate, geocode, linking, orgtype, spans
from orgweave.plans.config import LinkConfig, PipelineConfig
from orgweave.plans.pipeline import Engine
from orgweave.providers import gazetteer, gazetteer_ner, hashed_encoder, lexical_reranker, rate_limited
from orgweave.sources import registry as reg
from orgweave.sources.cache import Cache, latest, read_through
from orgweave.sources.tables import build_index, country_aliases
from orgweave.streaming import stream

ENT = "array<struct<entity_group:string,score:double,word:string,start:int,end:int>>"


def test_delimited_spans(spark):
    df = spark.createDataFrame([(0, "A, B; C ;; D"), (1, ""), (2, " ; "), (3, None), (4, "one")], schemas.INPUT)
    got = sorted((r.source_index, r.span_index, r.raw_text) for r in spans.expand_spans(df).collect())
    assert got == [(0, 0, "A, B"), (0, 1, "C"), (0, 2, "D"), (1, 0, ""), (2, 0, " ; "), (3, 0, ""), (4, 0, "one")]
    assert [r.raw_text for r in spans.expand_spans(df, "none").where("source_index = 0").collect()] == ["A, B; C ;; D"]
    with pytest.raises(ValueError):
        spans.expand_spans(df, "model")


def test_merging_is_greedy_and_in_pairs(spark):
    e = [("ORG", 0.9, "Uni", 0, 3), ("CITY", 0.5, "ver", 3, 6), ("ORG", 0.8, "sity", 6, 10), ("ORG", 0.7, "X", 11, 12), ("ORG", 0.6, "9", 12, 13), ("ORG", 0.1, "low", 13, 16), ("ORG", 0.9, "z", None, None)]
    df = spark.createDataFrame([(e, "University X9low")], f"e {ENT}, t string")
    got = [(x.word, x.score, x.entity_group) for x in df.select(spans.merge_adjacent(F.col("e"), "t", 0.2).alias("m")).first().m]
    assert got == [("Univer", 0.5, "ORG"), ("sity", 0.8, "ORG"), ("X9", 0.6, "ORG"), ("z", 0.9, "ORG")]
    no_digits = df.select(spans.merge_adjacent(F.col("e"), "t", 0.2, digits=False).alias("m")).first().m
    assert [x.word for x in no_digits] == ["Univer", "sity", "X", "9", "z"]


def test_parenthesis_is_closed(spark):
    rows = [("Lab (ABC", "Lab (ABC) x", 8, "Lab (ABC)"), ("Lab (ABC", "Lab (ABC def)", 8, "Lab (ABC"), ("Lab (ABC)", "Lab (ABC))", 9, "Lab (ABC)"), ("Lab (A", "Lab (ABC) x", 6, "Lab (ABC)"), ("Lab", "Lab) x", 3, "Lab"), ("(a) (b", "(a) (b;c)", 6, "(a) (b")]
    df = spark.createDataFrame(rows, "w string, t string, e int, want string")
    assert all(r.x == r.want for r in df.select(spans.close_parenthesis(F.col("w"), F.col("t"), F.col("e")).alias("x"), "want").collect())


def registry(spark):
    rows = [
        ("r1", "University of Girona", "active", None, "Spain", "ES", "Girona"), ("r2", "Old Institute", "inactive", "r3", "France", "FR", "Lyon"), ("r3", "New Institute", "active", None, "France", "FR", "Lyon"),
        ("r4", "Twin College", "active", None, "Spain", "ES", "Vigo"), ("r5", "Twin College", "active", None, "Spain", "ES", "Madrid"), ("r6", "Harbour Hospital", "active", None, "Canada", "CA", "Halifax"),
    ]
    df = spark.createDataFrame(rows, "id string, name string, status string, nxt string, country string, code string, city string")
    return reg.from_table(df, {"id": "id", "name": "name", "status": "status", "successor_id": "nxt", "country": "country", "country_code": "code", "city": "city", "types": "array('T')"}, "test")


def test_direct_match(spark):
    m = spark.createDataFrame([("a", "UNIVERSITY of Girona.", "España"), ("b", "university-of-girona", "es"), ("c", "Old Institute", "France"), ("d", "Twin College", "Spain"), ("e", "University of Girona", None), ("f", "", "Spain")], "mention_key string, word string, country string")
    got = {r.mention_key: r.record_id for r in linking.direct_match(m, registry(spark)).collect()}
    assert got == {"b": "r1", "c": "r3"}


def test_variants(spark):
    m = spark.createDataFrame([("a", "N", "C", "K", "R"), ("b", "N", None, "K", "R"), ("c", "N", "C", None, None), ("d", "N", None, None, "R"), ("e", " ", "C", "K", None)], "mention_key string, word string, city string, country string, region string")
    got = {k: [r.text for r in g] for k, g in itertools.groupby(linking.query_variants(m).orderBy("mention_key", "variant_no").collect(), lambda r: r.mention_key)}
    assert got == {
        "a": ["[MENTION] N [CITY] C [COUNTRY] K", "[MENTION] N [COUNTRY] K", "[MENTION] N [CITY] R [COUNTRY] K"],
        "b": ["[MENTION] N [COUNTRY] K", "[MENTION] N [CITY] R [COUNTRY] K"],
        "c": ["[MENTION] N [CITY] C"],
        "d": ["[MENTION] N"],
    }


@pytest.mark.parametrize("tile", [7, 1000])
def test_knn_forms_agree(spark, tile):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(60)
    e = e.unionByName(e.withColumn("vec_id", F.col("vec_id") + 1000)).select("vec_id", "embedding")  # ties
    q, i = e.where("vec_id % 7 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("iid"), "embedding").repartition(3)
    key = lambda df: sorted((r.qid, r["rank"], r.iid, round(r.score, 9)) for r in df.collect())
    assert key(linking.knn(q, i, 5, tile)) == key(linking.knn_sql(q, i, 5))
    assert linking.knn(q, i.where("false"), 5).count() == 0


def test_boost_gate_and_judge(spark):
    found = spark.createDataFrame([("m", "r1", 0.98), ("m", "r3", 0.99), ("m", "r6", 0.5), ("n", "r6", 0.2)], "mention_key string, record_id string, raw_score double")
    m = spark.createDataFrame([("m", "es", "GIRONA"), ("n", None, None)], "mention_key string, country string, city string")
    got = [(r.mention_key, r.record_id, round(r.score, 6)) for r in linking.boost(found, m, registry(spark), 2, LinkConfig()).orderBy("mention_key", F.desc("score")).collect()]
    assert got == [("m", "r1", 1.0), ("m", "r3", 0.99), ("n", "r6", 0.2)]
    c = found.withColumnRenamed("raw_score", "score")
    assert {r.mention_key for r in linking.quality_gate(c, 0.3).collect()} == {"m"}
    low = c.withColumn("score", F.col("score") / 10)

    def answers(logit_none):
        return lambda df: df.select("mention_key", "record_id", F.when(F.col("record_id") == "r6", 3.0).otherwise(1.0).alias("logit")).unionByName(df.select("mention_key", F.lit(None).cast("string").alias("record_id"), F.lit(logit_none).alias("logit")).distinct())

    judged = {(r.mention_key, r.record_id): r.score for r in linking.judge(low, answers(0.0), LinkConfig()).collect()}
    total = math.exp(3) + 2 * math.exp(1) + 1
    assert judged["m", "r6"] == pytest.approx(math.exp(3) / total) and judged["n", "r6"] == pytest.approx(0.02)
    assert {k for k, _ in [(r.mention_key, r.record_id) for r in linking.judge(low, answers(9.0), LinkConfig()).collect()]} == {"n"}


def test_cascade(spark):
    r, encoder = registry(spark), hashed_encoder()
    texts = reg.variant_texts(r)
    vectors = texts.join(encoder(texts.select("text").distinct()), "text").select("id", "variant", "embedding")
    m = spark.createDataFrame([("a", "University of Girona", "Spain", "Girona", None), ("b", "Universty of Girona", "Spain", "Girona", None), ("c", "Old Institutes", "France", "Lyon", None), ("d", "Something else entirely", None, None, None)], "mention_key string, word string, country string, city string, region string")
    got = {x.mention_key: (x.record_id, x.retriever) for x in linking.link_mentions(m, r, LinkConfig(threshold=0.6), vectors=vectors, encoder=encoder).collect()}
    assert got["a"] == ("r1", "direct_match") and got["b"] == ("r1", "dense") and got["c"] == ("r3", "dense") and "d" not in got
    reranked = {x.mention_key: x.retriever for x in linking.link_mentions(m, r, LinkConfig(threshold=0.2), vectors=vectors, encoder=encoder, reranker=lexical_reranker).collect()}
    assert reranked["b"] == "cross_encoder"
    combined = linking.combine_retrievers([(spark.createDataFrame([("m", "x", 1.0), ("m", "y", 0.5)], "mention_key string, record_id string, score double"), 0.5), (spark.createDataFrame([("m", "y", 1.0)], "mention_key string, record_id string, score double"), 0.5)], 1)
    assert [(x.record_id, x.score) for x in combined.collect()] == [("y", 0.75)]


def test_regions(spark):
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    polygons = [("A0", "Land", 0, [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6))]), ("B0", "Isles", 0, [ring((20, 0), (22, 0), (21, 2))]), ("A1", "Part", 1, [ring((0, 0), (5, 0), (5, 5), (0, 5), (0, 0))]), ("A1b", "Same", 1, [ring((0, 0), (5, 0), (5, 5), (0, 5))]), ("Z", "Empty", 2, [])]
    df = spark.createDataFrame(polygons, schemas.NUTS)
    pts = [("in", 1.0, 1.0), ("hole", 5.0, 5.0), ("edge", 0.0, 5.0), ("out", -1.0, -1.0), ("isle", 0.5, 21.0), ("vertex", 10.0, 10.0), ("right", 8.0, 8.0), ("none", None, 1.0)]
    got = {r.point_id: r.nuts for r in geocode.regions_of(spark.createDataFrame(pts, "point_id string, lat double, lon double"), df).collect()}
    assert got == {"in": {"nuts0_id": "A0", "nuts0_name": "Land", "nuts1_id": "A1", "nuts1_name": "Part"}, "isle": {"nuts0_id": "B0", "nuts0_name": "Isles"}, "right": {"nuts0_id": "A0", "nuts0_name": "Land"}}


def test_places(spark):
    rows = [({"town": "T", "country": "C"}, "town", "1.5", "2.5", 7), ({"country": "C"}, "city", "1", "2", 7), ({}, "", None, None, None), ({}, None, "1", "2", 7), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a map<string,string>, k string, lat string, lon string, o long")
    got = [r.p for r in df.select(geocode.parse_place(F.col("a"), F.col("k"), F.col("lat"), F.col("lon"), F.col("o")).alias("p")).collect()]
    assert got[0].city == "T" and got[0].lat == 1.5 and got[1] is None and got[2] is None and got[3].lat == 1.0 and got[4] is None


def test_cache(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "c"), 30)
    assert c.get().count() == 0
    day = lambda n: F.lit(float(n * 86400))
    c.put(spark.createDataFrame([("a", "1"), ("b", "1")], "key string, value string"), day(0))
    c.put(spark.createDataFrame([("a", "2")], "key string, value string"), day(20))
    assert {r.key: r.value for r in c.get(day(30)).collect()} == {"a": "2", "b": "1"}
    assert {r.key: r.value for r in c.get(day(31)).collect()} == {"a": "2"}
    assert c.stats(day(31)) == {"total": 2, "expired": 1}
    assert {r.key: r.value for r in latest(c.entries()).collect()} == {"a": "2", "b": "1"}
    asked = []

    def provider(df):
        asked.extend(r.query for r in df.collect())
        return df.withColumn("v", F.upper("query"))

    everything, new = read_through(spark.createDataFrame([("a",), ("z",), ("z",), (None,)], "q string"), "q", c.get(day(30)), provider, F.col("v"))
    assert {r.key: r.value for r in everything.collect()} == {"a": "2", "z": "Z"} and asked == ["z"] and new.count() == 1
    c.clear()
    assert c.get().count() == 0


def test_rate_limited_provider_retries(spark):
    def ask(q):
        if q == "bad":
            raise RuntimeError("down")
        return {"city": q.upper()}

    got = {r.query: r for r in rate_limited(ask, "city string", per_second=1000, tries=1)(spark.createDataFrame([("x",), ("bad",)], "query string")).collect()}
    assert got["x"].city == "X" and got["bad"].error == "down"


def test_types(spark):
    df = spark.createDataFrame([("Company", "PRC.sme", "PRC.sme"), ("Company", "HEI.other", None), ("Individual", "Individual", "Individual"), (None, "HEI.other", "HEI.other"), ("New", "x", "x")], "a string, b string, want string")
    assert all(r.x == r.want for r in df.select(orgtype.consistent_level2(F.col("a"), F.col("b")).alias("x"), "want").collect())
    got = {(r.name, r.country): r.lvl1 for r in orgtype.classify(spark.createDataFrame([("X University", "A"), ("X University", None), (" ", "A")], "name string, country string"), orgtype.keyword_classifier).collect()}
    assert got == {("X University", "A"): "Higher Education", ("X University", ""): "Higher Education"}


def test_scores(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"]), ([], ["a"]), (["a"], []), ([], []), (None, None)], "gold array<string>, predicted array<string>")
    got = [(r.p, r.r, round(r.f1, 3)) for r in evaluate.score_rows(df).collect()]
    assert got == [(0.5, 0.5, 0.5), (0.0, 1.0, 0.0), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 1.0, 0.0)]
    gold = evaluate.gold_text(spark.createDataFrame([("Org", "são paulo", None)], "ORG string, CITY string, COUNTRY string")).first()
    assert gold.raw_affiliation_string == "Org, São Paulo"


TEXTS = ["Physics Dept, University of Girona, Girona, Spain; Harbour Hospital, Canada", "", "Old Institute, France", "nothing known"]


def engine(spark, **settings_):
    names = spark.createDataFrame([("University of Girona", "ORG"), ("Harbour Hospital", "ORG"), ("Old Institute", "ORG"), ("Physics Dept", "SUB"), ("Girona", "CITY"), ("Spain", "COUNTRY"), ("Canada", "COUNTRY"), ("France", "COUNTRY")], "word string, label string")
    places = spark.createDataFrame([("city:Girona, Spain", "Girona", None, None, None, None, None, "España", 1.0, 1.0, 5), ("city:Lyon, France", "Lyon", None, None, None, None, None, "France", 2.0, 2.0, 6)], f"query string, {schemas.PLACE}")
    countries = spark.createDataFrame([("Spain", "España", "ESP", "ES", "Europe", "South")], schemas.COUNTRY)
    return Engine(spark, PipelineConfig(**settings_), registry=registry(spark), ner=gazetteer_ner(names), geocoder=gazetteer(places), countries=countries, org_types=orgtype.keyword_classifier, translator=lambda df: df.withColumn("translation", F.col("text")))


def test_engine(spark):
    rows = {r.source_index: r for r in engine(spark, enable_language_detect=True, enable_org_types=True).process(TEXTS).collect()}
    assert [rows[i].raw_text for i in range(4)] == TEXTS and [len(rows[i].outputs) for i in range(4)] == [2, 1, 1, 1]
    first, second = rows[0].outputs
    assert first.institutions[0].id.ror_id == "r1" and first.institutions[0].confidence == 1.0 and first.institutions[0].type.lvl1 == "Higher Education"
    assert first.subunits[0].name == "Physics Dept" and first.subunits[0].id is None and first.subunits[0].confidence is None
    assert first.location.city == "Girona" and first.location.country == "Spain" and first.location.country_code == "ESP" and first.location.source["city"] == "osm" and first.language == "en"
    assert second.institutions[0].id.ror_id == "r6" and second.location.country == "Canada" and second.location.source["country"] == "ner"
    moved = rows[2].outputs[0]
    assert moved.institutions[0].name == "New Institute" and moved.location.source["city"] == "ror-osm"
    assert rows[3].outputs[0].location is None and rows[3].outputs[0].institutions == []


def test_schema_is_the_same_for_every_setting(spark):
    schema = None
    for on in itertools.product([False, True], repeat=3):
        out = engine(spark, **dict(zip(["enable_language_detect", "enable_entity_linking", "enable_normalization"], on, strict=True))).process(["x"])
        schema = schema or out.schema.simpleString()
        assert out.schema.simpleString() == schema and out.count() == 1
    bare = Engine(spark).process(["a; b"])
    assert bare.schema.simpleString() == schema and len(bare.first().outputs) == 2
    assert Engine(spark).process([]).count() == 0


def test_settings_fail_loudly(spark):
    for bad in ({"span_strategy": "x"}, {"output_format": "x"}):
        with pytest.raises(ValueError):
            PipelineConfig(**bad)
    with pytest.raises(ValueError):
        Engine(spark, PipelineConfig(enable_translation=True))
    with pytest.raises(ValueError):
        LinkConfig(top_k=0)


def test_translation_keeps_the_original(spark):
    items = spark.createDataFrame([(0, 0, "東京", ("ja",)), (1, 0, "Paris", ("fr",)), (2, 0, "x", (None,))], "source_index long, span_index int, raw_text string, language_info struct<language:string>")
    got = {r.source_index: r for r in spans.translate(items, lambda df: df.withColumn("translation", F.lit("Tokyo"))).collect()}
    assert (got[0].raw_text, got[0].original_text, got[0].translated) == ("Tokyo", "東京", True)
    assert (got[1].raw_text, got[1].original_text, got[1].translated) == ("Paris", None, None) and got[2].raw_text == "x"


def test_index_is_kept(spark, tmp_path):
    calls = []
    inner = hashed_encoder(16)

    def encoder(df):
        calls.append(1)
        return inner(df)

    for name, n in (("e", 1), ("e", 1), ("f", 2)):
        assert build_index(registry(spark), encoder, name, str(tmp_path / "i")).count() == 6 and len(calls) == n
    with pytest.raises(ValueError):
        build_index(registry(spark), encoder, "e", str(tmp_path / "i"), "hnsw2")
    assert country_aliases(spark.createDataFrame([], schemas.COUNTRY)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    e = engine(spark, enable_language_detect=True)
    source = str(tmp_path / "in")
    spark.createDataFrame(list(enumerate(TEXTS)), schemas.INPUT).write.parquet(source)
    query = stream.process_stream(e, spark.readStream.schema(schemas.INPUT).parquet(source), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(180)
    streamed = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out") + "/batch=*").drop("batch")
    batch = e.spans_out(spark.read.parquet(source))
    key = lambda df: sorted(str(r.asDict(True)) for r in df.select(batch.columns).collect())
    assert key(streamed) == key(batch)


def test_windowed_stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    q = stream.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("w").collect()) == sorted(stream.windowed_counts(events, "ts", "event_type").collect())


def test_cells_find_most_neighbours(spark):
    from orgweave.operators import ivf

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q, i = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("iid"), "embedding")
    exact = {(r.qid, r.iid) for r in linking.knn(q, i, 10).collect()}
    centres = ivf.train_cells(i, 16)
    found = {(r.qid, r.iid) for r in ivf.search(q, i, 10, centres, 12).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    assert {(r.qid, r.iid) for r in ivf.search(q, i, 10, centres, 16).collect()} == exact
    assert ivf.search(q, i, 10, ivf.train_cells(i.where("false"))).count() == 0


def test_terms_of_many_words(spark):
    name = "International Institute of Applied and Theoretical Marine, Coastal and Polar Übersee Studies"
    texts = spark.createDataFrame([("a", f"Dept. 1, {name}, Bremen"), ("b", "Bremen"), ("c", None)], "text_key string, text string")
    names = spark.createDataFrame([(name, "ORG"), ("Bremen", "CITY"), (None, "ORG")], "word string, label string")
    found = sorted((r.text_key, r.label, r.word) for r in gazetteer_ner(names)(texts).collect())
    assert found == [("a", "CITY", "Bremen"), ("a", "ORG", name), ("b", "CITY", "Bremen")]
    assert gazetteer_ner(names.where("false"))(texts).count() == 0


def test_cells_at_their_defaults(spark):
    from orgweave.operators import ivf

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q, i = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("iid"), "embedding")
    exact = {(r.qid, r.iid) for r in linking.knn(q, i, 10).collect()}
    found = {(r.qid, r.iid) for r in ivf.search(q, i, 10, ivf.train_cells(i)).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_index_with_cells(spark, tmp_path):
    encoder = hashed_encoder(16)
    flat, celled = (build_index(registry(spark), encoder, "e", str(tmp_path / kind), kind) for kind in ("flat", "ivf"))
    assert celled.where("cell is not null").count() == flat.count() and celled.where("centre is not null").count() == celled.select("cell").distinct().count()
    words = [(r.id + r.variant, r.variant, None, None, None) for r in flat.collect()]
    mentions = spark.createDataFrame(words, "mention_key string, word string, country string, city string, region string")
    found = [{(r.mention_key, r.record_id, round(r.score, 9)) for r in linking.retrieve(mentions, registry(spark), v, encoder, LinkConfig(top_k=2)).collect()} for v in (flat, celled)]
    assert found[0] and len(found[0] & found[1]) >= 0.9 * len(found[0])
    assert build_index(registry(spark), encoder, "e", str(tmp_path / "ivf"), "ivf").columns == celled.columns


def test_fetching(tmp_path):
    import io

    from orgweave.sources import fetch, tables
    import zipfile

    archive = tmp_path / "b.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("data/small.json", "[]")
        z.writestr("data/v1-large.json", "[1, 2, 3]")
        z.writestr("data/../../evil", "x")
    opened = []

    def open_url(url):
        opened.append(url)
        return io.BytesIO(archive.read_bytes() if url.endswith("zip") else b'{"files": [{"key": "a.txt"}, {"key": "b.zip", "links": {"self": "u.zip"}}]}')

    url = fetch.release_archive("api", open_url)
    for _ in range(2):
        path = fetch.download(url, str(tmp_path / "d" / "b.zip"), open_url)
    assert opened == ["api", "u.zip"] and tables.largest_json(path) == "data/v1-large.json"
    with pytest.raises(ValueError):
        tables.extract_bundle(path, str(tmp_path / "out"), {"data/": "x"})
    assert (tmp_path / "out" / "x" / "v1-large.json").read_text() == "[1, 2, 3]"


def test_provider_is_asked_once_for_each_query(spark, tmp_path):
    """Counted by files that the provider's tasks leave behind."""
    from pyspark.sql import functions as F

    from orgweave.operators.geocode import geocode
    from orgweave.sources.tables import country_aliases
    from orgweave import schemas

    asked = str(tmp_path)

    def provider(df):
        def ask(batches):
            import uuid

            for pdf in batches:
                for q in pdf["query"]:
                    open(f"{asked}/{uuid.uuid4().hex}", "w").write(q)
                yield pdf.assign(city="c", state_district=None, county=None, province=None, state=None, region=None, country="k", lat=1.0, lon=2.0, osm_id=1)

        return df.mapInPandas(ask, "query string, city string, state_district string, county string, province string, state string, region string, country string, lat double, lon double, osm_id long")

    spans = spark.createDataFrame([(i, 0, f"town {i % 5}", None, "land") for i in range(40)], "source_index int, span_index int, city string, region string, country string")
    found, new = geocode(spans, provider, spark.createDataFrame([], "key string, value string"), country_aliases(spark.createDataFrame([], schemas.COUNTRY)))
    assert found.count() == 40 and found.select(F.col("osm.city")).distinct().count() == 1 and new.count() == 5
    import os

    assert len(os.listdir(asked)) == 5


def test_newest_dump_over_all_patterns(spark, tmp_path):
    import os

    from orgweave.sources.registry import find_dump

    for name, at in (("v1.json", 100), ("ror-data-2.json", 300), ("x-ror-y.json", 200)):
        (tmp_path / name).write_text("[]")
        os.utime(tmp_path / name, (at, at))
    assert find_dump(spark, str(tmp_path)).endswith("/ror-data-2.json")
    assert find_dump(spark, str(tmp_path / "none")) is None


def test_detector_answers_become_codes(spark):
    from pyspark.sql import functions as F

    from orgweave.functions import labels
    from orgweave.functions.language import detect

    logits = [0.0] * 45
    logits[44] = 3.0
    df = spark.createDataFrame([(0, "Prifysgol Bangor"), (1, None)], "source_index int, raw_text string")
    model = labels.slot_detector(lambda t: t.select("text", F.array(*[F.lit(x) for x in logits]).alias("logits")))
    p = round(float(__import__("math").exp(3) / (__import__("math").exp(3) + 44)), 4)
    assert {r.source_index: tuple(r.language_info) for r in detect(df, "raw_text", "combined_langdetect", model).collect()}[0] in {("cy", "combined_langdetect", p), ("en", "heuristic", None), ("es", "heuristic", None)}
    model = labels.label_detector(lambda t: t.select("text", F.lit("__label__cym_Latn").alias("label"), F.lit(0.5).alias("probability")))
    assert model(df.select(F.col("raw_text").alias("text"))).first()["first"] == "cy"


def test_prompts_of_mentions_with_one_candidate_and_texts_without_words(spark):
    from orgweave import schemas
    from orgweave.operators import prompts

    registry = spark.createDataFrame([], schemas.REGISTRY)
    found = spark.createDataFrame([(1, "r9", 0.5)], "mention_key int, record_id string, score double")
    mentions = spark.createDataFrame([(1, "Lab", "Lab, Oslo"), (2, "None", "x")], "mention_key int, word string, raw_text string")
    rows = prompts.judge_prompts(found, mentions, registry)[0].collect()
    assert len(rows) == 1 and rows[0].prompt == 'Affiliation: "Lab, Oslo"\nWhich entry is "Lab"?\n\nA) r9\n\nAnswer with one letter (A), or N if none is.'
    chats = prompts.translation_chats(spark.createDataFrame([("東京大学",), (" ",), (None,)], "text string")).collect()
    assert [(m.role, m.content) for m in chats[0].chat] == [("system", prompts.TRANSLATOR), ("user", "東京大学")] and len(chats) == 1
