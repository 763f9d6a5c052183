"""Clashing columns, empty tables, unbounded groups and the selectivity of the benchmark index."""

import hashlib
import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from orgweave.llm import decontaminate, linededup, ogg, shards, shared, toxicity
from orgweave.llm.tokens import Vocabulary


def test_no_documents_no_shards(spark):
    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    written = shards.write_training_order(spark.createDataFrame([], "doc_id long, text string"), vocabulary)
    assert written.count() == 0 and written.columns == ["shard", "first_slot", "n_records", "stride", "payload"]
    assert shards.read_records(written).count() == 0


def test_shards_as_files(spark, tmp_path):
    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.createDataFrame([(i, f"text {i} \r\n é漢 " * (i % 40)) for i in range(120)], "doc_id long, text string")
    written = shards.write_training_order(docs, vocabulary, key=3, sequence=16, per_shard=50)
    shards.write_files(written, f"file://{tmp_path}/out")
    row = lambda r: (r.slot, r.shard, r.byte_offset, r.doc_id, bytes(r.tokens), r.record_sha256)
    expected = sorted(map(row, shards.read_records(written).collect()))
    for first in (0, 1, 50, 137, len(expected) - 1, len(expected)):
        later = shards.read_files(spark, f"file://{tmp_path}/out", first)
        assert sorted(map(row, shards.read_records(later, first).collect())) == expected[first:]
    # any record by its place in the file
    slot, shard = expected[77][:2]
    (file,) = (tmp_path / "out" / "shards" / f"shard={shard}").glob("part-*")
    size = shards.stride(16)
    assert hashlib.sha256(file.read_bytes()[(slot - shard * 50) * size :][:size]).hexdigest() == expected[77][-1]
    assert file.stat().st_size == 50 * size + 1
    plan = shards.read_files(spark, f"file://{tmp_path}/out", 137)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and ">= 2" in plan


def test_spare_names(spark):
    df = spark.createDataFrame([(1, 2)], "gone int, GONE_ int")
    assert shared.spare("gone", df) == "gone__" and shared.spare("x", df) == "x"


def test_line_dedup_with_clashing_columns(spark):
    rows = [(1, "a\nb\nc\nd", 5, "k", 6, 7, 8), (2, "x\na\nb\nc", 5, "k", 6, 7, 8), (3, None, 5, None, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _gone_id string, gone int, gone_ int, text_key int")
    out = linededup.remove_repeated_lines(docs).orderBy("doc_id")
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert [(r.text, r._gone, r._gone_id, r.gone, r.n_removed) for r in out.collect()] == [("a\nb\nc\nd", 5, "k", 5 + 1, 0), ("x", 5, "k", 6, 3), (None, 5, None, 6, 0)]


def test_removal_of_leaks_with_clashing_columns(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words), 1, 2, 3), (2, "other words", 1, 2, 3)], "doc_id long, text string, _leak_id int, _leak_key int, item_id int")
    items = spark.createDataFrame([(9, " ".join(words[3:20]), 1)], "item_id long, text string, doc_id int")
    assert [r.doc_id for r in decontaminate.remove_leaks(docs, items).collect()] == [2]


def test_one_id_with_very_many_texts_keeps_the_sample_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 300)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 500)
    sizes = []
    fit = toxicity.fit_nnpu
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda pos, unl, *a, **k: sizes.append((len(pos), len(unl))) or fit(pos, unl, *a, **k))
    held = {r.id for r in spark.range(200).where(toxicity.held_out("id")).collect()}
    one, other = [i for i in range(200) if i not in held][:2]
    rows = [(one, f"vile{i % 7} hateful word{i} word{i + 1} word{i + 2} filler{i}") for i in range(6_000)] + [(other, f"kind{i % 7} garden thing{i} thing{i + 1} thing{i + 2} rest{i}") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(one, 1), (other, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert sizes and sizes[0][0] <= 300 and sizes[0][1] <= 500
    assert model.score("hateful vile1") > model.score("kind1 garden")


def weighted(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_blocks_select_and_lose_next_to_nothing(spark):
    """Random items of one length: few joined rows for a pair; planted near copies at a similarity of 0.8 to 0.85 are found."""
    r = random.Random(3)
    n, length = 1_100, 60
    items = [[f"t{r.randint(0, 10**6)}" for _ in range(length)] for _ in range(n)]
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    docs, planted = [], []
    for i, words in enumerate(items):
        copy = words[:]
        # shingles lost at one end: 56 of them, of which 6 differ on each side
        at = length - r.choice([5, 6])
        copy[at:] = [f"u{r.randint(0, 10**6)}" for _ in copy[at:]]
        assert 0.8 <= weighted(shingles(words), shingles(copy)) <= 0.85
        docs.append((i, " ".join(copy)))
        planted.append((i, i))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(table, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    assert len(found & set(planted)) >= 0.97 * n and found <= set(planted)
    sims = spark.range(2_000).select(F.xxhash64("id").alias("sim"))
    near = F.expr(f"filter(sequence(0, {(1 << decontaminate.BLOCK_BITS) - 1}), v -> bit_count(v) <= {decontaminate.BALL})")
    cut = sims.select("sim", F.explode(decontaminate._blocks("sim")).alias("b")).select("sim", "b.no", "b.value")
    ball = cut.limit(4 * 200).select("no", F.explode(F.transform(near, lambda v: v.bitwiseXOR(F.col("value")))).alias("value"))
    assert cut.join(ball, ["no", "value"]).count() < 0.05 * 2_000 * 200


def test_a_shingle_that_all_items_share(spark):
    r = random.Random(6)
    common = "this notice stands in every single item".split()
    items = [common + [f"i{i}x{j}" for j in range(20 + i % 9)] for i in range(300)]
    docs = [(i, " ".join(items[i])) for i in range(50)] + [(1000, " ".join(common * 40)), (1001, " ".join([*common, *[f"z{r.random()}" for _ in range(200)]]))]
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(50)}


def test_very_long_texts(spark):
    item = [f"q{i}" for i in range(40)]
    words = [f"v{i % 5_000}" for i in range(200_000)]
    words[150_000:150_000] = item
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    leaks = decontaminate.find_leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(x.window_start, x.window_words, x.similarity) for x in leaks] == [(150_000, 40, 1.0)]
    row = ogg.read(ogg.store(docs)).first()
    assert row.n_bytes == len(" ".join(words)) and row.payload_bytes % 192 == 0
