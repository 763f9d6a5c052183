"""Methods against slow forms: the risk's gradient, the order of training shards, scores of repeated rows."""

import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from orgweave.llm import shards, toxicity
from orgweave.llm.tokens import END_OF_DOCUMENT, Vocabulary

VOCABULARY = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks(), special_tokens={})


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_gradient_is_that_of_finite_differences(prior):
    rng = np.random.default_rng(1)
    pos = toxicity._Rows([rng.choice(6, 3, replace=False) for _ in range(8)])
    unl = toxicity._Rows([rng.choice(6, rng.integers(0, 4), replace=False) for _ in range(20)])
    signs = set()
    for _ in range(20):
        x = rng.normal(0, 2, 7)

        def followed(x):
            first, second = toxicity.risk_parts(pos, unl, x[:6], x[6], prior)
            return first + second if base >= 0 else -second

        base = toxicity.risk_parts(pos, unl, x[:6], x[6], prior)[1]
        signs.add(base >= 0)
        slow = [(followed(x + d) - followed(x - d)) / 2e-6 for d in np.eye(7) * 1e-6]
        assert np.allclose(toxicity.descent(pos, unl, x[:6], x[6], prior), slow, atol=1e-6)
    assert prior < 0.5 or signs == {True, False}


def slow_slot(n, key, value):
    """One value's way through the Feistel rounds in whole numbers, again and again until it lies below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, top = (1 << half) - 1, (1 << 64) - 1
    keys = [xxhash.xxh64_intdigest(struct.pack("<QI", key & top, r)) for r in range(shards.ROUNDS)]
    while True:
        left, right = value >> half, value & mask
        for k in keys:
            x = (right ^ k) * 0x9E3779B97F4A7C15 & top
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & top
            left, right = right, left ^ ((x ^ x >> 32) & mask)
        value = left << half | right
        if value < n:
            return value


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_slots_equal_slow_rounds(n):
    assert shards.Feistel(n, 77)(np.arange(n)).tolist() == [slow_slot(n, 77, i) for i in range(n)]


def test_shards_hold_each_sequence_at_its_slot(spark):
    texts = ["word " * 700, None, "", "one two three", "x y " * 900, "one two three"]
    ids = [4, 9, 2, 7, 7, 7]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").coalesce(1)
    key, size = 5, 64
    got = {r.slot: (r.doc_id, r.seq_no, r.n_tokens, bytes(r.tokens)) for r in shards.read_records(shards.write_training_order(docs, VOCABULARY, key, size, 4)).collect()}
    rows = []
    for i, t in zip(ids, texts, strict=True):
        tokens = np.array([*REFERENCE.encode_ordinary(t or ""), END_OF_DOCUMENT], "<u2")
        rows += [(i, k // size, len(tokens[k : k + size]), tokens[k : k + size].tobytes()) for k in range(0, len(tokens), size)]
    assert got == {slow_slot(len(rows), key, no): row for no, row in enumerate(rows)}


def test_shards_outlive_the_job_and_lie_in_ranges(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(50)], "doc_id long, text string").repartition(5)
    written = shards.write_training_order(docs, VOCABULARY, 3, 16, 4, path=f"{tmp_path}/order")
    again = spark.read.parquet(f"{tmp_path}/order")
    n = written.count()
    assert again.count() == n > 8
    slots = [r.slot for r in shards.read_records(again, first_slot=10).collect()]
    assert sorted(slots) == list(range(10, max(slots) + 1))
    spans = sorted((r.lo, r.hi) for r in again.selectExpr("_metadata.file_name as f", "shard").groupBy("f").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).collect())
    assert spans[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] == n - 1


def test_repeated_and_very_long_texts_score_alike(spark):
    rows = [(i, ("vile " if i % 3 == 0 else "mild ") + f"text w{i} of no{i} other") for i in range(300)]
    rows += [(3, rows[3][1]), (3, "mild text"), (None, rows[3][1]), (900, "mild " * 200_000), (901, "vile " * 200_000), (902, None), (903, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(3, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = [(r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows)
    by_text = {}
    for (_, text), (_, score, _) in zip(rows, got, strict=True):
        assert by_text.setdefault(text or "", score) == score
    assert by_text[rows[-3][1]] > 0.7 > by_text["mild " * 200_000]
