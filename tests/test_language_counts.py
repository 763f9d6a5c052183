"""Counting for the language features: against plain counts of each, in small batches, and without a pass of the text for each range."""

import random

from pyspark.sql import functions as F

from orgweave.functions import language as lang
from orgweave.functions import lexicons as L


def test_counts_equal_plain_ones(spark):
    r = random.Random(5)
    letters = "aeeinnstthz ,.-\"ßçãőłžğ" + "їъپجアのした大学，가ᄀกאα" + "𝒳😀İ"
    texts = ["", "ee", "eee eeee", None, "ata atata", *["".join(r.choice(letters) for _ in range(r.randrange(90))) for _ in range(80)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    features = {f: lang.feature(f, F.col("t")).alias(f) for f in ("chars", "bigrams", "trigrams", "scripts")}
    for row in df.select("t", F.lower("t").alias("low"), *features.values()).collect():
        if row.t is None:
            continue
        got = {f: {s.lang: s.score for s in row[f]} for f in features}
        words = lang.regex.findall(r"[\p{L}\p{N}_]+", row.low)
        windows = max(1, sum(max(0, len(w) - 2) for w in words))
        for code, ranges in L.SCRIPT_RANGES.items():
            assert got["scripts"].get(code, 0) == sum(lo <= ord(c) <= hi for c in row.t for lo, hi in ranges)
        for code, chars in L.SPECIFIC_CHARS.items():
            n = sum(c in chars for c in row.t) - 2 * sum(c in L.INCOMPATIBLE_CHARS.get(code, "") for c in row.t)
            assert got["chars"].get(code, 0) == max(0, n)
        for code, grams in L.BIGRAMS.items():
            assert abs(got["bigrams"][code] - 100 * sum(row.low.count(g) for g in grams) / max(1, len(row.t))) < 1e-9
        for code, grams in L.TRIGRAMS.items():
            n = sum(row.low.startswith(g, i) for g in grams for i in range(len(row.low)))
            assert abs(got["trigrams"].get(code, 0) - 100 * n / windows) < 1e-9


def test_texts_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        lang.decide(F.col("t"))
        assert int(spark.conf.get(key)) <= 500
    finally:
        spark.conf.set(key, before)


def test_no_pass_of_the_text_for_each_range(spark):
    df = spark.createDataFrame([("大学",)], "t string").select(lang.feature("scripts", F.col("t")).alias("s"))
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {s.lang: s.score for s in df.first().s} == {"zh": 2, "ja": 2}
