"""Language heuristics on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from orgweave.functions import language as lang
from orgweave.functions.text import compose


def decide(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df = compose(df, "t")
    return [r.x for r in df.select("i", lang.decide(F.col("t"), **kw).alias("x")).orderBy("i").collect()]


def test_decisions(spark):
    cases = {
        None: "en", "": "en", "  \n": "en", "123 - 45!": "en",
        "東京大学": "zh", "東京大学の研究所": "ja", "서울대학교": "ko", "北京大学": "zh", 'Institute of "Physics"': "zh",
        "Московский университет": "ru", "Київський університет ії": "uk", "Санкт-Петербург подъезд": "bg",
        "دانشگاه تهران پژوهش": "fa", "جامعة القاهرة": "ar", "Εθνικό Πανεπιστήμιο": "el", "האוניברסיטה העברית": "he", "मुंबई विश्वविद्यालय": "hi", "มหาวิทยาลัย": "th",
        "Department of Physics, University of the Arts": "en", "Universidad Autónoma España": "es", "Universidad de España": "nl", "Université de la Sorbonne et des sciences": "fr",
        "Technische Universität München, Institut für Physik": "de", "Università Roma, Dipartimento Fisica": "it", "Universidade São Paulo, Faculdade Ciências": "pt",
        "Uniwersytet Łódzki": "pl", "Boğaziçi Üniversitesi": "pl", "œuvre": "pl", "Universitas Indonesia, Depok": "id", "Universiteit Nijmegen, het onderzoek bij de afdeling": "nl",
        "Københavns på åen æble": "no", "Göteborgs universitet å": "sv",
    }
    got = decide(spark, list(cases))
    assert dict(zip(cases, got, strict=True)) == cases


def test_without_latin_scripts(spark):
    assert decide(spark, ["Boğaziçi Üniversitesi", "Uniwersytet Łódzki, ńśźż"], compat=False) == ["tr", "pl"]


def test_decomposed_text_is_composed(spark):
    assert decide(spark, ["Universidad Auto\u0301noma Espan\u0303a"]) == ["es"]


def test_features(spark):
    df = spark.createDataFrame([("the then; École the",)], "t string")
    get = lambda name: {s.lang: s.score for s in df.select(lang.feature(name, F.col("t")).alias("f")).first().f}
    assert get("chars")["fr"] == 1 and "de" not in get("chars")
    assert len(get("bigrams")) == 17
    # t-h three times and h-e three times among others, per 100 of 19 characters
    assert get("bigrams")["en"] == pytest.approx(100 * 6 / 19)
    assert get("trigrams")["en"] == pytest.approx(100 * 3 / (1 + 2 + 3 + 1))
    assert get("words") == {"en": pytest.approx(100 * 20 / 4)}
    assert get("keywords")["fr"] == 8


def test_overlapping_trigrams_count_each(spark):
    df = spark.createDataFrame([("atata",)], "t string")
    f = {s.lang: s.score for s in df.select(lang.feature("trigrams", F.col("t")).alias("f")).first().f}
    assert f["id"] == pytest.approx(100 * 2 / 3)


def test_register_language(spark):
    lex = lang.DEFAULT.register("xx", words={"blarg": 50}, bigrams=["zq"])
    df = spark.createDataFrame([("blarg zq",)], "t string")
    assert df.select(lang.decide(F.col("t"), lex=lex).alias("x")).first().x == "xx"
    assert "xx" not in lang.DEFAULT.words


def test_methods(spark):
    df = spark.createDataFrame([(0, "Universidad Autónoma España"), (1, "123"), (2, "Technische Universität München")], "i int, t string")
    asked = []

    def model(texts):
        asked.append(texts.count())
        return texts.withColumns({"first": F.lit("ca"), "first_p": F.lit(0.87654321), "second": F.lit("es"), "second_p": F.lit(0.1)})

    plain = {r.i: r.language_info for r in lang.detect(df, "t").collect()}
    assert plain[0].language == "es" and plain[0].confidence is None
    combined = {r.i: r.language_info for r in lang.detect(df, "t", "combined_langdetect", model).collect()}
    assert combined[2].language == "ca" and combined[2].confidence == 0.8765 and combined[2].method == "combined_langdetect"
    fallback = {r.i: r.language_info for r in lang.detect(df, "t", "e5", model).collect()}
    assert fallback[0].language == "es" and fallback[0].method == "heuristic" and fallback[1].language == "ca" and fallback[1].method == "e5"
    assert asked == [3, 1]
    with pytest.raises(ValueError):
        lang.detect(df, "t", "guess")


def test_combination_rules(spark):
    rows = [
        ("en", None, None, "en"), ("fr", "ca", "es", "ca"), ("de", "nl", "de", "nl"), ("en", "nl", "de", "en"), ("es", "pt", "es", "es"), ("ja", "zh-cn", None, "ja"), ("fr", "zh-tw", None, "zh"),
        ("fr", "ko", "zh-cn", "zh"), ("fr", "ko", "fr", "ja"), ("ja", "ko", "zh", "ja"), ("fr", "fr", "en", "fr"), ("fr", "it", "en", "it"), ("de", "ja", None, "ja"),
    ]
    df = spark.createDataFrame(rows, "h string, a string, b string, want string")
    x = lang.combine_with_model(F.col("h"), F.col("a"), F.lit(0.5), F.col("b"), F.lit(0.25))
    got = df.select(x.alias("x"), "want").collect()
    assert [r.x.language for r in got] == [r.want for r in got]
    assert got[7].x.confidence == 0.25 and got[0].x.method == "heuristic" and got[5].x.confidence == 0.5


SCRIPTS = [
    ("Московский государственный университет", "ru"), ("Київський національний університет імені Тараса Шевченка їжак", "uk"), ("Софийски университет съюз ъ", "bg"),
    ("Εθνικό Πανεπιστήμιο Αθηνών", "el"), ("جامعة القاهرة", "ar"), ("دانشگاه تهران پژوهش گروه", "fa"), ("האוניברסיטה העברית בירושלים", "he"), ("東京大学の研究センター", "ja"),
    ("北京大学，中国。", "zh"), ("서울대학교 연구소", "ko"), ("दिल्ली विश्वविद्यालय", "hi"), ("จุฬาลงกรณ์มหาวิทยาลัย", "th"), ("თბილისის უნივერსიტეტი", "ka"), ("Universität München für Wissenschaften", "de"),
    ("Université de la Sorbonne, école normale", "fr"), ("university of the north", "en"), ("", "en"), (None, "en"), ("12345 !!", "en"),
]


def test_scripts_by_hand(spark):
    from pyspark.sql import functions as F

    from orgweave.functions.language import decide

    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SCRIPTS)], "i int, t string")
    got = {r.i: r.lang for r in rows.select("i", decide(F.col("t")).alias("lang")).collect()}
    assert {SCRIPTS[i][0]: x for i, x in got.items()} == dict(SCRIPTS)
