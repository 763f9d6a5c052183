"""Labels of language detectors as the two-letter codes that the stages use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the output slots of the sentence-model detector, in their order
SLOT_LANGUAGES = [
    "ar", "eu", "br", "ca", "zh", "zh", "zh", "cv", "cs", "dv", "nl", "en", "eo", "et", "fr", "fy", "ka", "de", "el", "cnh", "id", "ia", "it", "ja", "kab", "rw",
    "ky", "lv", "mt", "mn", "fa", "pl", "pt", "ro", "rm", "ru", "sah", "sl", "es", "sv", "ta", "tt", "tr", "uk", "cy",
]

# ISO 639: three letters and two, of languages that have both
ISO_639 = {
    "afr": "af", "amh": "am", "ara": "ar", "aze": "az", "bel": "be", "ben": "bn", "bos": "bs", "bre": "br", "bul": "bg", "cat": "ca", "ces": "cs", "chv": "cv", "cym": "cy", "dan": "da",
    "deu": "de", "div": "dv", "ell": "el", "eng": "en", "epo": "eo", "est": "et", "eus": "eu", "fas": "fa", "fin": "fi", "fra": "fr", "fry": "fy", "gla": "gd", "gle": "ga", "glg": "gl",
    "guj": "gu", "hau": "ha", "heb": "he", "hin": "hi", "hrv": "hr", "hun": "hu", "hye": "hy", "ina": "ia", "ind": "id", "isl": "is", "ita": "it", "jav": "jv", "jpn": "ja", "kan": "kn",
    "kat": "ka", "kaz": "kk", "khm": "km", "kin": "rw", "kir": "ky", "kor": "ko", "kur": "ku", "lao": "lo", "lat": "la", "lav": "lv", "lit": "lt", "ltz": "lb", "mal": "ml", "mar": "mr",
    "mkd": "mk", "mlg": "mg", "mlt": "mt", "mon": "mn", "mri": "mi", "msa": "ms", "mya": "my", "nep": "ne", "nld": "nl", "nno": "nn", "nob": "nb", "nor": "no", "oci": "oc", "pan": "pa",
    "pol": "pl", "por": "pt", "pus": "ps", "roh": "rm", "ron": "ro", "rus": "ru", "sin": "si", "slk": "sk", "slv": "sl", "som": "so", "spa": "es", "sqi": "sq", "srp": "sr", "swa": "sw",
    "swe": "sv", "tam": "ta", "tat": "tt", "tel": "te", "tgk": "tg", "tgl": "tl", "tha": "th", "tur": "tr", "uig": "ug", "ukr": "uk", "urd": "ur", "uzb": "uz", "vie": "vi", "xho": "xh",
    "yid": "yi", "yor": "yo", "zho": "zh", "zul": "zu",
}


def slot_language(slot: Column) -> Column:
    """The language of an output slot, from 0; null beyond the slots."""
    return F.get(F.array(*[F.lit(x) for x in SLOT_LANGUAGES]), slot.cast("int"))


def two_letters(code: Column) -> Column:
    """The two-letter code of a three-letter one; `und` if it has none."""
    table = F.create_map(*[F.lit(x) for pair in ISO_639.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit("und"))


def label_code(label: Column) -> Column:
    """`__label__eng_Latn` → `en`."""
    return two_letters(F.substring_index(F.replace(label, F.lit("__label__"), F.lit("")), "_", 1))


def best_slot(logits: Column, digits: int = 4) -> Column:
    """struct(first, first_p) of an array of slot logits: the likeliest slot's language, of equals the first, and its probability."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top))
    return F.struct(slot_language(F.array_position(logits, top) - 1).alias("first"), F.round(1 / total, digits).alias("first_p"))


def slot_detector(logits) -> object:
    """A language model for `language.detect` out of a provider (text) → (text, logits array<double>)."""

    def run(texts):
        p = best_slot(F.col("logits"))
        none = F.lit(None)
        return logits(texts).select("text", p["first"].alias("first"), p["first_p"].alias("first_p"), none.cast("string").alias("second"), none.cast("double").alias("second_p"))

    return run


def label_detector(predict) -> object:
    """A language model for `language.detect` out of a provider (text) → (text, label, probability)."""

    def run(texts):
        none = F.lit(None)
        return predict(texts).select("text", label_code(F.col("label")).alias("first"), F.col("probability").cast("double").alias("first_p"), none.cast("string").alias("second"), none.cast("double").alias("second_p"))

    return run
