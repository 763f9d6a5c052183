"""String functions of the affiliation stages."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"
#: Deleted from each part of a search query; a fixed set.
QUERY_PUNCTUATION = "!()-[]{};:'\"\\<>./?@#$%^&*_~·"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


@F.pandas_udf(StringType())
def _fold_accents(x: pd.Series) -> pd.Series:
    def one(s: str | None) -> str | None:
        if s is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if unicodedata.category(c) != "Mn")
        return unicodedata.normalize("NFC", bare)

    return x.map(one)


@F.pandas_udf(StringType())
def _compose(x: pd.Series) -> pd.Series:
    return x.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(StringType())
def title_case(x: pd.Series) -> pd.Series:
    """Upper case after every character that is no letter (`initcap` knows only spaces)."""
    return x.map(lambda s: s if s is None else s.title())


def name_key(x: Column) -> Column:
    """The key under which names match: case, accents and dots don't count, hyphens and dashes are spaces, runs of spaces are one.

    Null stays null. Case folding and decomposition of what goes beyond ASCII run in one Arrow call, all else in the JVM.
    """
    trimmed = F.trim(x)
    folded = F.translate(F.coalesce(_fold_accents(F.when(trimmed.rlike(r"[^\x00-\x7F]"), trimmed)), F.lower(trimmed)), ".", "")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[-\u2013\u2014]", " "), r"(?U)\s+", " "))


def with_name_key(df: DataFrame, column: str, to: str) -> DataFrame:
    """`df` plus the key of `column`. The Arrow call sees each distinct string once; worth it where strings repeat."""
    keys = df.select(F.col(column).alias("_k")).where("_k is not null").distinct().withColumn(to, name_key(F.col("_k")))
    return df.join(keys, F.col(column) == F.col("_k"), "left").drop("_k")


def compose(df: DataFrame, column: str) -> DataFrame:
    """Canonical composition (NFC) of a column. Only rows that hold a combining mark or a Hangul letter go through Python."""
    apart = F.coalesce(F.col(column).rlike(r"[\p{M}\x{1100}-\x{11FF}\x{0340}-\x{037E}\x{2126}\x{212A}\x{212B}\x{F900}-\x{FAFF}]"), F.lit(False))
    return df.where(~apart).unionByName(df.where(apart).withColumn(column, _compose(F.col(column))))


def clean_query(x: Column) -> Column:
    """Title case, punctuation deleted in each part between commas, empty parts dropped."""
    bad = "[" + "".join("\\" + c if c in "[]\\^-&" else c for c in QUERY_PUNCTUATION) + "]+"
    parts = F.transform(F.split(title_case(x), ","), lambda p: F.trim(F.regexp_replace(p, bad, "")))
    return F.array_join(F.filter(parts, lambda p: p != ""), ", ")


def search_query(city: Column, region: Column, country: Column) -> Column:
    """`city:…`, `state:…` or `country:…` from the finest place known; null if none is."""
    city, region, country = blank_to_null(city), blank_to_null(region), blank_to_null(country)
    kind = F.when(city.isNotNull(), "city").when(region.isNotNull(), "state").when(country.isNotNull(), "country")
    return F.concat(kind, F.lit(":"), clean_query(F.concat_ws(", ", city, region, country)))


def tags(*parts: tuple[str, Column]) -> list[Column]:
    """`[TAG] value` of each part, null where the value is empty."""
    return [F.concat(F.lit(f"[{tag}] "), blank_to_null(value)) for tag, value in parts]


def tagged(name: Column, *parts: tuple[str, Column]) -> Column:
    """`[MENTION] name [TAG] value …`, empty parts left out."""
    return F.concat_ws(" ", F.concat(F.lit("[MENTION] "), F.trim(name)), *tags(*parts))


def candidate_document(name: Column, aliases: Column, city: Column, country: Column, most: int = 3) -> Column:
    """Name, a few aliases, city and country as one text for a reranker."""
    some = F.slice(F.coalesce(aliases, F.array().cast("array<string>")), 1, most)
    return F.concat_ws(" | ", name, F.nullif(F.array_join(some, " | "), F.lit("")), blank_to_null(city), blank_to_null(country))


def coordinates(x: Column) -> Column:
    """struct(lat, lon) from `('41.8', '12.4')` or `41.8,12.4`; nulls unless both parse."""
    parts = F.split(F.regexp_replace(x, "[()' ]", ""), ",")
    lat, lon = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    good = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    return F.struct(F.when(good, lat).alias("lat"), F.when(good, lon).alias("lon"))


def org_type_label(lvl2: Column) -> Column:
    """What follows the first dot, underscores as spaces, in title case: `HEI.institution` → `Institution`."""
    rest = F.when(lvl2.contains("."), F.regexp_extract(lvl2, r"(?s)^[^.]*[.](.*)$", 1)).otherwise(lvl2)
    return F.initcap(F.translate(rest, "_", " "))


def registry_ids(x: Column, prefix: str = r"https://ror\.org/") -> Column:
    """Ids in `Name {https://…/id}` items joined by `|`; an item without a full address may hold a bare `{id}`. Distinct, in order."""

    def one(item: Column) -> Column:
        full = F.regexp_extract_all(item, F.lit(r"\{" + prefix + r"([0-9a-z]+)\}"), 1)
        return F.when(F.size(full) > 0, full).otherwise(F.regexp_extract_all(item, F.lit(r"\{([0-9a-z]+)\}"), 1))

    return F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), one)))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda z: F.exp(z - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, z: a + z)
    return F.transform(weights, lambda z: z / total)


def unit(vector: Column) -> Column:
    """An array of numbers scaled to length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, z: a + z.cast("double") * z.cast("double")))
    return F.transform(vector, lambda z: F.when(norm > 0, z.cast("double") / norm).otherwise(z.cast("double")))


def language_base(tag: Column) -> Column:
    return F.substring_index(tag, "-", 1)


def cache_key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("::", F.lit(kind), *[F.lower(F.trim(p)) for p in parts])
