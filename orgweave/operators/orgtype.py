"""Types of organisations: context and classifier behind a provider, consistent levels, cached by name and country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions import lexicons as L
from orgweave.functions.text import cache_key
from orgweave.providers import Provider


def _literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def search_region(country: Column) -> Column:
    """The search region of a country; the whole world where there is none."""
    return F.coalesce(F.try_element_at(_literal_map(L.SEARCH_REGION), F.lower(F.trim(country))), F.lit(L.DEFAULT_SEARCH_REGION))


def consistent_level2(lvl1: Column, lvl2: Column) -> Column:
    """lvl2 if it belongs to lvl1, else null; an unknown lvl1 allows any."""
    prefix = F.try_element_at(_literal_map(L.ORG_TYPE_PREFIX), lvl1)
    return F.when(lvl1.isNull() | prefix.isNull() | F.startswith(lvl2, prefix), lvl2)


def classify(orgs: DataFrame, provider: Provider, cached: DataFrame | None = None) -> DataFrame:
    """orgs (name, country) → distinct (name, country, type_key, lvl1, lvl2).

    provider: (name, country, search_region) → (name, country, lvl1, lvl2). cached: (key, lvl1, lvl2). Homonyms in two countries have two types.
    """
    asked = orgs.where("trim(name) <> ''").select("name", F.coalesce("country", F.lit("")).alias("country")).distinct().withColumn("type_key", cache_key("type", F.col("name"), F.col("country")))
    if cached is not None:
        known = asked.join(cached.withColumnRenamed("key", "type_key"), "type_key")
        asked_now = asked.join(cached.select(F.col("key").alias("type_key")), "type_key", "left_anti")
    else:
        known, asked_now = None, asked
    answers = provider(asked_now.select("name", "country", search_region(F.col("country")).alias("search_region")))
    new = asked_now.join(answers, ["name", "country"], "left").select("name", "country", "type_key", "lvl1", consistent_level2(F.col("lvl1"), F.col("lvl2")).alias("lvl2"))
    return new if known is None else known.select(*new.columns).unionByName(new)


def keyword_classifier(df: DataFrame) -> DataFrame:
    """An offline stand-in for the two text classifiers: by telling words of the name."""
    name = F.lower("name")
    lvl1 = F.when(name.rlike("hospital|clinic"), "Healthcare").when(name.rlike("univers|college"), "Higher Education").when(name.rlike("ministry|council|government"), "Public Administration")
    lvl1 = lvl1.when(name.rlike("school"), "Primary and Secondary Education").when(name.rlike("institut|laborator|research"), "Research Organization").when(name.rlike(r"\b(inc|ltd|gmbh|company|corp)\b"), "Company")
    lvl2 = F.when(name.rlike("hospital"), "HEA.hospital").when(name.rlike("univers|college"), "HEI.institution").when(name.rlike("ministry|government"), "PUB.national")
    lvl2 = lvl2.when(name.rlike("institut"), "REC.institute").when(name.rlike("laborator"), "REC.lab")
    return df.select("name", "country", F.coalesce(lvl1, F.lit("Unknown")).alias("lvl1"), lvl2.alias("lvl2"))


def add_types(links: DataFrame, types: DataFrame) -> DataFrame:
    """Set `type` of each linked institution (subunits get none) in (source_index, span_index, institutions, subunits)."""
    each = links.select("source_index", "span_index", F.posexplode("institutions").alias("pos", "i"))
    name, country = F.coalesce("i.id.ror_name", "i.query"), F.coalesce("i.id.ror_country", F.lit(""))
    typed = each.withColumn("_n", name).withColumn("_c", country).join(types.select(F.col("name").alias("_n"), F.col("country").alias("_c"), F.struct("lvl1", "lvl2").alias("_t")), ["_n", "_c"], "left")
    packed = typed.groupBy("source_index", "span_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("i").withField("type", F.col("_t")).alias("i")))), lambda x: x["i"]).alias("_typed"))
    return links.join(packed, ["source_index", "span_index"], "left").withColumn("institutions", F.coalesce("_typed", "institutions")).drop("_typed")
