"""The public shape of a span: institutions, subunits, location, language and confidence in fixed structs, nulls for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave import schemas
from orgweave.functions.text import org_type_label

_NO_ID = f"cast(null as {schemas.RECORD_ID})"
NER_FIELDS = {"city": "CITY", "region": "REGION", "country": "COUNTRY", "postal_code": "POSTALCODE", "address": "ADDRESS"}
OSM_FIELDS = ("city", "county", "province", "region", "country", "country_code", "continent", "un_region")


def score_lookup(mentions: DataFrame) -> DataFrame:
    """(source_index, span_index, scores map<label|word, score>): of repeats the last counts; six places."""
    last = mentions.where("score is not null").groupBy("source_index", "span_index", "label", "word").agg(F.max_by("score", "pos").alias("score"))
    entries = F.collect_list(F.struct(F.concat_ws("|", "label", "word").alias("k"), F.bround("score", 6).alias("v")))
    return last.groupBy("source_index", "span_index").agg(F.map_from_entries(F.array_sort(entries)).alias("scores"))


def _linked(links: Column, with_type: bool) -> Column:
    """Linked mentions as shown; a score of 0 counts as none."""
    kind = lambda x: F.when(x["type"].isNotNull(), F.struct(x["type"]["lvl1"].alias("lvl1"), org_type_label(x["type"]["lvl2"]).alias("lvl2"))) if with_type else F.expr(f"cast(null as {schemas.ORG_TYPE})")
    shown = F.transform(
        links,
        lambda x: F.struct(
            F.coalesce(F.nullif(x["id"]["ror_name"], F.lit("")), x["query"]).alias("name"),
            x["query"].alias("raw"),
            x["id"].alias("id"),
            F.nullif(x["score"], F.lit(0.0)).alias("confidence"),
            x["source"].alias("source"),
            kind(x).alias("type"),
        ),
    )
    return F.filter(shown, lambda x: F.coalesce(x["name"], F.lit("")) != "")


def _from_ner(words: Column, label: str, scores: Column) -> Column:
    return F.transform(
        F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.coalesce(w, F.lit("")) != ""),
        lambda w: F.struct(
            w.alias("name"),
            F.lit(None).cast("string").alias("raw"),
            F.expr(_NO_ID).alias("id"),
            F.try_element_at(scores, F.concat(F.lit(label + "|"), w)).alias("confidence"),
            F.lit("ner").alias("source"),
            F.expr(f"cast(null as {schemas.ORG_TYPE})").alias("type"),
        ),
    )


def institutions(links: Column, ner: Column, scores: Column) -> Column:
    """The linked institutions if there is any mention, matched or not; else the ORG entities."""
    return F.when(F.size(links) > 0, _linked(links, True)).otherwise(_from_ner(F.try_element_at(ner, F.lit("ORG")), "ORG", scores))


def subunits(links: Column, ner: Column, scores: Column) -> Column:
    return F.when(F.size(links) > 0, _linked(links, False)).otherwise(_from_ner(F.try_element_at(ner, F.lit("SUB")), "SUB", scores))


def location(osm: Column, osm_source: Column, ner: Column, scores: Column) -> Column:
    """Each field from the geocoder, else from the entities; where each came from and how sure an entity was; null if nothing is known."""
    some = lambda c: F.nullif(c, F.lit(""))
    from_osm = {
        "city": some(osm["city"]), "county": some(osm["county"]), "province": F.coalesce(some(osm["province"]), some(osm["state_district"])), "region": some(osm["state"]),
        "country": some(osm["country"]), "country_code": some(osm["country_code"]), "continent": some(osm["continent"]), "un_region": some(osm["un_region"]),
    }
    words = {f: F.try_element_at(F.try_element_at(ner, F.lit(label)), F.lit(1)) for f, label in NER_FIELDS.items()}
    missing = F.lit(None).cast("string")
    fields = list(dict.fromkeys([*OSM_FIELDS, *NER_FIELDS]))
    values = {f: F.coalesce(from_osm.get(f, missing), words.get(f, missing)) for f in fields}
    origin = F.create_map(*[x for f in fields for x in (F.lit(f), F.when(from_osm.get(f, missing).isNotNull(), F.coalesce(osm_source, F.lit("osm"))).when(words.get(f, missing).isNotNull(), F.lit("ner")))])
    sure = F.create_map(*[x for f, label in NER_FIELDS.items() for x in (F.lit(f), F.when(from_osm.get(f, missing).isNull(), F.try_element_at(scores, F.concat(F.lit(label + "|"), words[f]))))])
    origin, sure = F.map_filter(origin, lambda _, v: v.isNotNull()), F.map_filter(sure, lambda _, v: v.isNotNull())
    lat, lon = F.when(osm["lon"].isNotNull(), osm["lat"]), F.when(osm["lat"].isNotNull(), osm["lon"])
    out = F.struct(
        *[values[f].alias(f) for f in fields],
        lat.alias("lat"),
        lon.alias("lon"),
        osm["nuts"].alias("nuts"),
        F.when(F.size(origin) > 0, origin).alias("source"),
        F.when(F.size(sure) > 0, sure).alias("confidence"),
    )
    return F.when(F.coalesce(*values.values(), lat.cast("string")).isNotNull() | (F.size(F.coalesce(osm["nuts"], F.create_map().cast("map<string,string>"))) > 0), out)


def shape_output(items: DataFrame) -> DataFrame:
    """items (source_index, span_index, raw_text, links_i, links_s, ner, scores, osm, osm_source, language) → (…, input, institutions, subunits, location, language, confidence)."""
    shown = items.withColumn("_i", institutions(F.col("links_i"), F.col("ner"), F.col("scores"))).withColumn("_s", subunits(F.col("links_s"), F.col("ner"), F.col("scores")))
    return shown.select(
        "source_index",
        "span_index",
        F.col("raw_text").alias("input"),
        F.col("_i").alias("institutions"),
        F.col("_s").alias("subunits"),
        location(F.col("osm"), F.col("osm_source"), F.col("ner"), F.col("scores")).alias("location"),
        "language",
        F.array_max(F.transform("_i", lambda x: x["confidence"])).alias("confidence"),
    )


OUTPUT_COLUMNS = ["input", "institutions", "subunits", "location", "language", "confidence"]
