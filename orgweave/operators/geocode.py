"""Geocoding of spans: queries, cache and provider, countries, regions by coordinates, and the second pass from linked records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.text import blank_to_null, search_query, title_case
from orgweave.operators import cover
from orgweave.operators.linking import mention_context
from orgweave.plans.settle import materialise
from orgweave.providers import Provider
from orgweave.sources.cache import read_through

#: Letters of the shortest name that may be misspelt, and the lengths at which it may be so twice; longer names than that only once, as deletions grow with the square.
FUZZY_LEAST = 5
FUZZY_TWO = (9, 40)
PLACE_FIELDS = ("city", "state_district", "county", "province", "state", "region", "country", "lat", "lon", "osm_id")


def parse_place(address: Column, addresstype: Column, lat: Column, lon: Column, osm_id: Column) -> Column:
    """A geocoder's address map as a place; null if the hit is no part of its own address or says nothing."""
    get = lambda k: F.try_element_at(address, F.lit(k))
    city = F.coalesce(*[blank_to_null(get(k)) for k in ("city", "town", "village", "municipality")])
    fields = [city.alias("city"), *[get(k).alias(k) for k in ("state_district", "county", "province", "state", "region", "country")]]
    place = F.struct(*fields, lat.try_cast("double").alias("lat"), lon.try_cast("double").alias("lon"), osm_id.alias("osm_id"))
    odd = (F.coalesce(addresstype, F.lit("")) != "") & ~F.map_contains_key(address, F.coalesce(addresstype, F.lit("")))
    empty = F.coalesce(city, *[get(k) for k in ("state_district", "county", "province", "state", "region", "country")], lat, lon).isNull()
    return F.when(address.isNotNull() & ~F.coalesce(odd, F.lit(False)) & ~empty, place)


def edits_allowed(name: Column) -> Column:
    """How many edits a name may be off: none below `FUZZY_LEAST` letters, where codes would meet, two within `FUZZY_TWO`, else one."""
    n = F.char_length(name)
    return F.when(n < FUZZY_LEAST, 0).when(n.between(*FUZZY_TWO), 2).otherwise(1)


def _deletes(name: Column) -> Column:
    """The name with none, one or, within `FUZZY_TWO`, two of its characters deleted."""
    without = lambda s: F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.char_length(s))))
    one = without(name)
    two = F.when(F.char_length(name).between(FUZZY_TWO[0] - 2, FUZZY_TWO[1] + 2), F.flatten(F.transform(one, without))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(name), one, two))


def near_countries(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (n) → (n, key): the alias of least edit distance to a name, in small letters, within `edits_allowed`; none if aliases of two countries are equally near.

    Two names that many edits apart share a string that as many deletions make of each, at most, so they meet by an equi-join on deletions; the distance is then
    computed. No name is compared with every alias.
    """
    asked = names.select("n", F.lower(F.trim("n")).alias("a")).withColumn("edits", edits_allowed(F.col("a"))).where("edits > 0")
    known = aliases.select("key", "name_short", F.lower(F.trim("key")).alias("b")).where(F.char_length("b") >= FUZZY_LEAST - 2)
    met = asked.withColumn("d", F.explode(_deletes(F.col("a")))).join(known.withColumn("d", F.explode(_deletes(F.col("b")))), "d").select("n", "a", "edits", "key", "name_short", "b").distinct()
    near = met.withColumn("off", F.levenshtein("a", "b")).where("off <= edits")
    best = near.groupBy("n").agg(F.min("off").alias("least")).join(near, "n").where("off = least")
    return best.groupBy("n").agg(F.count_distinct("name_short").alias("countries"), F.min("key").alias("key")).where("countries = 1").select("n", "key")


def normalise_country(df: DataFrame, column: str, aliases: DataFrame, fuzzy: bool = True) -> DataFrame:
    """`df` plus country_short, country_code, continent, un_region: by exact alias, else by alias in title case, else by the nearest alias within one or two
    edits (see `near_countries`; not if `fuzzy` is off). A name that nothing matches stays itself, trimmed.

    Only distinct names meet the alias table.
    """
    names = df.select(F.col(column).alias("_n")).where("_n is not null and trim(_n) <> ''").distinct().withColumn("_exact", F.trim("_n")).withColumn("_title", title_case(F.trim("_n")))
    exact = aliases.select(F.col("key").alias("_exact"), F.struct("name_short", "iso3", "continent", "un_region").alias("_a"))
    titled = aliases.select(F.col("key").alias("_title"), F.struct("name_short", "iso3", "continent", "un_region").alias("_b"))
    facts = names.join(exact, "_exact", "left").join(titled, "_title", "left").withColumn("_c", F.coalesce("_a", "_b"))
    if fuzzy:
        near = near_countries(facts.where("_c is null").select(F.col("_n").alias("n")), aliases).join(exact.withColumnsRenamed({"_exact": "key", "_a": "_near"}), "key")
        facts = facts.join(near.select(F.col("n").alias("_n"), "_near"), "_n", "left").withColumn("_c", F.coalesce("_c", "_near"))
    facts = facts.select("_n", F.coalesce("_c.name_short", "_exact").alias("country_short"), F.col("_c.iso3").alias("country_code"), F.col("_c.continent").alias("continent"), F.col("_c.un_region").alias("un_region"))
    return df.join(facts, F.col(column) == F.col("_n"), "left").drop("_n")


def regions_of(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """points (point_id, lat, lon) → (point_id, nuts map): nutsL_id and nutsL_name of the polygon of each level 0–3 that holds the point, its edge excepted; of several the least id.

    Points and polygons meet by the cells of a quadtree, an equi-join, so no point is compared with every polygon, and no polygon's rings are copied: see `cover`.
    """
    cells = cover.cover(polygons.where("level between 0 and 3"), ["nuts_id", "name", "level"])
    spots = points.where("lat is not null and lon is not null").select("point_id", F.col("lon").cast("double").alias("px"), F.col("lat").cast("double").alias("py"))
    # several joins and a count of levels read the covering
    hits = cover.points_in(spots, materialise(cells, "cells"))
    first = hits.groupBy("point_id", "level").agg(F.min(F.struct("nuts_id", "name")).alias("r"))
    entries = first.select("point_id", F.explode(F.array(F.struct(F.concat(F.lit("nuts"), "level", F.lit("_id")).alias("k"), F.col("r.nuts_id").alias("v")), F.struct(F.concat(F.lit("nuts"), "level", F.lit("_name")).alias("k"), F.col("r.name").alias("v")))).alias("e"))
    return entries.groupBy("point_id").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("nuts"))


def enrich(places: DataFrame, aliases: DataFrame, polygons: DataFrame | None = None) -> DataFrame:
    """Add country_code, continent, un_region and nuts to (query, …place columns); country becomes its short name."""
    named = normalise_country(places, "country", aliases).withColumn("country", F.col("country_short")).drop("country_short")
    if polygons is None:
        return named.withColumn("nuts", F.lit(None).cast("map<string,string>"))
    found = regions_of(named.select(F.col("query").alias("point_id"), "lat", "lon"), polygons).withColumnRenamed("point_id", "query")
    return named.join(found, "query", "left")


def geocode(spans: DataFrame, provider: Provider, cached: DataFrame, aliases: DataFrame, polygons: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """spans (source_index, span_index, city, region, country) → (…keys, osm struct) of those found, and the new cache entries.

    Each distinct query is looked up once, first in the cache; raw answers are cached, before they are enriched.
    """
    asked = spans.withColumn("query", search_query(F.col("city"), F.col("region"), F.col("country"))).select("source_index", "span_index", "query").where("query is not null")
    answers, new = read_through(asked, "query", cached, provider, F.to_json(F.struct(*PLACE_FIELDS)))
    shape = "city string, state_district string, county string, province string, state string, region string, country string, lat double, lon double, osm_id long"
    places = answers.select(F.col("key").alias("query"), F.from_json("value", shape).alias("p")).select("query", "p.*")
    full = enrich(places, aliases, polygons)
    osm = F.struct(*PLACE_FIELDS, "country_code", "continent", "un_region", "nuts")
    return asked.join(full.select("query", osm.alias("osm")), "query").drop("query"), new


def geocode_spans(mentions: DataFrame, links: DataFrame, provider: Provider, cached: DataFrame, aliases: DataFrame, polygons: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(source_index, span_index, osm, osm_source): from the span's own places; where these give nothing, from those of its linked records (`ror-osm`).

    The first institution with a city gives the city and the first with a country the country; subunits are asked only where no institution has a city.
    """
    own, new = geocode(mention_context(mentions), provider, cached, aliases, polygons)
    first = materialise(own.withColumn("osm_source", F.lit("osm")), "placed")
    pick = lambda arr, f: F.try_element_at(F.filter(F.transform(F.coalesce(arr, F.array()), lambda x: F.nullif(x["id"][f], F.lit(""))), lambda v: v.isNotNull()), F.lit(1))
    inst, sub = F.col("institutions"), F.col("subunits")
    city, country = pick(inst, "ror_city"), pick(inst, "ror_country")
    from_records = links.join(first, ["source_index", "span_index"], "left_anti").select(
        "source_index",
        "span_index",
        F.coalesce(city, pick(sub, "ror_city")).alias("city"),
        F.lit(None).cast("string").alias("region"),
        F.coalesce(country, F.when(city.isNull(), pick(sub, "ror_country"))).alias("country"),
    )
    second, more = geocode(from_records, provider, cached.select("key", "value").unionByName(new), aliases, polygons)
    return first.unionByName(second.withColumn("osm_source", F.lit("ror-osm"))), new.unionByName(more)
