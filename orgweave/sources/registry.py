"""The organisation registry: dumps in, one flat table out, and what is derived from it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orgweave import schemas
from orgweave.functions.text import blank_to_null, name_key, tagged, tags
from orgweave.plans.settle import materialise
from orgweave.sources import jsonarray

DUMP_PATTERNS = ("v*.json", "ror-data*.json", "*ror*.json")
MAX_HOPS = 5


def _strings(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def _related(kind: str) -> Column:
    """The last id of a kind of relationship."""
    hits = F.filter("relationships", lambda r: F.lower(r["type"]) == kind)
    return F.try_element_at(hits, F.lit(-1))["id"]


def normalise_v1(dump: DataFrame) -> DataFrame:
    """Registry rows of a first-schema dump; rows without an id go."""
    labels = F.filter(F.transform(F.coalesce("labels", F.array().cast("array<struct<label:string>>")), lambda x: x["label"]), lambda x: x.isNotNull() & (x != ""))
    return dump.where(blank_to_null(F.col("id")).isNotNull()).select(
        "id",
        F.coalesce("name", F.lit("")).alias("name"),
        _strings(F.col("aliases")).alias("aliases"),
        _strings(F.col("acronyms")).alias("acronyms"),
        labels.alias("labels"),
        F.coalesce("country.country_name", F.lit("")).alias("country"),
        F.coalesce("country.country_code", F.lit("")).alias("country_code"),
        F.coalesce(F.try_element_at("addresses", F.lit(1))["city"], F.lit("")).alias("city"),
        _strings(F.col("types")).alias("types"),
        F.coalesce("status", F.lit("active")).alias("status"),
        F.lit("ror").alias("source"),
        F.coalesce(F.try_element_at("links", F.lit(1)), F.lit("")).alias("url"),
        _related("parent").alias("parent_id"),
        _related("successor").alias("successor_id"),
    )


def normalise_v2(dump: DataFrame) -> DataFrame:
    """Registry rows of a second-schema dump. A name with several types counts as the first of: displayed, acronym, alias, label."""

    def kind(n: Column) -> Column:
        has = lambda t: F.array_contains(n["types"], t)
        return F.when(has("ror_display"), "display").when(has("acronym"), "acronym").when(has("alias"), "alias").when(has("label"), "label").otherwise("")

    def named(which: str) -> Column:
        return _strings(F.transform(F.filter("names", lambda n: (kind(n) == which) & n["value"].isNotNull() & (n["value"] != "")), lambda n: n["value"]))

    place = F.try_element_at("locations", F.lit(1))["geonames_details"]
    site = F.try_element_at(F.filter("links", lambda x: x["type"] == "website"), F.lit(1))["value"]
    return dump.where(blank_to_null(F.col("id")).isNotNull()).select(
        "id",
        F.coalesce(F.try_element_at(named("display"), F.lit(-1)), F.try_element_at("names", F.lit(1))["value"], F.lit("")).alias("name"),
        named("alias").alias("aliases"),
        named("acronym").alias("acronyms"),
        named("label").alias("labels"),
        F.coalesce(place["country_name"], F.lit("")).alias("country"),
        F.coalesce(place["country_code"], F.lit("")).alias("country_code"),
        F.coalesce(place["name"], F.lit("")).alias("city"),
        _strings(F.col("types")).alias("types"),
        F.coalesce("status", F.lit("active")).alias("status"),
        F.lit("ror").alias("source"),
        F.coalesce(site, F.lit("")).alias("url"),
        _related("parent").alias("parent_id"),
        _related("successor").alias("successor_id"),
    )


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array dump; entries with `names` follow the second schema, the others the first. Entries that don't parse are skipped.

    One file is read in as many tasks as it has ranges, see `jsonarray`.
    """
    entries = materialise(jsonarray.entries(spark, path), "dump-entries")
    parsed = entries.select(F.from_json("entry", schemas.DUMP_V1 + ", names string").alias("v1"), F.from_json("entry", schemas.DUMP_V2).alias("v2"))
    first = parsed.where("v1.id is not null and v1.names is null").select("v1.*").drop("names")
    return normalise_v1(first).unionByName(normalise_v2(parsed.where("v1.names is not null").select("v2.*")))


def find_dump(spark: SparkSession, directory: str) -> str | None:
    """The newest dump in a folder over all name patterns; of files equally new the last by name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    dated = []
    for pattern in DUMP_PATTERNS:
        glob = jvm.org.apache.hadoop.fs.Path(f"{directory.rstrip('/')}/{pattern}")
        dated += [(f.getModificationTime(), f.getPath().toString()) for f in glob.getFileSystem(conf).globStatus(glob) or ()]
    return max(dated)[1] if dated else None


def read_jsonl(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """Registry rows from JSON lines; unknown fields are ignored."""
    out = spark.read.schema(schemas.REGISTRY).json(path)
    return out.where(F.col("status") == "active") if active_only else out


def write_jsonl(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, directory: str, registry: str = "ror", active_only: bool = True) -> DataFrame:
    """The registry of a folder, read through: the table kept from an earlier call, else the newest dump, which is kept as Parquet."""
    if registry != "ror":
        raise ValueError(f"unknown registry {registry!r}")
    kept = f"{directory.rstrip('/')}/{registry}.parquet"
    if not exists(spark, kept):
        dump = find_dump(spark, directory)
        if dump is None:
            raise FileNotFoundError(f"no registry dump in {directory}")
        read_dump(spark, dump).write.mode("overwrite").parquet(kept)
    out = spark.read.parquet(kept)
    return out.where(F.col("status") == "active") if active_only else out


def from_table(df: DataFrame, mapping: Mapping[str, str], source: str) -> DataFrame:
    """Any table as a registry: mapping from registry column to SQL expression over `df`; columns left out are empty."""
    fields = [f.strip().split(" ", 1) for f in schemas.REGISTRY.split(", ")]
    default = {"status": "'active'", "source": f"'{source}'"}
    return df.selectExpr(*[f"cast({mapping.get(n, default.get(n, 'array()' if t.startswith('array') else 'null'))} as {t}) as {n}" for n, t in fields])


# --- names


def _all_names() -> Column:
    return F.concat(F.array("name"), _strings(F.col("aliases")), _strings(F.col("labels")), F.filter(_strings(F.col("acronyms")), lambda a: F.length(a) >= 2))


def name_variants(registry: DataFrame) -> DataFrame:
    """(id, variant_no, variant): name, aliases, labels and acronyms of two letters or more, each once per record whatever its case, the first kept, trimmed."""
    each = registry.select("id", F.posexplode(_all_names()).alias("pos", "raw")).withColumn("variant", F.trim("raw")).where("variant <> ''")
    first = each.groupBy("id", F.lower("variant").alias("_k")).agg(F.min(F.struct("pos", "variant")).alias("v"))
    order = Window.partitionBy("id").orderBy("v.pos")
    return first.select("id", (F.row_number().over(order) - 1).alias("variant_no"), F.col("v.variant").alias("variant"))


def variant_texts(registry: DataFrame) -> DataFrame:
    """(id, variant_no, variant, text): each name with its record's acronyms, city, country and parent as tags. A parent outside the table has no name."""
    parents = registry.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    acronyms = F.transform(F.filter(_strings(F.col("acronyms")), lambda a: F.length(a) >= 2), lambda a: F.concat(F.lit("[ACRONYM] "), a))
    facts = registry.select("id", F.nullif(F.array_join(acronyms, " "), F.lit("")).alias("acronyms"), "city", "country", "parent_id").join(parents, "parent_id", "left")
    text = F.concat_ws(" ", tagged(F.col("variant")), F.col("acronyms"), *tags(("CITY", F.col("city")), ("COUNTRY", F.col("country")), ("PARENT", F.col("parent_name"))))
    return name_variants(registry).join(facts, "id").select("id", "variant_no", "variant", text.alias("text"))


# --- direct match index and successors


def unique_names(registry: DataFrame) -> DataFrame:
    """(name_key, country_key, record_id): the pairs of name and country (its name or code) that a single record has."""
    names = name_variants(registry).select("id", name_key(F.col("variant")).alias("name_key"))
    places = registry.select("id", F.explode(F.array_distinct(F.array(name_key(F.coalesce("country", F.lit(""))), F.lower(F.trim(F.coalesce("country_code", F.lit(""))))))).alias("country_key"))
    keys = names.join(places, "id").where("name_key <> '' and country_key <> ''")
    return keys.groupBy("name_key", "country_key").agg(F.min("id").alias("record_id"), F.max("id").alias("_m")).where("record_id = _m").drop("_m")


def resolve_successors(registry: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(id, resolved_id) for each record: an inactive one is followed to its successor, for at most `max_hops` steps.

    The walk ends at an active record, at one without a successor, at an id that the table lacks, or where a cycle closes.
    """
    facts = registry.select("id", (F.col("status") == "active").alias("active"), blank_to_null(F.col("successor_id")).alias("next"))
    known = facts.select(F.col("id").alias("k_id"), F.when(~F.col("active"), F.col("next")).alias("k_next"))
    # only inactive records with a successor can move; the others are their own answer
    moving = facts.where("not active and next is not null").select("id", F.col("id").alias("at"), "next", F.array("id").alias("seen"))
    for _ in range(max_hops):
        hop = moving.join(known, moving["next"] == known["k_id"], "left")
        closes = F.array_contains("seen", F.coalesce("next", F.lit("")))
        moving = hop.select(
            "id",
            F.coalesce("next", "at").alias("at"),
            F.when(~closes, F.col("k_next")).alias("next"),
            F.when(F.col("next").isNull(), F.col("seen")).otherwise(F.array_append("seen", F.col("next"))).alias("seen"),
        )
    return facts.select("id").join(moving.select("id", "at"), "id", "left").select("id", F.coalesce("at", "id").alias("resolved_id"))
