"""Reference tables and results: countries, regions' polygons, dense index, results."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave import schemas
from orgweave.functions.text import blank_to_null
from orgweave.operators import hnsw, ivf
from orgweave.plans.settle import materialise
from orgweave.providers import Provider
from orgweave.sources.registry import exists, variant_texts

INDEX_TYPES = ("flat", "ivf", "hnsw")


def read_countries(spark: SparkSession, directories: list[str], name: str = "country_data.tsv") -> DataFrame:
    """The country table of the first folder that has one; none: no rows."""
    for d in directories:
        path = f"{d.rstrip('/')}/{name}"
        if exists(spark, path):
            return spark.read.schema(schemas.COUNTRY).csv(path, sep="\t", header=True)
    return spark.createDataFrame([], schemas.COUNTRY)


def country_aliases(countries: DataFrame) -> DataFrame:
    """(key, name_short, iso3, continent, un_region): every short name, official name and code; of rows that share a key the first counts."""
    c = countries.select(*[blank_to_null(F.col(x)).alias(x) for x in countries.columns]).where("name_short is not null")
    c = c.withColumn("_row", F.monotonically_increasing_id())
    facts = c.groupBy("name_short").agg(F.min(F.struct("_row", "ISO3", "continent", "UNregion")).alias("f"))
    keys = c.select("_row", "name_short", F.posexplode(F.array("name_short", "name_official", "ISO3", "ISO2")).alias("pos", "key")).where("key is not null")
    first = keys.groupBy("key").agg(F.min(F.struct("_row", "pos", "name_short")).alias("m")).select("key", F.col("m.name_short").alias("name_short"))
    return first.join(facts, "name_short").select("key", "name_short", F.col("f.ISO3").alias("iso3"), F.col("f.continent").alias("continent"), F.col("f.UNregion").alias("un_region"))


def read_nuts(spark: SparkSession, path: str) -> DataFrame:
    """Polygons converted beforehand to Parquet of `schemas.NUTS`, in longitude and latitude."""
    return spark.read.schema(schemas.NUTS).parquet(path)


def nuts_from_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Polygons and multipolygons of a GeoJSON feature collection with NUTS_ID, NUTS_NAME and LEVL_CODE; inner rings are holes."""
    props = "properties struct<NUTS_ID:string,NUTS_NAME:string,LEVL_CODE:int>"
    raw = spark.read.schema(f"features array<struct<{props.replace(' ', ':', 1)},geometry:struct<type:string,coordinates:string>>>").option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    polygon = F.from_json("c", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("c", "array<array<array<array<double>>>>"))
    points = F.when(F.col("type") == "Polygon", polygon).otherwise(multi)
    rings = F.transform(points, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return f.select(F.col("NUTS_ID").alias("nuts_id"), F.col("NUTS_NAME").alias("name"), F.col("LEVL_CODE").alias("level"), rings.alias("rings"))


def build_index(registry: DataFrame, encoder: Provider, encoder_name: str, path: str, index_type: str = "flat", rebuild: bool = False) -> DataFrame:
    """(id, variant, embedding) of the registry's name variants, kept at `path` and used again while encoder and type are the same.

    `ivf` adds a coarse cell per vector and the cells' centres, see `ivf.cells`; `linking.retrieve` then looks in near cells only. `hnsw` keeps graphs beside the
    vectors and returns these, see `hnsw.build`; `linking.retrieve` then walks them. `flat` is compared with every vector.
    """
    if index_type not in INDEX_TYPES:
        raise ValueError(f"index type is one of {', '.join(INDEX_TYPES)}, not {index_type!r}")
    spark = registry.sparkSession
    meta_path, graph_path = f"{path.rstrip('/')}/meta", f"{path.rstrip('/')}/graph"
    if not rebuild and exists(spark, f"{meta_path}/_SUCCESS") and exists(spark, f"{path.rstrip('/')}/vectors/_SUCCESS"):
        meta = spark.read.json(meta_path).first()
        if meta["encoder"] == encoder_name and meta["index_type"] == index_type:
            kept = spark.read.parquet(f"{path.rstrip('/')}/vectors")
            if index_type == "hnsw" and exists(spark, f"{graph_path}/_SUCCESS"):
                return spark.read.parquet(graph_path)
            if index_type == "flat" or "cell" in kept.columns:
                return kept
    texts = variant_texts(registry)
    coded = encoder(texts.select("text").distinct())
    vectors = texts.join(coded, "text").select("id", "variant", "embedding")
    if index_type == "ivf":
        vectors = ivf.cells(materialise(vectors, "index-vectors"))  # cells are trained in several passes
    vectors.write.mode("overwrite").parquet(f"{path.rstrip('/')}/vectors")
    out = spark.read.parquet(f"{path.rstrip('/')}/vectors")
    facts = out.agg(F.count("*").alias("num_vectors"), F.count_distinct("id").alias("num_records"), F.max(F.size("embedding")).alias("dim"))
    if index_type == "hnsw":
        hnsw.build(linking_items(out)).write.mode("overwrite").parquet(graph_path)
    facts.select("*", F.lit(encoder_name).alias("encoder"), F.lit(index_type).alias("index_type")).coalesce(1).write.mode("overwrite").json(meta_path)
    return spark.read.parquet(graph_path) if index_type == "hnsw" else out


def linking_items(vectors: DataFrame) -> DataFrame:
    """(iid, embedding) of (id, variant, embedding): the id under which a search returns a name variant."""
    return vectors.select(F.to_json(F.struct("id", "variant")).alias("iid"), "embedding")


def extract_bundle(archive: str, target: str, prefixes: dict[str, str]) -> list[str]:
    """Unpack a data bundle on the driver, moving path prefixes; members that would leave the folder are refused."""
    written = []
    with zipfile.ZipFile(archive) as z:
        for member in z.namelist():
            for old, new in prefixes.items():
                if member.startswith(old) and not member.endswith("/"):
                    to = os.path.normpath(os.path.join(target, new, member[len(old) :].lstrip("/")))
                    if not to.startswith(os.path.normpath(target) + os.sep):
                        raise ValueError(f"{member} leads out of {target}")
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    with z.open(member) as src, open(to, "wb") as out:
                        while chunk := src.read(1 << 20):
                            out.write(chunk)
                    written.append(to)
                    break
    return written


def largest_json(archive: str) -> str:
    """The largest .json member of a release archive: the registry dump."""
    with zipfile.ZipFile(archive) as z:
        return max((i for i in z.infolist() if i.filename.endswith(".json")), key=lambda i: i.file_size).filename


def write_results(results: DataFrame, path: str, form: str = "parquet") -> None:
    """Results as parquet, json (nulls left out) or tsv of flat columns."""
    w = results.write.mode("overwrite")
    if form == "parquet":
        w.parquet(path)
    elif form == "json":
        w.option("ignoreNullFields", True).json(path)
    elif form == "tsv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in results.dtypes]
        results.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def read_inputs(spark: SparkSession, texts: list[str] | str | Iterator[str]) -> DataFrame:
    """One text or several as (source_index, raw_text)."""
    if isinstance(texts, str):
        texts = [texts]
    texts = list(texts)
    if any(not isinstance(t, str) for t in texts):
        raise TypeError("inputs are strings")
    return spark.createDataFrame(list(enumerate(texts)), schemas.INPUT)


def dump_json(row) -> str:
    return json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str)
