"""The order of stages: spans, language, translation, entities, linking, places, types, output."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave import schemas
from orgweave.adapters import release
from orgweave.functions import detector
from orgweave.functions import language as lang
from orgweave.operators import evaluate, geocode, linking, orgtype, output, spans, tagger, typemodel
from orgweave.plans.config import PipelineConfig
from orgweave.plans.settle import materialise, spread
from orgweave.providers import Provider
from orgweave.sources.cache import Cache
from orgweave.sources.tables import country_aliases, read_inputs

_EMPTY_LINKS = f"cast(array() as array<{schemas.LINK}>)"
_OSM = (
    "struct<city:string,state_district:string,county:string,province:string,state:string,region:string,country:string,lat:double,lon:double,osm_id:bigint,"
    "country_code:string,continent:string,un_region:string,nuts:map<string,string>>"
)


@dataclass
class Engine:
    """Turns raw affiliation texts into structured records. Each stage is a public method over DataFrames; `process` runs them all.

    A stage whose provider or table is missing leaves its fields null; the schema of the result is always the same.
    """

    spark: SparkSession
    config: PipelineConfig = PipelineConfig()
    registry: DataFrame | None = None
    ner: Provider | None = None
    span_model: Provider | None = None
    language_model: Provider | None = None
    #: Labelled texts (text, lang) that a detector is trained on where the method asks for one and none is given.
    language_texts: DataFrame | None = None
    #: Labelled texts (text, entities array<struct(start, end, label)>) that a tagger of entities, and one of spans, is trained on if no such model is given.
    entity_texts: DataFrame | None = None
    span_texts: DataFrame | None = None
    #: Labelled names (name, lvl1, lvl2) that a classifier of types is trained on if none is given.
    type_names: DataFrame | None = None
    translator: Provider | None = None
    vectors: DataFrame | None = None
    encoder: Provider | None = None
    reranker: Provider | None = None
    judge: Provider | None = None
    geocoder: Provider | None = None
    geo_cache: Cache | None = None
    countries: DataFrame | None = None
    polygons: DataFrame | None = None
    org_types: Provider | None = None
    #: (stage, seconds) of each stage that has run, for `evaluate.stage_means`.
    times: list[tuple[str, float]] = field(default_factory=list)

    def _settled(self, df: DataFrame, stage: str) -> DataFrame:
        """A stage, written; how long that took is noted."""
        began = time.perf_counter()
        out = materialise(df, stage)
        self.times.append((stage, time.perf_counter() - began))
        return out

    def stage_times(self) -> DataFrame:
        """(stage, runs, seconds): the mean time of each stage so far."""
        return evaluate.stage_means(self.spark.createDataFrame(self.times, "stage string, seconds double"))

    def close(self) -> None:
        """Let go of models that providers hold in this process, and of providers that can be closed."""
        release()
        for provider in (self.ner, self.span_model, self.language_model, self.translator, self.encoder, self.reranker, self.judge, self.geocoder, self.org_types):
            close = getattr(provider, "close", None)
            if close is not None:
                close()

    def __post_init__(self) -> None:
        if self.ner is None and self.entity_texts is not None:
            self.ner = tagger.train(self.entity_texts).ner()
        if self.span_model is None and self.span_texts is not None:
            self.span_model = tagger.train(self.span_texts).span_model()
        if self.org_types is None and self.type_names is not None:
            self.org_types = typemodel.train(self.type_names).provider()
        wanted = {"span_strategy model": (self.config.span_strategy == "model", self.span_model), "enable_translation": (self.config.enable_translation, self.translator), "enable_org_types": (self.config.enable_org_types, self.org_types), "llm_judge": (self.config.link.llm_judge, self.judge)}
        if self.config.enable_language_detect and self.config.language_method != "heuristic" and self.language_model is None and self.language_texts is not None:
            self.language_model = detector.train(self.language_texts).provider()
        for name, (on, provider) in wanted.items():
            if on and provider is None:
                raise ValueError(f"{name} takes a provider")

    def get_spans(self, inputs: DataFrame) -> DataFrame:
        c = self.config
        return spans.expand_spans(inputs, c.span_strategy, c.span_delimiter, self.span_model)

    def get_language(self, items: DataFrame) -> DataFrame:
        if not self.config.enable_language_detect:
            return items.withColumn("language_info", F.lit(None).cast(schemas.LANGUAGE_INFO))
        return lang.detect(items, "raw_text", self.config.language_method, self.language_model, compat=self.config.compat)

    def get_translation(self, items: DataFrame) -> DataFrame:
        if not self.config.enable_translation:
            return items.withColumn("original_text", F.lit(None).cast("string")).withColumn("translated", F.lit(None).cast("boolean"))
        return spans.translate(items, self.translator, self.config.extra_languages)

    def get_ner(self, items: DataFrame) -> DataFrame:
        if self.ner is None:
            return self.spark.createDataFrame([], schemas.MENTIONS)
        return spans.tag_mentions(items, self.ner, self.config.min_entity_score)

    def get_links(self, mentions: DataFrame) -> DataFrame:
        c = self.config.link
        return linking.link_spans(mentions, self.registry, c, vectors=self.vectors, encoder=self.encoder, reranker=self.reranker if c.rerank else None, logits=self.judge if c.llm_judge else None)

    def get_normalization(self, mentions: DataFrame, links: DataFrame) -> DataFrame:
        """(source_index, span_index, osm, osm_source); new answers go to the cache."""
        aliases = country_aliases(self.countries) if self.countries is not None else country_aliases(self.spark.createDataFrame([], schemas.COUNTRY))
        cached = self.geo_cache.get() if self.geo_cache else self.spark.createDataFrame([], "key string, value string, created_at double")
        found, new = geocode.geocode_spans(mentions, links, self.geocoder, cached, aliases, self.polygons)
        if self.geo_cache:
            self.geo_cache.put(new)
        return found

    def items(self, inputs: DataFrame) -> DataFrame:
        """All stages, one row per span, before the public shape."""
        c, keys = self.config, ["source_index", "span_index"]
        # texts are few bytes, which come in a task or two, but much is made of each: they are dealt to all cores.
        # several branches read each stage, so it is settled before they part
        dealt = spread(self.get_spans(inputs), "source_index", "raw_text")
        base = self._settled(self.get_translation(self.get_language(dealt)), "spans")
        mentions = self._settled(self.get_ner(base), "mentions")
        out = base.join(spans.group_by_label(mentions), keys, "left").join(output.score_lookup(mentions), keys, "left")
        links = None
        if c.enable_entity_linking and self.registry is not None:
            links = self._settled(self.get_links(mentions), "links")
            if c.enable_org_types:
                each = links.select(F.explode("institutions").alias("i")).select(F.coalesce("i.id.ror_name", "i.query").alias("name"), "i.id.ror_country")
                links = orgtype.add_types(links, orgtype.classify(each.withColumnRenamed("ror_country", "country"), self.org_types))
                links = self._settled(links, "typed-links")
            out = out.join(links, keys, "left")
        else:
            out = out.withColumn("institutions", F.expr(_EMPTY_LINKS)).withColumn("subunits", F.expr(_EMPTY_LINKS))
        if c.enable_normalization and self.geocoder is not None:
            known = links if links is not None else base.select(*keys, F.expr(_EMPTY_LINKS).alias("institutions"), F.expr(_EMPTY_LINKS).alias("subunits"))
            out = out.join(self.get_normalization(mentions, known), keys, "left")
        else:
            out = out.withColumn("osm", F.lit(None).cast(_OSM)).withColumn("osm_source", F.lit(None).cast("string"))
        empty = lambda n: F.coalesce(n, F.expr(_EMPTY_LINKS))
        return out.withColumn("institutions", empty("institutions")).withColumn("subunits", empty("subunits"))

    def spans_out(self, inputs: DataFrame) -> DataFrame:
        """One public row per span."""
        items = self.items(inputs).withColumnsRenamed({"institutions": "links_i", "subunits": "links_s"}).withColumn("language", F.col("language_info.language"))
        return output.shape_output(items)

    def process(self, inputs: DataFrame | list[str] | str) -> DataFrame:
        """(source_index, raw_text, outputs): per text its spans in order; in the full format one wide row per span instead."""
        table = inputs if isinstance(inputs, DataFrame) else read_inputs(self.spark, inputs)
        if self.config.output_format == "full":
            return self.items(table)
        return spans.regroup(self.spans_out(table), table, output.OUTPUT_COLUMNS)

    def info(self) -> dict:
        """Which stages are on and what they run with."""
        c = self.config
        return {
            "span": c.span_strategy,
            "language": c.language_method if c.enable_language_detect else None,
            "translation": c.enable_translation,
            "ner": self.ner is not None,
            "linking": c.enable_entity_linking and self.registry is not None,
            "dense": self.vectors is not None and self.encoder is not None,
            "reranker": self.reranker is not None and c.link.rerank,
            "judge": c.link.llm_judge,
            "normalization": c.enable_normalization and self.geocoder is not None,
            "org_types": c.enable_org_types,
        }

    def summary(self, inputs: DataFrame) -> DataFrame:
        return evaluate.run_summary(self.spans_out(inputs))
