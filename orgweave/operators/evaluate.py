"""Precision, recall and F1 of predicted ids against gold ids, and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions.text import blank_to_null, registry_ids, title_case


def gold_text(df: DataFrame) -> DataFrame:
    """Fill a missing raw_affiliation_string from ORG, CITY (in title case) and COUNTRY."""
    parts = F.concat_ws(", ", blank_to_null(F.col("ORG")), blank_to_null(title_case(F.col("CITY"))), blank_to_null(F.col("COUNTRY")))
    return df.withColumn("raw_affiliation_string", F.coalesce("raw_affiliation_string", parts) if "raw_affiliation_string" in df.columns else parts)


def score_rows(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """`df` (arrays of ids) plus correct, incorrect, missing, p, r, f1. No prediction: p = 0; no gold: r = 1; repeats and nulls don't count."""
    g, q = F.array_distinct(F.array_compact(F.coalesce(gold, F.array().cast("array<string>")))), F.array_distinct(F.array_compact(F.coalesce(predicted, F.array().cast("array<string>"))))
    both = F.array_intersect(g, q)
    p = F.when(F.size(q) == 0, 0.0).otherwise(F.size(both) / F.size(q))
    r = F.when(F.size(g) == 0, 1.0).otherwise(F.size(both) / F.size(g))
    out = df.withColumn("correct", both).withColumn("incorrect", F.array_except(q, g)).withColumn("missing", F.array_except(g, q)).withColumn("p", p).withColumn("r", r)
    return out.withColumn("f1", F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))))


def score_labels(df: DataFrame, gold: str = "label", predicted: str = "pred_label") -> DataFrame:
    """As `score_rows`, from label strings `Name {address}` joined by `|`."""
    return score_rows(df.withColumn("_g", registry_ids(F.col(gold))).withColumn("_p", registry_ids(F.col(predicted))), "_g", "_p").drop("_g", "_p")


def join_predictions(gold: DataFrame, predictions: DataFrame, on: str, gold_ids: str = "gold", predicted_ids: str = "predicted") -> DataFrame:
    """Rows of `gold` with the predictions of the same key, scored as by `score_rows`. A row without a prediction counts as predicted nothing; predictions
    without a gold row are not scored; of repeated predictions of a key all ids count."""
    found = predictions.where(F.col(on).isNotNull()).groupBy(on).agg(F.flatten(F.collect_list(F.coalesce(predicted_ids, F.array().cast("array<string>")))).alias(predicted_ids))
    return score_rows(gold.drop(predicted_ids).join(found, on, "left"), gold_ids, predicted_ids)


def stage_means(times: DataFrame) -> DataFrame:
    """(stage, seconds) of each run → (stage, runs, seconds): the mean time of each stage."""
    return times.groupBy("stage").agg(F.count("*").alias("runs"), F.avg("seconds").alias("seconds"))


def summarise(scored: DataFrame, *by: str) -> DataFrame:
    """Macro means of p, r and f1, with the number of rows."""
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f1").alias("f1"))


def run_summary(outputs: DataFrame) -> DataFrame:
    """One row: spans, institutions, linked ones, most spans of a text."""
    per = outputs.select("source_index", F.size("institutions").alias("i"), F.size(F.filter("institutions", lambda x: x["id"].isNotNull())).alias("l"))
    each = per.groupBy("source_index").agg(F.count("*").alias("spans"), F.sum("i").alias("i"), F.sum("l").alias("l"))
    return each.agg(F.sum("spans").alias("spans"), F.sum("i").alias("institutions"), F.sum("l").alias("linked"), F.max("spans").alias("most_spans"))


def language_histogram(spans: DataFrame, top: int = 5) -> DataFrame:
    return spans.groupBy(F.col("language_info.language").alias("language")).count().orderBy(F.desc("count"), "language").limit(top)
