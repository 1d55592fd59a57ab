"""Measurement side of a watermark benchmark: rows by variant, sanity gate, aggregate in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upper_median(name: str) -> Column:
    """The middle value of a column, of two middle ones the larger; null of none. Values are counted, not gathered."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{name}` desc)")


def variant_order(v: Column) -> Column:
    return F.when(v == "control", 0).when(v == "layer-a", 1).when(v.startswith("rewrite"), 2).otherwise(3)


def sanity(text: Column, detected: Column) -> Column:
    """Why a sample is left out; null where it counts."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 50, "too short").when(~F.coalesce(detected, F.lit(False)), "not detected")


def detection(report: Column) -> Column:
    return F.coalesce(report["available"] & report["is_watermarked"], F.lit(False))


def compare(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """before and after (keys, pos, score), side by side; cleared only where it was positive before."""
    b = before.select(*keys, F.col("pos").alias("before_pos"), F.col("score").alias("score_before"))
    a = after.select(*keys, F.col("pos").alias("after_pos"), F.col("score").alias("score_after"))
    return b.join(a, keys).withColumn("cleared", F.when(F.col("before_pos"), ~F.col("after_pos")))


def aggregate(rows: DataFrame) -> DataFrame:
    """One row a variant: n, positives, cleared, clear_rate, means and upper medians, cost, notes, in a fixed order."""
    rows = rows.withColumn("_delta", F.col("score_before") - F.col("score_after"))
    delta = F.col("_delta")
    q = lambda name: F.avg(F.col(f"quality.{name}"))
    out = rows.groupBy("variant").agg(
        F.count("*").alias("n"),
        F.count_if("before_pos").alias("before_positive"),
        F.count_if("after_pos").alias("after_positive"),
        F.count_if("cleared").alias("cleared"),
        F.avg(delta).alias("mean_score_delta"),
        upper_median("_delta").alias("median_score_delta"),
        q("lexical_divergence").alias("mean_lexical_divergence"),
        q("length_ratio").alias("mean_length_ratio"),
        q("numbers_preserved").alias("mean_numbers_preserved"),
        q("urls_preserved").alias("mean_urls_preserved"),
        q("tokens_out").alias("mean_tokens_out"),
        F.avg("attempts").alias("mean_attempts"),
        F.avg("seconds").alias("mean_seconds"),
        upper_median("seconds").alias("median_seconds"),
        F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"),
        F.coalesce(F.sum("quality.tokens_out"), F.lit(0)).alias("tokens_out"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("notes")))).alias("notes"),
    )
    rate = F.when(F.col("before_positive") > 0, F.col("cleared") / F.col("before_positive"))
    per = F.when(F.col("tokens_out") > 0, F.col("cleared") / F.col("tokens_out") * 1_000_000)
    return out.withColumn("clear_rate", rate).withColumn("clears_per_mtok_out", per).orderBy(variant_order(F.col("variant")), "variant")
