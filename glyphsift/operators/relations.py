"""Pruning inside document packages: relationships, manifests, items, spines, encrypted parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dangling_relationships(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """rels (package, rel_id, target, mode) whose internal target isn't among parts (package, part)."""
    there = parts.select("package", F.col("part").alias("target"))
    return rels.where(F.lower(F.coalesce("mode", F.lit(""))) != "external").join(there, ["package", "target"], "left_anti")


def prune_relationships(rels: DataFrame, parts: DataFrame) -> DataFrame:
    return rels.join(dangling_relationships(rels, parts).select("package", "rel_id"), ["package", "rel_id"], "left_anti")


def prune_manifest(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Manifest entries (package, full_path) of parts that are still there; the root and folders stay."""
    gone = entries.where(~F.col("full_path").endswith("/")).join(parts.select("package", F.col("part").alias("full_path")), ["package", "full_path"], "left_anti")
    return entries.join(gone.select("package", "full_path"), ["package", "full_path"], "left_anti")


def prune_spine(items: DataFrame, spine: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (package, id, href) of existing parts, and spine entries (package, idref) of the items that stay."""
    kept = items.join(parts.select("package", F.col("part").alias("href")), ["package", "href"], "left_semi")
    return kept, spine.join(kept.select("package", F.col("id").alias("idref")), ["package", "idref"], "left_semi")


def readable_parts(parts: DataFrame, encrypted: DataFrame) -> DataFrame:
    return parts.join(encrypted.select("package", "part"), ["package", "part"], "left_anti")


def tag_spans(opens: DataFrame, closes: DataFrame) -> DataFrame:
    """(doc, start, end): each opening tag up to the first closing one after it; spans never overlap.

    opens and closes are (doc, pos). Between two closing tags the first opening one counts, as a span takes all to its
    end: one window pass, linear in the number of tags.
    """
    from pyspark.sql.window import Window

    marks = opens.select("doc", "pos", F.lit(0).alias("closing")).union(closes.select("doc", "pos", F.lit(1).alias("closing")))
    before = Window.partitionBy("doc").orderBy("pos", "closing").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("block", F.coalesce(F.sum("closing").over(before), F.lit(0)))
    out = marks.groupBy("doc", "block").agg(F.min(F.when(F.col("closing") == 0, F.col("pos"))).alias("start"), F.max(F.when(F.col("closing") == 1, F.col("pos"))).alias("end"))
    return out.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select("doc", "start", "end")


def covered(dropped: DataFrame, kept: DataFrame) -> DataFrame:
    """Dropped ranges (file, lo, hi) that a kept range of the file overlaps: their bytes must stay."""
    k = kept.select(F.col("file").alias("_f"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return dropped.join(k, (F.col("file") == F.col("_f")) & (F.col("lo") < F.col("_hi")) & (F.col("_lo") < F.col("hi")), "left_semi")
