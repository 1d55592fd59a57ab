"""Audit items, summaries, SARIF results and the run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import embedded, formats, layer_a, markup, media
from ..functions.confidence import LEVELS, confidence, sarif_rule
from .stylometry import GATE, stylometry

ITEM = ("path", "kind", "has_c2pa", "has_ai_metadata", "suspicious_total", "findings", "confidence")


def with_confidence(items: DataFrame) -> DataFrame:
    return items.withColumn("confidence", F.transform("findings", confidence)).select(*ITEM)


def text_items(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", check_stylometry: bool = False) -> DataFrame:
    """Audit items of plain texts: Layer A findings, and one of style where the score reaches the gate.

    One scan: the text of rows without any suspect character never reaches Python, where the exact scan runs.
    """
    out = stylometry(df.select(id_col, text_col), text_col) if check_stylometry else df.select(id_col, text_col)
    hits = layer_a.inspect_udf()(F.when(layer_a.is_suspect(F.col(text_col)), F.col(text_col)))
    both = out.withColumn("_hits", F.coalesce(hits, F.from_json(F.lit("[]"), layer_a.HIT)))
    said = F.transform("_hits", lambda h: F.format_string("layer-a [%s] %s x%d", h["kind"], h["label"], h["count"]))
    sure = F.transform("_hits", lambda h: h["confidence"])
    total = F.aggregate("_hits", F.lit(0), lambda a, h: a + h["count"])
    if check_stylometry:
        high = F.coalesce(reaches_gate(F.col("score")), F.lit(False))
        said = F.when(high, F.concat(said, F.array(style_finding()))).otherwise(said)
        sure = F.when(high, F.concat(sure, F.array(F.lit("probable")))).otherwise(sure)
        total = total + high.cast("int")
    no = F.lit(False)
    return both.select(F.col(id_col).cast("string").alias("path"), F.lit("text").alias("kind"), no.alias("has_c2pa"), no.alias("has_ai_metadata"), total.alias("suspicious_total"), said.alias("findings"), sure.alias("confidence"))


def reaches_gate(score: Column) -> Column:
    """Whether a score is at the gate as it is reported, with four places."""
    return F.round(score, 4) >= GATE


def style_finding() -> Column:
    return F.format_string("stylometry [high_probability] score %.2f (%s)", "score", "confidence_level")


def file_items(files: DataFrame, check_stylometry: bool = False) -> DataFrame:
    """Audit items of files (path, content) of any kind: each is classified once and goes to the inspector of its kind.

    Text goes through the exact scan, images, audio and video, packages and PDF through theirs, HTML, Markdown and SVG
    through theirs and, but for SVG, the exact scan of their body. What isn't known is 'unknown' without findings.
    """
    files = files.select("path", "content", formats.classify(F.col("path"), F.col("content")).alias("_kind"))
    ext = formats.extension(F.col("path"))
    box = F.when(F.col("_kind") == "container", F.coalesce(formats.container_format(F.col("content"), ext), F.lit("unknown")))
    markup_kind = box.isin("html", "markdown", "svg")
    text = F.when((F.col("_kind") == "text") | markup_kind, F.decode(F.col("content"), "UTF-8"))
    binary = F.when(F.col("_kind").isin("image", "av") | ((F.col("_kind") == "container") & ~markup_kind), F.col("content"))
    rows = files.select("path", "_kind", box.alias("_box"), text.alias("_text"), binary.alias("_bin"))
    if check_stylometry:
        rows = stylometry(rows, "_text")
    rows = rows.withColumn("_r", media.inspect_udf()("_bin")).withColumn("_hits", layer_a.inspect_udf()(F.when((F.coalesce(F.col("_box"), F.lit("")) != "svg") & layer_a.is_suspect(F.col("_text")), F.col("_text"))))
    t, kind = F.col("_text"), F.coalesce("_box", "_kind")
    none, no = F.array().cast("array<string>"), F.lit(False)
    html, md, svg = (F.col("_box") == x for x in ("html", "markdown", "svg"))
    uris = embedded.inspect_udf()(F.when((html | svg) & F.lower(t).contains("data:image/"), t))
    rows = rows.withColumn("_u", uris)
    own = F.when(html, markup.html_findings(t)).when(md, markup.markdown_findings(t)).when(svg, markup.svg_findings(t)).otherwise(F.coalesce(F.col("_r.findings"), none))
    own = F.concat(own, F.coalesce(F.col("_u.findings"), none))
    plain = F.col("_kind") == "text"
    hits = F.coalesce("_hits", F.from_json(F.lit("[]"), layer_a.HIT))
    said = F.transform(hits, lambda h: F.when(plain, F.format_string("layer-a [%s] %s x%d", h["kind"], h["label"], h["count"])).otherwise(F.format_string("layer-a: U+%04X %s x%d (%s)", h["codepoint"], h["label"], h["count"], h["kind"])))
    sure = F.transform(hits, lambda h: F.when(plain, h["confidence"]).otherwise("probable"))
    ai_keys = F.exists(markup.front_matter_keys(t), lambda k: k["ai"] | k["ai_value"])
    c2pa = F.when(html, markup.html_has_c2pa(t)).otherwise(F.coalesce(F.col("_r.has_c2pa"), no)) | F.coalesce(F.col("_u.has_c2pa"), no)
    ai = F.when(html, markup.html_has_ai(t)).when(md, ai_keys).when(svg, F.size(markup.svg_findings(t)) > 0).otherwise(F.coalesce(F.col("_r.has_ai_metadata"), no)) | F.coalesce(F.col("_u.has_ai_metadata"), no)
    total = F.aggregate(hits, F.lit(0), lambda a, h: a + h["count"])
    found, level = F.concat(own, said), F.concat(F.transform(own, confidence), sure)
    if check_stylometry:
        high = F.coalesce(reaches_gate(F.col("score")) & ~F.coalesce(svg, no), no)
        found, level = (F.when(high, F.concat(x, F.array(y))).otherwise(x) for x, y in ((found, style_finding()), (level, F.lit("probable"))))
        total = total + high.cast("int")
    shown = F.when(F.col("_kind").isin("image", "av"), F.coalesce(F.col("_r.format"), kind)).otherwise(kind)
    return rows.select("path", shown.alias("kind"), c2pa.alias("has_c2pa"), ai.alias("has_ai_metadata"), total.alias("suspicious_total"), found.alias("findings"), level.alias("confidence"))


def html_items(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    h = F.col(html_col)
    return with_confidence(df.select(F.col(id_col).cast("string").alias("path"), F.lit("container").alias("kind"), markup.html_has_c2pa(h).alias("has_c2pa"), markup.html_has_ai(h).alias("has_ai_metadata"), F.lit(0).alias("suspicious_total"), markup.html_findings(h).alias("findings")))


def is_actionable() -> Column:
    return F.col("has_c2pa") | F.exists("confidence", lambda c: c.isin("confirmed", "probable"))


def is_suspicious(score: Column | None = None, detectors: Column | None = None) -> Column:
    """The service's flag: any carrier or metadata, a high stylometric score, or a detector that is there and says so."""
    out = (F.col("suspicious_total") > 0) | F.col("has_c2pa") | F.col("has_ai_metadata")
    if score is not None:
        out = out | F.coalesce(reaches_gate(score), F.lit(False))
    if detectors is not None:
        out = out | F.coalesce(F.exists(detectors, lambda d: d["available"] & d["is_watermarked"]), F.lit(False))
    return out


def findings_of(items: DataFrame) -> DataFrame:
    """A row for each finding with its confidence; of arrays of two lengths the shorter counts."""
    n = F.least(F.size("findings"), F.size("confidence"))
    zipped = F.slice(F.arrays_zip("findings", "confidence"), 1, n)
    return items.where(n > 0).select("path", "kind", "has_c2pa", F.posexplode(zipped).alias("ord", "_z")).select("path", "kind", "has_c2pa", "ord", F.col("_z.findings").alias("finding"), F.col("_z.confidence").alias("confidence"))


def summary(items: DataFrame, by: str | None = None) -> DataFrame:
    """Totals of the items, one row or one for each value of ``by``; all four confidence levels are there."""
    level = lambda x: F.coalesce(F.sum(F.size(F.filter("confidence", lambda c: c == x))), F.lit(0)).alias(x)
    yes = lambda c, name: F.count_if(c).alias(name)
    groups = items.groupBy(by) if by else items.groupBy()
    return groups.agg(F.count("*").alias("total"), yes(F.col("has_c2pa"), "with_c2pa"), yes(F.col("has_ai_metadata"), "with_ai_metadata"), yes(F.col("suspicious_total") > 0, "with_suspicious_text"), yes(is_actionable(), "actionable_files"), *[level(x) for x in LEVELS])


def by_kind(items: DataFrame) -> DataFrame:
    return items.groupBy("kind").count().withColumnRenamed("count", "n")


def findings_by_confidence(items: DataFrame) -> DataFrame:
    """Findings of each level, zero where there are none."""
    spark = items.sparkSession
    levels = spark.createDataFrame([(x,) for x in LEVELS], "confidence string")
    counts = findings_of(items).groupBy("confidence").count()
    return levels.join(counts, "confidence", "left").select("confidence", F.coalesce("count", F.lit(0)).alias("n"))


def run_status(items: DataFrame, failures: DataFrame) -> DataFrame:
    """3 where any scan failed, else 1 where any item is actionable, else 0."""
    failed = failures.agg(F.count("*").alias("failed"))
    acting = items.agg(F.count_if(is_actionable()).alias("actionable"))
    return failed.crossJoin(acting).select("failed", "actionable", F.when(F.col("failed") > 0, 3).when(F.col("actionable") > 0, 1).otherwise(0).alias("status"))


def sarif_results(items: DataFrame) -> DataFrame:
    rows = findings_of(items).withColumn("_r", sarif_rule(F.col("finding"), F.col("has_c2pa"), F.col("confidence")))
    return rows.select("path", "ord", "finding", "_r.rule_id", "_r.level")


def sarif(items: DataFrame, tool: str = "glyphsift") -> DataFrame:
    """One row: a SARIF 2.1.0 document. It is made in one task: write sarif_results() where findings are many."""
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("finding").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"))
    rows = sarif_results(items).groupBy().agg(F.array_sort(F.collect_list(F.struct("path", "ord", result.alias("result")))).alias("_all"))
    rules = F.array(*[F.struct(F.lit(r).alias("id")) for r in ("C2PA", "METADATA", "STYLES-HIGH-PROBABILITY", "UNICODE-LAYER-A")])
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.transform("_all", lambda x: x["result"]).alias("results"))
    return rows.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def human_report(items: DataFrame) -> DataFrame:
    """One line for each finding, in order of paths."""
    return findings_of(items).orderBy("path", "ord").select(F.format_string("%s: [%s] %s", "path", "confidence", "finding").alias("value"))
