"""Confidence of a finding from its wording, first match first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("probable", "confirmed", "likely_false_positive", "informational")
CONFIRMED = r"c2pa-related manifest|c2patool reports|digital_?source_?type|jpeg app11 segment|png chunk (?:c2|cabx|jumb|jumd)|softwareagent|trainedalgorithmicmedia"
INFORMATIONAL = r"^info:|bad segment length|cms generator|customxml parts|format not|not a valid|not fully inspected|svg <metadata> present|svg decode note|truncated chunk|unsupported|xmp packet present"
PROBABLE = r"ai:|attr:|exif|frontmatter|interesting|jpeg app|json-ld|layer-a|marker:|meta:|pdf-structured|png |xmp"


def confidence(finding: Column) -> Column:
    f = F.lower(finding)
    return F.when(f.rlike(CONFIRMED), "confirmed").when(f.rlike(INFORMATIONAL), "informational").when(f.contains("byte-scan"), "likely_false_positive").when(f.rlike(PROBABLE), "probable").when(f.isNotNull(), "informational")


def sarif_rule(finding: Column, has_c2pa: Column, level: Column) -> Column:
    """(rule, level) of a finding in a SARIF report."""
    f = F.lower(finding)
    rule = lambda name, lv: F.struct(F.lit(name).alias("rule_id"), lv.alias("level"))
    sure = level.isin("confirmed", "probable")
    return (
        F.when(f.rlike("c2pa|jumbf") | has_c2pa, rule("C2PA", F.lit("error")))
        .when(f.contains("layer-a"), rule("UNICODE-LAYER-A", F.when(sure, "warning").otherwise("note")))
        .when(f.contains("stylometry"), rule("STYLES-HIGH-PROBABILITY", F.lit("note")))
        .otherwise(rule("METADATA", F.when(level == "confirmed", "error").when(level == "informational", "note").otherwise("warning")))
    )
