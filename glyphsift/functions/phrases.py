"""Weighted phrases of formulaic prose: (label, weight, pattern), case ignored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (label, weight, literals of which a text with the phrase has one, in lower case, pattern). The labels, weights and
#: wordings are the constants of the reference's phrase list.
PHRASES: tuple[tuple[str, float, str, str], ...] = (
    ("I hope this helps", 1.2, "helps", r"\bi\s+hope\s+this\s+helps\b"),
    ("a myriad of", 0.8, "myriad", r"\ba\s+myriad\s+of\b"),
    ("a testament to", 1.1, "testament", r"\ba\s+testament\s+to\b"),
    ("as an AI", 1.5, "", r"\bas\s+an\s+ai\b"),
    ("delve into", 1.2, "delve", r"\bdelve[sd]?\s+into\b"),
    ("fosters a sense/culture", 0.9, "foster", r"\bfoster(?:ed|ing|s)?\s+a\s+(?:culture|deeper\s+understanding|sense)\b"),
    ("furthermore,", 0.6, "furthermore", r"\bfurthermore\b[\s,]"),
    ("harnessing the power of", 1.0, "harness", r"\bharness(?:ed|es|ing)?\s+the\s+power\s+of\b"),
    ("holistic approach/perspective", 0.9, "holistic", r"\bholistic\s+(?:approach|perspective|view)\b"),
    ("in conclusion", 0.8, "conclusion", r"\bin\s+conclusion\b[\s,]"),
    ("in today's fast-paced world/landscape", 1.4, "environment era landscape world", r"\bin\s+(?:the|today'?s)\s+(?:(?:digital|ever-evolving|fast-paced|rapidly\s+changing)\s+)*(?:environment|era|landscape|world)\b"),
    ("it is important/crucial to note", 0.9, "consider highlight note remember", r"\bit\s+is\s+(?:crucial|essential|important|worth\s+noting)\s+to\s+(?:consider|highlight|note|remember)\b"),
    ("moreover,", 0.6, "moreover", r"\bmoreover\b[\s,]"),
    ("multifaceted nature/approach", 1.0, "multifaceted", r"\bmultifaceted\s+(?:approach|landscape|nature)\b"),
    ("navigating the complexities/nuances", 1.0, "navigat", r"\bnavigat(?:ed|es|e|ing)\s+the\s+(?:complexities|intricacies|nuances)\b"),
    ("not only ... but also serves to", 0.8, "highlights serves acts", r"\bnot\s+only\b[\s\w,]+\bbut\s+(?:also\s+)?(?:acts\s+as|highlights|serves\s+to)\b"),
    ("paradigm shift", 0.9, "paradigm", r"\bparadigm\s+shift\b"),
    ("plays a pivotal/crucial role", 1.0, "role", r"\bplays?\s+a\s+(?:crucial|key|pivotal|vital)\s+role\b"),
    ("rich tapestry", 1.3, "tapestry", r"\brich\s+tapestry(?:\s+of)?\b"),
    ("seamlessly integrates/blends", 1.0, "seamlessly", r"\bseamlessly\s+(?:blends?|combine[ds]?|integrated|integrates?)\b"),
    ("serves as a beacon/catalyst/cornerstone", 1.1, "beacon catalyst cornerstone reminder", r"\bserve[ds]?\s+as\s+a\s+(?:beacon|catalyst|cornerstone|reminder)\b"),
    ("to summarize", 0.8, "summarize", r"\bto\s+summarize\b[\s,]"),
    ("ultimately,", 0.6, "ultimately", r"\bultimately\b[\s,]"),
    ("underscores the importance/need", 0.9, "underscore", r"\bunderscore[ds]?\s+the\s+(?:importance|need|significance)\b"),
)


def _counts(t: Column) -> list[tuple[str, float, str, Column]]:
    """(label, weight, pattern, how often); a text without a phrase's literals is spared its pattern."""
    out, low = [], F.lower(t)
    for label, w, literals, p in PHRASES:
        count = F.regexp_count(t, F.lit("(?i)" + p))
        if literals:
            there = F.lit(False)
            for x in literals.split(" "):
                there = there | low.contains(x)
            count = F.when(there, count).when(t.isNotNull(), 0)
        out.append((label, w, p, count))
    return out


def matches(t: Column, samples: int = 3) -> Column:
    """Array of (phrase, count, weight, samples) of the phrases in t."""
    found = [F.when(n > 0, F.struct(F.lit(label).alias("phrase"), n.alias("count"), F.lit(w).alias("weight"), F.slice(F.regexp_extract_all(t, F.lit("(?i)" + p), F.lit(0)), 1, samples).alias("samples"))) for label, w, p, n in _counts(t)]
    return F.array_compact(F.array(*found))


def weight(t: Column) -> Column:
    """Sum over phrases of count times weight, in tenths, so that sums are exact; null for null."""
    total = F.lit(0)
    for _, w, _, n in _counts(t):
        total = total + n * round(w * 10)
    return total
