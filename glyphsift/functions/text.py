"""Words and sentences as column expressions that Java and RE2 regular expressions read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'\-]*[\p{L}\p{N}_])?"
LINE_BREAKS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
FENCE_LINE = r"(?m)^[ \t]*```[^\n]*$"


def word_list(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), F.lower)


def word_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(WORD))


def unfenced(t: Column) -> Column:
    """Text outside fenced code blocks: every other part between fence lines; an open fence hides the rest."""
    marked = F.regexp_replace(F.regexp_replace(t, LINE_BREAKS, "\n"), FENCE_LINE, "\x02")
    return F.array_join(F.filter(F.split(marked, "\x02"), lambda _, i: i % 2 == 0), "\n")


def sentences(t: Column) -> Column:
    ends = F.regexp_replace(unfenced(t), r"([.!?])\s+", "$1\x01")
    parts = F.split(F.regexp_replace(ends, r"\n+", "\x01"), "\x01")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentence_lengths(sents: Column) -> Column:
    """Words of each sentence that has any."""
    return F.filter(F.transform(sents, word_count), lambda n: n > 0)


def mean_and_cv(lengths: Column) -> tuple[Column, Column]:
    """Mean and coefficient of variation (sample deviation); the latter is null below two numbers."""
    n = F.size(lengths)
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    mean = F.when(n > 0, total / n).otherwise(F.lit(0.0))
    spread = F.sqrt(F.greatest((n * squares - total * total) / (n.cast("double") * (n - 1)), F.lit(0.0)))
    return mean, F.when(n >= 2, spread / mean)


def list_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct members of a that b has too; 1 where a is empty."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / n)
