"""Stylometric score: sentence-length burstiness, moving type-token ratio, phrase density, composite and tier."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import phrases

MIN_WORDS, FULL_WORDS, WINDOW, GATE = 30, 100, 50, 0.65
_WORD = re.compile(r"\b[\w'-]+\b")
_ODD_BREAK = re.compile("\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_FENCE = re.compile(r"(?m)^[ \t]*```[^\n]*$")
_END = re.compile("([.!?])[ \t\n\x0b\f\r]+")


def moving_ttr(words: list[str], window: int = WINDOW) -> float:
    """Mean share of distinct words over all windows, in one pass.

    A word adds one distinct word to each window that holds it but not its place before.
    """
    n = len(words)
    if n <= window:
        return len(set(words)) / n if n else 0.0
    last: dict[str, int] = {}
    before = np.empty(n, dtype=np.int64)
    for i, w in enumerate(words):
        before[i] = last.get(w, -1)
        last[w] = i
    at = np.arange(n)
    first = np.maximum(np.maximum(before + 1, at - window + 1), 0)
    return int(np.maximum(np.minimum(at, n - window) - first + 1, 0).sum()) / (window * (n - window + 1))


@F.pandas_udf(DoubleType())
def mattr(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else moving_ttr([w.lower() for w in _WORD.findall(t)]) for t in texts], dtype="float64")


def sentence_lengths(t: str) -> tuple[int, list[int]]:
    """How many sentences a text has outside fences, and the words of each that has any: text.sentences() in Python."""
    if "```" in t or _ODD_BREAK.search(t):
        parts = _FENCE.sub("\x02", _ODD_BREAK.sub("\n", t)).split("\x02")
        t = "\n".join(parts[::2])
    found = [s for x in _END.sub("\\1\x01", t).replace("\n", "\x01").split("\x01") if (s := x.strip(" \t\n\x0b\f\r"))]
    lengths = [len(_WORD.findall(s)) for s in found]
    return len(found), [n for n in lengths if n]


def mean_and_cv(lengths: list[int]) -> tuple[float, float | None]:
    """Mean and coefficient of variation (sample deviation); the latter is None below two numbers."""
    n, total = len(lengths), sum(lengths)
    if n < 2:
        return total / max(n, 1), None
    mean = total / n
    return mean, (max(sum(x * x for x in lengths) - total * mean, 0.0) / (n - 1)) ** 0.5 / mean


MEASURES = StructType([StructField(n, IntegerType()) for n in ("word_count", "sentence_count", "phrase_tenths")] + [StructField(n, DoubleType()) for n in ("mean_words", "cv", "mattr")])
_PHRASES = [(literals.split(" "), round(w * 10), re.compile(p, re.I | re.A)) for _, w, literals, p in phrases.PHRASES]


def phrase_tenths(t: str) -> int:
    """phrases.weight() in Python; a text without a phrase's literals is spared its pattern."""
    low = t.lower()
    return sum(w * sum(1 for _ in p.finditer(t)) for literals, w, p in _PHRASES if any(x in low for x in literals))


@F.pandas_udf(MEASURES)
def text_measures(texts: pd.Series) -> pd.DataFrame:
    """Words, sentences, weight of phrases, words a sentence, their variation and the moving type-token ratio, in one go.

    One function, as what follows from them names them many times over: expressions of the text would be computed anew.
    """
    out = []
    for t in texts:
        if t is None:
            out.append((None,) * 6)
            continue
        words = [w.lower() for w in _WORD.findall(t)]
        n, lengths = sentence_lengths(t)
        out.append((len(words), n, phrase_tenths(t), *mean_and_cv(lengths), moving_ttr(words)))
    return pd.DataFrame(out, columns=MEASURES.names).astype({"word_count": "Int32", "sentence_count": "Int32", "phrase_tenths": "Int32", "mean_words": "float64", "cv": "float64", "mattr": "float64"})


def steps(x: Column, cuts: list[tuple[float, float]], rest: float, below: bool) -> Column:
    """The value of the first cut that x is below (or at least), or the rest."""
    out = None
    for cut, value in cuts:
        test = x < cut if below else x >= cut
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(rest)


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with word_count, sentence_count, burstiness_cv, lexical_diversity, phrase_weight and ai_ngram_density."""
    t, m = F.col(text_col), free_name(df, "_m")
    out = df.withColumn(m, text_measures(t))
    real = lambda c: F.nanvl(F.col(f"{m}.{c}"), F.lit(None))
    out = out.select(*df.columns, F.col(f"{m}.word_count").alias("word_count"), F.col(f"{m}.sentence_count").alias("sentence_count"), real("cv").alias(m), real("mattr").alias("lexical_diversity"), (F.col(f"{m}.phrase_tenths") / 10).alias("phrase_weight"))
    short = F.col("word_count") < MIN_WORDS
    density = F.when(short, F.lit(0.0)).when(F.col("word_count").isNotNull(), F.col("phrase_weight") / (F.col("word_count") / 100))
    return out.withColumn("burstiness_cv", F.when(~short, F.col(m))).withColumn("ai_ngram_density", density).drop(m)


def free_name(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def stylometry(df: DataFrame, text_col: str = "text") -> DataFrame:
    """measures() with score, confidence_level and status. A null text has nulls throughout."""
    out = measures(df, text_col)
    cv, n, d = F.col("burstiness_cv"), F.col("ai_ngram_density"), F.col("lexical_diversity")
    burst = steps(cv, [(0.25, 0.95), (0.35, 0.80), (0.45, 0.50), (0.55, 0.25)], 0.05, True)
    gram = steps(n, [(2.0, 1.0), (1.0, 0.75), (0.5, 0.45)], 0.0, False)
    gram = F.when((n > 0) & (n < 0.5), 0.20).otherwise(gram)
    variety = F.when(d.between(0.68, 0.76), 0.4).otherwise(0.1)
    raw = F.when(cv.isNull(), (gram * 0.45 + variety * 0.10) / 0.55).otherwise(burst * 0.45 + gram * 0.45 + variety * 0.10)
    words = F.col("word_count")
    damp = F.when(words < FULL_WORDS, 0.4 + 0.6 * ((words - MIN_WORDS) / (FULL_WORDS - MIN_WORDS))).otherwise(F.lit(1.0))
    score = F.when(words < MIN_WORDS, F.lit(0.0)).when(words.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * damp)))
    out = out.withColumn("score", score).withColumn("confidence_level", tier(F.col("score")))
    return out.withColumn("status", F.when(words < MIN_WORDS, "insufficient_length").when(words.isNotNull(), "ok"))


def tier(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.5, "MEDIUM").when(score >= 0.25, "LOW").when(score.isNotNull(), "CLEAN")


def findings(df: DataFrame, text_col: str = "text") -> Column:
    """Finding strings of a row of stylometry(): phrases, an even cadence, a high density."""
    ok = F.col("status") == "ok"
    said = F.transform(phrases.matches(F.col(text_col)), lambda m: F.when(ok, F.format_string("AI cadence phrase '%s' (%dx)", m["phrase"], m["count"])).otherwise(F.format_string("AI phrase marker '%s' found (%dx)", m["phrase"], m["count"])))
    even = F.when(ok & (F.col("burstiness_cv") < 0.35) & (F.col("sentence_count") >= 3), F.format_string("Unnaturally uniform sentence cadence (CV=%.2f < 0.35)", "burstiness_cv"))
    dense = F.when(ok & (F.col("ai_ngram_density") >= 1), F.format_string("Elevated AI formulaic transition density (%.2f/100w)", "ai_ngram_density"))
    return F.array_compact(F.concat(said, F.array(even, dense)))
