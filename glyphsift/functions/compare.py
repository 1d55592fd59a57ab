"""Versions of a text against each other: lexical divergence, preserved numbers and links, candidate choice."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .text import list_overlap

TOKEN = "[a-z0-9]+"


def _tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0))


def _pairs(words: Column) -> Column:
    return F.array_distinct(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: an expression named inside a lambda is computed for each use."""
    return F.transform(F.array(value), use)[0]


def bigrams(t: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return _let(_tokens(t), lambda w: F.filter(_pairs(w), lambda x: x.contains(" ")))


_TOKEN = re.compile(TOKEN)


def _sides(t: str) -> tuple[int, set[tuple[str, str]]]:
    """How many words a text has, and its distinct pairs of neighbouring ones."""
    words = _TOKEN.findall(t.lower())
    return len(words), set(zip(words, words[1:]))


def divergence(a: tuple[int, set], b: tuple[int, set]) -> float:
    if not a[0] or not b[0]:
        return 1.0 if a[0] or b[0] else 0.0
    both = len(a[1] & b[1])
    either = len(a[1]) + len(b[1]) - both
    return 1 - both / either if either else 0.0


@F.pandas_udf(DoubleType())
def _divergences(a: pd.Series, b: pd.Series) -> pd.Series:
    out, last, own = [], None, None
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if x != last:  # candidates of one text come one after the other
            last, own = x, _sides(x)
        out.append(divergence(own, own if x == y else _sides(y)))
    return pd.Series(out, dtype="Float64")


def lexical_divergence(a: Column, b: Column) -> Column:
    """1 - Jaccard of word bigrams; 0 where neither text has words or bigrams, 1 where one alone has words.

    Words are runs of ASCII letters and digits, as the reference counts them. The sets are made in Python: arrays and
    lambdas of strings take ten times as long.
    """
    return _divergences(a, b)


def numbers_preserved(a: Column, b: Column) -> Column:
    found = lambda t: F.regexp_extract_all(t, F.lit(r"[0-9]+"), F.lit(0))
    return list_overlap(found(a), found(b))


def urls_preserved(a: Column, b: Column) -> Column:
    found = lambda t: F.regexp_extract_all(t, F.lit(r"https?://[^\s]+"), F.lit(0))
    return list_overlap(found(a), found(b))


def token_estimate(t: Column, per_token: float = 4.0) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(t) / per_token).cast("int"))


def quality(a: Column, b: Column) -> Column:
    return F.struct(
        lexical_divergence(a, b).alias("lexical_divergence"),
        (F.length(b) / F.greatest(F.length(a), F.lit(1))).alias("length_ratio"),
        numbers_preserved(a, b).alias("numbers_preserved"),
        urls_preserved(a, b).alias("urls_preserved"),
        token_estimate(a).alias("tokens_in"),
        token_estimate(b).alias("tokens_out"),
    )


def selection_score(a: Column, b: Column) -> Column:
    """Divergence, less 0.15 for a candidate over twice or under half as long."""
    ratio = F.length(b) / F.greatest(F.length(a), F.lit(1))
    return lexical_divergence(a, b) - F.when((ratio > 2) | (ratio < 0.5), 0.15).otherwise(0.0)


def best_candidate(df: DataFrame, key: str, index: str, original: str, candidate: str) -> DataFrame:
    """The candidate of each key with the best selection score; of equals, the first."""
    scored = df.withColumn("selection_score", selection_score(F.col(original), F.col(candidate)))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("selection_score"), F.col(index)))
    return scored.withColumn("_n", best).where("_n = 1").drop("_n")


def best_effort(df: DataFrame, key: str, index: str) -> DataFrame:
    """The attempt (passed, detector_score, divergence) of each key to return: one that passed, the last of them; else the
    lowest detector score, else the largest divergence; of equals the first."""
    order = [F.desc(F.coalesce(F.col("passed"), F.lit(False))), F.when(F.col("passed"), -F.col(index)), F.asc_nulls_last("detector_score"), F.desc_nulls_last("divergence"), F.col(index)]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
