"""Quality rules: a short-circuit cascade ordered by rejection per cost, estimated on a sample."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from statistics import median

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table

#: Rows of the sample that orders the rules, how often a timed run reads them, and timed runs of a rule after a warm-up.
#: They change which rule runs first, never the outcome.
SAMPLE_ROWS, COPIES, RUNS = 1000, 4, 3
SPACE = "[ \\t\\n\\r\\f]+"
SYMBOLS = "#$%&*|!<>{}~^=\\"


def _words(t: Column) -> Column:
    return F.filter(F.split(t, SPACE), lambda w: w != "")


def _letters(t: Column) -> Column:
    return F.length(t) - F.length(F.regexp_replace(t, "\\p{L}+", ""))


def _without(t: Column, chars: str) -> Column:
    return F.length(t) - F.length(F.translate(t, chars, ""))


def _adjacent(w: Column) -> Column:
    same = F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: a == b), lambda x: x)
    return (F.size(w) >= 10) & (F.size(same) * 10 > F.size(w) * 3)


def _repeated_lines(lines: Column) -> Column:
    return (F.size(lines) >= 4) & (F.size(F.array_distinct(lines)) * 3 < F.size(lines))


#: Each rule, of a text, its words and its number of letters, is true for a text that it rejects, and never null for a
#: text that isn't null.
RULES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "blank": lambda t, w, n: F.size(w) == 0,
    "symbols": lambda t, w, n: _without(t, SYMBOLS) * 4 > F.size(w),
    "upper_case": lambda t, w, n: (F.size(w) >= 10) & (F.regexp_count(t, F.lit("\\p{Lu}")) * 5 > n * 3),
    "repeated_words": lambda t, w, n: _adjacent(w),
    "repeated_lines": lambda t, w, n: _repeated_lines(F.split(t, "\n")),
    "few_letters": lambda t, w, n: (F.length(t) >= 20) & (n * 5 < F.length(t)),
}


def rules(t: Column) -> dict[str, Column]:
    return {name: rule(t, _words(t), _letters(t)) for name, rule in RULES.items()}


def cascade_order(costs: dict[str, float], hits: dict[str, np.ndarray]) -> list[tuple[str, float, float]]:
    """(rule, cost, share of the texts left that it rejects): at each place the rule with the most rejection per cost among
    the texts that the rules before it let pass; of equals the first by name."""
    left, out, alive = dict(costs), [], np.ones(len(next(iter(hits.values()))), dtype=bool)
    while left:
        share = {name: (np.count_nonzero(hits[name] & alive) + 0.5) / (alive.sum() + 1) for name in left}
        best = min(left, key=lambda name: (-share[name] / left[name], name))
        out.append((best, left.pop(best), share[best]))
        alive &= ~hits[best]
    return out


def plan_cascade(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """cascade_order() on a seeded sample.

    A rule costs what its run takes longer than one that reads the same texts and counts their characters; both are
    warmed up, and the median of RUNS runs counts, rounded to a power of two, so that noise seldom changes the order.
    """
    texts = df.select(F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull())
    # Collected, a limit reads only as many files as it needs; cached, it would read them all.
    rows = texts.where(F.pmod(F.xxhash64("t"), F.lit(8)) == 0).limit(sample_rows).collect()
    spark, t = df.sparkSession, F.col("t")
    sample = spark.createDataFrame(rows, "t string").coalesce(1).cache()

    def took(condition: Column) -> float:
        times, run = [], sample.crossJoin(spark.range(0, COPIES, 1, 1)).agg(F.count_if(condition))
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            run.collect()
            times.append(time.perf_counter() - began)
        return median(times[1:])

    try:
        n, found = max(sample.count(), 1), rules(t)
        flags = sample.select(*[F.coalesce(c, F.lit(True)).alias(name) for name, c in found.items()]).toPandas()
        base = took(F.length(t) < 0)
        cost = {name: max(took(c) - base, base / 20, 1e-4) / (n * COPIES) for name, c in found.items()}
    finally:
        sample.unpersist()
    return cascade_order({name: 2.0 ** round(math.log2(x)) for name, x in cost.items()}, {name: flags[name].to_numpy(dtype=bool) for name in found})


def rejected(t: Column, order: list[str]) -> Column:
    """True where some rule rejects t, or t is null. A later rule runs only where all before it passed.

    Words and letters are found once: a lambda's argument is computed once, an expression for each rule that names it.
    """
    let = lambda value, use: F.transform(F.array(value), use)[0]

    def any_rule(w: Column, n: Column) -> Column:
        out = F.lit(False)
        for name in order:
            out = out | RULES[name](t, w, n)
        return out

    return t.isNull() | let(_words(t), lambda w: let(_letters(t), lambda n: any_rule(w, n)))


def quality_rules(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of df whose text passes every rule, with all their columns as they are.

    A null, empty or blank text is rejected. Texts count whole, however long. Repeated rows fare alike; null ids and
    other columns, whatever their names, play no part. An empty table stays empty. The outcome doesn't depend on the
    order that the sample suggests.
    """
    order = [name for name, _, _ in plan_cascade(df, text_col, sample_rows)]
    return df.where(~rejected(F.col(text_col).cast("string"), order))


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row (id, kept) for each row of df, under the rules of quality_rules()."""
    order = [name for name, _, _ in plan_cascade(df, text_col, sample_rows)]
    return df.select(F.col(id_col), (~rejected(F.col(text_col).cast("string"), order)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))


REJECTED_SQL = r"""
  text is null or length(translate(text, ' ' || chr(9) || chr(10) || chr(12) || chr(13), '')) = 0
  or (length(text) - length(translate(text, '#$%&*|!<>{}~^=\', ''))) * 4 > len(ws)
  or (len(ws) >= 10 and len(regexp_extract_all(text, '\p{Lu}')) * 5 > len(regexp_extract_all(text, '\p{L}')) * 3)
  or (len(ws) >= 10 and len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) * 10 > len(ws) * 3)
  or (len(ls) >= 4 and len(list_distinct(ls)) * 3 < len(ls))
  or (length(text) >= 20 and len(regexp_extract_all(text, '\p{L}')) * 5 < length(text))
"""
ORACLE = rf"""
with d as (
  select doc_id, text, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda w: w <> '') ws,
         string_split(text, chr(10)) ls
  from documents
)
select doc_id, not ({REJECTED_SQL}) kept from d
"""
