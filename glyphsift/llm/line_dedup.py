"""Line dedup: later copies of repeated line runs go, found by a suffix array over line ids by prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import table
from .common import discard, free_name, sized_broadcast, stored, whole_id

#: A run of lines is deleted as a copy if it has at least so many words.
MIN_WORDS = 50
SPACES = " \t\r\f"
ORDER = ["_d", "_t", "_p"]


def _blank(x: Column) -> Column:
    return F.length(F.translate(x, SPACES, "")) == 0


def _reach(min_words: int):
    """Adds to each document's lines how many lines reach min_words from it onwards (_f) and up to it (_b), or 0."""

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out_f, out_b = [], []
            for words in pdf["_w"]:
                words = words.tolist()
                n, lo, total = len(words), 0, 0
                forward, backward = [0] * n, [0] * n
                for hi in range(n):
                    total += words[hi]
                    while total - words[lo] >= min_words:
                        forward[lo] = forward[lo] or hi - lo + 1
                        total -= words[lo]
                        lo += 1
                    if total >= min_words:
                        forward[lo] = forward[lo] or hi - lo + 1
                        backward[hi] = hi - lo + 1
                out_f.append(forward)
                out_b.append(backward)
            yield pdf.assign(_f=out_f, _b=out_b)[["_d", "_t", "_h", "_g", "_f", "_b"]]

    return reach


def copied_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_d, _t, _p): the lines with words, by number, that belong to a later copy of a repeated run of docs (_d, _t, _x).

    The suffix array is sorted by prefix doubling as far as min_words lines reach: in round k, each suffix has its rank
    in the order of all suffixes by their first 2**k lines, lines ordered by their ids. Equal ranks are the
    longest-common-prefix intervals of that depth. A suffix that begins with a line found once, or whose rank is its own,
    takes no further part. A maximal repeated run is the union of the shortest stretches in it with min_words words: from
    each of its lines onwards and up to each of its lines; none of these has more than min_words lines, so that deeper
    ranks would change nothing. A stretch of m lines, 2**k <= m < 2**(k + 1), is named by the ranks of its first and its
    last 2**k lines; of those with one name the first stays, by document, text key and line. What many suffixes share is
    counted before it is moved, and joined back by joins that split a hot key: no task holds all places of a line.
    """
    squeezed = F.filter(F.transform(F.split("_x", "\n"), lambda x: F.trim(F.regexp_replace(x, f"[{SPACES}]+", " "))), lambda x: x != "")
    words = F.transform("_a", lambda x: F.length(x) - F.length(F.translate(x, " ", "")) + 1)
    held = docs.select("_d", "_t", squeezed.alias("_a")).where(F.size("_a") > 0)
    held = held.select("_d", "_t", words.alias("_w"), F.transform("_a", lambda x: F.xxhash64(x)).alias("_h"), F.transform("_a", lambda x: F.xxhash64(F.lit(1), x)).alias("_g"))
    rows = held.mapInPandas(_reach(min_words), "_d long, _t long, _h array<long>, _g array<long>, _f array<int>, _b array<int>")
    lines = stored(rows.select("_d", "_t", F.posexplode(F.arrays_zip("_h", "_g", "_f", "_b")).alias("_p", "_z")).select(*ORDER, "_z._h", "_z._g", "_z._f", "_z._b"), "lines")
    # Rows that repeat a document's id and text are the same lines.
    first = lines.join(_ranked(lines, ["_h", "_g"], "_r0"), ["_h", "_g"]).drop("_h", "_g").dropDuplicates(ORDER)
    ranks = stored(first, "suffixes")
    discard(lines)
    for level in range(max(1, int(min_words)).bit_length() - 1):
        old, ranks = ranks, _double(ranks, level)
        discard(old)
        if not ranks.where(F.col(f"_r{level + 1}") >= 0).head(1):
            break
    return _later_copies(ranks)


def _ranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """(*by, name): the rank, in the order of all rows, of each combination that more than one row has.

    Combinations are counted, sorted by ranges and numbered within these; the ranges' totals alone reach the driver.
    """
    found = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    # A fixed number of ranges isn't merged: what is numbered in one task stays a share of the whole.
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(found.repartitionByRange(ranges, *by).withColumn("_part", F.spark_partition_id()), "combinations")
    totals = sorted(found.groupBy("_part").agg(F.sum("_n").alias("n")).collect())
    starts, total = [], 0
    for part, n in totals:
        starts.append((part, total))
        total += n
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _start long"))
    own = F.sum("_n").over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_own", F.coalesce(own, F.lit(0))).join(start, "_part").select(*by, (F.col("_start") + F.col("_own")).alias(name))


def _double(ranks: DataFrame, level: int) -> DataFrame:
    """Adds _r{level + 1}: the rank by the first 2**(level + 1) lines.

    -1 stands for a rank of one suffix alone, as where fewer lines than that follow that are found elsewhere too.
    """
    old, new = f"_r{level}", f"_r{level + 1}"
    after = Window.partitionBy("_d", "_t").orderBy("_p").rangeBetween(1 << level, 1 << level)
    paired = stored(ranks.withColumn("_o2", F.coalesce(F.first(old).over(after), F.lit(-1))), "pairs")
    active = (F.col(old) >= 0) & (F.col("_o2") >= 0)
    named = _ranked(paired.where(active), [old, "_o2"], new)
    out = paired.join(named, [old, "_o2"], "left").drop("_o2").fillna({new: -1})
    out = stored(out, "suffixes")
    discard(paired)
    return out


def _later_copies(ranks: DataFrame) -> DataFrame:
    levels = sorted(int(c[2:]) for c in ranks.columns if c.startswith("_r"))
    span = lambda start, lines: F.struct(start.alias("s"), lines.alias("m"))
    spans = ranks.select("_d", "_t", F.explode(F.array(span(F.col("_p"), F.col("_f")), span(F.col("_p") - F.col("_b") + 1, F.col("_b")))).alias("_v"))
    spans = spans.where((F.col("_v.m") > 0) & (F.col("_v.m") < 1 << (levels[-1] + 1))).select("_d", "_t", F.col("_v.s").alias("_p"), F.col("_v.m").alias("_m")).distinct()
    k = F.lit(0)
    for lv in levels[1:]:
        k = F.when(F.col("_m") >= 1 << lv, lv).otherwise(k)
    power = F.lit(1)
    for lv in levels[1:]:
        power = F.when(F.col("_m") >= 1 << lv, 1 << lv).otherwise(power)
    rank = F.array(*[F.col(f"_r{lv}") for lv in levels])
    spans = spans.withColumn("_k", k).withColumn("_q", F.col("_p") + F.col("_m") - power)
    heads = spans.join(ranks.select(*ORDER, rank.alias("_a")), ORDER).withColumn("_o", F.col("_a")[F.col("_k")]).where(F.col("_o") >= 0).drop("_a")
    ends = ranks.select("_d", "_t", F.col("_p").alias("_q"), rank.alias("_a"))
    named = heads.join(ends, ["_d", "_t", "_q"]).withColumn("_o2", F.col("_a")[F.col("_k")]).where(F.col("_o2") >= 0)
    named = stored(named.select(*ORDER, "_m", "_o", "_o2"), "stretches")
    name, place = ["_m", "_o", "_o2"], F.struct(*ORDER)
    first = named.groupBy(*name).agg(F.min(place).alias("_l"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    later = named.join(first.drop("_n"), name).where(place != F.col("_l"))
    return later.select("_d", "_t", F.explode(F.sequence("_p", F.col("_p") + F.col("_m") - 1)).alias("_p")).distinct()


def _without(text: Column, gone: Column) -> Column:
    """text without the lines whose numbers, counted among lines with words, are in gone."""
    # A lambda's argument is computed once; an expression named inside a lambda is computed for each element.
    let = lambda value, use: F.transform(F.array(value), use)[0]
    worded = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(~_blank(x), i)), lambda i: i.isNotNull())
    stay = lambda lines, w: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(gone, lambda g: F.get(w, g)))
    rest = lambda lines, at: F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n")
    return let(F.split(text, "\n"), lambda lines: let(worded(lines), lambda w: let(stay(lines, w), lambda at: rest(lines, at))))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, drop_emptied: bool = False) -> DataFrame:
    """df without later copies of repeated line runs of at least min_words words; all columns stay, the text shortened.

    Lines part at line feeds and compare with white space squeezed; lines without words are passed over and stay. Of
    equal runs the first stays, by document id (nulls last), text key and line; overlapping copies and copies within a
    document count. Rows that repeat id and text are one document and fare alike. A null text stays null, a text without
    repeated runs stays to the letter. With drop_emptied, a document that lost its lines and has no words left goes;
    else it stays. n_chars, if there as a whole number, is set anew for a changed text. An empty table stays empty. A
    run shorter than min_words, such as a licence line, stays wherever it is. Ids must be whole numbers.
    """
    d, t, p, c = (free_name(df, x) for x in ("_d", "_t", "_p", "_c"))
    text = F.col(text_col).cast("string")
    number, key = whole_id(df, id_col), F.xxhash64(text)
    docs = df.select(number.alias("_d"), key.alias("_t"), text.alias("_x")).where(F.col("_x").isNotNull())
    gone = stored(copied_lines(docs, min_words).groupBy("_d", "_t").agg(F.collect_set("_p").alias("_p")), "copied-lines")
    rows, held = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("_p")), F.lit(0))).first()
    side = sized_broadcast(gone.select(F.col("_d").alias(d), F.col("_t").alias(t), F.col("_p").alias(p)), rows, 64 + 4 * held // max(rows, 1))
    keyed = df.withColumn(free_name(df, "_n"), number).withColumn(c, key)
    joined = keyed.join(side, (F.col(free_name(df, "_n")) == F.col(d)) & (F.col(c) == F.col(t)), "left")
    changed = F.col(p).isNotNull()
    shorter = joined.withColumn(text_col, F.when(changed, _without(text, F.col(p))).otherwise(F.col(text_col)))
    if drop_emptied:
        shorter = shorter.where(~(changed & _blank(F.translate(F.col(text_col), "\n", ""))))
    kind = dict(df.dtypes).get("n_chars")
    if kind in ("int", "bigint"):
        shorter = shorter.withColumn("n_chars", F.when(changed, F.length(text_col).cast(kind)).otherwise(F.col("n_chars")))
    return shorter.select(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same by definition, without a suffix array: all shortest stretches of 50 words by their text, the first stays.
ORACLE = rf"""
with raw as (
  select doc_id, text, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i
  from documents
), worded as (
  select doc_id, i, line, trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g')) l from raw
), lines as (
  select doc_id, i, l, len(string_split(l, ' ')) w, row_number() over (partition by doc_id order by i) p from worded where l <> ''
), sums as (
  select *, sum(w) over (partition by doc_id order by p) c from lines
), spans as (
  select a.doc_id, a.p s, min(b.p) e from sums a join sums b on a.doc_id = b.doc_id and b.p between a.p and a.p + {MIN_WORDS} and b.c - a.c + a.w >= {MIN_WORDS} group by all
  union
  select b.doc_id, max(a.p) s, b.p e from sums a join sums b on a.doc_id = b.doc_id and b.p between a.p and a.p + {MIN_WORDS} and b.c - a.c + a.w >= {MIN_WORDS} group by b.doc_id, b.p
), named as (
  select s.doc_id, s.s, s.e, string_agg(l, chr(10) order by p) body from spans s join lines l on l.doc_id = s.doc_id and l.p between s.s and s.e group by all
), later as (
  select *, row_number() over (partition by body order by doc_id, s) n from named
), gone as (
  select distinct l.doc_id, l.i from later x join lines l on x.doc_id = l.doc_id and l.p between x.s and x.e where n > 1
)
select doc_id, case when text is null then null else coalesce((
  select string_agg(r.line, chr(10) order by r.i) from raw r anti join gone g on r.doc_id = g.doc_id and r.i = g.i where r.doc_id = d.doc_id
), '') end as text from documents d
"""
