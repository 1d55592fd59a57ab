"""Sharding: a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import table
from .common import stored

SHARDS, VNODES, EPSILON = 64, 128, 0.05
#: Rows of one key that a task writes at most, where a repeated key parts between shards.
CHUNK = 1 << 20


def ring(shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Positions of all virtual nodes, in order round the ring, and the shard of each."""
    at = sorted((int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:8], 16), s, v) for s in range(shards) for v in range(vnodes))
    return [p for p, _, _ in at], [s for _, s, _ in at]


def capacity(n: int, shards: int, epsilon: float) -> int:
    """ceil((1 + epsilon) * n / shards), without rounding errors."""
    return -(-(1 + Fraction(str(epsilon))) * n // shards).__int__() if n else 0


def settle(counts: dict[int, int], owners: list[int], limit: int) -> list[tuple[int, int, int, int]]:
    """Where the keys of each arc go: (arc, first rank, past-last rank, shard).

    In rounds, what is left of each arc knocks at the next virtual node clockwise. A shard takes those who knock in the
    order of their arcs, lowest ranks first, until it is full; the others go on in the next round. Equal to the same
    rounds key by key, but the work depends on the number of virtual nodes alone.
    """
    left, out = {s: limit for s in set(owners)}, []
    waiting = [(arc, 0, n, arc) for arc, n in sorted(counts.items()) if n]
    while waiting:
        over = []
        for arc, lo, hi, node in waiting:
            shard = owners[node]
            take = min(hi - lo, left[shard])
            if take:
                out.append((arc, lo, lo + take, shard))
                left[shard] -= take
            if lo + take < hi:
                over.append((arc, lo + take, hi, node))
        # Full shards are passed once the round is over: within it, who knocks where is settled by its beginning.
        waiting = []
        for arc, lo, hi, node in over:
            node = (node + 1) % len(owners)
            while left[owners[node]] == 0:
                node = (node + 1) % len(owners)
            waiting.append((arc, lo, hi, node))
    return out


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES, epsilon: float = EPSILON) -> DataFrame:
    """One row (key, shard, home_shard, moved) for each row of df; no shard has over ceil((1 + epsilon) * n / shards) rows.

    A key's home is the first virtual node clockwise of its hash; overflowing keys continue clockwise to the next shard
    with room. Within an arc, keys rank by hash, then key. A null key is a key of its own hash. Repeated keys count each
    and may part when their shard fills between them. Other columns are ignored. An empty table gives no rows.
    Only counts per arc reach the driver, at most shards * vnodes of them. The ranks of keys are found for the arcs that
    overflow alone, among distinct keys with their counts: a key that is in every row is one row there.
    """
    if shards < 1 or vnodes < 1 or epsilon < 0:
        raise ValueError("shards and vnodes must be positive, epsilon not negative")
    spark = df.sparkSession
    points, owners = ring(shards, vnodes)
    arcs = np.array(points, dtype=np.int64)
    digest = F.md5(F.concat_ws("-", F.lit("key"), F.coalesce(F.col(key).cast("string"), F.lit("\u0000null"))).cast("binary"))
    keys = df.select(F.col(key).alias("_k"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("_h"))

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(arcs, h.to_numpy(), side="left") % len(arcs)).astype(np.int32))

    keys = stored(keys.withColumn("_arc", arc_of("_h")), "ring")
    counts = {r["_arc"]: r["count"] for r in keys.groupBy("_arc").count().collect()}
    parts = settle(counts, owners, capacity(sum(counts.values()), shards, epsilon))
    whole = {a: s for a, lo, hi, s in parts if (lo, hi) == (0, counts[a])}
    home = np.array(owners, dtype=np.int32)
    table = np.full(len(owners), -1, dtype=np.int32)
    for a, s in whole.items():
        table[a] = s
    split: dict[int, tuple[list[int], list[int]]] = {}
    for a, lo, hi, s in sorted(parts):
        if a not in whole:
            split.setdefault(a, ([], []))[0].append(lo)
            split[a][1].append(s)

    @F.pandas_udf("int")
    def home_of(arc: pd.Series) -> pd.Series:
        return pd.Series(home[arc.to_numpy()])

    @F.pandas_udf("int")
    def shard_of(arc: pd.Series) -> pd.Series:
        return pd.Series(table[arc.to_numpy()])

    @F.pandas_udf("array<struct<shard:int,n:long>>")
    def shares(arc: pd.Series, start: pd.Series, count: pd.Series) -> pd.Series:
        out = []
        for a, lo, n in zip(arc.tolist(), start.tolist(), count.tolist()):
            at, own = split[a], []
            i = bisect.bisect_right(at[0], lo) - 1
            while n:
                end = at[0][i + 1] if i + 1 < len(at[0]) else lo + n
                take = min(n, end - lo)
                own.append({"shard": at[1][i], "n": take})
                lo, n, i = lo + take, n - take, i + 1
            out.append(own)
        return pd.Series(out, dtype=object)

    plain = keys.withColumn("shard", shard_of("_arc"))
    if split:
        is_split = F.col("_arc").isin(sorted(split)) if len(split) < 200 else shard_of("_arc") < 0
        plain = keys.where(~is_split).withColumn("shard", shard_of("_arc"))
        distinct = keys.where(is_split).groupBy("_arc", "_h", "_k").agg(F.count("*").alias("_n"))
        before = Window.partitionBy("_arc").orderBy("_h", "_k").rowsBetween(Window.unboundedPreceding, -1)
        cut = distinct.withColumn("_s", shares("_arc", F.coalesce(F.sum("_n").over(before), F.lit(0)), "_n"))
        cut = cut.select("_k", "_h", "_arc", F.explode("_s").alias("_s")).select("_k", "_h", "_arc", "_s.shard", "_s.n")
        # A row for each row of the table; those of a hot key are written by several tasks.
        cut = cut.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
        cut = cut.repartition("_h", "_c").withColumn("_c", F.explode(F.sequence(F.col("_c"), F.least(F.col("_c") + CHUNK, F.col("n")) - 1)))
        plain = plain.unionByName(cut.select(*plain.columns))
    return plain.withColumn("home_shard", home_of("_arc")).select(F.col("_k").alias(key), "shard", "home_shard", (F.col("shard") != F.col("home_shard")).alias("moved"))


def query(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


def homes_query(spark, sf_dir: str) -> DataFrame:
    """What SQL can check of it: each key's home, and that no shard is over its bound."""
    out = query(spark, sf_dir)
    loads = out.groupBy("shard").agg(F.count("*").alias("n"))
    limit = F.ceil(F.col("rows") * round((1 + EPSILON) * 100) / (100 * SHARDS))
    fits = loads.agg(F.max("n").alias("most"), F.sum("n").alias("rows")).select((F.col("most") <= limit).alias("within_bound"))
    return out.select("doc_id", "home_shard").crossJoin(F.broadcast(fits))


HOMES_ORACLE = f"""
with points as (
  select s, v, ('0x' || left(md5('shard-' || s || '-' || v), 8))::bigint p from range({SHARDS}) a(s), range({VNODES}) b(v)
), ring as (
  select p, arg_min(s, s * {VNODES} + v) s from points group by p
  union all select min(p) + 4294967296, arg_min(s, (p, s, v)) from points
), keys as (
  select doc_id, ('0x' || left(md5('key-' || coalesce(doc_id::varchar, chr(0) || 'null')), 8))::bigint h from documents
)
select k.doc_id, r.s::int home_shard, true within_bound from keys k asof join ring r on k.h <= r.p
"""
