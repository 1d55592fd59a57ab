"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction, on a histogram of sizes."""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import table
from .common import stored

CAPACITY = 2048
#: Parts of each size class in which pieces are ranked side by side.
RANK_PARTS = 1024
Pattern = tuple[tuple[int, int], ...]


def word_count(t: Column) -> Column:
    """Runs of characters other than ASCII white space: the default size of a text."""
    return F.regexp_count(t, F.lit("[^ \\t\\n\\r\\f]+"))


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Bins that some optimal packing has (pattern, how many), and the counts of the sizes that are left.

    Martello and Toth: a set F of pieces dominates G if G's pieces can be spread over F's so that none is larger than
    the one that takes it; if F dominates every feasible set with piece j, a bin F can be fixed. For the size s:
    {s} if nothing fits beside it; {s, k}, k the largest that fits, if it fills the bin, if no two pieces fit beside s,
    or if at most two do and no such pair weighs more than k. Sizes are handled with their multiplicity.
    """
    left, fixed, changed = {s: n for s, n in counts.items() if n}, [], True
    while changed and left:
        changed = False
        for s in sorted(left, reverse=True):
            while left.get(s):
                left[s] -= 1
                sizes = sorted(x for x, n in left.items() if n)
                small = [x for x in sizes[:3] for _ in range(min(3, left[x]))][:3]
                left[s] += 1
                room = capacity - s
                if not small or small[0] > room:
                    fixed.append((((s, 1),), left.pop(s)))
                    changed = True
                    break
                k = sizes[bisect.bisect_right(sizes, room) - 1]
                good = k == room or len(small) < 2 or small[0] + small[1] > room
                if not good and (len(small) < 3 or sum(small) > room):
                    good = k >= _best_pair(left, sizes, s, room)
                if not good:
                    break
                n = left[s] // 2 if k == s else min(left[s], left[k])
                fixed.append((((s, 2),) if k == s else ((s, 1), (k, 1)), n))
                for x, take in ((s, 2 * n),) if k == s else ((s, n), (k, n)):
                    left[x] -= take
                    if not left[x]:
                        del left[x]
                changed = True
    return fixed, left


def _best_pair(left: dict[int, int], sizes: list[int], s: int, room: int) -> int:
    """The largest sum within room of two pieces beside one of size s."""
    best, i, j = 0, 0, len(sizes) - 1
    spare = lambda x: left[x] - (x == s)
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > room:
            j -= 1
        elif i == j and spare(sizes[i]) < 2:
            i += 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over sizes with multiplicity: equal to placing the pieces one by one, the largest first."""
    opened: dict[int, dict[Pattern, int]] = defaultdict(lambda: defaultdict(int))
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if not opened[room]:
                bisect.insort(rooms, room)
            opened[room][pattern] += n

    for s in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                each = capacity // s
                put(capacity - each * s, ((s, each),), n // each)
                put(capacity - n % each * s, ((s, n % each),), int(n % each > 0))
                break
            room = rooms[at]
            each, bins = room // s, opened[room]
            pattern = min(bins)
            m = bins.pop(pattern)
            full = min(m, n // each)
            rest = n - full * each if full < m else 0
            if not bins:
                rooms.pop(at)
            put(room - each * s, (*pattern, (s, each)), full)
            put(room - rest * s, (*pattern, (s, rest)), int(rest > 0))
            put(room, pattern, m - full - int(rest > 0))
            n -= full * each + rest
    return [(p, n) for room in rooms for p, n in sorted(opened[room].items())]


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Segments of pieces, sorted by size and rank, and the number of bins.

    Keys are size << 40 | first rank; the values are the pieces of that size in each bin, its first bin, and the offset.
    """
    fixed, left = dominance_reduction(counts, capacity)
    rank, bins, rows = defaultdict(int), 0, []
    for pattern, n in fixed + best_fit(left, capacity):
        offset = 0
        for s, each in pattern:
            rows.append((s << 40 | rank[s], each, bins, offset, s))
            rank[s] += n * each
            offset += s * each
        bins += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return table[:, 0], table[:, 1:], bins


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, size: Column | None = None) -> DataFrame:
    """One row (id, piece, tokens, bin_id, bin_offset) for each piece of a document of df.

    A document longer than the capacity is cut into full pieces and a rest. Pieces go into bins of the capacity: first
    those that dominance fixes, then the rest best-fit. Null and blank texts, or null sizes, have no tokens and no
    piece. Null ids and repeated rows are documents like any other; equal sizes are told apart by id and part, so which
    of two equals goes where is settled but for rows that repeat. Other columns are ignored. An empty table: no rows.
    Only the histogram, at most ``capacity`` sizes, reaches the driver. size, if given, counts a row's tokens.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    tokens = F.coalesce((word_count(F.col(text_col).cast("string")) if size is None else size).cast("long"), F.lit(0))
    docs = df.select(F.col(id_col).alias("_id"), tokens.alias("_n")).where(F.col("_n") > 0)
    last = (F.col("_n") + capacity - 1).cast("long")
    pieces = docs.select("_id", "_n", F.explode(F.sequence(F.lit(0), (F.floor(last / capacity) - 1).cast("int"))).alias("_p"))
    pieces = pieces.select("_id", "_p", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("_p").cast("long") * capacity).alias("_s"))
    pieces = stored(pieces.withColumn("_b", F.pmod(F.xxhash64("_id", "_p"), F.lit(RANK_PARTS)).cast("int")), "pieces")
    parts = pieces.groupBy("_s", "_b").count()
    before = F.sum("count").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = {r["_s"]: r["n"] for r in parts.groupBy("_s").agg(F.sum("count").alias("n")).collect()}
    keys, values, _ = plan_bins(counts, capacity)

    @F.pandas_udf("bin_id long, bin_offset long")
    def place(s: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, rank = s.to_numpy(), rank.to_numpy()
        at = np.searchsorted(keys, s << 40 | rank, side="right") - 1
        own = rank - (keys[at] & ((1 << 40) - 1))
        return pd.DataFrame({"bin_id": values[at, 1] + own // values[at, 0], "bin_offset": values[at, 2] + own % values[at, 0] * s})

    offsets = parts.select("_s", "_b", F.coalesce(before, F.lit(0)).alias("_o"))
    ranked = pieces.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_id", "_p")) - 1).join(offsets, ["_s", "_b"])
    out = ranked.select("_id", "_p", "_s", place("_s", F.col("_r") + F.col("_o")).alias("_at"))
    return out.select(F.col("_id").alias(id_col), F.col("_p").alias("piece"), F.col("_s").alias("tokens"), "_at.bin_id", "_at.bin_offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pieces_query(spark, sf_dir: str) -> DataFrame:
    """What SQL can check of it: pieces and tokens of each document, and that bins hold no more than their capacity, back to back."""
    out = query(spark, sf_dir)
    bins = out.groupBy("bin_id").agg(F.sum("tokens").alias("n"), F.max(F.col("bin_offset") + F.col("tokens")).alias("end"), F.min("bin_offset").alias("lo"))
    sound = bins.agg(((F.max("n") <= CAPACITY) & (F.max(F.abs(F.col("n") - F.col("end"))) == 0) & (F.max("lo") == 0)).alias("sound"))
    per = out.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    return per.crossJoin(F.broadcast(sound))


PIECES_ORACLE = rf"""
with d as (select doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f]+')) n from documents)
select doc_id, sum((n + {CAPACITY - 1}) // {CAPACITY})::bigint pieces, sum(n)::bigint tokens, true sound from d where n > 0 group by doc_id"""
