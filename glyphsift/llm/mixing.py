"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded selection."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import table
from .common import discard, free_name, sized_broadcast, stored
from .packing import word_count

MAX_EPOCHS, SEED = 4, 17
#: Without given weights, a source weighs the square root of its tokens.
SMOOTHING = 0.5
#: Patterns the flow may have on the driver; a corpus with more raises an error.
MAX_PATTERNS = 200_000
#: Parts the names in a source column, where a document belongs to several.
SEPARATOR = "\x1f"
#: Leading bits of the seeded hash: parts of a pattern whose running totals are found side by side.
PART_BITS = 12


def quotas(weights: Mapping[str, float], budget: int) -> dict[str, int]:
    """Whole tokens of each source that add up to the budget, by largest remainders."""
    total = sum(weights.values())
    if not total:
        return {s: 0 for s in weights}
    exact = {s: budget * w / total for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, budget - sum(out.values()))]:
        out[s] += 1
    return out


def route(capacity: Mapping[tuple[str, ...], int], quota: Mapping[str, int], max_epochs: int = MAX_EPOCHS) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens of each pattern that go to each source: as much of the quotas as can be met, at least repetition cost.

    Arcs run from the start to a pattern, once for each epoch e with its tokens at a cost of e(e - 1)/2 a token, which
    is convex; from a pattern to the sources in it; from a source to the end with its quota. Only the first arcs cost
    anything, so successive cheapest paths take the epochs in order: for each, the flow so far grows to a largest one by
    Dinic's blocking flows. Ties are settled by node order.
    """
    patterns, sources = sorted(capacity), sorted(quota)
    at = {s: i for i, s in enumerate(sources)}
    members = [[at[s] for s in p if s in at] for p in patterns]
    holders: list[list[int]] = [[] for _ in sources]
    for p, own in enumerate(members):
        for s in own:
            holders[s].append(p)
    flow = [dict.fromkeys(own, 0) for own in members]
    room, supply = [quota[s] for s in sources], [0] * len(patterns)
    for _ in range(max_epochs):
        supply = [x + capacity[p] for x, p in zip(supply, patterns)]
        while _blocking_flow(members, holders, flow, supply, room):
            pass
    return {(patterns[p], sources[s]): n for p, own in enumerate(flow) for s, n in own.items() if n}


def _blocking_flow(members: list[list[int]], holders: list[list[int]], flow: list[dict[int, int]], supply: list[int], room: list[int]) -> bool:
    """One phase: shortest paths from patterns with supply to sources with room, until none of this length is left.

    A path goes from a pattern to one of its sources, from a source back to a pattern that sends to it, and so on.
    """
    far_s, far_p = [-1] * len(room), [-1] * len(supply)
    queue = deque()
    for s, n in enumerate(room):
        if n:
            far_s[s] = 0
            queue.append(s)
    while queue:
        s = queue.popleft()
        for p in holders[s]:
            if far_p[p] < 0:
                far_p[p] = far_s[s] + 1
                for other, n in flow[p].items():
                    if n and far_s[other] < 0:
                        far_s[other] = far_p[p] + 1
                        queue.append(other)
    next_s, next_p, any_ = [0] * len(room), [0] * len(supply), False
    for start in sorted((p for p, n in enumerate(supply) if n and far_p[p] > 0), key=lambda p: (far_p[p], p)):
        while supply[start]:
            path = [start]  # patterns at even places, sources at odd ones
            while path:
                if len(path) % 2:
                    p = path[-1]
                    step = next((s for s in members[p][next_p[p] :] if 0 <= far_s[s] < far_p[p]), None)
                    if step is not None:
                        next_p[p] = members[p].index(step)
                        path.append(step)
                        continue
                    next_p[p] = len(members[p])
                else:
                    s = path[-1]
                    if room[s]:
                        break
                    while next_s[s] < len(holders[s]):
                        p = holders[s][next_s[s]]
                        if flow[p][s] and 0 < far_p[p] < far_s[s]:
                            break
                        next_s[s] += 1
                    if next_s[s] < len(holders[s]):
                        path.append(holders[s][next_s[s]])
                        continue
                path.pop()
                if path:  # a dead end: its predecessor passes on
                    if len(path) % 2:
                        next_p[path[-1]] += 1
                    else:
                        next_s[path[-1]] += 1
            if not path:
                break
            push = min([supply[start], room[path[-1]], *(flow[path[i + 1]][path[i]] for i in range(1, len(path) - 1, 2))])
            for i in range(0, len(path) - 1, 2):
                flow[path[i]][path[i + 1]] += push
            for i in range(1, len(path) - 1, 2):
                flow[path[i + 1]][path[i]] -= push
            supply[start] -= push
            room[path[-1]] -= push
            any_ = True
    return any_


def _units(df: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, size: Column | None) -> DataFrame:
    """(_k, _id, _n, _p, _rows, _h, _b): each distinct text with tokens and sources, in how many rows it is, and its seeded hash."""
    text = F.col(text_col).cast("string")
    tokens = F.coalesce((word_count(text) if size is None else size).cast("long"), F.lit(0))
    own = F.filter(F.split(F.col(source_col).cast("string"), SEPARATOR), lambda s: s != "")
    rows = df.select(F.col(id_col).alias("_id"), F.md5(text.cast("binary")).alias("_k"), own.alias("_s"), tokens.alias("_n"))
    rows = rows.where((F.size("_s") > 0) & F.col("_k").isNotNull() & (F.col("_n") > 0))
    units = rows.groupBy("_k").agg(F.min("_id").alias("_id"), F.max("_n").alias("_n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_s")))).alias("_p"), F.count("*").alias("_rows"))
    h = _seeded(F.col("_k"), seed)
    return stored(units.withColumn("_h", h).withColumn("_b", F.shiftright(h, 64 - PART_BITS)), "units")


def _seeded(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def _plan(units: DataFrame, weights: Mapping[str, float] | None, budget: int | None, max_epochs: int) -> list[tuple[list[str], int, int, list[tuple[int, str]]]]:
    """(pattern, its tokens, tokens taken, (upto, source) stretches of these) of each pattern that the flow uses."""
    if max_epochs < 1:
        raise ValueError("max_epochs must be positive")
    per = stored(units.groupBy("_p").agg(F.sum("_n").alias("n")), "patterns")
    if (count := per.count()) > MAX_PATTERNS:
        raise ValueError(f"{count} membership patterns; at most {MAX_PATTERNS} can be routed")
    held = {tuple(r["_p"]): r["n"] for r in per.collect()}
    discard(per)
    if weights is None:
        total: dict[str, int] = {}
        for p, n in held.items():
            for s in p:
                total[s] = total.get(s, 0) + n
        weights = {s: n**SMOOTHING for s, n in total.items()}
    flow = route(held, quotas(weights, sum(held.values()) if budget is None else budget), max_epochs)
    plan = []
    for p, n in sorted(held.items()):
        upto, stretches = 0, []
        for s in p:
            if f := flow.get((p, s)):
                upto += f
                stretches.append((upto, s))
        if upto:
            plan.append((list(p), n, upto, stretches))
    return plan


def _placed(units: DataFrame) -> DataFrame:
    """units with _at: the tokens of their pattern before them in seeded order, found in parts of each pattern side by side."""
    sums = units.groupBy("_p", "_b").agg(F.sum("_n").alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("_n").over(Window.partitionBy("_p", "_b").orderBy("_h", "_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return units.withColumn("_own", own).join(sums.select("_p", "_b", base.alias("_base")), ["_p", "_b"]).withColumn("_at", F.col("_base") + F.col("_own"))


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """One row (id, text_key, source, epoch, tokens) for each copy of a document that the mixture takes.

    Rows with one text are one document that belongs to all their sources; the smallest id, nulls last, stands for it. A
    row of several sources names them parted by SEPARATOR. budget is the tokens wanted, by default those of all documents
    once; weights the share of each source, by default the square root of its tokens, a shared document counting in each.
    Sources without a weight get nothing. A source that can't meet its quota in max_epochs passes stays short. In seeded
    order, the copies of a pattern's documents line up; a copy belongs to the source in whose stretch it starts, so a
    source gets its tokens to within one document a pattern. Null and blank texts have no tokens; rows of a null or empty
    source belong to none: neither is taken. Repeated rows count once. Other columns are ignored. An empty table gives no
    rows. The driver holds the patterns alone, counted first; more than MAX_PATTERNS raise an error.
    """
    units = _units(df, seed, id_col, text_col, source_col, size)
    plan = _plan(units, weights, budget, max_epochs)
    kind = "_p array<string>, _all long, _take long, _cuts array<struct<upto:long,source:string>>"
    plans = sized_broadcast(df.sparkSession.createDataFrame(plan, kind), len(plan), 256)
    start = F.col("_at") + F.col("_e") * F.col("_all")
    copies = _placed(units).join(plans, "_p").withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("_at", start).where(F.col("_at") < F.col("_take"))
    source = F.filter("_cuts", lambda c: c["upto"] > F.col("_at"))[0]["source"]
    return copies.select(F.col("_id").alias(id_col), F.col("_k").alias("text_key"), source.alias("source"), (F.col("_e") + 1).alias("epoch"), F.col("_n").alias("tokens"))


def mixed_documents(df: DataFrame, weights: Mapping[str, float] | None = None, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of mix() as rows of df, all columns as they are but the source, which is the one that the copy is taken for.

    Within a pattern and an epoch, the documents taken for a source are a stretch in seeded order. Its last document is all
    that a row needs to know, so that whole texts are neither shuffled nor joined with what grows with them; only texts
    that several rows have are looked up. Of rows that repeat id and text, one stands for the document.
    """
    spark = df.sparkSession
    units = _units(df, seed, id_col, text_col, source_col, None)
    # (pattern, epoch, place, source, whole, tokens of the epoch up to its end) of each stretch
    stretches = []
    for p, n, _, own in _plan(units, weights, budget, max_epochs):
        for e in range(max_epochs):
            for j, (upto, s) in enumerate(own):
                if upto > e * n and (not j or own[j - 1][0] < (e + 1) * n):
                    stretches.append((p, e, j, s, upto >= (e + 1) * n, upto - e * n))
    parts = [(x[0], x[1], x[2], x[5]) for x in stretches if not x[4]]
    cut = sized_broadcast(spark.createDataFrame(parts, "_p array<string>, _e int, _j int, _upto long"), len(parts), 128)
    last = _placed(units).join(cut, "_p").where(F.col("_at") < F.col("_upto")).groupBy("_p", "_e", "_j").agg(F.max(F.struct("_h", "_k")).alias("_l"))
    ends = {(tuple(r["_p"]), r["_e"], r["_j"]): (r["_l"]["_h"], r["_l"]["_k"]) for r in last.collect()} if parts else {}
    rules: dict[tuple[str, ...], list] = {}
    for p, e, j, s, whole, _ in stretches:
        end = ends.get((tuple(p), e, j))
        if whole or end:
            rules.setdefault(tuple(p), []).append((e, s, whole, *(end or (0, ""))))
    names = [free_name(df, x) for x in ("_pattern", "_rules", "_key", "_hash", "_first", "_member", "_source")]
    pattern, rule, key, hashed, first, member, source = names
    table = spark.createDataFrame([(list(p), own) for p, own in rules.items()], "p array<string>, r array<struct<e:int,s:string,whole:boolean,h:long,k:string>>")
    table = sized_broadcast(table.select(F.col("p").alias(pattern), F.col("r").alias(rule)), len(rules), 512)
    text = F.col(text_col).cast("string")
    own = F.array_sort(F.array_distinct(F.filter(F.split(F.col(source_col).cast("string"), SEPARATOR), lambda s: s != "")))
    rows = df.where(text.rlike("[^ \\t\\n\\r\\f]")).withColumn(key, F.md5(text.cast("binary"))).withColumn(hashed, _seeded(F.col(key), seed)).withColumn(pattern, own)
    many = units.where(F.col("_rows") > 1).select(F.col("_k").alias(first), F.col("_id").alias(member), F.col("_p").alias(source))
    if n := many.count():
        looked = rows.join(sized_broadcast(many, n, 128), F.col(key) == F.col(first), "left")
        once = looked.where(F.col(first).isNotNull() & F.col(id_col).eqNullSafe(F.col(member)) & (F.size(pattern) > 0)).dropDuplicates([first])
        rows = looked.where(F.col(first).isNull()).unionByName(once.withColumn(pattern, F.col(source))).drop(first, member, source)
    before = lambda x: x["whole"] | (F.col(hashed) < x["h"]) | ((F.col(hashed) == x["h"]) & (F.col(key) <= x["k"]))
    taken = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: F.get(F.filter(rule, lambda x: (x["e"] == e) & before(x)), F.lit(0))["s"]))
    copies = rows.join(table, pattern).withColumn(source, F.explode(taken)).withColumn(source_col, F.col(source))
    return copies.select(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def quotas_query(spark, sf_dir: str) -> DataFrame:
    """What SQL can check of it: each source's quota, and that the mixture meets it to within a document a pattern and epoch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    units = _units(docs, SEED, "doc_id", "text", "source", None)
    plan = _plan(units, None, None, MAX_EPOCHS)
    wanted = {}
    for _, _, _, own in plan:
        for (upto, s), lo in zip(own, [0, *[u for u, _ in own]]):
            wanted[s] = wanted.get(s, 0) + upto - lo
    largest = F.broadcast(units.agg(F.max("_n").alias("most"), F.countDistinct("_p").alias("patterns")))
    got = mix(docs).groupBy("source").agg(F.sum("tokens").alias("got"))
    told = F.broadcast(spark.createDataFrame(sorted(wanted.items()), "source string, quota long"))
    near = F.abs(F.col("got") - F.col("quota")) <= F.col("most") * F.col("patterns") * MAX_EPOCHS
    return told.join(got, "source", "left").crossJoin(largest).select("source", "quota", F.coalesce(near, F.lit(False)).alias("met"))


#: Quotas by largest remainders; where the sources can't meet them in MAX_EPOCHS passes, the query's are smaller.
QUOTAS_ORACLE = r"""
with d as (
  select md5(text) k, max(len(regexp_extract_all(text, '[^ \t\n\r\f]+'))) n, list_distinct(list(source)) p from documents
  where text is not null and source is not null and source <> '' group by k
), t as (select sum(n) total from d), s as (select source, sum(n) tokens from (select n, unnest(p) source from d where n > 0) group by source),
x as (select source, (select total from t) * sqrt(tokens) / (select sum(sqrt(tokens)) from s) x from s),
r as (select source, floor(x) b, row_number() over (order by x - floor(x) desc, source) i, (select total from t) - sum(floor(x)) over () over_ from x)
select source, (b + (i <= over_)::int)::bigint quota, true met from r"""
