"""Embedding near-dedup: groups and links above a cosine threshold by int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import discard, stored, whole_id
from .minhash_dedup import components

THRESHOLD = 0.95
#: Rows of a tile: codes of a few megabytes, so that a row is sent to few tasks.
TILE_ROWS = 16384
SCHEMA = "id_a long, id_b long, similarity double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows of x as int8 codes, the scale of each, and an upper bound of each row's L2 quantisation error."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - codes * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return codes, scale, error


def _may_reach(a: tuple, b: tuple, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices (i in a, j in b, least) of all pairs whose cosine may reach the threshold, with a lower bound of each cosine;
    a and b are (codes, scale, error).

    For unit u, v with quantised q, r and error norms e, f: |u.v - q.r| <= |u - q||r| + |q||v - r| + |u - q||v - r|
    <= e(1 + f) + f(1 + e) + ef, as |q| <= 1 + e. A pair whose integer product plus this bound stays under the
    threshold can't reach it. Codes travel and lie in memory as int8; their integer products run through float32 matrix
    multiplication, which numpy has a fast kernel for, exact while 127 * 127 * dimension < 2**24; those of wider vectors
    through double precision.
    """
    (ca, sa, ea), (cb, sb, eb) = a, b
    kind = np.float32 if ca.shape[1] * 127 * 127 < 2**24 else np.float64
    cbt = np.ascontiguousarray(cb.astype(kind).T)
    for lo in range(0, len(ca), 128):
        hi = min(lo + 128, len(ca))
        dots = ca[lo:hi].astype(kind) @ cbt
        e, f = ea[lo:hi, None], eb[None, :]
        # The largest error of the tile first: one comparison a row rules out nearly everything.
        slack = float(e.max() + f.max() + 3 * e.max() * f.max())
        rough = (threshold - slack) * (1 - 1e-6) / sb[None, :].max() if threshold > slack else -np.inf
        i, j = np.nonzero(dots >= (rough / sa[lo:hi, None]).astype(kind) * (1 - 1e-6) if np.isfinite(rough) else np.ones_like(dots, bool))
        product, error = dots[i, j].astype(np.float64) * sa[lo + i] * sb[j], ea[lo + i] + eb[j] + 3 * ea[lo + i] * eb[j]
        keep = (product + error >= threshold) & ((lo + i < j) if same else True)
        yield lo + i[keep], j[keep], (product - error)[keep]


def tile_pairs(a: tuple, b: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i in a, j in b) of all pairs whose cosine may reach the threshold; a and b are (codes, scale, error)."""
    found = list(_may_reach(a, b, same, threshold))
    return tuple(np.concatenate([x[side] for x in found] or [np.zeros(0, int)]) for side in (0, 1))


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root, the smallest node known to be connected to each, after the edges (x, y)."""
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, y, x)
        while (root != (up := root[root])).any():
            root = up
    return root


def tile_links(a: tuple, b: tuple, weights: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two tiles, or of one with itself: (links, root, i, j), in memory that grows with the open pairs alone.

    Nodes are the rows of a and then, unless the tile is the same, those of b. links is the weight of the rows that each
    surely reaches the threshold with, root the smallest node it is connected to by them; the pairs (i, j) are open.
    """
    wa, wb = weights
    start = 0 if same else len(wa)
    n = start + len(wb)
    links, root, open_i, open_j = np.zeros(n), np.arange(n), [], []
    for i, j, least in _may_reach(a, b, same, threshold):
        sure = least >= threshold + 1e-9
        open_i.append(i[~sure])
        open_j.append(j[~sure] + start)
        i, j = i[sure], j[sure]
        links += np.bincount(i, weights=wb[j], minlength=n) + np.bincount(j + start, weights=wa[i], minlength=n)
        root = _joined(root, i, j + start)
    return links.astype(np.int64), root, np.concatenate(open_i or [np.zeros(0, int)]), np.concatenate(open_j or [np.zeros(0, int)])


def unit(vectors: list) -> np.ndarray:
    """Rows of one length at length 1, whatever their magnitude."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for _, own in pdf.groupby("_dim", sort=False):
            codes, scale, error = quantise(unit(list(own["_v"])))
            yield pd.DataFrame({"_r": own["_r"].to_numpy(), "_dim": own["_dim"].to_numpy(), "_w": own["_w"].to_numpy(), "_t": own["_t"].to_numpy(), "_q": [c.tobytes() for c in codes], "_s": scale, "_e": error})


def _exact(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                own = pdf.iloc[lo : lo + 4096]
                for _, part in own.groupby(own["_va"].str.len(), sort=False):
                    sims = np.einsum("ij,ij->i", unit(list(part["_va"])), unit(list(part["_vb"])))
                    p, q, good = part["_ia"].to_numpy(), part["_ib"].to_numpy(), sims >= threshold
                    yield pd.DataFrame({"id_a": np.minimum(p, q)[good], "id_b": np.maximum(p, q)[good], "similarity": sims[good]})

    return run


def _reaching(threshold: float):
    """Of pairs of rows with their vectors and weights, those that reach the threshold, without the vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["_va"].str.len(), sort=False):
                good = np.einsum("ij,ij->i", unit(list(part["_va"])), unit(list(part["_vb"]))) >= threshold
                yield part.loc[good, ["_ra", "_rb", "_wa", "_wb"]]

    return run


def _has_cosine(x: Column) -> Column:
    sound = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(sound & F.exists(x, lambda v: v != 0), F.lit(False))


def _met(rows: DataFrame, tile_rows: int) -> DataFrame | None:
    """Rows (_r, _v, _dim, _w) as codes, once for each meeting (_dim, _a, _b) of their tile with another; _side 0 is of
    tile _a, 1 of tile _b. None without rows."""
    tiles = {r["_dim"]: max(1, -(-r["count"] // tile_rows)) for r in rows.groupBy("_dim").count().collect()}
    if not tiles:
        return None
    n = F.create_map(*[F.lit(v) for kv in tiles.items() for v in kv])[F.col("_dim")]
    # Equal vectors fall into tiles by their row, so no tile is hot; a tile holds about tile_rows rows.
    tiled = rows.select("_r", "_v", "_dim", "_w", F.pmod(F.xxhash64("_r"), n).cast("int").alias("_t"))
    coded = stored(tiled.mapInPandas(_coded, "_r long, _dim int, _w long, _t int, _q binary, _s double, _e double"), "codes").withColumn("_n", n)
    own = ["_r", "_q", "_s", "_e", "_w", "_dim"]
    left = coded.select(*own, F.explode(F.sequence(F.col("_t"), F.col("_n") - 1)).alias("_b"), F.col("_t").alias("_a"), F.lit(0).alias("_side"))
    right = coded.where(F.col("_t") > 0).select(*own, F.col("_t").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("_a"), F.lit(1).alias("_side"))
    return left.unionByName(right)


def _sides(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """Of a meeting, (codes, scale, error), weights and rows of either tile."""
    dim, a, b = key
    parts = [pdf[pdf["_side"] == side] for side in ((0, 1) if a != b else (0, 0))]
    return [((np.frombuffer(b"".join(x["_q"]), dtype=np.int8).reshape(-1, dim), x["_s"].to_numpy(), x["_e"].to_numpy()), x["_w"].to_numpy(), x["_r"].to_numpy()) for x in parts]


def _numbered(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    kind = "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast(kind).alias("_v"))


def _sound(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (_id, _v, _dim, _r) that have an id and a cosine, numbered."""
    rows = _numbered(df, id_col, vec_col).where(F.col("_id").isNotNull() & _has_cosine(F.col("_v")))
    return stored(rows.withColumn("_dim", F.size("_v")).withColumn("_r", F.monotonically_increasing_id()), "vectors")


def near_groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row (id, group_id, links) for each row of df.

    links is the number of other rows whose cosine with it is at least the threshold, exactly; rows that such links
    connect, over others too, form a group, and group_id is its smallest id. Pairs are those of near_pairs(), but aren't
    listed: equal vectors meet others once, a meeting of tiles tells the links of each row and what they connect, and only
    pairs that int8 codes leave open are joined with the vectors. The work grows with the square of the distinct vectors,
    the rows with those of df.
    Rows without an id or without a cosine have no links and group_id is their own id. Vectors of different lengths have
    no link. Ids must be whole numbers. Other columns are ignored. An empty table gives no rows. The threshold must be
    positive.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    whole_id(df, id_col)
    rows, number = _sound(df, id_col, vec_col), F.lit(0).cast("long")
    rest = _numbered(df, id_col, vec_col).where(F.col("_id").isNull() | ~_has_cosine(F.col("_v")))
    rest = rest.select(F.col("_id").alias(id_col), F.col("_id").alias("group_id"), number.alias("links"))
    kinds = stored(rows.groupBy("_v", "_dim").agg(F.min("_r").alias("_r"), F.min("_id").alias("_least"), F.count("*").alias("_w")), "distinct")
    met = _met(kinds, tile_rows)
    if met is None:
        return rest

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (a, wa, ra), (b, wb, rb) = _sides(key, pdf)
        same = key[1] == key[2]
        if not len(ra) or not len(rb):
            return pd.DataFrame({"_k": [], "_ra": [], "_rb": []}).astype("int64")
        links, root, i, j = tile_links(a, b, (wa, wb), same, threshold)
        r = ra if same else np.concatenate([ra, rb])
        some, held = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        kind = np.repeat([0, 1, 2], [len(some), len(held), len(i)])  # links of a row; what they connect; open pairs
        return pd.DataFrame({"_k": kind, "_ra": r[np.concatenate([some, held, i])], "_rb": np.concatenate([links[some], r[root[held]], r[j]])}).astype("int64")

    told = stored(met.groupBy("_dim", "_a", "_b").applyInPandas(meet, "_k long, _ra long, _rb long"), "links")
    one = lambda s: kinds.select(F.col("_r").alias(f"_r{s}"), F.col("_v").alias(f"_v{s}"), F.col("_w").alias(f"_w{s}"))
    both = told.where(F.col("_k") == 2).select("_ra", "_rb").join(one("a"), "_ra").join(one("b"), "_rb")
    good = stored(both.mapInPandas(_reaching(threshold), "_ra long, _rb long, _wa long, _wb long"), "reaching")
    pair = lambda a, b: [F.col(a).alias("_r"), F.col(b).alias("_n")]
    counts = told.where(F.col("_k") == 0).select(*pair("_ra", "_rb")).union(good.select(*pair("_ra", "_wb"))).union(good.select(*pair("_rb", "_wa")))
    edge = [F.col("_ra").alias("_a"), F.col("_rb").alias("_b")]
    roots = components(told.where(F.col("_k") == 1).select(*edge).union(good.select(*edge))).withColumnRenamed("_n", "_r")
    own = kinds.join(counts.groupBy("_r").agg(F.sum("_n").alias("_n")), "_r", "left").join(roots, "_r", "left").withColumn("_root", F.coalesce("_root", "_r"))
    own = stored(own.select("_v", "_root", "_least", (F.coalesce("_n", number) + F.col("_w") - 1).alias("links")), "groups")
    discard(told, good, kinds)
    least = own.groupBy("_root").agg(F.min("_least").alias("group_id"))
    own = own.join(least, "_root").select("_v", "group_id", "links")
    return rows.join(own, "_v").select(F.col("_id").alias(id_col), "group_id", "links").union(rest)


def near_pairs(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """All pairs (id_a <= id_b, similarity) of rows whose cosine is at least the threshold, exactly.

    Every row is a query and meets every other once: rows fall into tiles, a tile meets itself and the tiles after it,
    and each meeting is one task. Int8 codes travel, once per tile meeting; the pairs that they can't rule out are joined
    with the vectors and computed in double precision. The work grows with the square of the rows.
    Null ids, null, empty or zero vectors and those with a null, NaN or infinite number have no cosine: no pairs.
    Vectors of different lengths never pair. Repeated rows pair with each other, id_a = id_b where they share the id.
    Ids must be whole numbers. Other columns are ignored. An empty table gives no rows. The threshold must be positive.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    whole_id(df, id_col)
    rows = _sound(df, id_col, vec_col)
    met = _met(rows.withColumn("_w", F.lit(1).cast("long")), tile_rows)
    if met is None:
        return df.sparkSession.createDataFrame([], SCHEMA)

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (a, _, ra), (b, _, rb) = _sides(key, pdf)
        i, j = tile_pairs(a, b, key[1] == key[2], threshold) if len(ra) and len(rb) else (np.zeros(0, int),) * 2
        return pd.DataFrame({"_ra": ra[i], "_rb": rb[j]}).astype("int64")

    pairs = met.groupBy("_dim", "_a", "_b").applyInPandas(meet, "_ra long, _rb long")
    one = lambda s: rows.select(F.col("_r").alias(f"_r{s}"), F.col("_id").alias(f"_i{s}"), F.col("_v").alias(f"_v{s}"))
    both = stored(pairs, "may-reach").join(one("a"), "_ra").join(one("b"), "_rb")
    return both.select("_ia", "_ib", "_va", "_vb").mapInPandas(_exact(threshold), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
with recursive v as materialized (
  select vec_id, cast(embedding as double[]) e, row_number() over (order by vec_id) n from embeddings
), u as materialized (
  select vec_id, n, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from v
  where vec_id is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda y: y * y)) > 0
), p as materialized (
  select a.n a, b.n b from u a join u b on a.n <> b.n
  where case when len(a.e) = len(b.e) then list_dot_product(a.e, b.e) >= {THRESHOLD} else false end
), reach(a, b) as (
  select n, n from u union select reach.a, p.b from reach join p on reach.b = p.a
), g as (select reach.a n, min(u.vec_id) group_id from reach join u on u.n = reach.b group by reach.a
), l as (select a n, count(*) links from p group by a)
select v.vec_id, coalesce(g.group_id, v.vec_id) group_id, coalesce(l.links, 0) links
from v left join g on v.n = g.n left join l on v.n = l.n
"""
