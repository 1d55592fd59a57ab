"""MinHash near-dedup: ProbMinHash signatures of weighted shingles, banding, exact verification, connected groups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..sources.tables import table
from .common import NO_ID, discard, free_name, sized_broadcast, sliced, small_batches, stored, whole_id

WORDS, REGISTERS, ROWS, THRESHOLD = 3, 192, 4, 0.5
#: Bytes of text hashed at once.
CHUNK = 1 << 20
#: Scripts without spaces between words, of which each character is a word; and spaces and punctuation beyond ASCII.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
_BREAKS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u1680\u2000-\u206f\u3000-\u3004\u3008-\u3020\u30fb\ufe30-\ufe4f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input moves about half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, _B)]), dtype=np.uint64)
_INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, _BI)]), dtype=np.uint64)
_WORDY = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data, and where each begins: runs of ASCII letters and digits and of all beyond ASCII."""
    raw = np.frombuffer(data, dtype=np.uint8)
    wordy = _WORDY[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], wordy, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(raw) <= CHUNK:
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWER[: len(raw)], dtype=np.uint64)])
        return mixed((sums[end] - sums[start]) * _INVERSE[start] + (end - start).astype(np.uint64)), start
    hashes, starts, lo = [], [], 0
    while lo < len(raw):  # slices that end between words
        hi = min(lo + CHUNK, len(raw))
        gaps = np.flatnonzero(~wordy[lo:hi])
        if hi < len(raw) and len(gaps):
            hi = lo + int(gaps[-1]) + 1
        elif hi < len(raw):
            hi = int(end[np.searchsorted(end, hi)])
        if hi - lo > CHUNK:
            hashes.append(np.array([hash_long(data[lo:hi])], dtype=np.uint64))
            starts.append(np.array([lo]))
        else:
            own, at = word_hashes(data[lo:hi])
            hashes.append(own)
            starts.append(at + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(starts)


def hash_long(word: bytes) -> int:
    out = np.uint64(len(word))
    for i in range(0, len(word), CHUNK):
        part = np.frombuffer(word[i : i + CHUNK], dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        out = mixed(np.array([out + np.sum(part * _POWER[: len(part)], dtype=np.uint64)], dtype=np.uint64))[0]
    return int(out)


def normal(text: str) -> bytes:
    """text in lower case, with blanks for spaces and punctuation beyond ASCII and around characters of unspaced scripts."""
    text = text.lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", _BREAKS.sub(" ", text))
    return text.encode("utf-8", "replace")


def shingles(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of the distinct n-word shingles of each text, sorted, and a key of each text's words.

    A text of fewer words has one shingle of all its words; one without words has none. The weight is how often.
    """
    docs, parts, key = [], [], np.zeros((len(texts), 2), dtype=np.uint64)
    group: list[int] = []
    blobs: list[bytes] = []

    def flush() -> None:
        if not group:
            return
        hashes, start = word_hashes(b"\n".join(blobs))
        first = np.concatenate([[0], np.cumsum([len(b) + 1 for b in blobs])[:-1]])
        doc = np.searchsorted(first, start, side="right") - 1
        count = np.bincount(doc, minlength=len(group))
        begin = np.concatenate([[0], np.cumsum(count)])
        place = np.arange(len(hashes)) - begin[doc]
        wrap = (mixed(hashes + mixed(place.astype(np.uint64))), mixed(hashes ^ mixed(place.astype(np.uint64) * _B + np.uint64(7))))
        for c, w in enumerate(wrap):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(w, dtype=np.uint64)])
            key[group, c] = sums[begin[1:]] - sums[begin[:-1]]
        size = np.minimum(n, count[doc])
        usable = place + size <= count[doc]
        value = np.zeros(len(hashes), dtype=np.uint64)
        for j in range(n):
            has = np.flatnonzero(usable & (j < size))
            value[has] = mixed(value[has] * _B + hashes[has + j])
        docs.append(np.asarray(group)[doc[usable]])
        parts.append(value[usable])
        group.clear()
        blobs.clear()

    held = 0
    for i, text in enumerate(texts):
        blob = normal(text)
        if held + len(blob) >= CHUNK:
            flush()
            held = 0
        group.append(i)
        blobs.append(blob)
        held += len(blob) + 1
    flush()
    doc = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
    value = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    order = np.argsort(value)
    small = doc[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64)  # 16 bits are sorted by counting
    order = order[np.argsort(small, kind="stable")]
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.concatenate([at, [len(doc)]])), key


def prob_minhash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures, n_docs x registers: two documents agree in a register with their probability Jaccard.

    Each element is a Poisson process of arrivals at its weight as rate; an arrival takes a random register if it comes
    earlier than what the register holds. Arrivals of an element only grow, so its process ends once the next comes
    after the latest time in its document's registers. Rounds run over all elements still active.
    """
    time = np.full((n_docs, registers), np.inf)
    sign = np.zeros((n_docs, registers), dtype=np.uint64)
    at, state, rate, own = np.zeros(len(doc)), mixed(value + _B), weight.astype(np.float64), doc
    held = value
    while len(own):
        state = mixed(state + _B)
        uniform = ((state >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        at = at - np.log(uniform) / rate
        # The register comes from other bits than the waiting time does.
        register = (mixed(state ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
        flat = own * registers + register
        better = np.flatnonzero(at < time.ravel()[flat])
        # The earliest time of each register first, so that only what has it is sorted: of equal times the smaller element.
        np.minimum.at(time.ravel(), flat[better], at[better])
        better = better[at[better] == time.ravel()[flat[better]]]
        order = better[np.lexsort((held[better], flat[better]))]
        cell = flat[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = cell[1:] != cell[:-1]
        sign.ravel()[cell[first]] = held[order[first]]
        go = at < time.max(axis=1)[own]
        own, held, state, at, rate = own[go], held[go], state[go], at[go], rate[go]
    return sign


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P = sum over d in both of 1 / sum over d' of max(a(d') / a(d), b(d') / b(d)), of (sorted shingles, weights)."""
    (va, wa), (vb, wb) = a, b
    if not len(va) or not len(vb):
        return 0.0
    common, i, j = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[i].astype(np.float64), wb[j].astype(np.float64)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y, ratio = x[order], y[order], (x / y)[order]
    low = np.searchsorted(ratio, ratio, side="left")
    before = np.concatenate([[0.0], np.cumsum(y)])[low]
    after = x.sum() - np.concatenate([[0.0], np.cumsum(x)])[low]
    return float(np.sum(1.0 / ((only_a + after) / x + (only_b + before) / y)))


def _signatures(registers: int, rows: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches, CHUNK):
            doc, value, weight, key = shingles(list(pdf["_x"]))
            seen = np.unique(doc)
            if not len(seen):
                continue
            sigs = prob_minhash(np.searchsorted(seen, doc), value, weight, len(seen), registers)
            band = np.zeros((len(seen), registers // rows), dtype=np.uint64)
            for r in range(rows):
                band = mixed(band * _B + sigs[:, r :: rows][:, : registers // rows])
            band = mixed(band + np.arange(registers // rows, dtype=np.uint64) * _BI)  # bands of one place alone meet
            yield pd.DataFrame({"_d": pdf["_d"].to_numpy()[seen], "_t": pdf["_t"].to_numpy()[seen], "_k": [f"{a:016x}{b:016x}" for a, b in key[seen].tolist()], "_bands": list(band.view(np.int64))})

    return sign


def _shingle_blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document's shingles and their weights, as bytes; no weights where all are one."""
    for pdf in sliced(batches, CHUNK):
        doc, value, weight, _ = shingles(list(pdf["_x"]))
        begin = np.searchsorted(doc, np.arange(len(pdf) + 1))
        value, weight = value.astype("<u8"), weight.astype("<u4")
        spans = list(zip(begin[:-1].tolist(), begin[1:].tolist()))
        plain = np.add.reduceat(np.append(weight > 1, False), begin[:-1]) * (begin[1:] > begin[:-1]) == 0 if len(weight) else np.ones(len(pdf), bool)
        yield pd.DataFrame({"_d": pdf["_d"].to_numpy(), "_t": pdf["_t"].to_numpy(), "_v": [value[a:b].tobytes() for a, b in spans], "_w": [b"" if p else weight[a:b].tobytes() for p, (a, b) in zip(plain, spans)]})


def _read(v: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    value = np.frombuffer(v, "<u8")
    return value, np.frombuffer(w, "<u4") if w else np.ones(len(value), dtype=np.uint32)


@F.pandas_udf(DoubleType())
def _similarity(v1: pd.Series, w1: pd.Series, v2: pd.Series, w2: pd.Series) -> pd.Series:
    return pd.Series([probability_jaccard(_read(a, b), _read(c, d)) for a, b, c, d in zip(v1, w1, v2, w2)], dtype="float64")


def _verified(pairs: DataFrame, blobs: DataFrame, name: str) -> DataFrame:
    """pairs (_a, _b) with their exact similarity _s."""
    side = lambda x, n: blobs.select(F.struct("_d", "_t").alias(x), F.col("_v").alias(f"_v{n}"), F.col("_w").alias(f"_w{n}"))
    both = pairs.join(side("_b", 2), "_b").join(side("_a", 1), "_a")
    with small_batches(pairs.sparkSession):
        return stored(both.select("_a", "_b", _similarity("_v1", "_w1", "_v2", "_w2").alias("_s")), name)


def components(edges: DataFrame) -> DataFrame:
    """(_n, _root): the smallest node that each node of edges (_a, _b) is connected to.

    Each round takes the smallest root next to a node or its root, then follows roots to their own; it ends when no
    root changes. Rounds grow with the logarithm of the longest path but for adverse orders.
    """
    edges = edges.select("_a", "_b").union(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct()
    edges = stored(edges, "edges")
    roots = stored(edges.groupBy(F.col("_a").alias("_n")).agg(F.least(F.first("_a"), F.min("_b")).alias("_root")), "roots")
    while True:
        over = edges.join(roots.select(F.col("_n").alias("_b"), F.col("_root").alias("_r")), "_b")
        found = over.join(roots.select(F.col("_n").alias("_a"), F.col("_root").alias("_o")), "_a")
        # The smaller root reaches the node and the node's present root.
        offers = found.select(F.explode(F.array(F.struct(F.col("_a").alias("n"), F.col("_r").alias("r")), F.struct(F.col("_o").alias("n"), F.col("_r").alias("r")))).alias("_x")).select("_x.n", "_x.r")
        least = offers.groupBy(F.col("n").alias("_n")).agg(F.min("r").alias("_m"))
        new = roots.join(least, "_n", "left").select("_n", F.least("_root", F.coalesce("_m", "_root")).alias("_root"), F.col("_root").alias("_was"))
        new, old = stored(new, "roots"), roots
        up = new.select(F.col("_n").alias("_root"), F.col("_root").alias("_up"))
        jumped = stored(new.join(up, "_root", "left").select("_n", F.coalesce("_up", "_root").alias("_root"), "_was"), "roots")
        discard(old, new)
        if not jumped.where(F.col("_root") != F.col("_was")).head(1):
            discard(edges)
            return jumped.select("_n", "_root")
        roots = jumped.select("_n", "_root")
        roots._glyphsift_path = jumped._glyphsift_path


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(whole_id(df, id_col).alias("_d"), F.xxhash64(text).alias("_t"), text.alias("_x")).where(F.col("_x").isNotNull())


def _edges(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (_a, _b) of nodes, at least threshold alike, that connect all which some pair of a bucket connects.

    Every member meets the first of its bucket. One that isn't similar to it meets the others there: the groups are those
    of all pairs within buckets, without the square of a bucket of copies. As 1 less the probability Jaccard is a metric
    (a consistent sample collides with just that probability), two members whose similarities to the first differ by more
    than 1 - threshold can't reach the threshold: they don't meet.
    """
    bucket = Window.partitionBy("_h")
    placed = nodes.select("_n", F.explode("_bands").alias("_h")).withColumn("_c", F.count("*").over(bucket)).where(F.col("_c") > 1)
    placed = stored(placed.select("_h", "_n", F.min("_n").over(bucket).alias("_l")), "buckets")
    wanted = placed.select("_n._d", "_n._t").distinct()
    with small_batches(docs.sparkSession):
        blobs = stored(docs.join(wanted, ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"]).mapInPandas(_shingle_blobs, "_d long, _t long, _v binary, _w binary"), "shingles")
    others = placed.where(F.col("_n") != F.col("_l"))
    first = _verified(others.select(F.col("_l").alias("_a"), F.col("_n").alias("_b")).distinct(), blobs, "verified")
    like = others.join(first.select(F.col("_a").alias("_l"), F.col("_b").alias("_n"), "_s"), ["_l", "_n"]).select("_h", "_n", "_s")
    far = like.where(F.col("_s") < threshold).select("_h", F.col("_n").alias("_a"), F.col("_s").alias("_sa"))
    more = far.join(like.select("_h", F.col("_n").alias("_b"), "_s"), "_h").where((F.col("_a") != F.col("_b")) & (F.abs(F.col("_sa") - F.col("_s")) <= 1 - threshold + 1e-9))
    more = more.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct().join(first, ["_a", "_b"], "left_anti")
    second = _verified(more, blobs, "verified")
    edges = stored(first.union(second).where(F.col("_s") >= threshold), "edges")
    discard(placed, blobs, first, second)
    return edges


def _members(df: DataFrame, id_col: str, text_col: str, threshold: float, registers: int, rows: int) -> DataFrame:
    """(_d, _t, _root, _kept) for each row of df in a group of two rows or more, _root the smallest (_d, _t) of it."""
    docs = _keyed(df, id_col, text_col)
    with small_batches(df.sparkSession):
        signed = stored(docs.mapInPandas(_signatures(registers, rows), "_d long, _t long, _k string, _bands array<long>"), "signatures")
    # Texts of the same words are one node: thousands of copies cost one signature from here on.
    nodes = stored(signed.groupBy("_k").agg(F.min(F.struct("_d", "_t")).alias("_n"), F.min_by("_bands", F.struct("_d", "_t")).alias("_bands")), "nodes")
    edges = _edges(docs, nodes, threshold)
    roots = components(edges)
    rooted = nodes.select("_k", "_n").join(roots, "_n", "left").select("_k", F.coalesce("_root", "_n").alias("_root"))
    group = Window.partitionBy("_root")
    rows_ = signed.select("_d", "_t", "_k").join(rooted, "_k").withColumn("_c", F.count("*").over(group)).where(F.col("_c") > 1)
    members = stored(rows_.select("_d", "_t", "_root", (F.row_number().over(group.orderBy("_d", "_t")) == 1).alias("_kept")), "members")
    discard(signed, nodes, edges)
    return members


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """One row (id, group_id, kept) for each document of a group of near copies; a document without copies has none.

    Documents are alike if the probability Jaccard of their weighted 3-word shingles, computed exactly for each candidate
    pair, is at least the threshold; groups are the connected ones, so that of a chain in which each is like the next, one
    stays though its ends may differ. Candidates agree in a band of rows registers of the ProbMinHash signature; 48 bands
    of 4 find a pair at 0.5 with a chance of 0.95, at 0.6 of 0.998. Words are those of word_hashes() in normal() texts; of
    scripts without spaces each character is one. One row of a group is kept, that of the smallest id (nulls last), then
    text key; group_id is its id. Texts that are null or without words are nobody's copies. Repeated rows are copies of
    each other. Texts count whole; other columns are ignored; an empty table gives no rows. Ids must be whole numbers.
    """
    out = _members(df, id_col, text_col, threshold, registers, rows)
    number = lambda x: F.when(x != NO_ID, x)
    return out.select(number(F.col("_d")).alias(id_col), number(F.col("_root._d")).alias("group_id"), F.col("_kept").alias("kept"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, registers: int = REGISTERS, rows: int = ROWS, gather: str | None = None, separator: str = "\x1f") -> DataFrame:
    """df with one row of each group of near_groups(), all columns as they are; rows in no group all stay.

    gather names a string column in which the row kept gets the values of its whole group: parted at the separator, each
    once, in order. Null and empty values add nothing; where a group has no other, the row's own value stays.
    """
    d, t, k, n, g, d0, t0 = (free_name(df, x) for x in ("_d", "_t", "_kept", "_rows", "_gathered", "_d0", "_t0"))
    members = _members(df, id_col, text_col, threshold, registers, rows)
    keys = members.groupBy(F.col("_d").alias(d), F.col("_t").alias(t)).agg(F.max("_kept").alias(k), F.count("*").alias(n), F.first("_root").alias("_root"))
    keys = stored(keys, "keys")
    count = keys.count()
    own = df.withColumn(d0, whole_id(df, id_col)).withColumn(t0, F.xxhash64(F.col(text_col).cast("string")))
    here = lambda side: (own[d0] == side[d]) & (own[t0] == side[t])
    side = keys.drop("_root")
    if gather:
        values = own.join(sized_broadcast(keys, count, 64), here(keys)).select("_root", F.explode(F.split(F.col(gather), separator)).alias("_x")).where(F.col("_x") != "")
        values = values.groupBy("_root").agg(F.array_join(F.array_sort(F.collect_set("_x")), separator).alias(g))
        side = stored(keys.join(values.withColumnRenamed("_root", "_r"), F.col("_root") == F.col("_r"), "left").select(d, t, k, n, F.when(F.col(k), F.col(g)).alias(g)), "gathered")
    joined = own.join(sized_broadcast(side, count, 96), here(side), "left")
    if gather:
        joined = joined.withColumn(gather, F.when(F.col(k), F.coalesce(F.col(g), F.col(gather))).otherwise(F.col(gather)))
    once = joined.where(F.col(k).isNull() | (F.col(k) & (F.col(n) == 1))).select(*df.columns)
    if not keys.where(F.col(k) & (F.col(n) > 1)).head(1):
        return once
    return once.unionByName(joined.where(F.col(k) & (F.col(n) > 1)).dropDuplicates([d, t]).select(*df.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def copies_query(spark, sf_dir: str) -> DataFrame:
    """What SQL can check of it: each exact copy of a text with words, and that it shares a group with the first of them."""
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k")).where(F.col("text").rlike("[A-Za-z]")), "texts")
    first = docs.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    groups = stored(query(spark, sf_dir), "groups")
    pairs = docs.join(first, "k").join(groups.select("doc_id", "group_id", "kept"), "doc_id", "left")
    pairs = pairs.join(groups.select(F.col("doc_id").alias("first_id"), F.col("group_id").alias("first_group")), "first_id", "left")
    together = F.coalesce(F.col("group_id") == F.col("first_group"), F.lit(False))
    return pairs.select("doc_id", "first_id", together.alias("together"), F.coalesce(~F.col("kept") | (F.col("doc_id") == F.col("first_id")), F.lit(False)).alias("one_kept"))


COPIES_ORACLE = """
with d as (select doc_id, min(doc_id) over (partition by text) first_id, count(*) over (partition by text) n from documents where regexp_matches(text, '[A-Za-z]'))
select doc_id, first_id, true together, true one_kept from d where n > 1"""
