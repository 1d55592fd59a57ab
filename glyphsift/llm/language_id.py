"""Language ID: a bidirectional gated recurrent network over bytes, trained here by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import table
from .common import spans

#: Units a direction; bytes of a window; bytes read before and after a window to bring the states in; windows side by side.
UNITS, WINDOW, CONTEXT, SIDE = 8, 112, 16, 640
#: Bytes of a window in training.
LEARNED = 64
#: Labelled texts that the network learns from, at most (but one of each language), and passes of BATCH windows in training.
TRAIN_ROWS, STEPS, BATCH, SEED = 2000, 250, 256, 7


@dataclass(frozen=True)
class Direction:
    """e: what each byte adds to update gate, reset gate and candidate; u, b: what the state adds."""

    e: np.ndarray
    u: np.ndarray
    b: np.ndarray


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    ahead: Direction
    back: Direction
    w: np.ndarray
    c: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.ahead.e, self.ahead.u, self.ahead.b, self.back.e, self.back.u, self.back.b, self.w, self.c]


def _run(d: Direction, x: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Of each step over x (time, windows): state before, gates, candidate, the state's part of it, state after."""
    n = d.u.shape[0]
    h, out = np.zeros((x.shape[1], n)), []
    for t in range(len(x)):
        i, s = d.e[x[t]], h @ d.u + d.b
        gates = np.clip(i[:, : 2 * n] + s[:, : 2 * n] + 0.5, 0, 1)
        z, r, part = gates[:, :n], gates[:, n:], s[:, 2 * n :]
        c = np.tanh(i[:, 2 * n :] + r * part)
        new = c + z * (h - c)
        out.append((h, z, r, c, part, new))
        h = new
    return out


def _unroll(d: Direction, x: np.ndarray, steps: list[tuple[np.ndarray, ...]], dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of e, u and b from those of the states (time, windows, units), backwards through time."""
    n = d.u.shape[0]
    de, du, db, carry = np.zeros_like(d.e), np.zeros_like(d.u), np.zeros_like(d.b), 0.0
    inner = np.zeros((len(x), x.shape[1], 3 * n))
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c, part, _ = steps[t]
        dh = dh_out[t] + carry
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * ((z > 0) & (z < 1))
        dr = dc * part * ((r > 0) & (r < 1))
        ds = np.concatenate([dz, dr, dc * r], axis=1)
        inner[t] = np.concatenate([dz, dr, dc], axis=1)
        du += h.T @ ds
        db += ds.sum(axis=0)
        carry = dh * z + ds @ d.u.T
    flat = inner.reshape(-1, 3 * n)
    for j in range(3 * n):
        de[:, j] = np.bincount(x.ravel(), weights=flat[:, j], minlength=256)
    return de, du, db


def _windows(data: bytes) -> np.ndarray:
    padded = np.frombuffer(data + b" " * (-len(data) % LEARNED), dtype=np.uint8)
    return padded.reshape(-1, LEARNED)


def _in_context(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all texts with CONTEXT bytes of their own text on either side, blanks beyond its ends; the text of
    each, and how many of its WINDOW bytes are text."""
    cuts = np.array([-(-len(b) // WINDOW) for b in data], dtype=np.int64)
    gap = b" " * CONTEXT
    stream = np.frombuffer(b"".join(gap + b + b" " * (-len(b) % WINDOW) + gap for b in data if b) or gap, dtype=np.uint8)
    owner = np.repeat(np.arange(len(data)), cuts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    sizes = np.where(cuts > 0, cuts * WINDOW + 2 * CONTEXT, 0)
    start = (np.cumsum(sizes) - sizes)[owner] + place * WINDOW
    x = np.lib.stride_tricks.sliding_window_view(stream, WINDOW + 2 * CONTEXT)[start] if len(owner) else np.zeros((0, WINDOW + 2 * CONTEXT), np.uint8)
    return x, owner, np.minimum(WINDOW, np.array([len(b) for b in data], dtype=np.int64)[owner] - place * WINDOW)


def fit(texts: list[str], names: list[str], steps: int = STEPS, seed: int = SEED) -> Model:
    """A network for the languages in names, one a text; Adam on the cross entropy of every position of random windows."""
    rng = np.random.default_rng(seed)
    kinds = sorted(set(names))
    parts = [(_windows(t.encode("utf-8", "replace")), kinds.index(n)) for t, n in zip(texts, names) if t]
    x_all = np.concatenate([p for p, _ in parts])
    y_all = np.concatenate([np.full(len(p), k) for p, k in parts])
    by = [np.flatnonzero(y_all == k) for k in range(len(kinds))]
    n, k = UNITS, len(kinds)
    init = lambda *s: rng.normal(0, 0.3, s)
    model = Model(tuple(kinds), Direction(init(256, 3 * n), init(n, 3 * n), np.zeros(3 * n)), Direction(init(256, 3 * n), init(n, 3 * n), np.zeros(3 * n)), init(2 * n, k), np.zeros(k))
    params = model.params()
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, BATCH // k + 1) for b in by])  # each language alike
        x, y = x_all[pick].T, y_all[pick]
        ahead, back = _run(model.ahead, x), _run(model.back, x[::-1])
        h = np.concatenate([np.stack([s[5] for s in ahead]), np.stack([s[5] for s in back])[::-1]], axis=2)
        logits = h @ model.w + model.c
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p /= x.size
        dh = p @ model.w.T
        flat = h.reshape(-1, 2 * n)
        grads = [*_unroll(model.ahead, x, ahead, dh[:, :, :n]), *_unroll(model.back, x[::-1], back, dh[::-1, :, n:]), flat.T @ p.reshape(-1, k), p.sum(axis=(0, 1))]
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.03 * (1 - step / (steps + 1))
        for q, g, m, v in zip(params, grads, mean, var):
            g = g * min(1.0, 1.0 / (size + 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def position_probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """(time, languages, windows) probabilities of each byte of x (windows, time), in single precision."""
    n, k = UNITS, len(model.names)
    steps, m = x.shape[1], x.shape[0]
    out = np.empty((steps, k, m), dtype=np.float32)
    out[:] = model.c.astype(np.float32)[:, None]
    x = np.ascontiguousarray(x.T)
    i, s, gates = (np.empty((r * n, m), dtype=np.float32) for r in (3, 3, 2))
    for d, w, order in ((model.ahead, model.w[:n], range(steps)), (model.back, model.w[n:], range(steps - 1, -1, -1))):
        e = d.e.copy()
        e[:, : 2 * n] += d.b[: 2 * n] + 0.5
        e, u, b, w = (np.ascontiguousarray(a.T, dtype=np.float32) for a in (e, d.u, d.b[None, 2 * n :], w))
        h, part = np.zeros((n, m), dtype=np.float32), np.empty((k, m), dtype=np.float32)
        for t in order:
            np.take(e, x[t], axis=1, out=i, mode="clip")
            np.matmul(u, h, out=s)
            np.add(i[: 2 * n], s[: 2 * n], out=gates)
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            c = s[2 * n :]
            c += b
            c *= gates[n:]
            c += i[2 * n :]
            np.tanh(c, out=c)
            h -= c
            h *= gates[:n]
            h += c
            out[t] += np.matmul(w, h, out=part)
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


def identify(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: bytes, summed probabilities of its positions by language, and how many positions have each label."""
    k = len(model.names)
    data = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    length = np.array([len(b) for b in data], dtype=np.int64)
    total, labels = np.zeros((len(data), k)), np.zeros((len(data), k), dtype=np.int64)
    x, owner, valid = _in_context(data)
    steps = np.arange(WINDOW)[:, None]
    for lo in range(0, len(owner), SIDE):
        own, own_valid = owner[lo : lo + SIDE], valid[lo : lo + SIDE]
        p = position_probabilities(model, x[lo : lo + SIDE])[CONTEXT:-CONTEXT]
        label = p.argmax(axis=1)
        inside = steps < own_valid
        if own_valid.min() < WINDOW:
            p *= inside[:, None, :]
        sums = p.sum(axis=0, dtype=np.float64)
        for c in range(k):
            total[:, c] += np.bincount(own, weights=sums[c], minlength=len(data))
            labels[:, c] += np.bincount(own, weights=((label == c) & inside).sum(axis=0), minlength=len(data)).astype(np.int64)
    return length, total, labels


def share(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many of each language's texts are learned from: all, or as many as rows leaves each alike, one at least."""
    left, out = max(0, rows), {}
    for i, name in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[name] = max(1, min(counts[name], left // (len(counts) - i)))
        left = max(0, left - out[name])
    return out


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    """A network of at most ``rows`` labelled texts of the whole table; None where no row has a language.

    Of each language, the texts of smallest hash: an equal share of ``rows``, all where there are fewer, whose rest goes
    to the others. No language is left out: where there are more languages than rows, each has one text. Equal texts of
    a language count once.
    """
    text, lang = F.col(text_col).cast("string").alias("x"), F.col(lang_col).cast("string").alias("l")
    told = df.select(text, lang).where((F.length("x") > 0) & F.col("l").isNotNull()).withColumn("h", F.xxhash64("x"))
    ranked = told.select("l", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("n") <= max(1, rows))
    hashes = {r["l"]: sorted(r["h"]) for r in ranked.groupBy("l").agg(F.collect_list("h").alias("h")).collect()}
    if not hashes:
        return None
    upto = [(name, hashes[name][n - 1]) for name, n in share({name: len(h) for name, h in hashes.items()}, rows).items()]
    limits = F.broadcast(df.sparkSession.createDataFrame(upto, "l string, most long"))
    sample = told.join(limits, "l").where(F.col("h") <= F.col("most")).select("x", "l").distinct().collect()
    sample = sorted((r["x"], r["l"]) for r in sample)
    return fit([x for x, _ in sample], [n for _, n in sample])


def language_id(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, language, probability, n_bytes, label_share) for each row of df.

    The network labels every byte of the whole text, in windows of WINDOW bytes whose states begin CONTEXT bytes before
    and after them; beyond that a byte's label can't see. The document's probabilities are the means over its positions;
    language is the most probable (of equals the first by name), label_share how many of the positions have it as label.
    Null and empty texts, and all without a model, are 'und' with nulls. Null ids, ids of any type and repeated rows are
    handled like others; other columns are ignored; an empty table gives no rows.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("language string, probability double, n_bytes long, label_share double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.concat([_labelled(held.value, texts.iloc[lo:hi]) for lo, hi in spans(texts)] or [_labelled(None, texts)], ignore_index=True)

    out = df.select(F.col(id_col).alias("_i"), label(F.col(text_col).cast("string")).alias("_r"))
    real = lambda c: F.nanvl(F.col(c), F.lit(None)).alias(c.split(".")[1])
    return out.select(F.col("_i").alias(id_col), "_r.language", real("_r.probability"), "_r.n_bytes", real("_r.label_share"))


def _labelled(model: Model | None, texts: pd.Series) -> pd.DataFrame:
    if model is None:
        return pd.DataFrame({"language": "und", "probability": np.nan, "n_bytes": [len(t.encode("utf-8", "replace")) if isinstance(t, str) else 0 for t in texts], "label_share": np.nan})
    length, total, labels = identify(model, list(texts))
    best, some, rows = total.argmax(axis=1), np.maximum(length, 1), np.arange(len(texts))
    return pd.DataFrame({
        "language": np.where(length > 0, np.array(model.names, dtype=object)[best], "und"),
        "probability": np.where(length > 0, total[rows, best] / some, np.nan),
        "n_bytes": length,
        "label_share": np.where(length > 0, labels[rows, best] / some, np.nan),
    })


def bytes_query(spark, sf_dir: str) -> DataFrame:
    """What SQL can check of it: how many bytes of each document were labelled, and whether the answer is a language of the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = F.broadcast(docs.select(F.col("lang").alias("language")).distinct().withColumn("known", F.lit(True)))
    out = query(spark, sf_dir).join(known, "language", "left")
    return out.select("doc_id", "n_bytes", (F.col("known").isNotNull() | (F.col("language") == "und")).alias("known_language"))


BYTES_ORACLE = "select doc_id, coalesce(octet_length(encode(text)), 0)::bigint n_bytes, true known_language from documents"


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id(docs, train(docs))
