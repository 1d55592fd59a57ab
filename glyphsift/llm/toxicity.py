"""Toxicity: class-conditional Kneser-Ney character models of words, with shared backoff counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import discard, sized_broadcast, spans, stored, whole_id

#: Length of the longest character n-grams, and of the longest whose counts both classes share.
ORDER, SHARED = 5, 2
#: Parts of the labelled documents; those of each are scored by a model of the other parts, and all these scores together
#: settle the mixture and the thresholds.
FOLDS = 4
#: Toxic and ordinary labelled documents that a length class needs for a threshold of its own.
CLASS_ROWS = 20
#: Up to so many scores the driver settles by itself; more stay where they are, with the same outcome.
DRIVER_ROWS = 50_000
#: Up to so many n-grams the driver builds a model by itself, in a second; larger ones are built where the data are.
DRIVER_GRAMS = 200_000
#: Bins to a unit of score in which scores are counted first. Scores lie between -0.4 and 50.
BINS = 1024
#: Words whose ratios a task remembers.
KNOWN = 200_000
#: Bytes of n-grams that may be sent to the executors; a larger model raises an error.
MAX_BYTES = 1 << 30
START, END = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")
_M = 0x9E3779B97F4A7C15
#: The shares of a toxic document's words that may come from the toxic model; the labelled documents choose.
SHARES = (0.003, 0.01, 0.03, 0.1, 0.3)


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return _WORD.findall(text.lower())


def grams_of(word: str, order: int = ORDER) -> list[str]:
    padded = START * (order - 1) + word + END
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def _suffix_hashes(chars: np.ndarray) -> list[np.ndarray]:
    """Of each row, the hash of its last k characters, for k = 0 to its length."""
    out, power = [np.zeros(len(chars), dtype=np.uint64)], 1
    for k in range(chars.shape[1]):
        out.append(out[-1] + (chars[:, -1 - k].astype(np.uint64) + np.uint64(1)) * np.uint64(power))
        power = power * _M % (1 << 64)
    return out


def _codes(grams: list[str], k: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, k)


@dataclass(frozen=True)
class Level:
    """Of one n-gram length: sorted hashes of n-grams with their discounted shares, and of contexts with their backoff weights.

    Shares and weights have a column for each class, ordinary and toxic.
    """

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


@dataclass(frozen=True)
class Model:
    levels: tuple[Level, ...]
    letters: int
    order: int

    def log_likelihoods(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of each word with its end, ordinary and toxic, and its length in characters."""
        if not words or not self.levels:
            return np.zeros((len(words), 2)), np.array([len(w) + 1.0 for w in words])
        pad = self.order - 1
        length = np.array([len(w) + 1 for w in words])
        stream = np.frombuffer((START * pad).join(["", *[w + END for w in words]]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        first = np.cumsum(length + pad) - length
        at = np.arange(length.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        windows = np.lib.stride_tricks.sliding_window_view(stream, self.order)[at - pad]
        # A character's chance depends on its window alone, and words share most of these.
        _, one, back = np.unique(_suffix_hashes(windows)[-1], return_index=True, return_inverse=True)
        windows = windows[one]
        grams, contexts = _suffix_hashes(windows), _suffix_hashes(windows[:, :-1])
        p = np.full((len(one), 2), 1.0 / self.letters)
        for k, level in enumerate(self.levels, 1):
            i = np.minimum(np.searchsorted(level.contexts, contexts[k - 1]), len(level.contexts) - 1)
            found = np.flatnonzero(level.contexts[i] == contexts[k - 1])
            p[found] *= level.weight[i[found]]
            j = np.minimum(np.searchsorted(level.grams, grams[k][found]), len(level.grams) - 1)
            hit = level.grams[j] == grams[k][found]
            p[found[hit]] += level.share[j[hit]]
        return np.add.reduceat(np.log(p)[back], np.cumsum(length) - length, axis=0), length.astype(np.float64)

    def ratios(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio, toxic over ordinary, of each word."""
        both = self.log_likelihoods(words)[0]
        return both[:, 1] - both[:, 0]


def _hashed(gram: str, k: int) -> Column:
    """The hash of a column of k-grams, as a signed number."""

    @F.pandas_udf("long")
    def of(grams: pd.Series) -> pd.Series:
        return pd.Series(_suffix_hashes(_codes(list(grams), k))[k].view(np.int64) if k else np.zeros(len(grams), dtype=np.int64))

    return of(F.col(gram))


def _arrays(df: DataFrame) -> list[np.ndarray]:
    """(hash, ordinary, toxic) of df, sorted by the hash."""
    pdf = df.toPandas()
    h = pdf["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return [h[order], np.stack([pdf["o"].to_numpy(dtype=np.float32), pdf["t"].to_numpy(dtype=np.float32)], axis=1)[order]]


def _build_here(pdf: pd.DataFrame, order: int, shared: int, max_bytes: int) -> Model:
    """build() of a few n-grams."""
    if not len(pdf):
        return Model((), 1, order)
    chars, counts = _codes(list(pdf["g"]), order), pdf[["o", "t"]].to_numpy(dtype=np.int64)
    levels, used, letters = [], 0, len(np.unique(chars[:, -1])) + 1
    for k in range(order, 0, -1):
        if k <= shared:
            counts = np.repeat(counts.sum(axis=1, keepdims=True), 2, axis=1)
        if (used := used + len(chars) * 32) > max_bytes:
            raise ValueError(f"a model of over {max_bytes} bytes of n-grams; take a smaller order or raise max_bytes")
        once, twice = (counts == 1).sum(axis=0), (counts == 2).sum(axis=0)
        d = np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.75)
        contexts, at = np.unique(_suffix_hashes(chars[:, :-1])[k - 1], return_inverse=True)
        n, kinds = np.zeros((len(contexts), 2)), np.zeros((len(contexts), 2))
        np.add.at(n, at, counts)
        np.add.at(kinds, at, counts > 0)
        share = np.where(counts > 0, np.maximum(counts - d, 0) / np.maximum(n[at], 1), 0).astype(np.float32)
        weight = np.where(n > 0, d * kinds / np.maximum(n, 1), 1).astype(np.float32)
        h = _suffix_hashes(chars)[k]
        rank = np.argsort(h)
        levels.append(Level(h[rank], share[rank], contexts, weight))
        _, first, at = np.unique(_suffix_hashes(chars[:, 1:])[k - 1], return_index=True, return_inverse=True)
        some = counts > 0
        if k - 1 <= shared:
            some = np.stack([some.any(axis=1), np.zeros(len(some), bool)], axis=1)
        counts = np.zeros((len(first), 2), dtype=np.int64)
        np.add.at(counts, at, some)
        chars = chars[first, 1:]
    return Model(tuple(reversed(levels)), letters, order)


def build(grams: DataFrame, order: int = ORDER, shared: int = SHARED, max_bytes: int = MAX_BYTES, driver_grams: int = DRIVER_GRAMS) -> Model:
    """Interpolated Kneser-Ney of grams (g, o, t): n-grams of full length with their counts in either class.

    Counts at the full order, below it the number of distinct longer n-grams. Each class has its own numbers down to
    n-grams longer than ``shared``; from there on both take the pooled ones, so a rare expression that neither knows
    scores alike under both. Beyond ``driver_grams`` the levels are counted where the data are; hashes and shares alone
    reach the driver.
    """
    if grams.count() <= driver_grams:
        return _build_here(grams.toPandas(), order, shared, max_bytes)
    levels, used, letters, longer = [], 0, 1, None
    own = grams
    for k in range(order, 0, -1):
        if k <= shared:
            own = own.withColumn("o", F.col("o") + F.col("t")).withColumn("t", F.col("o"))
        level = stored(own, f"grams-{k}")
        if longer is not None:
            discard(longer)
        longer = level
        ones = [F.count_if(F.col(c) == n).alias(f"{c}{n}") for c in "ot" for n in (1, 2)]
        last = [F.count_distinct(F.substring("g", k, 1)).alias("letters")] if k == order else []
        stats = level.agg(F.count("*").alias("n"), *last, *ones).first()
        if not stats["n"]:
            discard(level)
            return Model((), 1, order)
        if k == order:
            letters = stats["letters"] + 1
        if (used := used + stats["n"] * 32) > max_bytes:
            raise ValueError(f"a model of over {max_bytes} bytes of n-grams; take a smaller order or raise max_bytes")
        d = {c: stats[f"{c}1"] / (stats[f"{c}1"] + 2 * stats[f"{c}2"]) if stats[f"{c}1"] and stats[f"{c}2"] else 0.75 for c in "ot"}
        context = F.substring("g", 1, k - 1)
        contexts = level.groupBy(context.alias("c")).agg(*[F.sum(x).alias(f"n{x}") for x in "ot"], *[F.count_if(F.col(x) > 0).alias(f"k{x}") for x in "ot"])
        # A context that a class lacks leaves all to the shorter one.
        weight = lambda x: F.when(F.col(f"n{x}") > 0, F.lit(d[x]) * F.col(f"k{x}") / F.col(f"n{x}")).otherwise(1.0).cast("float").alias(x)
        share = lambda x: F.when(F.col(x) > 0, F.greatest(F.col(x) - d[x], F.lit(0.0)) / F.col(f"n{x}")).otherwise(0.0).cast("float").alias(x)
        shares = level.withColumn("c", context).join(contexts, "c").select(_hashed("g", k).alias("h"), share("o"), share("t"))
        levels.append(Level(*_arrays(shares), *_arrays(contexts.select(_hashed("c", k - 1).alias("h"), weight("o"), weight("t")))))
        # The number of distinct longer n-grams, of each class, or pooled where the classes share their counts.
        pooled = k - 1 <= shared
        seen = [F.count_if((F.col("o") > 0) | (F.col("t") > 0)).alias("o"), F.lit(0).cast("long").alias("t")] if pooled else [F.count_if(F.col(c) > 0).alias(c) for c in "ot"]
        own = level.groupBy(F.substring("g", 2, k - 1).alias("g")).agg(*seen)
    discard(longer)
    return Model(tuple(reversed(levels)), letters, order)


#: The columns of counts, ordinary and toxic, of each part of the labelled documents.
_COUNTS = [f"{c}{f}" for f in range(FOLDS) for c in "ot"]


def _class_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts = [Counter() for _ in _COUNTS]
        for text, toxic, fold in zip(pdf["_x"], pdf["_toxic"], pdf["_f"]):
            counts[2 * fold + toxic].update(words_of(text))
        words = list(set().union(*counts))
        yield pd.DataFrame({"w": pd.Series(words, dtype=object)} | {c: pd.Series([own[w] for w in words], dtype="int64") for c, own in zip(_COUNTS, counts)})


def _word_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        known: dict[str, int] = {}
        own = [[known.setdefault(g, len(known)) for g in grams_of(word)] for word in pdf["w"]]
        at, times = np.array([i for x in own for i in x], dtype=np.int64), np.array([len(x) for x in own], dtype=np.int64)
        out = {"g": pd.Series(list(known), dtype=object)}
        for c in _COUNTS:
            total = np.zeros(len(known), dtype=np.int64)
            np.add.at(total, at, np.repeat(pdf[c].to_numpy(dtype=np.int64), times))
            out[c] = total
        yield pd.DataFrame(out)


def counted(labelled: DataFrame) -> DataFrame:
    """(g, o0, t0, o1 ...): the n-grams of labelled (_x, _toxic, _f) by part and class; words are counted first, so that each is cut up once."""
    kind = ", ".join(f"{c} long" for c in _COUNTS)
    words = labelled.select("_x", "_toxic", "_f").mapInPandas(_class_words, f"w string, {kind}").groupBy("w").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return words.mapInPandas(_word_grams, f"g string, {kind}").groupBy("g").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _without(grams: DataFrame, fold: int | None = None) -> DataFrame:
    """(g, o, t) of counted() grams: the counts of all parts but ``fold``."""
    total = [sum((F.col(f"{c}{f}") for f in range(FOLDS) if f != fold), F.lit(0)).cast("long").alias(c) for c in "ot"]
    return grams.select("g", *total).where((F.col("o") > 0) | (F.col("t") > 0))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (_d, _x) with _toxic 0 or 1 where labels tell of them; contradictory ones are left out."""
    told = labels.select(F.col("doc_id").cast("long").alias("_d"), F.col("toxic").cast("int").alias("_toxic")).where(F.col("_d").isNotNull() & F.col("_toxic").isin(0, 1))
    told = told.groupBy("_d").agg(F.min("_toxic").alias("_toxic"), F.max("_toxic").alias("_most")).where(F.col("_toxic") == F.col("_most")).drop("_most")
    return docs.join(sized_broadcast(told, labels.count(), 32), "_d")


def excess(ratio: np.ndarray, share: float) -> np.ndarray:
    """log((1 - share) ordinary + share * toxic) - log ordinary of a word whose log-likelihood ratio is ``ratio``."""
    return np.log1p(share * np.expm1(np.minimum(ratio, 50.0)))


def length_class(words: Column) -> Column:
    """Documents of 1 to 3, 4 to 15, 16 to 63 ... words."""
    return F.floor(F.log2(words.cast("double")) / 2 + 1e-9).cast("int")


def best_cut(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold with the most F1; of the gap between the scores that it parts, the middle. Infinite without toxic ones."""
    if not toxic.any():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + hits[-1])
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores aren't parted
    i = int(np.argmax(f1))
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def cuts(scores: np.ndarray, classes: np.ndarray, toxic: np.ndarray) -> tuple[float, dict[int, float]]:
    """The threshold of all scored rows (score, length class, toxic), and those of classes with enough of either kind."""
    own = {}
    for c in np.unique(classes):
        at = classes == c
        if toxic[at].sum() >= CLASS_ROWS and (toxic[at] == 0).sum() >= CLASS_ROWS:
            own[int(c)] = best_cut(scores[at], toxic[at])
    return (best_cut(scores, toxic) if (toxic == 0).any() else float("inf")), own


def settle(scores: np.ndarray, classes: np.ndarray, toxic: np.ndarray) -> tuple[int, float, dict[int, float]]:
    """Of the columns of scores, one for each of SHARES, the one with the most F1 under its thresholds (of equals the first),
    and these."""
    best = None
    for i in range(scores.shape[1]):
        cut, own = cuts(scores[:, i], classes, toxic)
        flagged = scores[:, i] >= np.array([own.get(int(c), cut) for c in classes])
        f1 = 2 * (flagged & (toxic == 1)).sum() / max(1, flagged.sum() + toxic.sum())
        if best is None or f1 > best[0]:
            best = f1, i, cut, own
    return best[1:]


def settle_apart(scored: DataFrame) -> tuple[int, float, dict[int, float]]:
    """What settle() finds for rows (toxic, c, s: array of scores), whose scores stay on the executors.

    Scores are counted in bins of fixed width, which tell F1 exactly between bins and bound it within one. Only in bins
    that can hold the largest F1 are the scores themselves put in order, each bin by itself.
    """
    rows = scored.select("toxic", "c", F.explode(F.array(F.lit(-1), "c")).alias("_c"), "s")  # -1: all classes
    known = {r["_c"]: (r["n"] - r["t"], r["t"]) for r in rows.groupBy("_c").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    own = sorted(c for c, x in known.items() if c >= 0 and min(x) >= CLASS_ROWS)
    found = {}
    if min(known.get(-1, (0, 0))) > 0:
        flat = rows.where(F.col("_c").isin(-1, *own)).select("_c", "toxic", F.posexplode("s").alias("_k", "_x"))
        flat = flat.withColumn("_b", F.floor(F.col("_x") * BINS))
        bins = flat.groupBy("_k", "_c", "_b").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.max("_x").alias("top")).toPandas()
        near = []
        for (k, c), part in bins.sort_values("_b", ascending=False).groupby(["_k", "_c"]):
            n, t, top = part["n"].to_numpy(), part["t"].to_numpy(), part["top"].to_numpy()
            m, h = np.cumsum(n), np.cumsum(t)
            reach = 2 * h / (m - n + t + h[-1])
            for i in np.flatnonzero(reach >= (2 * h / (m + h[-1])).max()):
                near.append((int(k), int(c), int(part["_b"].iloc[i]), int(m[i] - n[i]), int(h[i] - t[i]), int(h[-1]), float(top[i + 1]) if i + 1 < len(top) else None))
        near = scored.sparkSession.createDataFrame(near, "_k int, _c int, _b long, m long, h long, most long, below double")
        part = flat.join(F.broadcast(near), ["_k", "_c", "_b"]).groupBy("_k", "_c", "_b", "m", "h", "most", "below", "_x").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
        down = Window.partitionBy("_k", "_c", "_b").orderBy(F.desc("_x"))
        f1 = 2 * (F.col("h") + F.sum("t").over(down)) / (F.col("m") + F.sum("n").over(down) + F.col("most"))
        part = part.select("_k", "_c", "_x", f1.alias("f1"), F.coalesce(F.lead("_x").over(down), "below", "_x").alias("next"))
        best = part.groupBy("_k", "_c").agg(F.max(F.struct("f1", "_x", "next")).alias("m"))
        found = {(r["_k"], r["_c"]): (r["m"]["_x"] + r["m"]["next"]) / 2 for r in best.collect()}
    most = known.get(-1, (0, 0))[1]
    cut_of = lambda k, c: F.lit(float(found.get((k, c), float("inf"))))
    flagged = []
    for k in range(len(SHARES)):
        cut = cut_of(k, -1)
        for c in own:
            cut = F.when(F.col("c") == c, cut_of(k, c)).otherwise(cut)
        flagged += [F.count_if(F.col("s")[k] >= cut).alias(f"n{k}"), F.count_if((F.col("s")[k] >= cut) & (F.col("toxic") == 1)).alias(f"t{k}")]
    told = scored.agg(*flagged).first()
    at = max(range(len(SHARES)), key=lambda k: (2 * told[f"t{k}"] / max(1, told[f"n{k}"] + most), -k))
    return at, found.get((at, -1), float("inf")), {c: found[at, c] for c in own}


class _Scorer:
    """Ratios of words under a model, remembered from text to text."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        own = [words_of(t) if isinstance(t, str) else [] for t in texts]
        if len(self.known) > KNOWN:
            self.known = {}
        todo = sorted({w for words in own for w in words} - self.known.keys())
        for lo in range(0, len(todo), 20_000):
            part = todo[lo : lo + 20_000]
            self.known.update(zip(part, self.model.ratios(part).tolist()))
        return [(words, np.fromiter(map(self.known.__getitem__, words), dtype=np.float64, count=len(words))) for words in own]


def score_documents(df: DataFrame, text: Column, model: Model, share: float) -> DataFrame:
    """df with _r: (n_words, mean_ratio, score, expression) of each text.

    score is the difference of the log-likelihoods of the two classes, toxic less ordinary, a word: a toxic document's
    words come from the toxic model with the chance ``share`` and else from the ordinary one, as most of its words are
    ordinary. mean_ratio is the same difference with all words from the toxic model; expression is the word with the
    largest ratio. All but n_words are null without words.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_words int, mean_ratio double, score double, expression string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(held.value)
        for texts in batches:
            out = []
            for lo, hi in spans(texts):
                for words, ratio in scorer(list(texts.iloc[lo:hi])):
                    if words:
                        top = ratio.max()
                        out.append((len(words), float(ratio.mean()), float(excess(ratio, share).mean()), min(words[i] for i in np.flatnonzero(ratio == top))))
                    else:
                        out.append((0, np.nan, np.nan, None))
            yield pd.DataFrame(out, columns=["n_words", "mean_ratio", "score", "expression"]).astype({"n_words": "int32", "mean_ratio": "float64", "score": "float64", "expression": object})

    return df.withColumn("_r", score(text))


def _held_scores(held: Broadcast):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(held.value)
        for pdf in batches:
            out = []
            for lo, hi in spans(pdf["_x"]):
                own = scorer(list(pdf["_x"].iloc[lo:hi]))
                out += [(int(t), len(r), [float(excess(r, x).mean()) for x in SHARES]) for (_, r), t in zip(own, pdf["_toxic"].iloc[lo:hi]) if len(r)]
            yield pd.DataFrame(out, columns=["toxic", "n", "s"]).astype({"toxic": "int64", "n": "int64"})

    return score


@dataclass(frozen=True)
class Judge:
    """A model with the mixture's share, the threshold of all documents and those by length class."""

    model: Model
    share: float
    cut: float
    by_class: dict[int, float]


def _crossed(told: DataFrame, grams: DataFrame) -> list[DataFrame]:
    """(toxic, c, s) of the labelled rows of each part, scored by a model of the other parts."""
    out = []
    for fold in range(FOLDS):
        held = told.sparkSession.sparkContext.broadcast(build(_without(grams, fold)))
        own = told.where(F.col("_f") == fold).select("_x", "_toxic").mapInPandas(_held_scores(held), "toxic long, n long, s array<double>")
        out.append(stored(own.select("toxic", length_class(F.col("n")).alias("c"), "s"), f"scores-{fold}"))
        held.destroy()
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", driver_rows: int = DRIVER_ROWS) -> Judge:
    """The model of all labelled documents, and what their scores settle.

    Every labelled document teaches the model. The share of the mixture and the thresholds come from the scores of all of
    them as well, each by a model that doesn't know it: they fall into FOLDS parts by the hash of their text, so copies
    stay together, and each part is scored by a model of the others. n-grams are counted once, by part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).cast("string").alias("_x")).where(F.col("_x").isNotNull())
    told = stored(_labelled(rows, labels).withColumn("_f", F.pmod(F.xxhash64("_x"), F.lit(FOLDS)).cast("int")), "labelled")
    grams = stored(counted(told), "counts")
    parts = _crossed(told, grams)
    scored = reduce(DataFrame.unionAll, parts)
    if scored.count() <= driver_rows:
        held = scored.toPandas()
        at, cut, by_class = settle(np.array(held["s"].to_list(), dtype=np.float64).reshape(-1, len(SHARES)), held["c"].to_numpy(np.int64), held["toxic"].to_numpy(np.int64))
    else:
        at, cut, by_class = settle_apart(scored)
    model = build(_without(grams))
    discard(told, grams, *parts)
    return Judge(model, SHARES[at], cut, by_class)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_words, mean_ratio, score, expression, toxic) for each row of df.

    Two Kneser-Ney models, of toxic and of ordinary labelled documents, give each word a log-likelihood under either. The
    score is the difference of a document's two log-likelihoods, divided by its length in words; a document is toxic at
    the threshold that parts the labelled documents of its length class best, by scores of models that don't know them,
    see train(). Texts and words count whole. Null texts and texts without letters have no words, a null score and aren't toxic. Null ids and repeated rows
    are scored like others; null labels, and ids with labels of both kinds, don't teach. Without labels of either kind no
    document is toxic. Ids must be whole numbers. Other columns of df or labels are ignored. An empty table gives no rows.
    """
    return _judged(df, labels, id_col, text_col).drop("_x")


def _judged(df: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """toxicity() with the text, as _x."""
    whole_id(df, id_col)
    judge = train(df, labels, id_col, text_col)
    inf = lambda x: F.lit(float(x))
    cut = inf(judge.cut)
    for c, x in judge.by_class.items():
        cut = F.when(length_class(F.col("_r.n_words")) == c, inf(x)).otherwise(cut)
    rows = score_documents(df.select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("_x")), F.col("_x"), judge.model, judge.share)
    some = lambda c: F.when(F.col("_r.n_words") > 0, F.col(f"_r.{c}")).alias(c)
    rows = rows.select("_d", "_x", "_r")
    return rows.select("_x", F.col("_d").alias(id_col), "_r.n_words", some("mean_ratio"), some("score"), "_r.expression", F.coalesce((F.col("_r.n_words") > 0) & (F.col("_r.score") >= cut), F.lit(False)).alias("toxic"))


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def words_query(spark, sf_dir: str) -> DataFrame:
    """What SQL can check of it: whether a document has words and a score, and that its expression is a word of it."""
    out = _judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), "doc_id", "text")
    holds = F.lower("_x").contains(F.col("expression")) | ((F.col("n_words") == 0) & F.col("_x").isNotNull())
    return out.select("doc_id", (F.col("n_words") > 0).alias("has_words"), F.col("score").isNotNull().alias("scored"), F.coalesce(holds, F.lit(False)).alias("expression_found"))


WORDS_ORACLE = r"select doc_id, coalesce(regexp_matches(text, '\p{L}'), false) has_words, coalesce(regexp_matches(text, '\p{L}'), false) scored, text is not null expression_found from documents"
