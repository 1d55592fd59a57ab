"""Replay of a keyed Gumbel watermark test, by whoever holds the key: token ids, masking, statistic and p-value."""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, THRESHOLD = 4, 1e-6
#: Tokens whose ids a worker remembers from text to text.
KNOWN = 100_000
#: HMAC's two pads, as tables of bytes.
_INNER, _OUTER = (bytes(b ^ x for b in range(256)) for x in (0x36, 0x5C))
REPORT = "tokens_total int, skipped_no_context int, skipped_repeated int, counted int, statistic double, p_value double, score double, is_watermarked boolean"


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))


def token_hex(token: Column) -> Column:
    """The id of a token, the first 8 bytes of its SHA-256, in hexadecimal: Spark's integers have no unsigned 64 bits."""
    return F.substring(F.sha2(token, 256), 1, 16)


def token_id(token: Column) -> Column:
    return F.conv(token_hex(token), 16, 10).cast("decimal(20,0)")


def masking(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Per document: tokens_total, skipped_no_context, skipped_repeated, counted, without the key. No rows are made of tokens."""
    words, ctx = F.col("_g.w"), F.col("_g.c")
    # A lambda's argument is computed once.
    shingles = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - window, F.lit(0))), lambda _, i: F.array_join(F.slice(w, i + 1, window), " "))
    both = F.transform(F.array(F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))), lambda w: F.struct(w.alias("w"), shingles(w).alias("c")))[0]
    rows = df.select(F.col(id_col).alias("_i"), both.alias("_g")).select("_i", F.size(words).alias("n"), F.size(ctx).alias("m"), F.size(F.array_distinct(ctx)).alias("u"))
    whole = lambda c, name: c.cast("long").alias(name)
    return rows.select(F.col("_i").alias(id_col), whole(F.col("n"), "tokens_total"), whole(F.least("n", F.lit(window)), "skipped_no_context"), whole(F.col("m") - F.col("u"), "skipped_repeated"), whole(F.col("u"), "counted"))


def key_bytes(key: str) -> bytes:
    key = key.strip()
    return bytes.fromhex(key[2:]) if re.fullmatch(r"0[xX](?:[0-9a-fA-F]{2})+", key) else key.encode()


def uniform(key: bytes, context: tuple[int, ...], token: int) -> float:
    seed = hmac.digest(key, struct.pack(f">{len(context)}Q", *context), "sha256")
    return (int.from_bytes(hmac.digest(seed, struct.pack(">Q", token), "sha256")[:8], "big") + 0.5) / 2.0**64


def survival(s, n):
    """P(Gamma(n, 1) >= s) = exp(-s) * sum of s**k / k! for k < n, by logarithms."""
    if n <= 0 or s <= 0:
        return 1.0
    k = np.arange(n)
    terms = k * math.log(s) - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    top = terms.max()
    return float(min(1.0, max(0.0, math.exp(top - s + math.log(np.exp(terms - top).sum())))))


def detect(ids: list[int], key: bytes, window: int = WINDOW, threshold: float = THRESHOLD, mask: bool = True) -> tuple:
    """The report on token ids, in the order of REPORT."""
    return detect_packed(struct.pack(f">{len(ids)}Q", *ids), key, window, threshold, mask)


def detect_packed(ids: bytes, key: bytes, window: int = WINDOW, threshold: float = THRESHOLD, mask: bool = True) -> tuple:
    """detect() on ids of 8 bytes each, the most significant first: a context is a slice of them."""
    n, wide = len(ids) // 8, 8 * window
    ends = range(len(ids) - 8, wide - 8, -8)  # from the last, so that of equal contexts the first stays
    pairs = ((ids[end - wide : end], ids[end : end + 8]) for end in ends)
    pairs = list(dict(pairs).items() if mask else pairs)
    counted, repeated = len(pairs), len(ends) - len(pairs)
    uniforms = _uniforms(pairs, key)
    u = (np.frombuffer(b"".join(uniforms), dtype=">u8").astype(np.float64) + 0.5) / 2.0**64
    total = math.fsum(-np.log1p(-np.minimum(u, 1 - 2.0**-53)))
    p = survival(total, counted)
    score = (-math.log10(p) if p > 0 else 300.0) if counted else 0.0
    return n, min(window, n), repeated, counted, total if counted else None, p, abs(score), bool(counted and p < threshold)


def _uniforms(pairs: list[tuple[bytes, bytes]], key: bytes) -> list[bytes]:
    """The 8 bytes of each (context, token), by HMAC's definition: hashes of its parts take less time than hmac.digest()."""
    sha = hashlib.sha256
    key = (sha(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer, pad, last = key.translate(_INNER), key.translate(_OUTER), b"\x36" * 32, b"\x5c" * 32
    out = []
    for context, token in pairs:
        seed = sha(outer + sha(inner + context).digest()).digest()
        out.append(sha(seed.translate(_OUTER) + last + sha(seed.translate(_INNER) + pad + token).digest()).digest()[:8])
    return out


class _Ids(dict):
    """Token to the first 8 bytes of its SHA-256."""

    def __missing__(self, token: str) -> bytes:
        out = hashlib.sha256(token.encode()).digest()[:8]
        if len(token) <= 64:
            self[token] = out
        return out


_ids = _Ids()


def simple_ids(text: str) -> list[int]:
    return list(struct.unpack(f">{len(packed := packed_ids(text)) // 8}Q", packed))


def packed_ids(text: str) -> bytes:
    """The ids of a text's tokens, the first 8 bytes of their SHA-256, one after the other."""
    if len(_ids) > KNOWN:
        _ids.clear()
    return b"".join(map(_ids.__getitem__, re.findall("[a-z0-9]+", text.lower())))


def detect_udf(key: str, window: int = WINDOW, threshold: float = THRESHOLD):
    raw = key_bytes(key)

    @F.pandas_udf(REPORT)
    def report(texts: pd.Series) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in REPORT.split(", ")]
        return pd.DataFrame([detect_packed(packed_ids(t), raw, window, threshold) if t is not None else (None,) * 8 for t in texts], columns=names)

    return report


def parse_token_ids(t: Column) -> Column:
    """Token ids from a JSON array, or one a line in base 10 or 16, as decimals; null where neither fits."""
    json = F.from_json(t, "array<decimal(20,0)>")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    one = lambda x: F.when(x.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substr(x, F.lit(3)), 16, 10)).when(x.rlike("^[0-9]{1,20}$"), x).cast("decimal(20,0)")
    parsed = F.transform(lines, one)
    return F.when(F.trim(t).startswith("["), json).when(~F.exists(parsed, lambda x: x.isNull()), parsed)
