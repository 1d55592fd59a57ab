"""Images inside text as data URIs: their own inspectors and cleaners, base64 or percent-encoded."""

from __future__ import annotations

import base64
import binascii
import re
from urllib.parse import quote_from_bytes, unquote_to_bytes

import pandas as pd
from pyspark.sql import functions as F

from . import media

URI = re.compile(r"""data:image/([a-z0-9+.-]+)((?:;[^\s"')<>,]+)*),([a-z0-9+/=%\s]+)""", re.I)
#: What is looked at as an image; other payloads are searched for markers.
RASTER = ("png", "jpeg", "webp", "avif", "heic")
SVG_BLOCK = re.compile(r"(?is)<metadata\b[^>]*>.*?</metadata\s*>|<x:xmpmeta\b[^>]*>.*?</x:xmpmeta\s*>")


def payload(params: str, body: str) -> bytes | None:
    """The bytes of a data URI, None where they can't be read."""
    if "base64" not in params.lower():
        return unquote_to_bytes(body.strip())
    body = re.sub(r"\s+", "", unquote_to_bytes(body).decode("latin-1"))
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def inspect(text: str) -> tuple[bool, bool, list[str]]:
    """(has_c2pa, has_ai_metadata, findings) of all images in a text."""
    c2pa, ai, out = False, False, []
    for mime, params, body in URI.findall(text):
        if not (data := payload(params, body)):
            continue
        kind = media.sniff(data)
        if kind in RASTER:
            _, c, a, found = media.inspect(data)
        else:
            names = media.hits(data)
            c, a, found = bool(media.hits(data, media.C2PA)), bool(names), [f"ai:{n}" for n in names]
            if b"<metadata" in data.lower():
                found.insert(0, "svg <metadata> present")
        c2pa, ai = c2pa | c, ai | a | c
        out += [f"embedded data:image/{mime.lower()}: {x}" for x in found]
    return c2pa, ai, out


def clean(text: str) -> tuple[str, list[str]]:
    """text with its images cleaned, encoded as they were, and what was done; what can't be read or cleaned stays."""
    actions: list[str] = []

    def swap(m: re.Match) -> str:
        mime, params, body = m.groups()
        data = payload(params, body)
        if not data:
            return m[0]
        if media.sniff(data) in RASTER:
            new, own = media.clean(data)
        else:
            new = SVG_BLOCK.sub("", data.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")
            own = ["drop svg metadata"] if new != data else []
        if not own or new == data:
            return m[0]
        actions.append(f"cleaned embedded data:image/{mime} ({', '.join(own[:2])})")
        return f"data:image/{mime}{params}," + (base64.b64encode(new).decode() if "base64" in params.lower() else quote_from_bytes(new))

    return URI.sub(swap, text), actions


def inspect_udf():
    @F.pandas_udf("has_c2pa boolean, has_ai_metadata boolean, findings array<string>")
    def report(texts: pd.Series) -> pd.DataFrame:
        rows = [inspect(t) if t is not None and "data:" in t.lower() else (False, False, []) for t in texts]
        return pd.DataFrame(rows, columns=["has_c2pa", "has_ai_metadata", "findings"])

    return report


def clean_udf():
    @F.pandas_udf("text string, actions array<string>")
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        rows = [clean(t) if t is not None and "data:" in t.lower() else (t, []) for t in texts]
        return pd.DataFrame(rows, columns=["text", "actions"]).astype({"text": object})

    return cleaned
