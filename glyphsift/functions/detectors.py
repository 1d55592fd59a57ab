"""A registry of text detectors with one report, as columns: a detector that fails says so and never raises."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import gumbel

REPORT = "struct<detector:string,available:boolean,is_watermarked:boolean,score:double,p_value:double,error:string,note:string>"
FIELDS = ("detector", "available", "is_watermarked", "score", "p_value", "error", "note")
Detector = Callable[[str], dict]
_REGISTRY: dict[str, Detector] = {}


def register(name: str, detect: Detector) -> None:
    """detect gives a dictionary of some of FIELDS for a text."""
    _REGISTRY[name] = detect


def unregister(name: str) -> None:
    _REGISTRY.pop(name, None)


def names() -> list[str]:
    return sorted(_REGISTRY)


def vendor(_: str) -> dict:
    return {"available": False, "note": "only the vendor holds the key"}


def keyed(key: str, window: int = gumbel.WINDOW) -> Detector:
    raw = gumbel.key_bytes(key)

    def detect(text: str) -> dict:
        *_, p, score, marked = gumbel.detect(gumbel.simple_ids(text), raw, window)
        return {"is_watermarked": marked, "score": score, "p_value": p}

    return detect


register("vendor", vendor)


def run(name: str, text: Column) -> Column:
    """The report of one detector; null for a null text."""
    detect = _REGISTRY[name]

    def one(t: str | None) -> dict | None:
        if t is None:
            return None
        try:
            found = {"available": True} | detect(t)
        except Exception as e:  # noqa: BLE001 - a detector's fault is a result
            found = {"available": False, "error": f"{type(e).__name__}: {e}"}
        return {f: found.get(f) for f in FIELDS} | {"detector": name}

    @F.pandas_udf(REPORT)
    def report(texts: pd.Series) -> pd.DataFrame:
        rows = [one(t) or dict.fromkeys(FIELDS) for t in texts]
        return pd.DataFrame(rows, columns=list(FIELDS)).astype({"score": "float64", "p_value": "float64"})

    return F.when(text.isNotNull(), report(text))


def run_all(text: Column, chosen: list[str] | None = None) -> Column:
    """Reports of all registered detectors, or the chosen ones."""
    return F.array(*[run(n, text) for n in (names() if chosen is None else chosen)])


def available(reports: Column) -> Column:
    return F.filter(reports, lambda r: r["available"])


def evaluator(reports: Column) -> Column:
    """The name of the detector to judge by: the keyed replay, else any that is there, else lexical divergence."""
    ok = F.transform(available(reports), lambda r: r["detector"])
    return F.when(F.array_contains(ok, "gumbel"), "gumbel").otherwise(F.coalesce(F.try_element_at(F.array_sort(ok), F.lit(1)), F.lit("divergence")))
