import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (id, text) or (id, text, lang, source)."""

    def make(rows, extra=""):
        full = [(*r, None, None)[:4] if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """prose(seed, words): made-up text that shares no long passage with that of another seed."""

    def make(seed, words=60, per_line=10):
        rng = random.Random(seed)
        out = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(words)]
        return "\n".join(" ".join(out[i : i + per_line]) for i in range(0, words, per_line))

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs, prose):
    """Null in every column, empty, blank and very long texts, ties and repeated rows."""
    long = prose(99, 60_000)
    return make_docs(
        [(None, None), (1, None), (2, ""), (3, "  \n\t\n"), (4, prose(4)), (4, prose(4)), (4, prose(5)), (None, prose(6)), (None, prose(6)), (5, long, "en", "a"), (6, long, "en", "b"), (7, "x" * 100_000), (8, "ok", "de", None)]
    )
