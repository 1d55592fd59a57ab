import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphsift.functions import codepoints as cp
from glyphsift.functions import layer_a as la

KEPT = {
    "bidi": "السعر ⁦123 USD⁩‏", "embedding": "a ‫x‬ b", "cjk": "葛\U000e0100", "mongolian": "ᠠ᠋", "family": "\U0001f468‍\U0001f469‍\U0001f467", "heart": "❤️‍\U0001f525",
    "persian": "می‌روم", "flag": "\U0001f3f4\U000e0067\U000e0062\U000e007f", "arabic": "؀١", "khmer": "ក឴", "hangul": "ᄀᅠ", "digits": "1‍2", "egypt": "\U00013000\U00013430",
}


@pytest.mark.parametrize("name", KEPT)
def test_what_belongs_to_a_neighbour_stays(name):
    text, _, _, removed, replaced, *_ = la.clean(KEPT[name])
    assert text == KEPT[name] and not removed and not replaced


@pytest.mark.parametrize(
    ("text", "want", "removed", "replaced"),
    [
        ("Hello​World­!", "HelloWorld!", 2, 0), ("a b　c", "a b c", 0, 2), ("hi\U000e0041there", "hithere", 1, 0), ("ab‮ef", "abef", 1, 0),
        ("葛\U000e0100\U000e0101", "葛\U000e0100", 1, 0), ("a‍b", "ab", 1, 0), ("﻿x", "x", 1, 0), ("x‮‬y", "xy", 2, 0), ("\U0001f3f4\U000e0067x", "\U0001f3f4x", 1, 0), ("a\xa0\xa0b", "a  b", 0, 2),
    ],
)
def test_cleaning(text, want, removed, replaced):
    got = la.clean(text)
    assert (got[0], got[5], got[6]) == (want, removed, replaced)


def test_options():
    assert la.clean("السعر ⁦123 USD⁩‏", strip_bidi=True)[0] == "السعر 123 USD"
    assert la.clean("аＡ")[0] == "аＡ" and la.clean("аＡ", confusables=True)[0] == "aA"
    assert la.clean("a\xa0b", spaces=False)[0] == "a\xa0b"
    assert la.clean(KEPT["family"], strip_glue=True)[0] == "\U0001f468\U0001f469\U0001f467"
    assert [la.clean(t, nfkc=True)[i] for t, i in (("Ａ", 0), ("Ａ", 7), ("Ａ", 6))] == ["A", True, 1]
    assert la.clean("ＡＢ ﬃ", nfkc=True)[6] == 3 and la.clean("Å Å", nfkc=True)[6] == 4


def test_every_reserved_character_and_noncharacter_goes():
    for rs in (cp.RESERVED, cp.NONCHARACTER, cp.ranges("180F 3164 FFA0")):
        for lo, hi in rs:
            for c in {lo, hi, (lo + hi) // 2}:
                assert la.clean(f"word{chr(c)}word")[0] == "wordword", hex(c)
    assert sum(hi - lo + 1 for lo, hi in cp.NONCHARACTER) == 66


def test_inspection_reports_bidi_that_cleaning_keeps():
    hits = la.inspect(KEPT["bidi"])
    assert {h[3] for h in hits} == {"bidi"} and sum(h[2] for h in hits) == 3
    hits = la.inspect("a​b​c\xa0d")
    assert [(h[0], h[2], h[3], h[4], h[5]) for h in hits] == [(0x200B, 2, "zwj_family", "probable", [1, 3]), (0xA0, 1, "space", "informational", [5])]
    assert hits[0][1] == "U+200B ZERO WIDTH SPACE (Cf)"
    assert len(la.inspect("​" * 30)[0][5]) == 10


def test_cleaning_is_idempotent():
    import random

    rng = random.Random(0)
    pool = [chr(c) for c in (0x200B, 0x200D, 0xFE0F, 0x202A, 0x202C, 0x202E, 0xE0100, 0x845B, 0x1F468, 0x61, 0x31, 0x1820, 0x180B, 0xA0, 0x645, 0x1780, 0x17B4, 0x600)]
    for _ in range(500):
        text = "".join(rng.choices(pool, k=12))
        once = la.clean(text, strip_bidi=True)[0]
        assert not la.inspect(once, strip_glue=False) or la.clean(once, strip_bidi=True)[0] != once or all(h[3] == "bidi" for h in la.inspect(once))


def test_native_counts_equal_the_kinds(spark):
    text = "".join(chr(c) for c in (0xAD, 0x200B, 0x202E, 0xE0041, 0xFEFF, 0xE000, 0xFDD0, 0xFE0F, 0x2065, 0xA0, 0x3000, 0xFFFF, 0x10FFFE))
    row = spark.createDataFrame([(text,)], "text string").select(*[c.alias(k) for k, c in la.kind_counts(F.col("text")).items()]).first()
    want = {}
    for ch in text:
        kind = cp.strip_kind(ord(ch)) or "space"
        want[kind] = want.get(kind, 0) + 1
    assert row.asDict() == dict.fromkeys(row.asDict(), 0) | want
    cleaned = spark.createDataFrame([(f"a{text}b",)], "text string").select(la.clean_context_free(F.col("text"))).first()[0]
    assert cleaned == "a  b"


def test_udfs_pass_nulls(spark):
    df = spark.createDataFrame([(None,), ("a​b",)], "text string")
    assert [r.h and len(r.h) for r in df.select(la.inspect_udf()("text").alias("h")).collect()] == [None, 1]
    assert [r.c.text for r in df.select(la.clean_udf()("text").alias("c")).collect()] == [None, "ab"]
    assert unicodedata.category("​") == "Cf"
