import json
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from glyphsift.llm.packing import CAPACITY


def test_stages_on_a_small_corpus(spark, make_docs, prose, tmp_path):
    passage = prose("shared", 60)
    rows = [(i, prose(i, 80), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, prose(100).upper(), "en", "s0"), (101, None, None, None), (102, "", "en", "s1")]
    rows += [(110 + i, f"{prose(110 + i)}\n{passage}", "en", "s1") for i in range(3)]
    near = prose(130, 200, 1000)
    rows += [(130, near, "en", "s2"), (131, near.replace(" ", " new ", 1), "en", "s2")]
    rows += [(132, prose(1, 80), "en", "s2")]
    make_docs(rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good, lines, unique, mixed = kept
    clean = set(range(60)) | {110, 111, 112, 130, 131, 132}
    assert set(good) == clean
    assert set(lines) == clean - {132} and passage in lines[110] and passage not in lines[111]
    assert set(unique) == clean - {132, 131}
    assert mixed and set(mixed) <= set(unique)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    counts = Counter(r.doc_id for r in docs.collect())
    assert Counter(r.doc_id for r in packed) == counts and max(r.bin_offset + r.tokens for r in packed) <= CAPACITY
    # The copy of 1 in another source, which line dedup emptied, is gone; 130 stands for itself and 131.
    by_id = {r.doc_id: r.source for r in spark.read.parquet(f"{tmp_path}/minhash_near_dedup").collect()}
    assert by_id[130] == "s2"
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(json.dumps(r.asDict()) for r in whole) == sorted(json.dumps(r.asDict()) for r in packed)


def test_shared_texts_are_mixed_from_all_their_sources(spark, make_docs, prose):
    """Near copies in two sources leave one document, which the mixture can take for either."""
    rows = []
    for i in range(40):
        text = prose(i, 120, 1000)
        rows += [(i, text, "en", "big"), (100 + i, text.replace(" ", " new ", 1), "en", "small")]
    rows += [(200 + i, prose(200 + i, 120, 1000), "en", "big") for i in range(60)] + [(300, prose(300, 120, 1000), "en", "small")]
    docs = make_docs(rows)
    unique = corpus_pipeline.drop_near_copies(spark, docs, "")
    sources = Counter(r.source for r in unique.collect())
    assert sources == {"big\x1fsmall": 40, "big": 60, "small": 1}
    mixed = corpus_pipeline.mix_sources(spark, unique, "").collect()
    taken = {(r.source, r.doc_id < 100) for r in mixed}
    assert ("small", True) in taken and {s for s, _ in taken} == {"big", "small"}
    again = corpus_pipeline.mix_sources(spark, unique.union(unique.where("doc_id < 20")), "").collect()
    assert sorted((r.doc_id, r.source) for r in again) == sorted((r.doc_id, r.source) for r in mixed)


def test_an_empty_corpus(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_with_odd_rows_and_clashing_columns(spark, odd_docs):
    names = ("_id", "_key", "_copies", "_d", "_t", "_kept", "kept", "_x", "shard")
    docs = odd_docs.withColumns({n: F.lit(1) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        rows, plain = stage(spark, docs, ""), stage(spark, odd_docs, "")
        assert rows.count() == plain.count(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0
