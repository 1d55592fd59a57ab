import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    from glyphsift.plans import catalogue

    assert catalogue.ORACLE_SQL.keys() <= catalogue.QUERIES.keys() and len(catalogue.QUERIES) > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["stylometry_score", "char_kind_counts", "audit_summary_by_kind", "html_audit_summary", "bench_aggregate", "gumbel_masking_counts", "gumbel_p_value", "clean_text_exact", "carriers_in_context", "audit_text_items", "html_clean", "file_items", "file_clean_reinspect", "package_text_runs"])
def test_some_queries_equal_their_sql(spark, name):
    import duckdb

    from glyphsift.plans import catalogue

    con = duckdb.connect()
    for table in ("documents", "pages", "lineitem"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) or v.__class__.__name__ == "Decimal" else v
    want = con.execute(f"select {', '.join(cols)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert sorted(got, key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_token_digest_covers_whole_texts(spark, tmp_path):
    import hashlib

    import duckdb

    from glyphsift.plans import catalogue

    texts = {1: "Word one " * 40 + "ends here", 2: "Word one " * 40 + "ends there", 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.tokens, r.digest) for r in catalogue.QUERIES["token_digest"](spark, str(tmp_path)).collect()}
    ids = "".join(hashlib.sha256(t.encode()).hexdigest()[:16] for t in texts[1].lower().split())
    assert got[1] == (82, hashlib.sha256(ids.encode()).hexdigest()) and got[2][0] == 82 and got[2] != got[1]
    assert got[3] == (0, hashlib.sha256(b"").hexdigest()) and got[4] == (None, None)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {i: (n, x) for i, n, x in con.execute(catalogue.ORACLE_SQL["token_digest"]).fetchall()} == got


def equal_their_sql(spark, tmp_path, rows, *names):
    """Whether the queries over documents of these rows give what their SQL gives; their rows are returned."""
    import duckdb

    rows = [(i, t, "en", "web", len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    out = {}
    for name in names:
        df = entry.queries()[name](spark, str(tmp_path))
        out[name] = sorted(map(tuple, df.collect()), key=repr)
        assert out[name] == sorted(con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall(), key=repr), name
    return out


def test_a_score_that_rounds_to_the_gate_counts(spark, tmp_path):
    text = " ".join(f"word{i % 20}" for i in range(57))  # 74 words of one sentence with the phrases: 0.64997
    got = equal_their_sql(spark, tmp_path, [(35, text), (36, text), (37, None), (40, "")], "audit_text_items")
    assert [r[1] for r in got["audit_text_items"] if r[0] == "35"] == [1] and len(got["audit_text_items"]) == 3


@pytest.mark.parametrize("name", ["stylometry_score", "clean_text_exact", "classify_files", "media_audit_summary", "zip_members"])
def test_workers_get_small_batches(spark, tmp_path, name):
    import pandas as pd
    from pyspark.sql import functions as F

    rows = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    spark.createDataFrame([(1, "a", "en", "web", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    try:
        entry.queries()[name](spark, str(tmp_path))
        assert spark.range(0, 2500, 1, 1).select(rows("id").alias("n")).agg(F.max("n")).first()[0] == 1000
        spark.conf.set(key, "500")
        entry.queries()[name](spark, str(tmp_path))
        assert spark.conf.get(key) == "500"
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_a_replay_costs_less_than_two_hmacs_a_token():
    import hmac
    import time

    from glyphsift.functions import gumbel

    ids, key = gumbel.packed_ids(" ".join(f"w{i}" for i in range(20_000))), b"k" * 65
    pairs = [(ids[i : i + 32], ids[i + 32 : i + 40]) for i in range(0, len(ids) - 32, 8)]
    both = lambda c, t: hmac.digest(hmac.digest(key, c, "sha256"), t, "sha256")

    def least(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: gumbel.detect_packed(ids, key)) < least(lambda: [both(*p) for p in pairs])
    assert gumbel._uniforms(pairs[:50], key) == [both(*p)[:8] for p in pairs[:50]]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


ODD = [(0, "the cat sat 一二 \U0001f600 the end. " * 3), (1, ""), (2, "x"), (3, "ар ­​　" * 12), (4, "The dog $1 \\ the été " * 30), (8, "\U0001f600" * 4 + "\U000e0041﻿" * 6), (11, "a b"), (22, "plain words alone " * 9)]


def test_best_candidate_without_lambdas_of_words(spark, tmp_path):
    equal_their_sql(spark, tmp_path, ODD, "best_candidate", "lexical_divergence_pairs")
    assert "lambda" not in plan_of(entry.queries()["best_candidate"](spark, str(tmp_path)))


def test_chunks_of_many_files_go_together(spark, tmp_path):
    import pyarrow as pa

    from glyphsift.plans import binary_queries
    from glyphsift.sources import binary

    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(900)], "content": [binary_queries._png("text", i) for i in range(900)]})
    assert [b.num_rows for b in binary.gathering(binary.png_chunks)(iter([batch]))] == [1000, 1000, 1000, 300]
    equal_their_sql(spark, tmp_path, ODD, "png_chunks", "zip_members")


def test_code_points_without_a_row_of_each_character(spark, tmp_path):
    equal_their_sql(spark, tmp_path, ODD, "top_codepoints")
    assert "split(" not in plan_of(entry.queries()["top_codepoints"](spark, str(tmp_path)))


def test_offsets_without_a_row_of_each_character(spark, tmp_path):
    got = equal_their_sql(spark, tmp_path, ODD, "first_offsets")["first_offsets"]
    assert max(r[2] for r in got) == 12 and max(len(r[3].split(",")) for r in got) == 10
    assert "split(" not in plan_of(entry.queries()["first_offsets"](spark, str(tmp_path)))


def test_cleaning_takes_plain_runs_whole(spark, tmp_path):
    equal_their_sql(spark, tmp_path, ODD, "clean_reinspect_zero", "clean_context_free", "clean_text_exact")
    assert "\\x{34e}]+" in plan_of(entry.queries()["clean_context_free"](spark, str(tmp_path)))
