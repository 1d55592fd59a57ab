import numpy as np
import pytest

from glyphsift.llm import embedding_dedup
from glyphsift.llm.embedding_dedup import near_groups, near_pairs, quantise, tile_pairs

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold):
    out = []
    for n, (i, u) in enumerate(rows):
        for j, v in rows[n + 1 :]:
            if len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                out.append((min(i, j), max(i, j)))
    return sorted(out)


def test_every_pair_above_the_threshold_and_no_other(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 24))
    near = base[rng.integers(0, 60, 90)] + rng.normal(size=(90, 24)) * rng.uniform(0, 0.5, (90, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)
    for threshold in (0.8, 0.95):
        got = near_pairs(df, threshold=threshold, tile_rows=20).collect()
        assert sorted((r.id_a, r.id_b) for r in got) == brute(rows, threshold)


def test_the_bound_is_never_below_the_true_product():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64)) ** 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = quantise(x)
    rough = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(x @ x.T - rough) <= e[:, None] + e + 3 * e[:, None] * e).all()
    i, j = tile_pairs((q, s, e), (q, s, e), True, 0.3)
    want = set(map(tuple, np.argwhere(np.triu(x @ x.T >= 0.3, 1))))
    assert want <= set(zip(i, j)) and len(i) < 1.5 * len(want) + 20


def test_wide_vectors_and_extreme_numbers(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 1100))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, base + rng.normal(size=base.shape) * 0.1]))]
    got = near_pairs(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == [(i, i + 12) for i in range(12)]
    far = [(1, [1e200, 1e199]), (2, [2e200, 2e199]), (3, [1e-200, 1e-201]), (4, [0.0, 5e-324])]
    got = near_pairs(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == [(1, 2), (1, 3), (2, 3)]
    with pytest.raises(TypeError):
        near_pairs(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_odd_rows_make_no_pairs_and_repeats_pair(spark):
    rows = [(None, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, None], 1), (6, [1.0, 1.0], None), (6, [1.0, 1.0], None), (7, [2.0, 2.0], 0), (8, [1.0, 1.0, 1.0], 0), (9, [float("inf"), 1.0], 0)]
    got = near_pairs(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == [(6, 6), (6, 7), (6, 7)]
    assert near_pairs(spark.createDataFrame([], KIND)).collect() == []
    with pytest.raises(ValueError):
        near_pairs(spark.createDataFrame([], KIND), threshold=0)


def test_clashing_columns_play_no_part(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 2, "x"), (2, [1.0, 0.01], 3, 4, "y")], "vec_id long, embedding array<float>, _id long, id_a long, similarity string")
    assert [(r.id_a, r.id_b) for r in near_pairs(df).collect()] == [(1, 2)]


def groups_of(rows, threshold):
    """{n: (group, links)} of rows (id, vector), from all pairs."""
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= threshold) & ~np.eye(len(x), dtype=bool)
    least = np.array([i for i, _ in rows])
    for _ in rows:
        least = np.minimum(least, np.where(near, least[None, :], least.max()).min(axis=1))
    return sorted(zip((i for i, _ in rows), least.tolist(), near.sum(axis=1).tolist()))


def test_groups_and_links_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    near = base[rng.integers(0, 40, 120)] + rng.normal(size=(120, 24)) * rng.uniform(0, 0.5, (120, 1))
    x = np.concatenate([base, near, near[:30], base[:3], base[:3]]).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)) + 5, x)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)
    for threshold, tile in ((0.8, 30), (0.95, 30), (0.95, 1000)):
        got = near_groups(df, threshold=threshold, tile_rows=tile).collect()
        assert sorted(map(tuple, got)) == groups_of(rows, threshold)


def test_one_row_for_each_vector_however_many_pairs(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(6)
    chain = [[float(np.cos(a)), float(np.sin(a))] for a in np.arange(40) * 0.2]
    vectors = [*chain, *[[1.0, 0.0]] * 30, [0.0, 0.0], None, [], [1.0, None], [1.0, 1.0, 1.0]]
    rows = [(int(i), v, 0) for i, v in zip(rng.permutation(len(vectors)), vectors)] + [(None, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = embedding_dedup.query(spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert df.columns == ["vec_id", "group_id", "links"] and len(got) == len(rows)
    assert got == sorted(con.execute(embedding_dedup.ORACLE).fetchall(), key=repr)
    assert near_groups(spark.createDataFrame([], KIND)).collect() == []
    with pytest.raises(ValueError):
        near_groups(spark.createDataFrame([], KIND), threshold=0)
