import random

import numpy as np
import pytest

from glyphsift.llm import toxicity as whole
from glyphsift.llm.toxicity import SHARES, START, END, best_cut, build, grams_of, settle, settle_apart, toxicity, train

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(make_docs, prose):
    rng, rows, labels = random.Random(0), [], []
    for i in range(400):
        words = prose(f"t{i}", 80, 1000).split(" ")
        if i % 8 == 0:
            for _ in range(3):
                words.insert(rng.randrange(80), rng.choice(["xurkwik", "xurkwok", "xurkwaf", "xurk"]) + rng.choice(["", "en", "os", "it"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 8 == 0)))
    return rows, labels


def test_held_out_documents(spark, make_docs, corpus):
    rows, labels = corpus
    told = spark.createDataFrame([x for x in labels if x[0] < 200], LABELS)
    got = {r.doc_id: r for r in toxicity(make_docs(rows), told).collect()}
    unseen = [x for x in labels if x[0] >= 200]
    assert np.mean([got[i].toxic == bool(t) for i, _, t in unseen]) > 0.97
    assert all(got[i].expression.startswith("xurk") for i, _, t in unseen if t)


def kneser_ney(grams, order, shared):
    """p(class, context, character) by the definition, from {n-gram: (ordinary, toxic)}."""
    levels = {order: {g: tuple(n) for g, n in grams.items()}}
    for k in range(order, 0, -1):
        if k <= shared:
            levels[k] = {g: (sum(n),) * 2 if k == order else (n[0],) * 2 for g, n in levels[k].items()}
        if k > 1:
            lower = {}
            for g, n in levels[k].items():
                own = lower.setdefault(g[1:], [0, 0])
                for c in range(2):
                    own[c] += (max(n) if k - 1 <= shared else n[c]) > 0
            levels[k - 1] = lower
    letters = len({g[-1] for g in grams}) + 1
    discount = {}
    for k, own in levels.items():
        for c in range(2):
            n1, n2 = (sum(n[c] == x for n in own.values()) for x in (1, 2))
            discount[k, c] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75

    def p(c, context, char, k=order):
        if not k:
            return 1 / letters
        context = context[len(context) - k + 1 :] if k > 1 else ""
        own = {g: n[c] for g, n in levels[k].items() if g[:-1] == context}
        total, kinds, d = sum(own.values()), sum(n > 0 for n in own.values()), discount[k, c]
        below = p(c, context, char, k - 1)
        return below if not total else max(own.get(context + char, 0) - d, 0) / total + d * kinds / total * below

    return p


def test_likelihoods_by_definition(spark):
    rng = random.Random(3)
    counts = {}
    for c in (0, 1):
        for _ in range(30):
            word = "".join(rng.choice("abc"[: 2 + c] + "é") for _ in range(rng.randint(1, 5)))
            for g in grams_of(word, 3):
                counts.setdefault(g, [0, 0])[c] += rng.randint(1, 2)
    for shared in (1, 2):
        p = kneser_ney(counts, 3, shared)
        model = build(spark.createDataFrame([(g, *n) for g, n in counts.items()], "g string, o long, t long"), 3, shared)
        words = ["ab", "b", "zzz", "cab", "éa", "aabb"]
        got, length = model.log_likelihoods(words)
        for w, row, n in zip(words, got, length):
            own = START * 2 + w + END
            want = [sum(np.log(p(c, own[i - 2 : i], own[i])) for i in range(2, len(own))) for c in range(2)]
            assert np.allclose(row, want, rtol=1e-4) and n == len(w) + 1
        for context in ("\x02a", "ab", "zz"):
            assert np.isclose(sum(p(1, context, x) for x in "abcé" + END), 1 - p(1, context, "?"), atol=0.2)


def test_a_model_too_large_is_refused(spark):
    with pytest.raises(ValueError):
        build(spark.createDataFrame([(g, 1, 0) for g in grams_of("abcdefgh")], "g string, o long, t long"), max_bytes=64)


def test_thresholds():
    scores, toxic = np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 0, 1, 1, 1])
    assert best_cut(scores, toxic) == pytest.approx(0.15)
    assert best_cut(scores, toxic * 0) == float("inf")
    assert best_cut(np.array([0.1, 0.4]), np.array([0, 1])) == 0.25
    noise = np.array([0.9, 0.8, 0.1, 0.2, 0.3])
    at, cut, own = settle(np.stack([noise, scores], axis=1), np.zeros(5, int), toxic)
    assert (at, own) == (1, {}) and cut == pytest.approx(0.15)


def test_every_labelled_document_teaches_and_settles(spark, make_docs, corpus, monkeypatch):
    rows, labels = corpus
    seen = []
    monkeypatch.setattr(whole, "settle", lambda scores, classes, toxic: seen.append((scores, toxic)) or settle(scores, classes, toxic))
    told = spark.createDataFrame(labels[:60], LABELS)
    judge = train(make_docs(rows), told)
    known = set(judge.model.levels[-1].grams.tolist())
    for _, text in rows[:60]:
        grams = [g for w in text.lower().split() for g in grams_of(w)]
        assert set(whole._suffix_hashes(whole._codes(grams, 5))[5].tolist()) <= known
    ((scores, toxic),) = seen
    assert scores.shape == (60, len(SHARES)) and toxic.sum() == sum(x[2] for x in labels[:60])
    apart = train(make_docs(rows), told, driver_rows=0)
    assert (apart.share, apart.cut, apart.by_class) == (judge.share, judge.cut, judge.by_class)


def test_a_model_built_apart_as_on_the_driver(spark):
    rng = random.Random(5)
    counts = {g: (rng.randint(0, 3), rng.randint(0, 2)) for _ in range(60) for g in grams_of("".join(rng.choice("abcé𝒳") for _ in range(rng.randint(1, 6))))}
    df = spark.createDataFrame([(g, *n) for g, n in counts.items() if any(n)], "g string, o long, t long")
    here, apart = build(df), build(df, driver_grams=0)
    assert (here.letters, here.order) == (apart.letters, apart.order)
    for a, b in zip(here.levels, apart.levels, strict=True):
        assert (a.grams == b.grams).all() and (a.contexts == b.contexts).all()
        assert np.allclose(a.share, b.share, rtol=1e-6) and np.allclose(a.weight, b.weight, rtol=1e-6)


def test_scores_settled_apart_as_together(spark):
    rng = np.random.default_rng(4)
    toxic = rng.integers(0, 2, 400)
    scores = np.round(rng.normal(size=(400, len(SHARES))) * 0.01 + 0.02 * toxic[:, None] * rng.uniform(0, 1, len(SHARES)), 4)
    classes = rng.choice([0, 1, 2, 3], 400, p=[0.5, 0.4, 0.05, 0.05])
    kind = "toxic long, c int, s array<double>"
    for at in (slice(None), slice(0, 90), slice(0, 5)):
        for t in (toxic[at], toxic[at] * 0, toxic[at] * 0 + 1):
            df = spark.createDataFrame(list(zip(t.tolist(), classes[at].tolist(), scores[at].tolist())), kind)
            assert settle_apart(df) == settle(scores[at], classes[at], t)
    assert settle_apart(spark.createDataFrame([], kind)) == (0, float("inf"), {})


def test_large_ids_beside_null(spark, make_docs, corpus):
    rows, labels = corpus
    big = 9007199254740993
    docs = make_docs([(None, "some words"), (big, "other words"), *rows[:30]])
    told = spark.createDataFrame(labels[:30] + [(big, 1, 0), (None, 1, 1)], LABELS)
    assert big in {r.doc_id for r in toxicity(docs, told).collect()}
    with pytest.raises(TypeError):
        toxicity(spark.createDataFrame([("a", "b")], "doc_id string, text string"), told)


def test_odd_rows(spark, odd_docs, make_docs, corpus):
    rows, labels = corpus
    odd = [(None, 1, 1), (1, None, None), (2, 0, 1), (3, 1, 0), (4, 1, 0), (4, 1, 1), (0, 1, 1)]
    told = spark.createDataFrame(labels + odd, LABELS)
    both = odd_docs.unionByName(make_docs([(i + 1000, t) for i, t in rows[:20]]))
    got = toxicity(both, told).collect()
    assert len(got) == odd_docs.count() + 20
    blank = [r for r in got if r.doc_id in (1, 2, 3)]
    assert len(blank) == 3 and all(r.n_words == 0 and r.score is None and not r.toxic for r in blank)
    none = spark.createDataFrame([], LABELS)
    assert not any(r.toxic for r in toxicity(odd_docs, none).collect())
    assert toxicity(odd_docs.limit(0), told).collect() == []
    clash = spark.createDataFrame([(1, "a b", "x", 1)], "doc_id long, text string, toxic string, _d int")
    assert toxicity(clash, told).columns == ["doc_id", "n_words", "mean_ratio", "score", "expression", "toxic"]


def test_words_of_null_texts_and_repeated_ids_equal_the_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "good words here"), (1, "bad words there"), (2, None), (None, "no id"), (3, ""), (4, "7 8"), (5, "\u00c9t\u00e9")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (4, 1, 1), (5, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = whole.words_query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(con.execute(whole.WORDS_ORACLE).fetchall(), key=repr)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
