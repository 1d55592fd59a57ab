import random

import numpy as np
import pytest

from glyphsift.llm import language_id as lid

SYLLABLES = {"aa": ["the", "ing", "ou", "wh", "and"], "bb": ["cht", "sch", "ü", "ung", "ei"], "cc": ["eau", "é", "ment", "oi", "que"]}


def text(lang, seed, words=30):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def model():
    train = [(text(lang, i), lang) for i in range(40) for lang in SYLLABLES]
    return lid.fit([t for t, _ in train], [n for _, n in train], steps=60)


def test_held_out_accuracy(model):
    held = [(text(lang, 1000 + i, 5 + i), lang) for i in range(40) for lang in SYLLABLES]
    length, total, labels = lid.identify(model, [t for t, _ in held])
    assert np.mean([model.names[k] == lang for k, (_, lang) in zip(total.argmax(axis=1), held)]) > 0.97
    assert (length == [len(t.encode()) for t, _ in held]).all() and (labels.sum(axis=1) == length).all()
    assert np.allclose(total.sum(axis=1), length, rtol=1e-4)


def test_fast_inference_equals_the_trained_network(model):
    x = lid._windows(text("aa", 5, 200).encode())
    slow = lid._run(model.ahead, x.T), lid._run(model.back, x.T[::-1])
    h = np.concatenate([np.stack([s[5] for s in slow[0]]), np.stack([s[5] for s in slow[1]])[::-1]], axis=2)
    p = np.exp(h @ model.w + model.c)
    p /= p.sum(axis=2, keepdims=True)
    assert np.allclose(lid.position_probabilities(model, x), p.transpose(0, 2, 1), atol=1e-4)


def test_bytes_see_their_neighbours_across_windows(model):
    data = [text("bb", 7, 120).encode(), b"", b"x", text("aa", 8, 90).encode()]
    x, owner, valid = lid._in_context(data)
    for i, own in enumerate(data):
        rows = np.flatnonzero(owner == i)
        assert b"".join(x[r, lid.CONTEXT : lid.CONTEXT + valid[r]].tobytes() for r in rows) == own
        for a, b in zip(rows, rows[1:]):
            assert (x[a, -lid.CONTEXT :] == x[b, lid.CONTEXT : 2 * lid.CONTEXT]).all() and (x[b, : lid.CONTEXT] == x[a, -2 * lid.CONTEXT : -lid.CONTEXT]).all()
    whole = lid.position_probabilities(model, np.frombuffer(data[0], dtype=np.uint8)[None, :])[:, :, 0]
    parts = np.concatenate([lid.position_probabilities(model, x[r : r + 1])[lid.CONTEXT : lid.CONTEXT + valid[r], :, 0] for r in np.flatnonzero(owner == 0)])
    assert (whole.argmax(axis=1) == parts.argmax(axis=1)).mean() > 0.97


def test_large_ids_beside_null(spark, model):
    big = 9007199254740993
    docs = spark.createDataFrame([(None, "the and"), (big, "eau ment")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in lid.language_id(docs, model).collect()} == {None, big}


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    d = lid.Direction(rng.normal(0, 0.2, (256, 24)), rng.normal(0, 0.2, (8, 24)), rng.normal(0, 0.1, 24))
    x, weight = rng.integers(0, 256, (6, 3)), rng.normal(size=(6, 3, 8))
    loss = lambda: sum((s[5] * weight[t]).sum() for t, s in enumerate(lid._run(d, x)))
    grads = lid._unroll(d, x, lid._run(d, x), weight)
    for array, grad in zip((d.e, d.u, d.b), grads):
        for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(5)] + ([(x[2, 1], 3)] if array is d.e else []):
            old = array[at]
            array[at] = old + 1e-6
            up = loss()
            array[at] = old - 1e-6
            assert np.isclose((up - loss()) / 2e-6, grad[at], atol=1e-4)
            array[at] = old


def test_odd_rows(spark, odd_docs, model):
    got = lid.language_id(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [tuple(by[i][0])[1:] for i in (1, 2)] == [("und", None, 0, None)] * 2
    assert by[5][0].n_bytes > 100_000 and by[5][0].language == by[6][0].language
    assert {r.language for r in lid.language_id(odd_docs, None).collect()} == {"und"}
    assert lid.train(odd_docs.limit(0)) is None and lid.language_id(odd_docs.limit(0), model).collect() == []
    assert lid.train(odd_docs.where("lang is null")) is None
    clash = spark.createDataFrame([("a", "the and", 1, "x")], "doc_id string, text string, language int, _i string")
    assert lid.language_id(clash, model).columns == ["doc_id", "language", "probability", "n_bytes", "label_share"]


def test_share():
    assert lid.share({"aa": 3000, "bb": 900, "cc": 5}, 2000) == {"aa": 1095, "bb": 900, "cc": 5}
    assert lid.share({"aa": 7, "bb": 3}, 2000) == {"aa": 7, "bb": 3}
    assert lid.share({"aa": 7, "bb": 3, "cc": 1}, 2) == {"aa": 1, "bb": 1, "cc": 1}


def test_every_language_is_learned(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(lid, "fit", lambda texts, names: seen.update(texts=texts, names=names) or sorted(set(names)))
    rows = [(text("aa", i), "aa") for i in range(300)] + [(text("bb", i), "bb") for i in range(40)] + [(text("cc", 1), "cc")] * 3
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert lid.train(df) == ["aa", "bb", "cc"]
    assert sorted(zip(seen["texts"], seen["names"])) == sorted(set(rows))
    assert lid.train(df.sort("lang").coalesce(1), rows=90) == ["aa", "bb", "cc"]
    assert [seen["names"].count(n) for n in SYLLABLES] == [49, 40, 1]
    first = seen.copy()
    lid.train(df.repartition(7), rows=90)
    assert seen == first
