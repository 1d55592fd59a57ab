import random

import numpy as np

from glyphsift.llm.minhash_dedup import components, drop_duplicates, near_groups, prob_minhash, probability_jaccard, shingles, word_hashes


def exact(a, b):
    """Probability Jaccard by its definition, of two dictionaries of weights."""
    keys = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in keys) for d in a.keys() & b.keys())


def weights(text):
    d, v, w, _ = shingles([text])
    return dict(zip(v.tolist(), w.tolist()))


def test_similarity_by_definition():
    rng = random.Random(0)
    for _ in range(100):
        a, b = ({rng.randint(0, 12): rng.randint(1, 4) for _ in range(rng.randint(1, 9))} for _ in range(2))
        pack = lambda x: (np.array(sorted(x), dtype=np.uint32), np.array([x[k] for k in sorted(x)]))
        assert np.isclose(probability_jaccard(pack(a), pack(b)), exact(a, b))


def test_only_what_takes_a_register_is_sorted(monkeypatch):
    rng, sizes, sort = np.random.default_rng(2), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (sizes.append(len(keys[0])), sort(keys))[1])
    value, doc = np.sort(rng.integers(0, 1 << 62, 20_000).astype(np.uint64)), np.zeros(20_000, dtype=np.int64)
    sign = prob_minhash(doc, value, np.ones(20_000, dtype=np.int64), 1)
    assert np.isin(sign, value).all() and sign.shape == (1, 192) and max(sizes) <= 192
    order = rng.permutation(20_000)
    assert (prob_minhash(doc, value[order], np.ones(20_000, dtype=np.int64), 1) == sign).all()


def test_registers_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    rest = rng.integers(0, 1 << 62, (2, 30)).astype(np.uint64)
    docs = [np.sort(np.concatenate([both, r])) for r in rest]
    w = [(x % np.uint64(5)).astype(int) + 1 for x in docs]
    sign = prob_minhash(np.repeat([0, 1], 90), np.concatenate(docs), np.concatenate(w), 2, 4096)
    want = exact(*({int(k): int(n) for k, n in zip(d, x)} for d, x in zip(docs, w)))
    assert abs((sign[0] == sign[1]).mean() - want) < 0.03
    alone = prob_minhash(np.zeros(1, int), both[:1], np.ones(1, int), 1, 64)
    assert (alone == both[0]).all()


def test_hashes_depend_on_words_alone():
    a, _ = word_hashes("über one, two".encode())
    b, _ = word_hashes("x two. über; one".encode())
    assert a[0] == b[2] and a[1] == b[3] and a[2] == b[1] and len(set(a.tolist())) == 3
    whole = "a" * ((1 << 20) + 5)
    assert len(word_hashes((whole + " b").encode())[0]) == 2
    text = "some words that fill a slice of their own " * 30_000
    _, v1, w1, k1 = shingles([text])
    _, v2, w2, k2 = shingles(["else", text])
    assert set(v1) <= set(v2) and (k1[0] == k2[1]).all()


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in text.split(" "))


def test_groups_equal_brute_force(make_docs, prose):
    docs, n = [], 0
    for g in range(25):
        base = prose(g, 120, 1000)
        for c in range(1 + g % 6):
            docs.append((n, edited(base, [0, 0.02, 0.05, 0.12, 0.3][(c + g) % 5], n)))
            n += 1
    w = {i: weights(t) for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(i):
        return i if root[i] == i else find(root[i])

    pairs = {(i, j) for i in w for j in w if i < j and exact(w[i], w[j]) >= 0.5}
    for i, j in sorted(pairs):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in root if sum(find(j) == find(i) for j in root) > 1}
    got = {r.doc_id: r.group_id for r in near_groups(make_docs(docs)).collect()}
    found = {(i, j) for i, j in pairs if got.get(i) is not None and got.get(i) == got.get(j)}
    assert len(found) >= 0.95 * len(pairs)
    assert {i for i in got} <= set(want) and all(want[i] == want[g] for i, g in got.items())
    kept = {r.doc_id for r in drop_duplicates(make_docs(docs)).collect()}
    assert kept == {i for i in root if got.get(i, i) == i}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r._n: r._root for r in components(spark.createDataFrame(edges, "_a long, _b long")).collect()}
    assert got == root


def test_odd_rows(odd_docs, spark):
    rows = near_groups(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.group_id or 0, r.kept) for r in rows) == [(0, 0, False), (0, 0, True), (4, 4, False), (4, 4, True), (5, 5, True), (6, 5, False)]
    kept = drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert near_groups(odd_docs.limit(0)).collect() == [] and drop_duplicates(odd_docs.limit(0)).collect() == []
    clash = spark.createDataFrame([(1, "a b", 2, 3, 4), (2, "a b", 2, 3, 4)], "doc_id long, text string, _d int, _kept int, _T int")
    assert [tuple(r) for r in drop_duplicates(clash).collect()] == [(1, "a b", 2, 3, 4)]


def test_scripts_without_spaces(make_docs):
    rng = random.Random(6)
    text = "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(240))
    other = "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(240))
    got = {r.doc_id: r.group_id for r in near_groups(make_docs([(1, text), (2, text[:100] + "新" + text[101:]), (3, other)])).collect()}
    assert got == {1: 1, 2: 1}


def test_the_kept_row_gathers_its_group(make_docs, prose):
    docs = [(1, prose(1), "en", "b"), (2, prose(1), "en", "a"), (3, prose(1), "en", None), (4, prose(4), "en", "c"), (5, prose(5), "en", None), (6, prose(5), "en", "")]
    kept = {r.doc_id: r.source for r in drop_duplicates(make_docs(docs), gather="source", separator="|").collect()}
    assert kept == {1: "a|b", 4: "c", 5: None}


def test_unlike_members_of_a_bucket_are_not_all_compared(spark, make_docs, prose, monkeypatch):
    """Copies of a leader and texts half like it share buckets; all groups are still those of all pairs."""
    from glyphsift.llm import minhash_dedup as md

    seen = []
    real = md._verified
    monkeypatch.setattr(md, "_verified", lambda pairs, blobs, name: seen.append(pairs.count()) or real(pairs, blobs, name))
    base = prose(1, 200, 1000)
    docs = [(i, edited(base, 0.004, i)) for i in range(60)] + [(100 + i, " ".join(base.split(" ")[:60]) + " " + prose(f"o{i}", 260, 1000)) for i in range(40)]
    got = {r.doc_id: r.group_id for r in near_groups(make_docs(docs)).collect()}
    assert got == dict.fromkeys(range(60), 0)
    assert sum(seen) < 100 * 99 / 2


def test_odd_ids_are_refused(spark):
    import pytest

    with pytest.raises(TypeError):
        near_groups(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(Exception, match="stands for null"):
        near_groups(spark.createDataFrame([((1 << 63) - 1, "b c d")], "doc_id long, text string")).collect()
