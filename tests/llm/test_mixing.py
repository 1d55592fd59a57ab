import itertools
import random
from collections import Counter, defaultdict

import time

import pytest

from glyphsift.llm.mixing import SEPARATOR, mix, mixed_documents, quotas, route


def cost(flow, capacity):
    out = 0
    for p, n in capacity.items():
        used = sum(f for (q, _), f in flow.items() if q == p)
        for e in range(10):
            out += min(max(used - e * n, 0), n) * e * (e + 1) // 2
    return out


def test_flow_is_least_cost():
    rng = random.Random(0)
    for _ in range(40):
        sources = ["a", "b"]
        capacity = {p: rng.randint(0, 4) for p in (("a",), ("b",), ("a", "b"))}
        quota = {s: rng.randint(0, 7) for s in sources}
        flow = route(capacity, quota, 2)
        best = None
        for x in itertools.product(range(9), repeat=4):
            f = {(("a",), "a"): x[0], (("b",), "b"): x[1], (("a", "b"), "a"): x[2], (("a", "b"), "b"): x[3]}
            if any(sum(v for (q, _), v in f.items() if q == p) > 2 * n for p, n in capacity.items()) or any(sum(v for (_, t), v in f.items() if t == s) > quota[s] for s in sources):
                continue
            key = (-sum(x), cost(f, capacity))
            best = key if best is None else min(best, key)
        assert (-sum(flow.values()), cost(flow, capacity)) == best


def test_flow_with_detours():
    """Three sources and many patterns: as much flow as possible, each epoch's flow a largest one, checked by augmenting paths."""
    rng = random.Random(2)
    for _ in range(60):
        names = "abcd"
        capacity = {p: rng.randint(1, 9) for p in {tuple(sorted(rng.sample(names, rng.randint(1, 3)))) for _ in range(5)}}
        quota = {s: rng.randint(0, 25) for s in names}
        for epochs in (1, 2, 3):
            flow = route(capacity, quota, epochs)
            sent = Counter()
            for (p, s), n in flow.items():
                assert s in p and n > 0
                sent[p] += n
            assert all(n <= epochs * capacity[p] for p, n in sent.items())
            assert all(sum(n for (_, t), n in flow.items() if t == s) <= q for s, q in quota.items())
            # By Hall: the most that can flow is the least, over sets of sources, of their quotas and the rest's supply.
            least = min(sum(quota[s] for s in chosen) + sum(epochs * n for p, n in capacity.items() if not set(p) <= set(chosen)) for k in range(5) for chosen in itertools.combinations(names, k))
            assert sum(sent.values()) == least
            if epochs > 1:
                assert cost(flow, capacity) == min_cost(capacity, quota, epochs)


def min_cost(capacity, quota, epochs):
    """Epoch by epoch: what more flows with e passes than with e - 1 costs e(e - 1)/2 a token."""
    most = [0]
    for e in range(1, epochs + 1):
        most.append(sum(route(capacity, quota, e).values()))
    return sum((most[e] - most[e - 1]) * e * (e - 1) // 2 for e in range(1, epochs + 1))


def test_many_patterns_are_routed_in_time():
    rng = random.Random(1)
    names = [f"s{i}" for i in range(40)]
    capacity = {tuple(sorted(rng.sample(names, rng.randint(1, 5)))): rng.randint(1, 1000) for _ in range(20_000)}
    total = sum(capacity.values())
    began = time.perf_counter()
    flow = route(capacity, quotas({s: i + 1 for i, s in enumerate(names)}, total))
    assert time.perf_counter() - began < 30 and sum(flow.values()) == total


def test_documents_are_those_of_the_mixture(spark, make_docs, prose):
    sources = ["a", "b", f"a{SEPARATOR}b", None, "", f"b{SEPARATOR}c{SEPARATOR}a"]
    docs = [(i, prose(i, 5 + i % 40), "en", sources[i % 6]) for i in range(240)]
    docs += [(1000 + i, prose(i, 5 + i % 40), "en", "c") for i in range(0, 240, 10)] + docs[:12] + [(None, prose(7, 12), "en", "a"), (3, None, "en", "a"), (4, " ", "en", "b")]
    df = make_docs(docs)
    for weights, budget in ((None, None), ({"a": 5, "b": 1, "c": 2}, 9000), ({"a": 1}, 50)):
        want = Counter((r.doc_id, r.source) for r in mix(df, weights, budget).collect())
        got = Counter((r.doc_id, r.source) for r in mixed_documents(df, weights, budget).collect())
        assert got == want and want
    assert mixed_documents(df).columns == df.columns
    with pytest.raises(ValueError):
        mix(df, max_epochs=0)


def test_quotas_add_up():
    assert sum(quotas({"a": 1, "b": 1, "c": 1}, 100).values()) == 100
    assert quotas({"a": 0, "b": 0}, 10) == {"a": 0, "b": 0}


def test_targets_are_met(make_docs, prose):
    docs = [(i, prose(i, 20), "en", "a" if i % 4 else "b") for i in range(200)] + [(1000 + i, prose(i, 20), "en", "b") for i in range(1, 40, 4)]
    rows = mix(make_docs(docs), {"a": 1, "b": 1}, budget=3200).collect()
    got = Counter()
    for r in rows:
        got[r.source] += r.tokens
    assert all(abs(got[s] - 1600) <= 3 * 20 for s in "ab")
    assert max(r.epoch for r in rows) <= 2
    assert not {r.doc_id for r in rows} & {1000 + i for i in range(1, 40, 4)}  # one row stands for a text
    epochs = defaultdict(set)
    for r in rows:
        assert r.epoch not in epochs[r.doc_id]
        epochs[r.doc_id].add(r.epoch)
    assert all(e == set(range(1, len(e) + 1)) for e in epochs.values())
    again = mix(make_docs(docs[::-1]), {"a": 1, "b": 1}, budget=3200).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_rows(odd_docs, spark):
    rows = mix(odd_docs, {"a": 1.0, "b": 1.0}).collect()
    assert {r.doc_id for r in rows} == {5}  # the only text with sources, in both
    assert mix(odd_docs.limit(0)).collect() == []
    assert mix(odd_docs, {"nowhere": 1.0}).collect() == []
    clash = spark.createDataFrame([(1, "a b", "s", 1, 2)], "doc_id long, text string, source string, tokens int, _p int")
    assert [(r.doc_id, r.source, r.epoch, r.tokens) for r in mix(clash).collect()] == [(1, "s", 1, 2)]
