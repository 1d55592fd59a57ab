import random
from collections import Counter, defaultdict
from functools import lru_cache

from glyphsift.llm.packing import best_fit, dominance_reduction, pack, plan_bins


def optimum(sizes, capacity):
    """Fewest bins, by exhaustive search over placements of the pieces in order."""

    @lru_cache(None)
    def least(rest, rooms):
        if not rest:
            return 0
        s, out = rest[0], 1 + least(rest[1:], tuple(sorted((*rooms, capacity - rest[0]))))
        for i, r in enumerate(rooms):
            if r >= s and (not i or rooms[i - 1] != r):
                out = min(out, least(rest[1:], tuple(sorted((*rooms[:i], r - s, *rooms[i + 1 :])))))
        return out

    return least(tuple(sorted(sizes, reverse=True)), ())


def one_by_one(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    for _ in range(250):
        capacity = rng.randint(8, 24)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, left = dominance_reduction(dict(Counter(sizes)), capacity)
        used = Counter()
        for pattern, n in fixed:
            assert sum(s * k for s, k in pattern) <= capacity
            for s, k in pattern:
                used[s] += k * n
        assert used + Counter(left) == Counter(sizes)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + optimum(rest, capacity) == optimum(sizes, capacity)


def test_best_fit_equals_one_by_one():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.randint(5, 60)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        bins = best_fit(dict(Counter(sizes)), capacity)
        assert sorted(capacity - sum(s * k for s, k in p) for p, n in bins for _ in range(n)) == one_by_one(sizes, capacity)


def check(rows, want, capacity):
    bins, whole = defaultdict(list), Counter()
    for r in rows:
        bins[r.bin_id].append((r.bin_offset, r.tokens))
        whole[r.doc_id] += r.tokens
    assert whole == want
    for own in bins.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end and n > 0
            end += n
        assert end <= capacity
    assert set(bins) == set(range(len(bins)))
    return len(bins)


def test_every_token_has_one_place(make_docs, prose):
    rng = random.Random(5)
    sizes = [rng.randint(1, 90) for _ in range(300)]
    rows = pack(make_docs([(i, prose(i, n)) for i, n in enumerate(sizes)]), capacity=40).collect()
    n = check(rows, Counter(dict(enumerate(sizes))), 40)
    assert n == plan_bins(dict(Counter(r.tokens for r in rows)), 40)[2]
    assert n <= sum(sizes) / 40 * 1.05 + 1


def test_odd_rows(odd_docs, spark):
    rows = pack(odd_docs).collect()
    want = Counter({4: 180, None: 120, 5: 60_000, 6: 60_000, 7: 1, 8: 1})
    check(rows, want, 2048)
    assert pack(odd_docs.limit(0)).collect() == []
    clash = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, bin_id int, _s int")
    assert [tuple(r) for r in pack(clash).collect()] == [(1, 0, 2, 0, 0)]
    import pytest

    with pytest.raises(ValueError):
        pack(odd_docs, capacity=0)
