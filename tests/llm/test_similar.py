"""Near duplicates by exact shingle similarity, against all pairs."""

import random

import pytest

from tests.llm.conftest import make


def brute(rows, t=0.8):
    """Ids that stay: the least of each component of texts with five-word Jaccard of t or more."""
    sets = []
    for i, x, *_ in rows:
        w = (x or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x == y or len(x & y) >= t * len(x | y) - 1e-9:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return {least.get(find(k)) for k in range(len(sets))}


@pytest.fixture(scope="module")
def near():
    """Texts and copies of them with one to ten words changed, chains of copies, and one passage in many texts."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    common, rows = [word() for _ in range(60)], []
    for g in range(12):
        t = [word() for _ in range(r.randint(60, 200))] + (common if g % 2 else [])
        for k in range(8):
            rows.append(" ".join(t))
            t = list(t) if k % 2 else t[:]
            for _ in range(r.randint(1, 10)):
                t[r.randrange(len(t))] = word()
    r.shuffle(rows)
    return [(i, t, "en", "s") for i, t in enumerate(rows)]


def test_stage_keeps_one_of_each_similar_group(spark, docs, rows, near):
    import corpus_pipeline

    for d, x in ((make(spark, near).repartition(3), near), (docs, rows)):
        out = corpus_pipeline.near_dedup(spark, d, None)
        assert out.columns == d.columns
        ids = [r.doc_id for r in out.collect()]
        assert len(ids) == len(set(ids)) and set(ids) == brute(x)
    assert 12 < len(brute(near)) < 90


def test_bounds_dismiss_no_similar_pair():
    import numpy as np

    from weftlake.llm.similar import may_reach, parities, prefix

    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 400))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < r.uniform(0.7, 1)], r.integers(0, 1 << 63, int(r.integers(0, n // 6 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both >= 0.8 * (len(x) + len(y) - both):
            keys = np.sort(x[: len(x) // 3])
            heavy = keys, np.arange(len(keys))[::-1]
            assert may_reach(parities(x), parities(y), len(x), len(y), 0.8)
            assert len(np.intersect1d(prefix(x, heavy, 0.8), prefix(y, heavy, 0.8)))
