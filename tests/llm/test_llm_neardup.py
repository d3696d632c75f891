import random
from collections import defaultdict

import pytest

from acervo.llm import neardup


def brute(rows, k, percent):
    """doc_id → smallest id reachable, comparing every two documents."""
    sets = defaultdict(list)
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        own = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        if doc_id is not None:
            sets[doc_id].append(own)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in ids}


def corpus(seed, copies):
    """A base text in many edits, whose likeness to each other runs from far below to above the threshold, and strangers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(copies):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, 12])):
            own[rng.randrange(len(own))] = word()
        rows.append((i * 3 + 5, " ".join(own)))
    rows += [(10_000 + i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_components_equal_brute_force(spark, k, percent, seed, monkeypatch):
    monkeypatch.setattr(neardup, "OUTSIDE", 7)  # many blocks on a small table
    monkeypatch.setattr(neardup, "INSIDE", 16)
    monkeypatch.setattr(neardup, "CHUNK", 5)
    rows = corpus(seed, 130)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    want = brute(rows, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)
    assert len(set(want.values())) > 45


def test_edge_rows(spark):
    rows = [(1, "Un dos Tres"), (2, "un dos tres"), (3, None), (4, ""), (5, " \n\t"), (6, "one two"), (7, "ONE two"), (7, "ONE two"),
            (None, "un dos tres"), (8, "x " * 50_000), (9, "x " * 40_000), (10, "w0 w1 w2 w3"), (11, "other words in here"), (11, "w0 w1 w2 w3")]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, rep string, root long")
    got = neardup.near_duplicates(df, 3, 85).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"]): r for r in got}
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)] == [1, 1, 3, 4, 5, 6, 6, 8, 8, 10, 10]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[4]["n_shingles"] == 0 and by[6]["n_shingles"] == 1 and by[8]["n_shingles"] == 1
    kept = neardup.deduplicated(df, 3, 85)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 10]
    assert neardup.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_every_coordinate_is_filled():
    import numpy as np

    sets = [np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (1, 2, 300, 5000)]
    sketch = neardup.sketches(np.concatenate(sets), np.array([len(s) for s in sets]), 252)
    assert (sketch != neardup.EMPTY).all()
    a, b = sets[3][:4000], sets[3][1000:]  # Jaccard 0.6
    both = neardup.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]), 252)
    assert abs((both[0] == both[1]).mean() - 0.6) < 0.12
