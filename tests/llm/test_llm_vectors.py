import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.llm import vectors
from acervo.llm.hnsw import Graph


def brute(rows, cosine):
    """One (vec_id, n_links, component_id, kept) per row, comparing every two rows."""
    unit = []
    for vec_id, e in rows:
        fine = vec_id is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
        unit.append(np.array(e) / np.linalg.norm(e) if fine else None)
    like = [[i != j and u is not None and v is not None and len(u) == len(v) and float(u @ v) >= cosine for j, v in enumerate(unit)] for i, u in enumerate(unit)]
    root = {vec_id: vec_id for vec_id, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, _) in enumerate(rows):
        for j in np.flatnonzero(like[i]):
            low, high = sorted((find(a), find(rows[j][0])))
            root[high] = low
    return sorted(((i, sum(own), find(i) if i is not None else None, i is None or find(i) == i) for (i, _), own in zip(rows, like)), key=repr)


def corpus(seed, length=24):
    """Strangers, tight groups, groups spread around the threshold, exact and scaled copies."""
    rng = np.random.default_rng(seed)
    at = [rng.standard_normal(length) for _ in range(150)]
    for spread, size in ((0.02, 90), (0.05, 60), (0.066, 70), (0.085, 50)):
        middle = rng.standard_normal(length)
        middle /= np.linalg.norm(middle)
        at += [middle + spread * rng.standard_normal(length) for _ in range(size)]
    at += [at[200]] * 25 + [3 * at[3], at[4]]
    ids = rng.permutation(2 * len(at))[:len(at)]
    return [(int(i), v.tolist()) for i, v in zip(ids, at)]


@pytest.mark.parametrize(("seed", "shards"), [(1, 1), (2, 5)])
def test_links_and_components_equal_brute_force(spark, seed, shards, monkeypatch):
    monkeypatch.setattr(vectors, "MEMBERS", 7)  # many blocks on a small table
    monkeypatch.setattr(vectors, "PAIRS", 2)
    monkeypatch.setattr(vectors, "QUERIES", 40)
    rows = corpus(seed)
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=shards)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 0.95)


def test_beam_widens_until_the_audit_passes():
    rng = np.random.default_rng(5)
    middle = rng.standard_normal(16)
    crowd = middle / np.linalg.norm(middle) + 0.05 * rng.standard_normal((400, 16))
    crowd = np.concatenate([crowd, rng.standard_normal((800, 16))])
    crowd /= np.linalg.norm(crowd, axis=1)[:, None]
    graph = Graph(16)
    graph.add(crowd)
    reach = vectors.Reach(graph, 0.0)
    asked, least = crowd.astype(np.float32), np.full(len(crowd), np.float32(0.9))
    reach.audit(asked, least, float(np.arccos(0.9)))
    q, node = reach.search(asked, least, reach.beam)
    there = (asked @ graph.vectors.T >= 0.9)
    assert there[q, node].all() and len(set(zip(q, node))) == len(q) >= 0.99 * there.sum()


def test_edge_rows(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(5, v), (5, [0.0, 0.0, 1.0]), (9, [0.0, 0.0, 2.0]), (3, v), (3, v), (None, v), (20, None), (21, []), (22, [0.0, 0.0, 0.0]), (23, [1.0, None, 2.0]),
            (24, [float("nan"), 1.0, 1.0]), (25, [float("inf"), 1.0, 1.0]), (26, [1.0, 2.0]), (27, [2.0, 4.0]), (28, [1e200, 2e200, 0.0]), (29, [1e-200, 2e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("vec", F.lit("x")).withColumn("n_links", F.lit(0))
    got = sorted(map(tuple, vectors.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 4, 3, False), (5, 1, 3, False), (9, 1, 3, False), (3, 4, 3, True), (3, 4, 3, True), (None, 0, None, True), *[(i, 0, i, True) for i in (20, 21, 22, 23, 24, 25)],
                          (26, 1, 26, True), (27, 1, 26, False), (28, 4, 3, False), (29, 4, 3, False)], key=repr)
    assert vectors.near_duplicates(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        vectors.near_duplicates(df, cosine=0.0)


def test_shards_cheaper_to_compare_whole_are_not_walked(monkeypatch):
    """F1 of round 4: a beam that costs more than all nodes of a shard is the whole shard, and nothing in reach is missed."""
    rng = np.random.default_rng(6)
    nodes = rng.standard_normal((700, 16))
    nodes[:300] = nodes[0] + 0.05 * rng.standard_normal((300, 16))
    nodes /= np.linalg.norm(nodes, axis=1)[:, None]
    graph = Graph(16)
    graph.add(nodes)
    asked, least = nodes.astype(np.float32), np.full(700, np.float32(0.9))
    there = set(zip(*np.nonzero(asked @ graph.vectors.T >= 0.9)))
    walks = []
    monkeypatch.setattr(graph, "search", lambda *given: walks.append(given) or Graph.search(graph, *given))
    reach = vectors.Reach(graph, 0.0)
    reach.audit(asked, least, float(np.arccos(0.9)))
    assert set(zip(*reach.search(asked, least, reach.beam))) == there and not walks
    monkeypatch.setattr(vectors, "WALK", 1)  # a shard too large for that is walked, with the same audit
    reach = vectors.Reach(graph, 0.0)
    reach.audit(asked, least, float(np.arccos(0.9)))
    assert len(set(zip(*reach.search(asked, least, reach.beam))) & there) >= 0.99 * len(there) and walks
