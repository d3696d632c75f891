import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.llm import centroids


def brute(rows, count, rounds, length=64, steps=256):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == length and all(x is not None and np.isfinite(x) for x in e):
            kept.append((vec_id, [int(np.floor(x * steps)) for x in e]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middles = [v for _, v in order[:count]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))
    for _ in range(rounds):
        own = [(place(v)[1], v) for _, v in kept]
        middles = [[sum(col) // len(col) for col in zip(*[v for k, v in own if k == c])] if any(k == c for k, _ in own) else m for c, m in enumerate(middles)]
    found = [(vec_id, *place(v)[::-1]) for vec_id, v in kept]
    whole = sum(d for *_, d in found)
    return sorted(((i, c, d, sum(x for _, k, x in found if k == c), whole, hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


@pytest.mark.parametrize(("length", "spread"), [(64, 1.0), (3, 0.02)])
def test_clusters_equal_brute_force(spark, length, spread):
    rng = random.Random(length)
    rows = [(i, [rng.gauss(0, spread) for _ in range(length)]) for i in range(400)]  # the small spread has many ties
    rows += [(rng.randrange(400), rows[5][1]) for _ in range(150)] + [(None, rows[7][1]), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(900, None), (901, []), (902, rows[0][1][:-1]), (903, [None] + rows[0][1][1:]), (904, [float("nan")] + rows[0][1][1:]), (905, [float("inf")] + rows[0][1][1:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("vector", F.lit(1)).withColumn("cluster", F.lit(2))
    got = centroids.clustered(df, 12, 4, length)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 12, 4, length)


def test_nearest_stops_early_and_keeps_ties():
    rng = np.random.default_rng(1)
    middles = np.concatenate([rng.integers(-40, 40, (30, 4)), rng.integers(-40, 40, (30, 4))[:10]]).astype(np.int64)
    middles[35] = middles[3]
    vectors = rng.integers(-60, 60, (5000, 4)).astype(np.int64)
    number, distance = centroids.nearest(vectors, middles)
    every = ((vectors[:, None] - middles[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_edge_tables(spark):
    far = [(1, [1e30] * 64), (2, [0.5] * 64), (3, [0.25] * 64)]
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in centroids.clustered(spark.createDataFrame(far, "vec_id long, embedding array<float>")).collect()}
    assert got[1] == (None, None) and got[2][1] == got[3][1] == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.clustered(empty).count() == 0
    assert centroids.clustered(spark.createDataFrame(far[:1], "vec_id long, embedding array<float>")).count() == 1
