import os
import random

import pytest
from pyspark.sql import functions as F

from acervo.sources import store

SCHEMA = "doc long, nth int, text string, tags map<string,string>"


def rows(spark, items):
    return spark.createDataFrame([(d, n, t, {"t": t}) for d, n, t in items], SCHEMA)


def current(spark, path):
    return sorted((r["doc"], r["nth"], r["text"]) for r in store.read_store(spark, path).collect())


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/base/") for f in names if f.endswith(".parquet")}


@pytest.fixture
def filled(spark, tmp_path):
    path = str(tmp_path / "store")
    items = [(d, n, f"{d}.{n}") for d in range(30) for n in range(4)]
    store.create_store(rows(spark, items), path, key=["doc", "nth"], owner=["doc"], buckets=8)
    return path, items


def test_only_touched_buckets_are_rewritten(spark, filled):
    path, items = filled
    before = files(path)
    touched = store.merge_store(rows(spark, [(3, 1, "new"), (3, 9, "more")]), path)
    after = files(path)
    assert len(touched) == 1
    same = {f for f in before if f"bucket={touched[0]}/" not in f}
    assert same and all(after[f] == before[f] for f in same)
    assert set(after) - set(before) and all(f"bucket={touched[0]}/" in f for f in set(after) - set(before))
    assert current(spark, path) == sorted([i for i in items if i[:2] != (3, 1)] + [(3, 1, "new"), (3, 9, "more")])


def test_old_tail_of_a_shorter_document_goes(spark, filled):
    path, items = filled
    store.add_changes(rows(spark, [(5, 0, "a"), (5, 1, "b")]), path, 0, whole_owner=True)
    store.add_changes(rows(spark, [(6, None, None)]), path, 1, whole_owner=True)  # now without chunks
    store.add_changes(rows(spark, [(5, 3, "late")]), path, 2)
    want = sorted([i for i in items if i[0] not in (5, 6)] + [(5, 0, "a"), (5, 1, "b"), (5, 3, "late")])
    assert current(spark, path) == want  # from the deltas
    store.compact_store(spark, path)
    assert current(spark, path) == want  # from the buckets
    assert store.compact_store(spark, path) == []


def test_batches_are_idempotent_and_tombstones_stay_until_vacuum(spark, filled):
    path, items = filled
    gone = rows(spark, [i for i in items if i[0] % 2]).withColumn("gone", F.lit(True))
    for _ in range(2):
        store.add_changes(gone, path, 7, deleted="gone")
    want = [i for i in items if not i[0] % 2]
    assert current(spark, path) == want
    store.compact_store(spark, path)
    store.add_changes(gone, path, 7, deleted="gone")  # run again after it was merged
    store.compact_store(spark, path)
    assert current(spark, path) == want
    assert spark.read.parquet(f"{path}/base").where("_deleted").count() == 60
    store.vacuum_store(spark, path)
    assert current(spark, path) == want
    every = rows(spark, want).withColumn("gone", F.lit(True))
    store.merge_store(every, path, deleted="gone")
    store.vacuum_store(spark, path)
    assert current(spark, path) == []
    store.merge_store(rows(spark, items[:3]), path)
    assert current(spark, path) == items[:3]


def test_lacking_columns_keep_their_values_and_empty_tables(spark, tmp_path, filled):
    path, items = filled
    store.merge_store(rows(spark, [(4, 2, "x"), (99, 0, "y")]).select("doc", "nth"), path)
    got = {(r["doc"], r["nth"]): r for r in store.read_store(spark, path).collect()}
    assert got[4, 2]["text"] == "4.2" and got[4, 2]["tags"] == {"t": "4.2"} and got[99, 0]["text"] is None
    empty = str(tmp_path / "empty")
    store.create_store(rows(spark, []), empty, key=["doc", "nth"])
    assert current(spark, empty) == []
    assert store.merge_store(rows(spark, []), empty) == []
    store.merge_store(rows(spark, [(1, 1, "a")]), empty)
    assert current(spark, empty) == [(1, 1, "a")]
    with pytest.raises(ValueError):
        store.create_store(rows(spark, []), empty, key=["none"])


def test_random_batches_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    path, state = str(tmp_path / "store"), {}
    store.create_store(rows(spark, []), path, key=["doc", "nth"], owner=["doc"], buckets=5)
    for batch in range(6):
        kind = rng.choice(["rows", "gone", "whole"])
        keys = {(rng.randrange(8), rng.randrange(5)) for _ in range(12)}
        changes = [(d, n, f"{batch}:{d}.{n}") for d, n in sorted(keys)]
        df = rows(spark, changes)
        if kind == "gone":
            store.add_changes(df.withColumn("gone", F.lit(True)), path, batch, deleted="gone")
            state = {k: v for k, v in state.items() if k not in keys}
        else:
            store.add_changes(df, path, batch, whole_owner=kind == "whole")
            owners = {d for d, _ in keys} if kind == "whole" else set()
            state = {k: v for k, v in state.items() if k[0] not in owners} | {(d, n): t for d, n, t in changes}
        if batch in (2, 4):
            store.compact_store(spark, path)
        assert current(spark, path) == sorted((d, n, t) for (d, n), t in state.items())
