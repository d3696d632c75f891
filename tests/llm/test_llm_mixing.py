import hashlib
import random
import re
from collections import defaultdict

from acervo.llm import mixing


def brute(rows, weights=(1, 2, 3), most=3):
    """The mix by the wording of its contract: shares by weight, caps, the excess shared again until none is above."""
    sized = [(d, s, len(re.findall("[^\x20\x09-\x0D]+", t or ""))) for d, s, t in rows]
    size = defaultdict(int)
    for _, s, n in sized:
        size[s] += n
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = [s for s in order if s not in capped]
        left = sum(size.values()) - sum(target[s] for s in capped)
        for s in rest:
            target[s] = left * weight[s] / sum(weight[x] for x in rest)
        over = [s for s in rest if target[s] > most * size[s]]
        if not over:
            break
        for s in over:
            target[s] = most * size[s]
            capped.add(s)
    out = []
    for s in order:
        own = sorted((hashlib.md5(f"mix-1:{'' if d is None else d}".encode()).hexdigest(), d is None, d or 0, n, d) for d, x, n in sized if x == s)
        budget = int(target[s] + 0.5)
        rounds, left = divmod(budget, size[s]) if size[s] else (0, 0)
        for _, _, _, n, d in own:
            cut = min(n, left)
            left -= cut
            out.append((d, n, size[s], round(target[s], 6), rounds * n + cut))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(df).collect()), key=repr)


def test_mix_equals_the_wording(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", "d"] if rng.random() < 0.6 else ["hot"]), "w " * rng.randint(0, 40)) for i in range(300)]
    rows += [(900 + i, "tiny", "one") for i in range(2)] + [(950, None, "x y z"), (951, None, None), (952, "blank", " \n"), (None, "a", "no id here"), (7, "a", "again"), (7, "a", "again")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, text string, size int, range string")
    assert got(df) == brute(rows)
    assert got(df) == got(df.repartition(7))


def test_budget_is_met_to_the_word(spark):
    rows = [(i, f"s{i % 5}", "w " * (1 + i % 13)) for i in range(400)]
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    by = defaultdict(int)
    for r in plan.collect():
        by[r["target"], r["source_size"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken - target) <= 0.5 for (target, _), taken in by.items())


def test_rows_of_the_mix(spark):
    docs = spark.createDataFrame([(1, "a", "w w w w"), (2, "b", "w w"), (3, "c", "")], "doc_id long, source string, text string")
    plan = mixing.mix(docs)
    copies = mixing.mixed_rows(docs, plan)
    assert copies.groupBy().sum("words").first()[0] == plan.groupBy().sum("taken").first()[0]
    assert set(docs.columns) <= set(copies.columns)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_copies_of_equal_rows_and_rows_without_id(spark):
    rows = [(1, "a", "x y z"), (1, "a", "x y z"), (None, "a", "p q"), (None, "b", "p q"), (2, "b", "")]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, source string, text string, size string")
    plan = mixing.mix(docs)
    copies = mixing.mixed_rows(docs, plan).collect()
    assert sum(r["words"] for r in copies) == sum(r["taken"] for r in plan.collect())
    first = sorted((r["doc_id"] or 0, r["source"], r["text"]) for r in copies if r["epoch"] == 1)
    taken = sorted((r["doc_id"] or 0) for r in plan.where("taken > 0").collect())
    assert [f[0] for f in first] == taken and all(r["size"] == "kept" for r in copies)
