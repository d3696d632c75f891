import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from acervo.llm import spelling

LOWER = str.maketrans(spelling.UPPER, spelling.UPPER.lower())


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(rows):
    n = brute_counts(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def corpus(seed, rows=60):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeéÀÿstn", k=rng.randint(4, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Straße", "× ÷", "naïve"]
    words = list(base)
    for w in base:
        for _ in range(4):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1:]]))
    weights = [rng.choice([1, 2, 4, 9, 20]) for _ in words]
    return [(i, rng.choice([" ", ", ", "-", "1"]).join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert any(root != form and form for form, root, *_ in want.values())  # chains of two forms


@pytest.mark.parametrize("large", [0, 500_000])
def test_large_groups_meet_in_blocks(spark, monkeypatch, large):
    monkeypatch.setattr(spelling, "LARGE", large)  # shuffled and broadcast
    words = {w: n for w, n in brute_counts(corpus(3, 120)).items()}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    small = spelling.near_pairs(df, block=2).collect()
    assert sorted(map(tuple, small)) == sorted((a, b, words[b]) for a in words for b in words if one_edit(a, b))


def test_edge_rows(spark):
    long = "Wörter " * 40_000
    rows = [(None, "Wörter Wörter"), (7, None), (7, ""), (8, "12 .. abcd"), (9, long), (9, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).withColumn("key", F.lit(2.0))
    assert {r["word"]: r["n"] for r in spelling.spelling_variants(docs).collect()} == brute_counts(rows)
    assert spelling.spelling_variants(docs.where("false")).count() == 0
