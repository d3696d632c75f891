import hashlib
import random
from collections import defaultdict

import pytest

from acervo.llm import repeats


def brute(rows):
    least, out = {}, []
    for d, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - 49):
            if d is not None:
                key = tuple(w[p:p + 50])
                least[key] = min(d, least.get(key, d))
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if d is not None and least[tuple(w[p:p + 50])] < d:
                gone[p:p + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in repeats.without_repeats(df).collect()), key=repr)


@pytest.mark.parametrize("slice_words", [300, 1_000_000])
def test_equals_brute_force(spark, monkeypatch, slice_words):
    monkeypatch.setattr(repeats, "SLICE_WORDS", slice_words)
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [words(n) for n in (49, 50, 51, 74, 75, 120, 400)]
    rows = []
    for i in range(160):
        own = words(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            own += rng.choice(passages) + words(rng.randint(0, 60))
        rows.append((rng.randrange(10_000), " ".join(own)))
    long = " ".join(words(6000))
    rows += [(20_000, long), (20_001, long), (20_002, "x " + long), (20_003, "la " * 3000), (20_004, "la " * 60), (5, "la " * 49)]
    rows += [(20_005, None), (20_006, ""), (20_007, " \t\n"), (None, long), (rows[0][0], rows[0][1]), (rows[1][0], long), (-3, " ".join(passages[5]))]
    df = spark.createDataFrame([(d, t, 1, "x", b"y") for d, t in rows], "doc_id long, text string, bucket int, kind string, at binary")
    assert got(df) == brute(rows)


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
