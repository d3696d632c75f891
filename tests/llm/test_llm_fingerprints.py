import hashlib
import random
import re

import xxhash

from acervo.llm import fingerprints as fp

SIGNED = lambda h: h - 2**64 if h >= 2**63 else h


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs; None is passed over."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), seed=seed)
    return seed


def sketch(text):
    tokens = re.findall(fp.TOKEN.replace("\\\\", "\\"), text)
    if not tokens:
        return {}
    kmers = [tokens[i:i + fp.K] for i in range(max(1, len(tokens) - fp.K + 1))]
    seen, numbered = {}, []
    for at, kmer in enumerate(kmers):
        head = spark_hash(*kmer) >> 32
        occurrence = seen[head] = seen.get(head, -1) + 1
        # Spark hashes the occurrence as a 32-bit integer
        value = xxhash.xxh64_intdigest(head.to_bytes(8, "little"), seed=42)
        numbered.append((int_hash(occurrence, value) >> 32, at))
    bins = {}
    for value, at in sorted(numbered):
        bins.setdefault(value >> 26, []).append((value, at))
    out = {}
    for b, own in bins.items():
        ordered = [v for v, _ in sorted(own[:fp.TUPLE], key=lambda x: x[1])]
        out[b] = spark_hash(*ordered) >> (64 - fp.HASH)
    return out


def int_hash(value, seed):
    """xxh64 of one 32-bit integer, as Spark computes it."""
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed=seed)


def like(a, b):
    filled = set(a) | set(b)
    return sum(a.get(k) == b.get(k) for k in filled) / len(filled) if filled else 1.0


def text_of(s):
    return ",".join(f"{(b << fp.HASH) | h:x}" for b, h in sorted(s.items()))


def test_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeéß漢😀", k=rng.randint(1, 30)))
    ids = rng.sample(range(-50_000, 50_000_000), 60)
    rows = [(i, " ".join(rng.choices([word() for _ in range(40)], k=rng.randint(0, 90)))) for i in ids]
    rows += [(60_000_000, None), (60_000_001, ""), (60_000_002, " \n"), (60_000_003, "one"), (60_000_004, "na " * 5000), (60_000_005, "x" * 40_000)]
    got = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame([(*r, "t", 7) for r in rows], "doc_id long, text string, head string, half int")).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, other, after = sketch(text), sketch(edited), sketch(following)
        r = got[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text_of(own), text_of(other))
        assert abs(r["near_edited"] - like(own, other)) < 1e-9
        assert abs(r["near_next"] - like(own, after)) < 1e-9


def test_order_and_edits(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    moved = [w for i in range(0, 400, 4) for w in reversed(words[i:i + 4])]
    edited = list(words)
    edited[200] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(edited)), (4, " ".join(moved))]
    bins = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", fp.sketch("text").alias("b"))
    a, b, c, d = (set(r["b"]) for r in bins.orderBy("doc_id").collect())
    assert a == b and len(a & c) > 0.8 * len(a) and len(a & d) < 0.1 * len(a)


def test_repeated_rows_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c e"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    got = fp.fingerprints(df).collect()
    assert len(got) == 5
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 7 and r["doc_id"] != 2}) == 1
    alone = next(r for r in got if r["doc_id"] is None and r["n_chars"] == 0)
    assert alone["fingerprint"] == "" and alone["near_next"] == 1.0
    assert fp.fingerprints(df.limit(0)).count() == 0


def test_next_ids(spark):
    ids = [-9_000_000, -1, 0, 5, 4095, 4096, 17_000_000, 10**12]
    got = dict(tuple(r) for r in fp.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect())
    assert got == {a: b for a, b in zip(ids, [ids[-1], *ids[:-1]], strict=True)}
