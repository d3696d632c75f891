"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's shingles are hashed into the bins of its sketch in rounds: round *i* places
every shingle once more by its own hash functions and a bin keeps the smallest value of the
first round that reached it.  Rounds go on until every bin is filled (after as many rounds
as bins, the bins left take the smallest value over all shingles), so all coordinates are
filled and agree with a chance equal to the Jaccard similarity, with concentration bounds,
in time n + t log t.  Coordinates are cut into bands; documents that share a band are
candidates; candidates are linked only after their full shingle sets have been compared.

Work stays linear in the rows of a band.  Documents with equal sets are one class.  First
every class is compared with the smallest class of its bands.  Once these links have been
contracted, only pairs of *different* components that share a band are left.  All of these
are compared, in blocks of members, inside the tasks; what leaves a task is a link between
two components, so no candidate pair is lost and none is written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import WordHash
from acervo.session import written

#: Coordinates in a band, and the chance that a pair exactly at the threshold shares no band.
ROWS, MISS = 7, 1e-6
SLICE_WORDS = 400_000
#: Members that share one copy of their pivot's text when pairs are verified.
CHUNK = 256
#: Members of a band outside its first component, and members of it, that meet in one block.
OUTSIDE, INSIDE = 256, 512
EMPTY = np.uint64(2**64 - 1)


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lower-cased; bytes split at the same six characters as WORD."""
    return text.encode("utf-8", "replace").lower().split()


def shingle_sets(split: list[list[bytes]], k: int, cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, sorted and distinct in each text; how many each has)."""
    counts = np.array([len(w) for w in split])
    hashes = np.fromiter((cache[w] for own in split for w in own), np.uint64, int(counts.sum()))
    ends = np.repeat(np.cumsum(counts), counts)
    owner = np.repeat(np.arange(len(split)), counts)
    position = np.arange(len(hashes))
    short = counts < k
    total = np.zeros(len(hashes), np.uint64)
    for i in range(k):
        part = np.roll(hashes, -i) * np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 2**64))
        inside = position + i < ends
        total += np.where(inside, part, np.uint64(0))
    first = position == ends - counts[owner] if len(owner) else np.zeros(0, bool)
    used = (position + k <= ends) | (short[owner] & first)
    total = mixed(total + np.where(short[owner], counts[owner], 0).astype(np.uint64))[used]
    owner = owner[used]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[fresh], np.bincount(owner[fresh], minlength=len(split))


def sketches(elements: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """One sketch of ``bins`` coordinates per set; a coordinate is (round, value)."""
    out = np.full(len(sizes) * bins, EMPTY)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    open_ = sizes > 0
    active = elements
    for i in range(bins):
        if not len(active):
            break
        h = mixed(active + np.uint64((i + 1) * 0xD1B54A32D192ED03 % 2**64))
        bin_ = ((h >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)
        value = (h & np.uint64(2**40 - 1)) | np.uint64(i << 40)
        np.minimum.at(out, owner * bins + bin_.astype(np.int64), value)
        open_ = open_ & (out.reshape(-1, bins) == EMPTY).any(axis=1)
        stay = open_[owner]
        active, owner = active[stay], owner[stay]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, int)
    for j in range(bins if len(owner) else 0):
        h = mixed(active + np.uint64((bins + j + 1) * 0xD1B54A32D192ED03 % 2**64))
        least = np.minimum.reduceat(h & np.uint64(2**40 - 1), starts) | np.uint64((bins + j) << 40)
        at = owner[starts] * bins + j
        out[at] = np.minimum(out[at], least)
    return out.reshape(-1, bins)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of every sketch."""
    bands = sketch.shape[1] // rows
    parts = sketch[:, : bands * rows].reshape(-1, bands, rows)
    total = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        total = mixed(total ^ parts[:, :, r])
    return mixed(total + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)


def sliced(texts: list[str]) -> Iterator[list[list[bytes]]]:
    own: list[list[bytes]] = []
    held = 0
    for text in texts:
        own.append(words_of(text))
        held += len(own[-1])
        if held >= SLICE_WORDS:
            yield own
            own, held = [], 0
    if own:
        yield own


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) per row; ``set_key`` is a 128-bit hash of the set, null where it is empty."""
    bands = band_count(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        for batch in batches:
            ids, at = batch["doc_id"], 0
            for split in sliced(batch["text"].fillna("").tolist()):
                elements, sizes = shingle_sets(split, k, cache)
                keys = band_keys(sketches(elements, sizes, bands * ROWS), ROWS)
                ends = np.cumsum(sizes)
                yield pd.DataFrame({
                    "doc_id": ids.iloc[at:at + len(split)].values,
                    "n_shingles": sizes.astype(np.int64),
                    "set_key": [xxhash.xxh3_128_hexdigest(elements[e - n:e].tobytes()) if n else None for e, n in zip(ends, sizes, strict=True)],
                    "bands": [list(own) if n else None for own, n in zip(keys, sizes, strict=True)],
                })
                at += len(split)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_shingles long, set_key string, bands array<long>"
    )


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are alike.  ``texts`` (doc_id, text) holds every id of them.

    Members meet a copy of their pivot's text in groups of about CHUNK, so a pivot with
    many members is spread over many groups.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = dealt.join(texts, dealt.b == texts.doc_id).select("a", "part", F.col("b").alias("member"), "text")
    pivots = dealt.select("a", "part").distinct().join(texts, F.col("a") == texts.doc_id).select("a", "part", F.lit(None).cast("long").alias("member"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        group, held = None, []
        for batch in batches:
            found = []
            for a, part, member, text in zip(batch["a"], batch["part"], batch["member"], batch["text"], strict=True):
                own = shingle_sets([words_of(text)], k, cache)[0]
                if group != (a, part):
                    group, held = (a, part), []
                if pd.isna(member):
                    held.append(own)
                    continue
                for other in held:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found.append((a, int(member)))
                        break
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    spread = members.unionByName(pivots).repartition("a", "part").sortWithinPartitions("a", "part", F.col("member").asc_nulls_first())
    return spread.mapInPandas(run, "a long, b long")


def joined_components(shared: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between the roots of components that share a band and hold two documents that are alike.

    ``shared``: key, rep, root.  In each band the members outside its first component are
    compared with all members of other components, block by block.
    """
    first = shared.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("key", "first")
    members = shared.join(first, "key")
    blocks = members.groupBy("key").agg(
        F.ceil(F.count(F.when(F.col("root") != F.col("first"), 1)) / OUTSIDE).cast("int").alias("outs"), F.ceil(F.count(F.lit(1)) / INSIDE).cast("int").alias("ins"))
    dealt = members.join(blocks, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("rep")), F.col(n)).cast("int")
    out = dealt.where("root <> first").select("key", own("outs", 1).alias("o"), every("ins").alias("i"), F.lit(0).alias("role"), "rep", "root")
    inside = dealt.select("key", every("outs").alias("o"), own("ins", 2).alias("i"), F.lit(1).alias("role"), "rep", "root")
    rows = out.unionByName(inside).join(texts, F.col("rep") == texts.doc_id).select("key", "o", "i", "role", "root", "text")

    def block(outs: list, ins: list) -> set[tuple[int, int]]:
        if not outs or not ins:
            return set()
        sizes = np.array([len(own) for _, own in ins])
        roots = np.array([root for root, _ in ins])
        known, index = np.unique(np.concatenate([own for _, own in ins]), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        flag = np.zeros(len(known), bool)
        links = set()
        for root, own in outs:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            at = at[known[at] == own]
            flag[at] = True
            both = np.add.reduceat(flag[index], starts, dtype=np.int64)
            flag[at] = False
            like = (100 * both >= percent * (len(own) + sizes - both)) & (roots != root)
            links.update((min(root, r), max(root, r)) for r in map(int, np.unique(roots[like])))
        return links

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        group, sides = None, ([], [])
        for batch in batches:
            found = set()
            for key, o, i, role, root, text in zip(batch["key"], batch["o"], batch["i"], batch["role"], batch["root"], batch["text"], strict=True):
                if group != (key, o, i):
                    found |= block(*sides)
                    group, sides = (key, o, i), ([], [])
                sides[role].append((int(root), shingle_sets([words_of(text)], k, cache)[0]))
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(sorted(block(*sides)), columns=["a", "b"], dtype="int64")

    spread = rows.repartition("key", "o", "i").sortWithinPartitions("key", "o", "i", "role")
    return spread.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large and small stars; every round is written to the shared folder.  A
    hub's smallest neighbour is found by a pre-aggregated minimum and joined back.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v")
        following = written(small.distinct(), "cc")
        state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state(following) == state(edges):
            break
        edges = following
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The component of every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents are linked when their sets of ``k``-word shingles have a Jaccard
    similarity of at least ``percent`` hundredths.  Returns (doc_id, n_shingles,
    component_id, kept), one row per input row.  A text of fewer than ``k`` words is one
    shingle; null, empty and blank texts have none and are linked with nothing; rows that
    share a doc_id are one document, linked through any of their texts; a row without
    doc_id is compared with nothing (component_id null, kept); an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows = written(signatures(docs, k, percent), "near-signatures")
    known = rows.where("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    banded = (
        known.select("set_key", "doc_id", "bands").join(classes, "set_key").where("doc_id = rep")
        .select("rep", F.explode("bands").alias("key")).distinct()
    )
    buckets = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = written(banded.join(buckets, "key").select("key", "rep", "pivot"), "near-buckets")
    stars = written(shared.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "near-stars")
    wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi").distinct(), "near-texts")
    versions = (
        known.select("doc_id", "set_key").distinct().join(classes, "set_key").select("doc_id", "rep")
        .join(known.groupBy("doc_id").agg(F.min("set_key").alias("set_key"), F.max("set_key").alias("other")).where("set_key <> other").join(classes, "set_key").select("doc_id", F.col("rep").alias("first")), "doc_id")
        .where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    )
    links = written(verified(stars, texts, k, percent).union(versions), "near-links")
    first = components(links)
    named = shared.join(first, shared.rep == first.node, "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    second = components(joined_components(written(named, "near-named"), texts, k, percent))
    found = (
        first.withColumnRenamed("root", "near").join(second.withColumnRenamed("node", "near"), "near", "left").select("node", F.coalesce("root", "near").alias("root"))
        .unionByName(second.join(first, "node", "left_anti"))
    )
    placed = known.select("doc_id", "set_key").distinct().join(classes, "set_key").join(found, F.col("rep") == F.col("node"), "left")
    placed = placed.groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, all columns kept; copies of a row with one doc_id become one.

    Rows without doc_id all stay.
    """
    kept = near_duplicates(docs, k, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id").dropDuplicates(["doc_id"]).select(docs.columns).union(docs.where("doc_id is null"))
