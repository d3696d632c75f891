"""Repeated passages across documents, found with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``BLOCK`` words, which are
indexed, and is probed with every rolling window of ``BLOCK`` words.  A repeated window of
``WINDOW`` = 2 · BLOCK words holds a whole reference block of each document it stands in, so
every repeat has an anchor.  Around anchors, hits are extended: all windows that hold an
anchor are compared, by a hash of 96 bits beside the anchor's, and the runs of those that
also start in a smaller document are the maximal exact repeats whose words are removed.

Hashes travel packed, one row per task slice and bucket, not one row per word: buckets are
ranges of the hash, so they are even, and a slice that meets a hash more than once settles
those copies itself and sends one, so a passage shared by very many documents is
pre-aggregated before the shuffle.  Texts move twice: all of them once, to their anchors,
and those with an anchor once more, to the verdict.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import WORD, WordHash, text_or_empty
from acervo.session import written

WINDOW = 50
BLOCK = WINDOW // 2
#: Words in a task's slice, words (of the table) per bucket, and buckets at least.
SLICE_WORDS, BUCKET_WORDS, BUCKETS = 500_000, 700_000, 13
A, B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """factor ** i and its inverse modulo 2**64, grown on demand."""

    def __init__(self, factor: int) -> None:
        self.factor, self.inverse = factor, pow(factor, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            ones = np.ones(size, np.uint64)
            ones[1:] = self.factor
            self.up = np.cumprod(ones)
            ones[1:] = self.inverse
            self.down = np.cumprod(ones)
        return self.up[:n], self.down[:n]


POWERS = Powers(A), Powers(B)


def rolling(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = POWERS[which].upto(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mixed((sums[length:] - sums[:n]) * down[:n])


class Slice:
    """The words of some rows, end to end; rows of one document follow each other and count as one document."""

    def __init__(self, ids: np.ndarray, texts: list[list[bytes]], cache: WordHash) -> None:
        counts = np.array([len(w) for w in texts], np.int64)
        self.row_ends = np.repeat(np.cumsum(counts), counts)
        fresh = np.r_[True, ids[1:] != ids[:-1]]
        self.ids = ids[fresh]
        self.row_document = np.cumsum(fresh) - 1
        self.counts = np.bincount(self.row_document, counts).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.hashes = np.fromiter((cache[w] for own in texts for w in own), np.uint64, int(counts.sum()))
        self.key = xxhash.xxh3_64_intdigest(self.ids.tobytes() + self.hashes.tobytes()) >> 1

    def owners(self, at: np.ndarray) -> np.ndarray:
        """Index of the document of each position."""
        return np.searchsorted(self.ends, at, "right")

    def starts_within(self, length: int) -> np.ndarray:
        """Start positions of the runs of ``length`` words that stay in one row."""
        n = max(0, len(self.hashes) - length + 1)
        return np.flatnonzero(np.arange(n) + length <= self.row_ends[:n])


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[Slice]:
    """The rows of a task in slices; texts of fewer than WINDOW words cannot repeat and are left out."""
    cache = WordHash()
    held, ids, texts = 0, [], []
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            words = text.encode("utf-8", "replace").split()
            if len(words) < WINDOW:
                continue
            ids.append(doc_id)
            texts.append(words)
            held += len(words)
            if held >= SLICE_WORDS:
                yield Slice(np.array(ids, np.int64), texts, cache)
                held, ids, texts = 0, [], []
    if ids:
        yield Slice(np.array(ids, np.int64), texts, cache)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses where high bytes repeat."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def numbers(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def packed_places(ids: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
    """(documents with their number of positions, positions as differences); sorted by document and position."""
    first = np.r_[True, ids[1:] != ids[:-1]]
    cuts = np.flatnonzero(np.r_[first, True])
    step = at.astype(np.int64)
    step[1:] = np.where(first[1:], at[1:], at[1:] - at[:-1])
    return np.stack([ids[first], np.diff(cuts)], axis=1).astype(np.int64).tobytes(), planes(step.astype(np.uint32))


def places(ids: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(documents, positions), one of each per packed entry."""
    own = np.frombuffer(ids, np.int64).reshape(-1, 2)
    step = numbers(at, np.uint32).astype(np.int64)
    total = np.cumsum(step)
    starts = np.cumsum(own[:, 1]) - own[:, 1]
    return np.repeat(own[:, 0], own[:, 1]), total - np.repeat(total[starts] - step[starts], own[:, 1])


def document_rows(kind: str, ids: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[dict]:
    """Positions of documents, packed by the bucket of the document."""
    own = ids % buckets
    order = np.lexsort((at, ids, own))
    ids, at, own = ids[order], at[order], own[order]
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.empty(0, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        packed = packed_places(ids[a:b], at[a:b])
        yield {"kind": kind, "bucket": int(own[a]), "ids": packed[0], "at": packed[1]}


def hash_rows(kind: str, own: Slice, at: np.ndarray, hashes: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> Iterator[dict]:
    """Hashes at positions, packed by the bucket of the hash, a range of its upper half; ``extra``: upper halves and 32 bits more to send."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.lexsort((at, bucket))
    at, hashes, bucket = at[order], hashes[order], bucket[order]
    owner = own.owners(at)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(at) else np.empty(0, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        packed = packed_places(own.ids[owner[a:b]], at[a:b] - own.starts[owner[a:b]])
        yield {"kind": kind, "bucket": int(bucket[a]), "slice": own.key, "hashes": planes(hashes[a:b].astype(np.uint32)),
               "extra": None if extra is None else planes(np.ascontiguousarray((hashes[a:b] >> np.uint64(32)).astype(np.uint32))) + planes(extra[order][a:b]),
               "ids": packed[0], "at": packed[1]}


def grouped(owner: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries with equal keys, settled by document: (entries of the smallest document of each key; entries of keys
    met in several documents; those of them that are not in the smallest)."""
    order = np.lexsort((owner, *keys))
    o = owner[order]
    fresh = np.zeros(len(o), bool)
    fresh[:1] = True
    for key in keys:
        k = key[order]
        fresh[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    smallest = o == o[starts][run] if len(o) else np.zeros(0, bool)
    last = np.r_[starts[1:], len(o)] - 1 if len(o) else starts
    several = (o[last] != o[starts])[run] if len(o) else np.zeros(0, bool)
    return order[smallest], order[several], order[several & ~smallest]


def frame(rows: list[dict], columns: str) -> pd.DataFrame:
    names = [c.split()[0] for c in columns.split(",")]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


ANCHORS = "kind string, bucket int, slice long, hashes binary, extra binary, ids binary, at binary"
STAGED = f"{ANCHORS}, doc_id long, text string, n_words long, n_removed long, kept_sha256 string"


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed rows of a table's probes (every rolling window), index (reference blocks) and hits settled in a slice.

    A hash is sent once per slice, at its positions in the smallest document; all positions
    of a hash that the slice meets in several documents are hits at once.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in slices(batches):
            at = own.starts_within(BLOCK)
            hashes = rolling(own.hashes, BLOCK)[at]
            owner = own.owners(at)
            send, local, _ = grouped(own.ids[owner], hashes)
            yield frame(list(hash_rows("probe", own, at[send], hashes[send], buckets)), ANCHORS)
            block = (at - own.starts[owner]) % BLOCK == 0
            send = np.flatnonzero(block)[grouped(own.ids[owner[block]], hashes[block])[0]]
            yield frame(list(hash_rows("block", own, at[send], hashes[send], buckets)), ANCHORS)
            yield frame(list(document_rows("hit", own.ids[owner[local]], at[local] - own.starts[owner[local]], buckets)), ANCHORS)

    return docs.mapInPandas(run, ANCHORS)


def anchor_hits(packed: DataFrame, buckets: int) -> DataFrame:
    """Positions whose hash is a reference block of one slice and is met by another, and the hits settled before."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        settled = rows[rows["kind"] == "hit"]
        rows = rows[rows["kind"] != "hit"]
        if not len(rows):
            return settled
        ids, at = map(np.concatenate, zip(*(places(r.ids, r.at) for r in rows.itertuples()), strict=True))
        hashes = [numbers(h, np.uint32) for h in rows["hashes"]]
        lengths = [len(h) for h in hashes]
        owner = np.repeat(rows["slice"].to_numpy(np.int64), lengths)
        block = np.repeat((rows["kind"] == "block").to_numpy(), lengths)
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        starts = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
        good = (np.minimum.reduceat(owner[order], starts) != np.maximum.reduceat(owner[order], starts)) & np.maximum.reduceat(block[order], starts)
        hit = order[np.repeat(good, np.diff(np.r_[starts, len(order)]))]
        return pd.concat([settled, frame(list(document_rows("hit", ids[hit], at[hit], buckets)), ANCHORS)], ignore_index=True)

    return packed.groupBy("bucket").applyInPandas(run, ANCHORS)


def ordered(rows: pd.DataFrame) -> tuple[np.ndarray, list[list[bytes]], list[str]]:
    """(ids, words, texts) by document, the texts of one document by code point."""
    rows = rows.sort_values(["doc_id", "text"], kind="stable")
    texts = rows["text"].tolist()
    return rows["doc_id"].to_numpy(np.int64), [t.encode("utf-8", "replace").split() for t in texts], texts


def placed(own: Slice, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(index of the document in the slice, position in it) of packed positions of documents."""
    parts = [places(r.ids, r.at) for r in rows.itertuples()]
    if not parts or not len(own.ids):
        return np.empty(0, int), np.empty(0, int)
    ids, at = map(np.concatenate, zip(*parts, strict=True))
    index = np.minimum(np.searchsorted(own.ids, ids), len(own.ids) - 1)
    known = own.ids[index] == ids
    return index[known], at[known]


def verdict(doc_id: int, words: list[bytes], removed: np.ndarray) -> dict:
    kept = [w for w, gone in zip(words, removed, strict=True) if not gone] if removed.any() else words
    return {"kind": "done", "doc_id": int(doc_id), "n_words": len(words), "n_removed": int(removed.sum()),
            "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}


def extended(docs: DataFrame, hits: DataFrame, buckets: int) -> DataFrame:
    """For each document bucket: final rows of the documents without an anchor; of the others the text, the windows
    around anchors, packed by hash, and the positions that the bucket settles itself."""
    def run(rows: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        ids, split, texts = ordered(rows)
        if not len(ids):
            return frame([], STAGED)
        own = Slice(ids, split, WordHash())
        out = []
        mark = np.zeros(len(own.hashes) + 1, bool)
        index, at = placed(own, hits)
        row_counts = np.array([len(w) for w in split])
        row_starts = np.cumsum(row_counts) - row_counts
        rows_of = np.searchsorted(own.row_document, np.arange(len(own.ids) + 1))
        for nth in count():  # the hits of a document count for each of its rows
            row = rows_of[index] + nth
            more = row < rows_of[index + 1]
            if not more.any():
                break
            use = more & (at < row_counts[np.minimum(row, len(split) - 1)])
            mark[row_starts[row[use]] + at[use]] = True
        total = np.r_[0, np.cumsum(mark)]
        at = own.starts_within(WINDOW)
        at = at[total[at + BLOCK + 1] > total[at]]
        owner = own.owners(at)
        h, extra = rolling(own.hashes, WINDOW, 1)[at], rolling(own.hashes, WINDOW, 0)[at].astype(np.uint32)
        send, _, settled = grouped(own.ids[owner], h, extra)
        anchored = np.zeros(len(own.ids), bool)
        anchored[owner] = True
        for k, words in enumerate(split):
            if anchored[own.row_document[k]]:
                out.append({"kind": "text", "bucket": int(ids[k] % buckets), "doc_id": int(ids[k]), "text": texts[k]})
            else:
                out.append(verdict(ids[k], words, np.zeros(len(words), bool)))
        out += hash_rows("window", own, at[send], h[send], buckets, extra[send])
        out += document_rows("repeat", own.ids[owner[settled]], at[settled] - own.starts[owner[settled]], buckets)
        return frame(out, STAGED)

    return docs.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInPandas(run, STAGED)


def repeats(windows: DataFrame, buckets: int) -> DataFrame:
    """Start positions of the windows that also start in a smaller document."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, at = map(np.concatenate, zip(*(places(r.ids, r.at) for r in rows.itertuples()), strict=True))
        low = np.concatenate([numbers(h, np.uint32) for h in rows["hashes"]])
        high, extra = (np.concatenate([numbers(e[(i * len(e)) // 2:((i + 1) * len(e)) // 2], np.uint32) for e in rows["extra"]]) for i in (0, 1))
        later = grouped(ids, low, high, extra)[2]
        return frame(list(document_rows("repeat", ids[later], at[later], buckets)), ANCHORS)

    return windows.groupBy("bucket").applyInPandas(run, ANCHORS)


def judged(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Final rows of the documents with an anchor."""
    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ids, split, _ = ordered(rows)
        if not len(ids):
            return frame([], STAGED)
        own = Slice(ids, split, WordHash())
        index, at = placed(own, found)
        change = np.zeros(len(own.hashes) + WINDOW + 1, np.int64)
        np.add.at(change, own.starts[index] + at, 1)
        np.add.at(change, own.starts[index] + at + WINDOW, -1)
        removed = np.cumsum(change) > 0
        ends = np.cumsum([len(w) for w in split])
        return frame([verdict(i, w, removed[e - len(w):e]) for i, w, e in zip(ids, split, ends, strict=True)], STAGED)

    return texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInPandas(run, STAGED)


def prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def without_repeats(docs: DataFrame) -> DataFrame:
    """What is left of each row of ``docs`` (doc_id, text; other columns are ignored) without repeated windows.

    A window is WINDOW consecutive words of one text; a word goes when a window over it also
    starts in a document with a smaller doc_id.  Returns (doc_id, n_words, n_removed,
    kept_sha256), one row per input row.  Null and empty texts have no words; texts of fewer
    than WINDOW words lose none; rows that share a doc_id are one document and never repeat
    each other; a row without doc_id is compared with nothing; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # by the words alone: a bucket of hashes sends a row to each bucket of documents that it has hits in
    buckets = prime_from(max(BUCKETS, size // 6 // BUCKET_WORDS))
    known = rows.where("doc_id is not null")
    hits = written(anchor_hits(anchors(known, buckets), buckets).select("bucket", "ids", "at"), "repeat-hits")
    placed_docs = known.withColumn("bucket", F.pmod("doc_id", F.lit(buckets)).cast("int"))
    staged = written(extended(placed_docs, hits, buckets), "repeat-windows")
    windows = staged.where("kind = 'window'").select(*(c.split()[0] for c in ANCHORS.split(", ")))
    found = staged.where("kind = 'repeat'").select("bucket", "ids", "at").unionByName(repeats(windows, buckets).select("bucket", "ids", "at"))
    texts = staged.where("kind = 'text'").select("bucket", "doc_id", "text")
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    unnamed = rows.where("doc_id is null").select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
        F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("kept_sha256"),
    )
    return staged.where("kind = 'done'").select(columns).unionByName(judged(texts, found).select(columns)).unionByName(unnamed)
