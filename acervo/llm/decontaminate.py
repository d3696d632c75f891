"""Benchmark decontamination by templates.

Words become template tokens: numbers, names and units turn into typed placeholders,
everything else is lower-cased and loses its outer punctuation.  Windows of template
tokens are hashed and looked up in the hash table of the benchmark's windows.  Hits of a
document and an item are laid on a diagonal, and the slots behind the placeholders must
map consistently from item to document, so that a question asked with other numbers or
names is caught and a mere likeness of form is not.

The benchmark goes to the tasks in blocks of ``BLOCK_BYTES`` of text at most, the bound of
what is sent; every block is one pass over the documents, and texts never leave their task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Literal (not placeholder) tokens that a window needs to count as evidence by its template; with fewer, its words must be the same.
LITERALS = 5
#: Items with fewer words are no evidence and never match.
SHORTEST = 4
#: Accept a pair that covers this share of the item, or a run of RUN tokens.
COVERAGE, RUN = 0.5, 13
#: Share of slots that must agree with one mapping from item values to document values.
CONSISTENT = 0.8
BLOCK_BYTES = 8_000_000
#: Diagonals this far from the one that is judged count with it (words put in or left out).
DRIFT = 4
SLICE_CHARS = 2_000_000

# Words that stand for numbers, and units of measure.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds lb lbs ml l liter "
    "liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "meter meters metre metres gram grams kilogram kilograms kilometer kilometers kilometre kilometres dollar dollars cent "
    "cents euro euros percent % degree degrees watt watts volt volts mph kmh hz"
).split()
NUMBER = re.compile(r"[$€£]?[+-]?[0-9][0-9.,:/]*(?:%|st|nd|rd|th|[a-z]{1,3})?$", re.IGNORECASE)
NAME = re.compile(r"[^\W\d_][^\W\d_]*(?:['’-][^\W\d_]+)*$")
BEFORE, AFTER = re.compile(r"[^\w$€£%+-]*"), re.compile(r"[^\w%]*")
NUM, NAMED, UNIT, LITERAL = 1, 2, 3, 0
M = 0x9E3779B97F4A7C15 | 1


def canonical(word: str, first: bool) -> tuple[int, str]:
    """(class, token): the placeholder class of a word, and its lower-cased core.

    ``first``: the word opens a sentence, so that a capital does not make it a name.
    """
    core = word
    if not word.isalnum():
        core = word[BEFORE.match(word).end():]
        core = core[:len(core) - AFTER.match(core[::-1]).end()]  # from the end: in linear time for long runs of marks too
    low = core.lower()
    if NUMBER.match(core) or low in NUMBER_SET:
        return NUM, low
    if low in UNIT_SET:
        return UNIT, low
    if not first and len(core) > 1 and core[0].isupper() and core[1:] == core[1:].lower() and NAME.match(core):
        return NAMED, low
    return LITERAL, low


NUMBER_SET, UNIT_SET = frozenset(NUMBER_WORDS), frozenset(UNITS)


class Vocabulary:
    """word → properties, held once per task; emptied between slices when it has grown large."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.rows: list[tuple] = []
        self.table = [np.empty(0, kind) for kind in PROPERTIES]

    def ids(self, words: list[bytes]) -> np.ndarray:
        index, rows = self.index, self.rows
        out = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            k = index.get(word)
            if k is None:
                text = word.decode("utf-8", "replace")
                made = [canonical(text, first) for first in (True, False)]
                hashed = [xxhash.xxh3_64_intdigest(t if c == LITERAL else f"\0{c}") for c, t in made]
                k = index[word] = len(index)
                rows.append((hashed[0], hashed[1], made[0][0] == LITERAL, made[1][0] == LITERAL, text.rstrip("\"')]»”").endswith((".", "!", "?", ":")), xxhash.xxh3_64_intdigest(f"\1{made[0][1]}")))
            out[i] = k
        if rows:
            self.table = [np.append(old, np.array(new, old.dtype)) for old, new in zip(self.table, zip(*rows, strict=True), strict=True)]
            rows.clear()
        return out

    def readings(self, words: list[bytes], starts: np.ndarray, lines: np.ndarray, opening: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(hashes of the template tokens, which are literal, hashes of the words or None) for each way to take capitals.

        ``starts`` and ``lines``: where texts and their lines begin.  Names are placeholders, with
        and without a line break as the end of a sentence, and, with ``opening``, with the first
        word of a text as any other; last, names are words, and this one has the hashes of the words.
        """
        ids = self.ids(words)
        h0, h1, l0, l1, ends, own = self.table
        within = np.append(False, ends[ids[:-1]])
        firsts = []
        for at in (starts, lines, *([starts[:0]] if opening else [])):
            first = within.copy()
            first[at[at < len(ids)]] = True
            if not firsts or not np.array_equal(first, firsts[0]):
                firsts.append(first)
        return [*((np.where(f, h0[ids], h1[ids]), np.where(f, l0[ids], l1[ids]), None) for f in firsts), (h0[ids], l0[ids], own[ids])]


#: Of a word: the hash of its token as the first of a sentence and elsewhere, whether these are literal, whether it ends a sentence, and the hash of the word itself.
PROPERTIES = np.uint64, np.uint64, bool, bool, bool, np.uint64


def split_words(text: bytes) -> tuple[list[bytes], list[int]]:
    """The words, and where lines begin."""
    words, lines = [], []
    for line in text.splitlines():
        lines.append(len(words))
        words += line.split()
    return words, lines


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` tokens; empty when there are fewer."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(length):
        total += hashes[k:k + n] * np.uint64(factor)
        factor = factor * M % 2**64
    return mixed(total)


def windows(hashes: np.ndarray, literal: np.ndarray, ends: np.ndarray, length: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows that stay in their text and have enough literals; ``ends``: end of the text per token.

    With ``words``, hashes of the words themselves, windows with too few literals have the hash of these.
    """
    rolled = rolling(hashes, length)
    if not len(rolled):
        return np.empty(0, np.int64), rolled
    count = np.concatenate([[0], np.cumsum(literal)])
    enough = count[length:] - count[:-length] >= min(LITERALS, length - 1)
    inside = np.arange(len(rolled)) + length <= ends[: len(rolled)]
    at = np.flatnonzero(enough & inside)
    rolled = rolled[at]
    if words is not None and len(few := np.flatnonzero(inside & ~enough)):
        total = np.zeros(len(few), np.uint64)
        factor = 1
        for k in range(length):
            total += words[few + k] * np.uint64(factor)
            factor = factor * M % 2**64
        at, rolled = np.concatenate([at, few]), np.concatenate([rolled, mixed(total)])
    return at, rolled


def window_length(words: int) -> int:
    return min(WINDOW, words)


class Items:
    """The windows of one block of the benchmark."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        vocabulary = Vocabulary()
        self.ids, self.words = [], []
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in rows:
            words, lines = split_words((text or "").encode())
            if len(words) < SHORTEST:
                continue
            length = window_length(len(words))
            own = set()
            for hashes, literal, plain in vocabulary.readings(words, np.array([0]), np.array(lines), opening=True):
                own.update((int(h), len(self.ids), int(p)) for p, h in zip(*windows(hashes, literal, np.full(len(words), len(words)), length, plain), strict=True))
            found[length] += own
            self.ids.append(item_id)
            self.words.append(words)
        self.by_length = {}
        for length, hits in found.items():
            hits.sort()
            keys = np.array([h for h, _, _ in hits], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[length] = seen, keys, np.array([(i, p) for _, i, p in hits])


def slots(item: list[bytes], doc: list[bytes], pairs: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(slots, slots that keep to one mapping, slots whose value differs) over aligned positions."""
    seen: dict[tuple[int, str], dict[str, int]] = defaultdict(lambda: defaultdict(int))
    changed = 0
    for i, d in pairs:
        kind, a = canonical(item[i].decode("utf-8", "replace"), False)
        if kind != LITERAL:
            b = canonical(doc[d].decode("utf-8", "replace"), False)[1]
            seen[kind, a][b] += 1
            changed += a != b
    return sum(sum(v.values()) for v in seen.values()), sum(max(v.values()) for v in seen.values()), changed


def judge(items: Items, doc: list[bytes], hits: list[tuple[int, int, int, int]]) -> list[tuple]:
    """Accepted pairs of one document: (item_id, start word, words matched, share of the item, slots, changed slots).

    ``hits``: (item, position in item, position in document, window length).
    """
    by_item: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for item, p, d, length in hits:
        by_item[item].append((p, d, length))
    out = []
    for item, own in by_item.items():
        diagonals: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for p, d, length in own:
            diagonals[d - p].append((p, d, length))
        for best in sorted(diagonals, key=lambda k: (-len(diagonals[k]), k)):  # a document may hold an item's form several times
            near = [x for k in range(best - DRIFT, best + DRIFT + 1) for x in diagonals.get(k, ())]
            pairs: dict[int, int] = {}
            for p, d, length in sorted(near, key=lambda x: (abs(x[1] - x[0] - best), x)):
                for k in range(length):
                    pairs.setdefault(p + k, d + k)
            covered = sorted(pairs)
            run = longest = 0
            for k, p in enumerate(covered):
                run = run + 1 if k and covered[k - 1] == p - 1 else 1
                longest = max(longest, run)
            share = len(covered) / len(items.words[item])
            if share < COVERAGE and longest < RUN:
                continue
            total, kept, changed = slots(items.words[item], doc, list(pairs.items()))
            if kept >= CONSISTENT * total:
                out.append((items.ids[item], min(pairs.values()), len(covered), round(share, 6), total, changed))
                break
    return sorted(out)


def sliced(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Whole texts in slices of about ``chars`` characters: (index of the first, texts)."""
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield start, texts[start:k + 1]
            start, held = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def find(items: Items, vocabulary: Vocabulary, texts: list[str]) -> list[list[tuple]]:
    """Accepted pairs per text."""
    out: list[list[tuple]] = [[] for _ in texts]
    for base, part in sliced(texts):
        if len(vocabulary.index) > 300_000:
            vocabulary.clear()
        split, breaks = zip(*(split_words(t.encode("utf-8", "replace")) for t in part), strict=True)
        lengths = np.array([len(w) for w in split])
        words = [w for own in split for w in own]
        if not words:
            continue
        bounds = np.cumsum(lengths)
        starts = bounds - lengths
        lines = np.concatenate([starts, *(s + np.array(at, np.int64) for s, at in zip(starts, breaks, strict=True) if len(at) > 1)])
        ends = np.repeat(bounds, lengths)
        hits: dict[int, set[tuple[int, int, int, int]]] = defaultdict(set)
        for hashes, literal, plain in vocabulary.readings(words, starts, lines):
            for length, (seen, keys, rows) in items.by_length.items():
                at, rolled = windows(hashes, literal, ends, length, plain)
                maybe = seen[(rolled >> np.uint64(44)).astype(np.int64)]
                at, rolled = at[maybe], rolled[maybe]
                lo, hi = np.searchsorted(keys, rolled, "left"), np.searchsorted(keys, rolled, "right")
                for a, x, y in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                    k = int(np.searchsorted(bounds, a, "right"))
                    d = int(a - starts[k])
                    hits[k].update((int(i), int(p), d, length) for i, p in rows[x:y])
        for k, own in hits.items():
            out[base + k] = judge(items, split[k], sorted(own))
    return out


PAIR = "array<struct<item_id:bigint,start_word:int,words:int,share:double,slots:int,changed_slots:int>>"


def leaks(rows: list[tuple[int, str]], text: Column) -> Column:
    """The accepted benchmark items of a text, by item id."""
    items = Items(rows)

    @F.pandas_udf(PAIR)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary()
        for texts in batches:
            found = find(items, vocabulary, texts.fillna("").tolist())
            yield pd.Series([[dict(zip(("item_id", "start_word", "words", "share", "slots", "changed_slots"), x, strict=True)) for x in own] for own in found])

    return run(text)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in parts of about ``block_bytes`` of text."""
    total = benchmark.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for part in range(parts):
        own = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
        own = own if parts == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield sorted((r[0], r[1]) for r in own.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored.  Returns
    (doc_id, item_id, start_word, words, share, slots, changed_slots).  Null and empty texts
    contain nothing; items without text or id, or of fewer than ``SHORTEST`` words, match
    nothing; repeated rows report again; empty tables give an empty result.
    """
    found = None
    for rows in blocks(benchmark, block_bytes):
        own = docs.select("doc_id", F.explode(leaks(rows, F.col("text"))).alias("hit")).select("doc_id", "hit.*")
        found = own if found is None else found.unionByName(own)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns."""
    for rows in blocks(benchmark, block_bytes):
        docs = docs.where(F.size(leaks(rows, F.col("text"))) == 0)
    return docs
