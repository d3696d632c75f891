"""Spelling variants of the words of a corpus, by partition-and-enumerate signatures.

A word's letters, each with its occurrence number, are a binary vector: ``anna`` is
{a1, a2, n1, n2}.  One edit changes at most two elements, so near words are vectors at a
Hamming distance of at most two.  The elements are dealt by a hash into PARTS parts; two
changed elements leave at least PARTS - 2 parts alone, so near words agree in one of the
enumerated choices of PARTS - 2 parts.  One edit also leaves the first or the last half
of the (shorter) word as it is; the half is a part of the signature, which keeps groups
small.  Signatures are joined by equality; a pair that meets is kept when its bit vectors
differ in two places at most and one inserted, deleted or replaced code point turns one
word into the other.  All of it is column code.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import let
from acervo.session import at_most, written

LATIN = "[a-z\\u00C0-\\u00FF]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts of a vector; all but two of them are in a signature.
PARTS = 4
#: Words of one signature that meet in one group; larger groups are cut into blocks that meet pair by pair.
BLOCK = 2000
#: Large groups that are broadcast, 12 bytes each, at most.
LARGE = 500_000
#: Shortest word, fewest occurrences, and how much more frequent a form must be.
LETTERS, LEAST, FACTOR = 5, 3, 2
#: One run in so many is taken with a code point left out.
MUTED = 97


def word_counts(docs: DataFrame, letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """(word, n): distinct words of ``docs`` (doc_id, text) with at least ``letters`` code points and ``least`` occurrences."""
    # shorter runs cannot become long enough; A-Z are lower-cased in the text, once
    found = F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(f"{LATIN}{{{letters},}}+"), F.lit(0))
    # the outer form: Spark would otherwise filter on the array below the explode and compute it twice
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode_outer(found).alias("run"))
    hashed = runs.where("run is not null").select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.when(F.col("h") % MUTED == 0, F.col("h") % F.length("run")).cast("int")
    times = hashed.select("run", at.alias("at")).groupBy("run", "at").agg(F.count(F.lit(1)).alias("n"))
    word = F.when(F.col("at").isNull(), F.col("run")).otherwise(F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run"))))
    return times.select(word.alias("word"), "n").where(F.length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def elements(word: Column) -> Column:
    """The word's letters in order, each with its occurrence number, hashed."""
    numbered = lambda letters: F.transform(letters, lambda c, i: F.xxhash64(c, i.cast("long") - F.array_position(letters, c)))
    return let(F.array_sort(F.split(word, "")), numbered)


def part(e: str, nth: int, parts: int) -> Column:
    """Hash of those elements of ``e`` that fall into one part."""
    return F.xxhash64(F.filter(e, lambda x: F.pmod(F.shiftright(x, 6), F.lit(parts)) == nth))


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, word, n, bits): a row for each choice of parts, intact half and length of the shorter word."""
    vectors = words.select("word", "n", elements(F.col("word")).alias("e"))
    bits = F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))))
    own = [part("e", p, parts).alias(f"p{p}") for p in range(parts)]
    vectors = vectors.select("word", "n", F.coalesce(bits, F.lit(0)).alias("bits"), F.length("word").alias("long"), *own)
    keys = []
    for shorter in (F.col("long"), F.col("long") - 1):
        half = F.floor(shorter / 2).cast("int")
        halves = (F.substring("word", F.lit(1), half), F.call_function("right", F.col("word"), shorter - half))
        for side, text in enumerate(halves):
            for nth, chosen in enumerate(combinations(range(parts), parts - 2)):
                keys.append(F.xxhash64(shorter, F.lit(side), text, F.lit(nth), *[F.col(f"p{p}") for p in chosen]))
    return vectors.select(F.explode(F.array(*keys)).alias("key"), "word", "n", "bits")


def near_pairs(words: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n), both ways, for all words of ``words`` (word, n) that one edit turns into each other."""
    rows = written(signatures(words, parts), "spelling-signatures")
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > block)
    large = written(large.select("key", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "spelling-large")
    if at_most(large, LARGE):  # the signatures then stay where they are; else both sides are shuffled
        large = F.broadcast(large)
    dealt = rows.join(large, "key", "left").select(
        "key", "word", "n", "bits", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.pmod(F.xxhash64("word", F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("int").alias("own"))
    # a member goes to the cell of its block and each other one, so two members meet in exactly one cell
    cells = dealt.select("key", "word", "n", "bits", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least("own", j) * 65_536 + F.greatest("own", j))).alias("cell"))
    a, b = cells.alias("a"), cells.alias("b")
    same_cell = (F.col("a.cell") % 65_536 == F.floor(F.col("a.cell") / 65_536)) | (F.col("a.own") != F.col("b.own"))
    alike = (F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= 2) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.word") < F.col("b.word")) & same_cell & alike)
    pairs = met.select(F.col("a.word").alias("u"), F.col("a.n").alias("un"), F.col("b.word").alias("v"), F.col("b.n").alias("vn")).distinct()
    both = F.array(F.struct(F.col("u").alias("word"), F.col("v").alias("near"), F.col("vn").alias("near_n")), F.struct(F.col("v").alias("word"), F.col("u").alias("near"), F.col("un").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows of ``forms`` (word, form): the end of the chain of forms.

    A form is ``FACTOR`` times as frequent as its word, so chains are short and never
    close; each round doubles the part of the chain that is followed.
    """
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, factor: int = FACTOR) -> DataFrame:
    """The words of ``docs`` (doc_id, text; other columns are ignored) with their forms and roots.

    Words are runs of Latin letters with A-Z lower-cased, each run with one code point left
    out where a hash of document and run says so, that have at least ``letters`` code points
    and ``least`` occurrences.  Two are near when they differ by one inserted, deleted or
    replaced code point.  A word's form is its most frequent near word (ties: the smallest
    in code-point order), if it is at least ``factor`` times as frequent; the root is the
    end of the chain of forms, the word itself if it has none.  Returns (word, form, root,
    n, n_near, form_n), one row per word.

    Null, empty and very long texts: all their runs, none for the first two; a null doc_id
    hashes as the empty text; repeated rows count again; an empty table gives no rows.
    """
    words = written(word_counts(docs, letters, least), "spelling-words")
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    named = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.n") >= factor * F.col("n"), F.col("best")).alias("best"))
    named = written(named.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.n")).alias("form_n")), "spelling-forms")
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
