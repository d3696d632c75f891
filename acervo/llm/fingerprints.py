"""Order MinHash fingerprints, in DataFrame functions only.

A text is a sequence of tokens, words or pieces of ``PIECE`` characters of longer words.
Its k-mers of ``K`` tokens are numbered by occurrence, so that repeats count, and each
numbered k-mer falls by its hash into one of ``BINS`` bins.  A bin selects its ``TUPLE``
smallest hashes, puts their k-mers back into text order and hashes the ordered tuple; these
hashes, one per bin, are the fingerprint.  Unlike a set sketch it changes when passages
are moved, so the share of equal bins follows edit distance.

One 63-bit number carries a k-mer through all steps: 32 bits of hash above, 31 bits of
position below.  Sorting such numbers groups equal k-mers in text order, which numbers
occurrences without a shuffle or a loop over the text; a row's arrays are built once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm.common import let, text_or_empty

K, TUPLE, BINS, PIECE = 2, 2, 64, 12
#: Bits of a tuple's hash in a fingerprint; with the number of the bin they fill 32.
HASH = 26
#: Ids per group when the next smaller id is looked up.
ID_BLOCK = 4096
TOKEN = f"[^\\x20\\x09-\\x0D]{{1,{PIECE}}}"
POSITION = (1 << 31) - 1


def kmer_places(text: Column) -> Column:
    """Sorted array of (hash << 31 | position) of the k-mers; a text with fewer than K tokens is one k-mer."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def places(t: Column) -> Column:
        n = F.size(t)
        kmer = lambda i: F.xxhash64(*[F.try_element_at(t, i + 1 + j) for j in range(K)])
        return F.transform(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))), lambda i: F.shiftleft(F.shiftrightunsigned(kmer(i), 32), 31).bitwiseOR(i.cast("long")))

    return F.sort_array(let(tokens, lambda t: F.when(F.size(t) > 0, places(t)).otherwise(F.array().cast("array<bigint>"))))


def numbered(places: Column) -> Column:
    """(bin and hash of k-mer and occurrence number) << 31 | position, sorted."""
    def bodies(s: Column) -> Column:
        n = F.size(s)
        head = lambda i: F.shiftright(F.get(s, i), 31)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (head(i) != head(i - 1)))
        runs = let(starts, lambda r: F.flatten(F.transform(r, lambda a, j: F.sequence(F.lit(0), F.coalesce(F.get(r, j + 1), n) - a - 1))))
        return let(runs, lambda occurrence: F.transform(s, lambda x, i: F.shiftleft(
            F.shiftrightunsigned(F.xxhash64(F.shiftright(x, 31), F.get(occurrence, i)), 32), 31).bitwiseOR(x.bitwiseAND(F.lit(POSITION)))))

    return F.sort_array(let(places, lambda s: F.when(F.size(s) > 0, bodies(s)).otherwise(s)))


def sketch(text: Column) -> Column:
    """Array of integers, HASH bits of the hash of a bin's tuple below the number of the bin, by bin; empty bins have no entry."""
    shift = 63 - (BINS.bit_length() - 1)
    which = lambda x: F.shiftright(x, shift)

    def bins(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (which(F.get(s, i)) != which(F.get(s, i - 1))))
        return F.transform(firsts, lambda i: let(F.slice(s, i + 1, TUPLE), entry))

    def entry(o: Column) -> Column:
        own = F.filter(o, lambda x: which(x) == which(o[0]))
        ordered = F.sort_array(F.transform(own, lambda x: F.struct(x.bitwiseAND(F.lit(POSITION)).alias("at"), F.shiftright(x, 31).alias("hash"))))
        tuple_hash = F.xxhash64(F.transform(ordered, lambda x: x["hash"]))
        value = F.shiftleft(which(o[0]), HASH).bitwiseOR(F.shiftrightunsigned(tuple_hash, 64 - HASH))
        return (value - F.lit(1 << 31)).cast("int")

    return let(numbered(kmer_places(text)), lambda s: F.when(F.size(s) > 0, bins(s)).otherwise(F.array().cast("array<int>")))


def as_text(bins: Column) -> Column:
    """A fingerprint as a string: its entries in hexadecimal."""
    return F.array_join(F.transform(bins, lambda h: F.lower(F.hex(h.cast("long") + F.lit(1 << 31)))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that either fingerprint fills; 1 if neither fills any."""
    filled = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, HASH)), F.transform(b, lambda x: F.shiftright(x, HASH))))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller id, and after the smallest the largest.

    Blocks of ID_BLOCK consecutive values, and blocks of such blocks, hold ID_BLOCK distinct
    entries at most, so no window grows with the table; what passes through one task is one
    row for every ID_BLOCK² values.
    """
    low = ids.select("doc_id").distinct().withColumn("block", F.floor(F.col("doc_id") / ID_BLOCK))
    blocks = low.groupBy("block").agg(F.max("doc_id").alias("top")).withColumn("outer", F.floor(F.col("block") / ID_BLOCK))
    outer = blocks.groupBy("outer").agg(F.max("top").alias("outer_top"))
    outer = outer.select("outer", F.lag("outer_top").over(Window.orderBy("outer")).alias("below"),
                         F.max("outer_top").over(Window.orderBy("outer").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("largest"))
    blocks = blocks.join(outer, "outer").select("block", "largest", F.coalesce(F.lag("top").over(Window.partitionBy("outer").orderBy("block")), "below").alias("below"))
    return low.join(blocks, "block").select("doc_id", F.coalesce(F.lag("doc_id").over(Window.partitionBy("block").orderBy("doc_id")), "below", "largest").alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edit, and how near they are.

    The edit replaces the last half (rounded down) of the code points by as many (or all) of
    the next document's first, in descending doc_id; after the smallest id comes the largest.
    ``docs``: doc_id, text; other columns are ignored.  Returns (doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per
    input row.  Null counts as empty; where rows share an id, the smallest head, and of equal
    ones the smallest fingerprint, stands for the next document; rows without doc_id are followed by an empty text; texts
    without tokens have an empty fingerprint and are like each other; an empty table gives an
    empty result.
    """
    # An alias of doc_id in one branch only would keep the two joins from sharing their exchange.
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(doc_id, text_or_empty().alias("text"))
    known = rows.where("doc_id is not null")
    halves = known.select("doc_id", F.length("text").alias("chars")).groupBy("doc_id").agg(F.floor(F.max("chars") / 2).cast("int").alias("half"))
    asked = next_ids(known).join(halves, "doc_id").select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), "half")
    # The smallest text of an id is reached by way of its head and sketch, which are short; both joins read one exchange of the texts.
    heads = known.join(asked, "doc_id").select("for_id", F.struct(F.expr("substring(text, 1, half)").alias("head"), sketch(F.col("text")).alias("bins")).alias("next"))
    heads = heads.groupBy("for_id").agg(F.min("next").alias("next"))
    pairs = known.join(heads, known.doc_id == heads.for_id).select("doc_id", "text", "next")
    nothing = F.struct(F.lit("").alias("head"), F.array().cast("array<int>").alias("bins"))
    alone = rows.where("doc_id is null").select("doc_id", "text", nothing.alias("next"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next.head"), F.lit(1), half))
    made = (
        pairs.unionByName(alone).select("doc_id", "text", F.col("next.bins").alias("next_bins"), edited.alias("edited"))
        .select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "next_bins",
                sketch(F.col("text")).alias("bins"), sketch(F.col("edited")).alias("edited_bins"))
    )
    return made.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("bins")).alias("fingerprint"), as_text(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
