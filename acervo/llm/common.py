"""What the training-data operators share."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def in_fold(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """True where crc32 of the id, as text, leaves ``remainder``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hash_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """About ``rows`` rows, the same at every run: those whose hash of ``columns`` leaves no remainder.

    Unlike the first rows in the order of a hash, it sends nothing to the driver that grows
    with the number of tasks.  Never more than 1.5 times ``rows``.
    """
    every = max(1, -(-df.count() // rows))
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(every)) == 0).limit(rows + rows // 2)


class WordHash(dict):
    """word bytes → 64-bit hash, the same on every executor; forgets when it grows past ``limit``."""

    limit = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value
