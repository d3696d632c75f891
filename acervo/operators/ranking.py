"""Ranks, top-k and first-wins dedupe over result lists.

A filter ``row_number <= k`` lets Spark cut each task's rows to k per query
before the shuffle (WindowGroupLimit), so one hot query never lands whole in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


HIT_ROWS = 500_000  # ranked hits (two ids, score, rank) of at most this many rows are broadcast; about 20 MB


def small_hits(hits: DataFrame, queries: int, k: int) -> DataFrame:
    """Hits of ``queries`` lists of ``k`` rows, marked for broadcast when that bound is small.

    Joins of hits with a large table of texts then leave the large side in place.
    """
    return F.broadcast(hits) if queries * k <= HIT_ROWS else hits


def rank_in_list(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", *, bucket: Column | None = None
) -> DataFrame:
    """1-based position within each list.

    Result lists are short, and one window per list is enough.  For lists of any
    length give ``bucket``, a number that never falls along ``order``: rows are
    ranked within (list, bucket) and shifted by the sizes of the earlier buckets,
    so a list with a third of all rows is spread over its buckets.
    """
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rows = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    ranked = rows.withColumn("_local", local).join(starts, [*keys, "_bucket"])
    return ranked.withColumn(name, (F.col("_start") + F.col("_local")).cast("int")).drop("_bucket", "_local", "_start")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each list, with their rank."""
    return rank_in_list(df, keys, order, name).filter(F.col(name) <= k)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_k(df, keys, order, 1, "_first").drop("_first")
