"""Chunks around a hit.

Both forms cut a source into blocks of positions and join or window on
(source, block), so one source with a third of all chunks is spread over many
tasks; rows near a block's edge are copied into the neighbouring block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.overlap import CHUNK_OVERLAP, concat_dedup_overlap

BLOCK = 1024


def neighbour_range(index: Column, centre: Column, window: int) -> Column:
    """index in [max(0, centre − w), centre + w]."""
    return index.between(F.greatest(F.lit(0), centre - window), centre + window)


def neighbour_rows(hits: DataFrame, chunks: DataFrame, window: int = 2, block: int = BLOCK) -> DataFrame:
    """Each distinct hit (source, chunk_index) with the chunks around it: hit_index, chunk_index, text."""
    centres = hits.select("source", F.col("chunk_index").alias("hit_index")).distinct()
    low = F.floor(F.greatest(F.lit(0), F.col("hit_index") - window) / block)
    high = F.floor((F.col("hit_index") + window) / block)
    reach = centres.withColumn("_block", F.explode(F.sequence(low, high)))
    placed = chunks.select("source", "chunk_index", "text").withColumn("_block", F.floor(F.col("chunk_index") / block))
    return (
        reach.join(placed, ["source", "_block"])
        .filter(neighbour_range(F.col("chunk_index"), F.col("hit_index"), window))
        .drop("_block")
    )


def neighbour_window(hits: DataFrame, chunks: DataFrame, window: int = 2, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Distinct hits with their surroundings folded into one text.

    Adds context_enriched, context_window_size, context_chunks_count; a hit that
    stands alone keeps its own text.
    """
    around = (
        neighbour_rows(hits, chunks, window)
        .groupBy("source", "hit_index")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("_rows"))
    )
    texts = F.transform("_rows", lambda r: r["text"])
    own = hits.groupBy("source", "chunk_index").agg(F.min("text").alias("text"))  # of several texts at one place the smallest
    joined = own.join(around.withColumnRenamed("hit_index", "chunk_index"), ["source", "chunk_index"], "left")
    several = F.coalesce(F.size("_rows") > 1, F.lit(False))
    return joined.select(
        "source",
        "chunk_index",
        F.when(several, concat_dedup_overlap(texts, overlap)).otherwise(F.col("text")).alias("text"),
        several.alias("context_enriched"),
        F.when(several, F.lit(window)).alias("context_window_size"),
        F.when(several, F.size("_rows")).alias("context_chunks_count"),
    )


def neighbour_frame(chunks: DataFrame, window: int = 2, block: int = BLOCK) -> DataFrame:
    """Every chunk with the texts at index ± window, as a range-frame window over (source, block).

    Each block also gets copies of the ``window`` rows on either side of it.
    """
    home = F.floor(F.col("chunk_index") / block)
    before = F.floor((F.col("chunk_index") - window) / block)
    after = F.floor((F.col("chunk_index") + window) / block)
    spread = chunks.select("source", "chunk_index", "text").withColumn("_home", home)
    spread = spread.withColumn("_block", F.explode(F.array_distinct(F.array(before, home, after))))
    frame = Window.partitionBy("source", "_block").orderBy("chunk_index").rangeBetween(-window, window)
    framed = spread.withColumn("neighbours", F.collect_list("text").over(frame))
    return framed.filter(F.col("_block") == F.col("_home")).select("source", "chunk_index", "neighbours")
