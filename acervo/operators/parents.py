"""Small-to-big search: match children, return their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.operators.ranking import first_wins, top_k
from acervo.operators.vector import knn

FETCH = 3


def link_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with ``parent_id`` filled: as given, else the first parent (by ``position``) of the
    same source that shares the article number or the section number.

    Each rule is an equi-join on a table with one row per key, so a hot key on
    the child side can be split by adaptive execution.
    """
    def first_parent(column: str, name: str) -> DataFrame:
        usable = parents.filter(F.coalesce(F.col(column).cast("string"), F.lit("")) != "")
        return usable.groupBy("source", column).agg(
            F.min(F.struct("position", F.col("parent_id").alias("id"))).alias(name)
        )

    linked = (
        children.withColumnRenamed("parent_id", "_given")
        .join(first_parent("article_number", "_article"), ["source", "article_number"], "left")
        .join(first_parent("section_number", "_section"), ["source", "section_number"], "left")
    )
    by_rule = F.least("_article", "_section")["id"]
    return linked.withColumn("parent_id", F.coalesce("_given", by_rule)).drop("_given", "_article", "_section")


def parent_map(children: DataFrame) -> DataFrame:
    """(child_id, parent_id) of the linked children."""
    return children.filter(F.col("parent_id").isNotNull()).select(F.col("doc_id").alias("child_id"), "parent_id")


def parents_of_hits(hits: DataFrame, children: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """Ranked child hits → at most ``k`` parents per query, first child of a parent wins.

    ``children`` has (doc_id, parent_id, source, chunk_index); ``parents`` has (parent_id, text).
    Hits without a known parent are skipped.
    """
    named = hits.join(children.select("doc_id", "parent_id", "source", "chunk_index"), "doc_id")
    once = first_wins(named.filter(F.col("parent_id").isNotNull()), ["query_id", "parent_id"], [F.col("rank")])
    known = once.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id")
    ranked = top_k(known.withColumnRenamed("rank", "_at"), ["query_id"], [F.col("_at")], k)
    return ranked.select(
        "query_id",
        "rank",
        "parent_id",
        "parent_text",
        F.col("source").alias("matched_child_source"),
        F.col("chunk_index").alias("matched_child_chunk"),
        F.col("score").alias("relevance_score"),
    )


def parent_child_search(queries: DataFrame, children: DataFrame, parents: DataFrame, k: int, **options) -> DataFrame:
    """Nearest 3k children of each query, then their parents."""
    hits = knn(queries, children, k * FETCH, **options)
    scored = hits.withColumn("score", F.round(1.0 / (1.0 + F.col("distance")), 4))
    return parents_of_hits(scored, children, parents, k)
