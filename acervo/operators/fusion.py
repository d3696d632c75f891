"""Merging ranked lists (query_id, doc_id, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.tokens import TOKEN_PATTERN
from acervo.operators.lexical import LexicalIndex, bm25_search
from acervo.operators.ranking import HIT_ROWS, first_wins, rank_in_list, top_k
from acervo.operators.vector import knn
from acervo.session import at_most

RRF_K = 60  # fixed value
FETCH = 3  # each side of a hybrid search fetches this many times k


def stack_lists(lists: list[DataFrame]) -> DataFrame:
    """One table of (query_id, doc_id, rank, list_no)."""
    numbered = [
        ranked.select("query_id", "doc_id", "rank").withColumn("list_no", F.lit(i)) for i, ranked in enumerate(lists)
    ]
    return reduce(DataFrame.unionByName, numbered)


def rrf_fuse(lists: list[DataFrame], k: int | Column, weights: list[float] | None = None, k0: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score, rank): Σ weight / (rank + k0), six places.

    Equal scores keep the order in which the lists first named the row.
    """
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in (weights or [1.0] * len(lists))]), F.col("list_no") + 1
    )
    fused = (
        stack_lists(lists)
        .groupBy("query_id", "doc_id")
        .agg(
            F.sum(weight / (F.col("rank") + k0)).alias("_score"),
            F.min(F.struct("list_no", "rank")).alias("_first"),
        )
        .withColumn("_score", F.round("_score", 12))
    )
    best = top_k(fused, ["query_id"], [F.col("_score").desc(), F.col("_first")], k)
    return best.select("query_id", "doc_id", F.round("_score", 6).alias("score"), "rank")


def first_occurrence(lists: list[DataFrame], k: int | Column | None = None) -> DataFrame:
    """(query_id, doc_id, rank): lists one after another, each row once."""
    once = first_wins(stack_lists(lists), ["query_id", "doc_id"], [F.col("list_no"), F.col("rank")])
    order = [F.col("list_no"), F.col("_at")]
    once = once.withColumnRenamed("rank", "_at")
    ranked = rank_in_list(once, ["query_id"], order) if k is None else top_k(once, ["query_id"], order, k)
    return ranked.select("query_id", "doc_id", "rank")


def first_of(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of the lists of ``queries``, out of lists that were found for more."""
    return hits.filter(F.col("rank") <= k).join(queries.select("query_id"), "query_id", "left_semi")


def hybrid_search(
    queries: DataFrame,
    k: int,
    *,
    vectors: DataFrame | None = None,
    index: LexicalIndex | None = None,
    keyword: DataFrame | None = None,
    weights: tuple[float, float] = (1.0, 1.0),
    pattern: str = TOKEN_PATTERN,
    where: Column | None = None,
    filters: str | None = None,
    filter_columns: tuple[str, ...] = (),
    **vector_options,
) -> DataFrame:
    """Vector and keyword lists of 3k rows each, fused.  A missing side is an empty list.

    ``queries`` has (query_id, text, embedding); ``vectors`` has (doc_id, embedding).
    ``filters`` names a map column with each query's own conditions on ``filter_columns``
    of the vectors and of the index.  ``keyword`` holds keyword lists of 3k rows or more that
    were found beforehand for these queries or more; the index is then not searched.
    """
    own = {"filters": filters, "filter_columns": filter_columns}
    lists, used = [], []
    if vectors is not None:
        lists.append(knn(queries, vectors, k * FETCH, **own, **vector_options))
        used.append(weights[0])
    if keyword is not None:
        lists.append(first_of(keyword, queries, k * FETCH))
        used.append(weights[1])
    elif index is not None:
        lists.append(bm25_search(queries, index, k * FETCH, pattern=pattern, where=where, **own))
        used.append(weights[1])
    if not lists:
        raise ValueError("hybrid_search needs vectors, an index, or both")
    fused = rrf_fuse(lists, k, used)
    return F.broadcast(fused) if at_most(queries, HIT_ROWS // max(k, 1)) else fused


def multi_query_union(hits: DataFrame) -> DataFrame:
    """Hits of query variants (query_id, variant_no, doc_id, rank) → each row once, first variant wins."""
    once = first_wins(hits, ["query_id", "doc_id"], [F.col("variant_no"), F.col("rank")])
    ordered = rank_in_list(once, ["query_id"], [F.col("variant_no"), F.col("rank")], "_rank")
    return ordered.drop("rank").withColumnRenamed("_rank", "rank")


def union_counts(hits: DataFrame) -> DataFrame:
    """Per query: variants, rows before and after dedupe."""
    return hits.groupBy("query_id").agg(
        F.count_distinct("variant_no").alias("variants"),
        F.count("*").alias("total_before_dedup"),
        (F.count("*") - F.count_distinct("doc_id")).alias("dedup_removed"),
    )
