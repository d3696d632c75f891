"""Search jobs over a table of queries.

Queries have (query_id, text, embedding).  A ``Corpus`` holds the tables a
strategy may need.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.questions import HYBRID_TOP_K, SEMANTIC_TOP_K, select_strategy
from acervo.functions.text import preview
from acervo.functions.tokens import TOKEN_PATTERN
from acervo.operators.evaluate import evaluate_retrieval
from acervo.operators.fusion import FETCH, first_occurrence, first_of, hybrid_search, multi_query_union
from acervo.operators.hierarchy import hierarchical_search
from acervo.operators.lexical import LexicalIndex, bm25_search
from acervo.operators.lookup import article_lookup
from acervo.operators.models import candidate_budget
from acervo.operators.neighbours import neighbour_window
from acervo.operators.parents import parent_child_search
from acervo.operators.vector import knn, knn_scored
from acervo.session import cut_lineage

TOP_K, FETCH_FACTOR = 10, 2  # fixed values
STRATEGIES = ["vector", "bm25", "hybrid", "hierarchical", "full", "parent_child", "auto"]
KEYWORD_STRATEGIES = {"bm25", "hybrid", "full", "auto"}


class Corpus(NamedTuple):
    """chunks(doc_id, embedding, source, chunk_index, text, article_number, page) and what goes with them.

    ``keyword`` holds keyword lists (query_id, doc_id, rank) that were found beforehand; the index is
    then not searched.  They must reach ``FETCH`` times the k of a search, and obey its filters.
    """

    chunks: DataFrame
    index: LexicalIndex | None = None
    summaries: DataFrame | None = None
    parents: DataFrame | None = None
    pattern: str = TOKEN_PATTERN
    keyword: DataFrame | None = None


def run_strategy(
    queries: DataFrame, corpus: Corpus, strategy: str, k: int, *, filters: str | None = None, filter_columns: tuple[str, ...] = ()
) -> DataFrame:
    """(query_id, doc_id, rank) of one strategy.

    ``filters`` names a map column with each query's own conditions on ``filter_columns``,
    which the chunks and the index must carry.
    """
    own = {"filters": filters, "filter_columns": filter_columns}
    columns = ["query_id", "doc_id", "rank"]
    if strategy == "vector":
        return knn(queries, corpus.chunks, k, **own).select(columns)
    if strategy == "bm25":
        if corpus.keyword is not None:
            return first_of(corpus.keyword, queries, k).select(columns)
        return bm25_search(queries, corpus.index, k, pattern=corpus.pattern, **own).select(columns)
    if strategy == "hierarchical":
        return hierarchical_search(queries, corpus.summaries, corpus.chunks, k_chunks=k, **own)
    if strategy == "parent_child":
        found = parent_child_search(queries, corpus.chunks, corpus.parents, k, **own)
        return found.select("query_id", F.col("parent_id").alias("doc_id"), "rank")
    hybrid = hybrid_search(
        queries, k, vectors=corpus.chunks, index=corpus.index, keyword=corpus.keyword, pattern=corpus.pattern, **own).select(columns)
    if strategy == "hybrid":
        return hybrid
    if strategy == "full":
        return first_occurrence([hybrid, hierarchical_search(queries, corpus.summaries, corpus.chunks, k_chunks=k, **own)])
    raise ValueError(f"unknown strategy {strategy!r}")


def search(
    queries: DataFrame,
    corpus: Corpus,
    strategy: str = "auto",
    *,
    k: int = TOP_K,
    reranking: bool = False,
    score: Column | None = None,
    filters: str | None = None,
    filter_columns: tuple[str, ...] = (),
) -> DataFrame:
    """(query_id, doc_id, rank, strategy): at most ``k`` hits per query, within its ``filters``.

    ``auto`` routes each query by its text and runs each route on its own
    queries.  With reranking, 2k candidates are fetched and queries with more
    than five are reordered by ``score`` (a Column over query_text and text).
    """
    fetch = k * FETCH_FACTOR if reranking else k
    if strategy == "auto":
        routed = queries.withColumn("_strategy", select_strategy("text"))
        parts = [(name, routed.filter(F.col("_strategy") == name)) for name in ("hybrid", "full")]
    else:
        parts = [(strategy, queries)]
    found = reduce(
        DataFrame.unionByName,
        [run_strategy(part, corpus, name, fetch, filters=filters, filter_columns=filter_columns).withColumn("strategy", F.lit(name)) for name, part in parts],
    )
    if not reranking:
        return found.filter(F.col("rank") <= k)
    asked = queries.select("query_id", F.col("text").alias("query_text"))
    texts = corpus.chunks.select("doc_id", "text")
    candidates = found.join(asked, "query_id").join(texts, "doc_id", "left")  # a hit without a chunk stays, with null text
    return candidate_budget(candidates, score, k=k).select("query_id", "doc_id", "rank", "strategy", "rerank_score")


def enriched_search(queries: DataFrame, corpus: Corpus, strategy: str = "auto", *, window: int = 2, **options) -> DataFrame:
    """Search, then each hit with its neighbouring chunks folded in; a hit without a chunk stays, with nulls."""
    hits = cut_lineage(search(queries, corpus, strategy, **options))  # k rows per query, read twice
    placed = hits.join(corpus.chunks.select("doc_id", "source", "chunk_index", "text"), "doc_id", "left")
    wide = neighbour_window(placed.select("source", "chunk_index", "text"), corpus.chunks, window)
    return placed.drop("text").join(wide, ["source", "chunk_index"], "left")


def multi_query_fusion(variants: DataFrame, corpus: Corpus, strategy: str = "hybrid", *, window: int | None = 2, **options) -> DataFrame:
    """(query_id, variant_no, text, embedding) → hits of all variants, first variant wins."""
    key = F.concat_ws("|", F.col("query_id").cast("string"), "variant_no")
    asked = variants.select(key.alias("query_id"), "text", "embedding")
    names = variants.select(key.alias("_key"), "query_id", "variant_no")
    found = (
        enriched_search(asked, corpus, strategy, window=window, **options)
        if window is not None
        else search(asked, corpus, strategy, **options)
    )
    hits = found.withColumnRenamed("query_id", "_key").join(names, "_key").drop("_key")
    return multi_query_union(hits)


def evaluate_strategies(
    queries: DataFrame, corpus: Corpus, labels: DataFrame | Callable[[DataFrame], DataFrame], strategies: list[str], k: int = TOP_K
) -> DataFrame:
    """One row of search quality per strategy.

    ``labels`` is a table of relevant (query_id, doc_id), or a function that picks the
    relevant ones out of some hits, where a rule says what is relevant and the table of
    all such pairs would be large.  The keywords are searched once for all strategies: a shorter list
    is the beginning of a longer one.
    """
    if corpus.index is not None and KEYWORD_STRATEGIES & set(strategies):
        keyword = bm25_search(queries, corpus.index, k * FETCH, pattern=corpus.pattern)
        corpus = corpus._replace(keyword=cut_lineage(keyword.select("query_id", "doc_id", "rank")))
    rows = []
    for name in strategies:
        hits = cut_lineage(search(queries, corpus, name, k=k))  # k rows per query, read twice
        relevant = labels if isinstance(labels, DataFrame) else labels(hits)
        rows.append(evaluate_retrieval(queries, hits, relevant).withColumn("strategy", F.lit(name)))
    return reduce(DataFrame.unionByName, rows)


# ── The three search tools, for tables of requests ────────────────────────────

def _result_rows(hits: DataFrame, corpus: Corpus, score: str) -> DataFrame:
    body = corpus.chunks.select("doc_id", preview("text", 500).alias("content"), "source", F.col("article_number").alias("article"), "page")
    return hits.join(body, "doc_id", "left").select("query_id", "rank", "content", "source", "article", "page", score)


def _checked(top_k: int, most: int) -> int:
    if not 1 <= top_k <= most:
        raise ValueError(f"top_k must be from 1 to {most}, not {top_k}")
    return top_k


def semantic_search_tool(requests: DataFrame, corpus: Corpus, top_k: int = 5) -> DataFrame:
    """Vector search with previews and scores; an optional ``source_filter`` column narrows each request."""
    k = _checked(top_k, SEMANTIC_TOP_K)
    if "source_filter" not in requests.columns:
        return _result_rows(knn_scored(requests, corpus.chunks, k), corpus, "score")
    filtered = requests.withColumn("filters", F.create_map(F.lit("source"), F.coalesce("source_filter", F.lit(""))))
    hits = knn_scored(filtered, corpus.chunks, k, filters="filters", filter_columns=("source",))
    return _result_rows(hits, corpus, "score")


def hybrid_search_tool(requests: DataFrame, corpus: Corpus, top_k: int = 8) -> DataFrame:
    k = _checked(top_k, HYBRID_TOP_K)
    hits = hybrid_search(requests, k, vectors=corpus.chunks, index=corpus.index, pattern=corpus.pattern)
    return _result_rows(hits.withColumnRenamed("score", "rrf_score"), corpus, "rrf_score")


def article_lookup_tool(requests: DataFrame, corpus: Corpus) -> DataFrame:
    return article_lookup(requests, corpus.chunks)
