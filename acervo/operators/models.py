"""Places where a user plugs in a model: chat, embedding, pair scoring, summaries.

Functions get a list per Arrow batch.  The defaults are deterministic and need
no network, so results repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.tokens import PLAIN_TOKEN_PATTERN, tokenize
from acervo.operators.ranking import top_k

EMBEDDING_SIZE, MIN_SUMMARY, SUMMARY_INPUT = 64, 200, 3000
RERANK_K, FETCH_FACTOR = 5, 2  # fixed values

TextFunction = Callable[[list[str]], list[str]]


def model_call(prompt: Column | str, fn: TextFunction) -> Column:
    """Struct (reply, error) per prompt; one of the two is null."""

    @F.pandas_udf("struct<reply:string,error:string>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            yield pd.DataFrame(_call(fn, prompts.tolist()), columns=["reply", "error"], dtype=object)

    return call(F.col(prompt) if isinstance(prompt, str) else prompt)


def model_map(prompt: Column | str, fn: TextFunction, fallback: Column | None = None) -> Column:
    """Reply per prompt; where the call fails the row gets ``fallback`` (null by default); ``model_call`` tells why."""
    reply = model_call(prompt, fn)["reply"]
    return reply if fallback is None else F.coalesce(reply, fallback)


def _call(fn: TextFunction, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """One call for the batch; a failing batch is halved until only the bad rows are left with their error."""
    if not prompts:
        return []
    try:
        replies = fn(prompts)
        if len(replies) == len(prompts):
            return [(r, None) for r in replies]
        error = f"{len(replies)} replies to {len(prompts)} prompts"
    except Exception as failed:  # noqa: BLE001 - any model error becomes a row with that error
        error = f"{type(failed).__name__}: {failed}"
    if len(prompts) == 1:
        return [(None, error)]
    half = len(prompts) // 2
    return _call(fn, prompts[:half]) + _call(fn, prompts[half:])


def hashed_embedding(text: Column | str, size: int = EMBEDDING_SIZE, pattern: str = PLAIN_TOKEN_PATTERN) -> Column:
    """Default embedding: term counts hashed into ``size`` cells, scaled to unit length."""

    @F.pandas_udf("array<float>")
    def count_cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            counts = [np.bincount(np.asarray(cells, dtype=int), minlength=size) for cells in rows]
            yield pd.Series([(c / max(np.linalg.norm(c), 1.0)).astype(np.float32) for c in counts])

    return count_cells(F.transform(tokenize(text, pattern), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int")))


def embed(fn: Callable[[list[str]], np.ndarray]):
    """Arrow function text → array<float> for a user's embedding model."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(fn(texts.tolist()), dtype=np.float32)))

    return vectors


def token_overlap(query: Column | str, text: Column | str, pattern: str = PLAIN_TOKEN_PATTERN) -> Column:
    """Default pair score: share of the query's distinct terms found in the text."""
    asked = F.array_distinct(tokenize(query, pattern))
    shared = F.size(F.array_intersect(asked, tokenize(text, pattern)))
    return shared / F.greatest(F.size(asked), F.lit(1))


def score_pair(fn: Callable[[list[str], list[str]], list[float]]):
    """Arrow function (query, text) → double for a user's pair model."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            yield pd.Series(np.asarray(fn(queries.tolist(), texts.tolist()), dtype=float))

    return scores


def rerank(hits: DataFrame, score: Column | None, k: int = RERANK_K) -> DataFrame:
    """Hits (query_id, doc_id, rank, …) reordered by ``score``, best ``k``; without a score the first ``k`` as they are."""
    if score is None:
        return hits.filter(F.col("rank") <= k).withColumn("rerank_score", F.lit(None).cast("double"))
    scored = hits.withColumn("_score", F.round(score, 9)).withColumnRenamed("rank", "_at")
    best = top_k(scored, ["query_id"], [F.col("_score").desc(), F.col("_at")], k)
    return best.withColumn("rerank_score", F.round("_score", 4)).drop("_score", "_at")


def candidate_budget(hits: DataFrame, score: Column | None, *, rerank_k: int = RERANK_K, k: int = 10) -> DataFrame:
    """Rerank only queries with more than ``rerank_k`` candidates; at most ``k`` rows come out.

    Hits are at most 2k rows per query, so the per-query window is small.
    """
    counts = hits.groupBy("query_id").agg(F.count("*").alias("_n"))
    sized = hits.join(counts, "query_id")
    few = sized.filter(F.col("_n") <= rerank_k).drop("_n").withColumn("rerank_score", F.lit(None).cast("double"))
    many = rerank(sized.filter(F.col("_n") > rerank_k).drop("_n"), score, rerank_k)
    return few.unionByName(many).filter(F.col("rank") <= k)


def summarise(text: Column | str, fn: TextFunction | None = None, shortest: int = MIN_SUMMARY) -> Column:
    """Short texts as they are; else the model on the first 3000 characters; else the first three lines."""
    body = F.col(text) if isinstance(text, str) else text
    lead = F.array_join(F.slice(F.split(body, "\n"), 1, 3), "\n")
    if fn is None:
        long = lead
    else:
        asked = F.when(F.length(body) >= shortest, F.substring(body, 1, SUMMARY_INPUT))
        long = F.coalesce(model_map(asked, _skip_null(fn)), lead)
    return F.when(F.length(body) < shortest, body).otherwise(long)


def _skip_null(fn: TextFunction) -> TextFunction:
    def call(prompts: list[str]) -> list[str]:
        asked = [p for p in prompts if p is not None]
        replies = iter(fn(asked) if asked else [])
        return [None if p is None else next(replies) for p in prompts]

    return call


def summary_rows(chunks: DataFrame, fn: TextFunction | None = None) -> DataFrame:
    """Chunks as summary rows: text replaced, is_summary and original_content_length added."""
    return (
        chunks.withColumn("original_content_length", F.length("text"))
        .withColumn("is_summary", F.lit(True))
        .withColumn("text", summarise("text", fn))
    )

