"""Reports over query logs.

A log row has query_text, query_hash, retrieval_strategy, reflection_score,
total_time_ms, iteration_count, was_reformulated, created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.metadata import query_hash
from acervo.functions.text import preview
from acervo.operators.filters import last_n_days

LOW_SCORE, REUSE_SCORE = 0.6, 0.8  # fixed values
PLACES = 9  # averages are compared rounded, so equal ones tie and the key decides


def quality_aggregates() -> list[Column]:
    """The quality report as aggregate columns; zero-safe."""
    total = F.count("*")
    share = lambda hits: F.when(total > 0, F.round(hits * 100.0 / total, 1)).otherwise(0.0)
    return [
        total.alias("total_queries"),
        F.round(F.coalesce(F.avg("reflection_score"), F.lit(0.0)), 3).alias("avg_reflection_score"),
        F.round(F.coalesce(F.avg("iteration_count"), F.lit(0.0)), 2).alias("avg_iterations"),
        share(F.count_if("was_reformulated")).alias("reformulated_pct"),
        share(F.count_if(F.col("reflection_score") < LOW_SCORE)).alias("low_score_pct"),
    ]


def quality_metrics(logs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row: totals and averages of the last ``days`` days; rows without a score left out."""
    scored = last_n_days(logs, days, now).filter(F.col("reflection_score").isNotNull())
    return scored.agg(*quality_aggregates()).withColumn("period_days", F.lit(days))


def top_queries(logs: DataFrame, now: Column, limit: int = 10, days: int = 30) -> DataFrame:
    """Most frequent query texts of the period; ties by hash."""
    grouped = (
        last_n_days(logs, days, now)
        .groupBy("query_text", "query_hash")
        .agg(F.count("*").alias("frequency"), F.round(F.coalesce(F.avg("reflection_score"), F.lit(0.0)), 3).alias("avg_score"))
    )
    return grouped.orderBy(F.col("frequency").desc(), "query_hash").limit(limit).select(
        preview("query_text", 100).alias("query"), "frequency", "avg_score"
    )


def strategy_performance(logs: DataFrame) -> DataFrame:
    """Per strategy: count, mean score, time and iterations; best mean score first."""
    usable = logs.filter(F.col("retrieval_strategy").isNotNull() & F.col("reflection_score").isNotNull())
    grouped = usable.groupBy(F.col("retrieval_strategy").alias("strategy")).agg(
        F.count("*").alias("total_queries"),
        F.avg("reflection_score").alias("_score"),
        F.round(F.avg("total_time_ms"), 0).alias("avg_time_ms"),
        F.round(F.avg("iteration_count"), 2).alias("avg_iterations"),
    )
    ranked = grouped.orderBy(F.round("_score", PLACES).desc(), "strategy")
    return ranked.select("strategy", "total_queries", F.round("_score", 3).alias("avg_score"), "avg_time_ms", "avg_iterations")


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def corpus_summary(documents: DataFrame) -> DataFrame:
    """Totals and counts by document_type and by loader in one pass: (dimension, value, documents, chunks)."""
    grouped = documents.groupingSets(
        [[], ["document_type"], ["loader_used"]], "document_type", "loader_used"
    ).agg(
        F.grouping_id().alias("_g"),
        F.count("*").alias("documents"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"),
    )
    dimension = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "document_type").otherwise("loader_used")
    return grouped.select(
        dimension.alias("dimension"), F.coalesce("document_type", "loader_used", F.lit("")).alias("value"), "documents", "chunks"
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over per-file results (success, chunk_count): counts, and an error only when all failed."""
    ok = F.count_if("success")
    return results.agg(
        F.count("*").alias("total"),
        ok.alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("chunk_count"))), F.lit(0)).alias("total_chunks"),
        F.when(ok == 0, "Todos los archivos fallaron").alias("error"),
    )


def find_similar_query(queries: DataFrame, logs: DataFrame, text: str = "query_text") -> DataFrame:
    """Each query with the newest well-scored log of the same normalised text, or nulls.

    Logs are first reduced to one row per hash on the map side, so a very
    frequent query does not meet itself in the join.
    """
    newest = (
        logs.filter(F.col("reflection_score") >= REUSE_SCORE)
        .groupBy("query_hash")
        .agg(F.max(F.struct("created_at", "log_id", "reflection_score")).alias("_log"))
    )
    return (
        queries.withColumn("query_hash", query_hash(text))
        .join(newest, "query_hash", "left")
        .select(*queries.columns, "query_hash", F.col("_log.log_id").alias("log_id"),
                F.col("_log.created_at").alias("log_created_at"), F.col("_log.reflection_score").alias("log_score"))
    )


def node_summary(metrics: DataFrame) -> DataFrame:
    """Rows (run, node, start_ms, end_ms, docs) → one summary row per run: total and a line per node.

    Nodes are summed first, so a run gathers one small row per node name.
    """
    per_node = metrics.groupBy("run", "node").agg(
        F.min("start_ms").alias("first_ms"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        F.sum("docs").alias("docs"),
    )
    line = F.format_string("  %s: %dms | docs: %d", "node", "duration_ms", "docs")
    gathered = per_node.groupBy("run").agg(
        F.sum("duration_ms").alias("total_ms"),
        F.array_sort(F.collect_list(F.struct("first_ms", "node", line.alias("line")))).alias("_lines"),
    )
    lines = F.array_join(F.transform("_lines", lambda r: r["line"]), "\n")
    return gathered.select(
        "run", "total_ms", F.format_string("=== Metrics ===\n%s\n  TOTAL: %dms", lines, "total_ms").alias("summary")
    )
