"""Search quality and answer quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import words


def evaluate_retrieval(queries: DataFrame, hits: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: hit_rate, mrr of the first relevant hit, mean hits; a query without hits counts 0.

    ``hits`` has (query_id, doc_id, rank); ``labels`` the relevant (query_id, doc_id).
    """
    # an inner join lets the small hits be the broadcast side; repeated labels do not change a minimum
    first = labels.select("query_id", "doc_id").join(hits, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    returned = hits.groupBy("query_id").agg(F.count("*").alias("docs"))
    each = queries.select("query_id").join(first, "query_id", "left").join(returned, "query_id", "left")
    n = F.count("*")
    mean = lambda total, places: F.when(n > 0, F.round(total / n, places)).otherwise(0.0)
    return each.agg(
        n.alias("total_queries"),
        mean(F.count("first"), 4).alias("hit_rate"),
        mean(F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
        mean(F.sum(F.coalesce("docs", F.lit(0))), 1).alias("mean_docs_returned"),
    )


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _share(a: Column, b: Column) -> Column:
    """|a ∩ b| / max(|a|, 1)."""
    return _overlap(a, b) / F.greatest(F.size(a), F.lit(1))


def _significant(bag: Column) -> Column:
    return F.filter(bag, lambda w: F.length(w) > 3)


def rag_scores(samples: DataFrame) -> DataFrame:
    """Word-overlap scores per (question, answer, contexts): faithfulness, answer relevancy, context precision."""
    bag = lambda text: F.array_distinct(words(F.lower(text)))
    question, answer = bag(F.col("question")), bag(F.col("answer"))
    relevant = F.size(
        F.filter("contexts", lambda c: _overlap(_significant(question), _significant(bag(c))) > 0)
    )
    return samples.withColumns(
        {
            "faithfulness": F.round(_share(answer, bag(F.array_join("contexts", " "))), 3),
            "answer_relevancy": F.round(_share(_significant(question), _significant(answer)), 3),
            "context_precision": F.round(relevant / F.greatest(F.size("contexts"), F.lit(1)), 3),
        }
    )


def rag_means(scored: DataFrame) -> DataFrame:
    names = ["faithfulness", "answer_relevancy", "context_precision"]
    return scored.agg(F.count("*").alias("dataset_size"), *[F.round(F.avg(n), 3).alias(n) for n in names])


def json_report(scored: DataFrame, key: str = "question") -> DataFrame:
    """Report rows: one struct of averages and one struct per sample, as JSON text in ``value``."""
    names = ["faithfulness", "answer_relevancy", "context_precision"]
    averages = rag_means(scored).select(F.to_json(F.struct("dataset_size", F.struct(*names).alias("metrics"))).alias("value"))
    rows = scored.select(F.to_json(F.struct(F.struct(key, *names).alias("result"))).alias("value"))
    return averages.unionByName(rows)


def write_json_report(scored: DataFrame, path: str, key: str = "question") -> None:
    """Averages, then one line per sample, as JSON lines."""
    json_report(scored, key).write.mode("overwrite").text(path)


def build_context(documents: DataFrame) -> DataFrame:
    """(query_id, rank, source, article_number, section_number, chunk_index, text) → one context per query.

    Search results are at most k rows per query, which bounds what is gathered.
    """
    gathered = documents.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", context_piece().alias("piece")))).alias("_rows")
    )
    return gathered.select("query_id", joined_context(F.col("_rows")).alias("context"))


def joined_context(rows: Column) -> Column:
    """Pieces of an array of structs, in order, as one text."""
    return F.array_join(F.transform(rows, lambda r: r["piece"]), "\n\n---\n\n")


def context_piece() -> Column:
    """One document of a context with its header line."""
    return F.concat(
        F.lit("[Documento "), F.col("rank").cast("string"), F.lit(" — "),
        F.concat_ws(
            " | ",
            F.concat(F.lit("Fuente: "), F.coalesce("source", F.lit("N/A"))),
            F.when(F.col("article_number") != "", F.concat(F.lit("Artículo: "), F.col("article_number"))),
            F.when(F.col("section_number") != "", F.concat(F.lit("Sección: "), F.col("section_number"))),
            F.concat(F.lit("Chunk: "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("?"))),
        ),
        F.lit("]\n"), F.col("text"),
    )


def grading_prompt(documents: DataFrame, n: int = 5, chars: int = 500) -> DataFrame:
    """First ``n`` documents of each query, ``chars`` characters each, as one prompt body."""
    piece = F.concat(
        F.format_string("[Doc %d] (source: %s, chunk: %s)\n", "rank", F.coalesce("source", F.lit("?")),
                        F.coalesce(F.col("chunk_index").cast("string"), F.lit("?"))),
        F.substring("text", 1, chars),
    )
    first = documents.filter(F.col("rank") <= n)
    gathered = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", piece.alias("piece")))).alias("_rows"))
    return gathered.select("query_id", F.array_join(F.transform("_rows", lambda r: r["piece"]), "\n---\n").alias("prompt"))
