"""Exact article lookup with a fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.metadata import article_key
from acervo.operators.vector import knn
from acervo.session import at_most, written

FEW_QUESTIONS = 10_000  # different questions, with their vectors, that are broadcast; 120 MB at 1536 dimensions


def article_lookup(requests: DataFrame, chunks: DataFrame, *, metric: str = "l2sq") -> DataFrame:
    """One row per request (query_id, article_number, source, embedding), found or not.

    First the nearest chunk of that article (dots trimmed on both sides) in that
    source; else the nearest of the source alone.  An empty source means any.
    ``chunks`` has (doc_id, embedding, article_number, source, text, page).
    """
    keyed = chunks.withColumn("article_key", article_key("article_number"))
    same = ["_article", "_source", "embedding"]  # requests alike in these have one answer and are asked once
    named = requests.select("*", F.coalesce(article_key("article_number"), F.lit("")).alias("_article"), F.coalesce(F.col("source"), F.lit("")).alias("_source"))
    questions = named.filter(F.col("embedding").isNotNull()).select(*same).distinct()
    questions = written(questions.withColumn("_question", F.monotonically_increasing_id()), "lookup-questions")
    exact = F.create_map(F.lit("article_key"), F.col("_article"), F.lit("source"), F.col("_source"))
    loose = F.create_map(F.lit("source"), F.col("_source"))
    # Where the source has chunks of the article, the nearest of them is the answer; only elsewhere is the source alone searched.
    # The other tier of a question goes without a vector, so nothing is compared with it.
    questions = questions.join(_articles(keyed), ["_article", "_source"], "left")
    first = F.col("_known").isNotNull()
    tiers = F.explode(F.array(F.struct(F.lit(1).alias("tier"), exact.alias("filters"), first.alias("open")), F.struct(F.lit(2).alias("tier"), loose.alias("filters"), (~first).alias("open"))))
    # both tiers are asked in one scan of the chunks
    asked = questions.select("_question", "embedding", tiers.alias("t")).select(
        F.concat_ws("|", "_question", "t.tier").alias("key"), F.when(F.col("t.open"), F.col("embedding")).alias("embedding"), "t.filters"
    )
    hits = knn(asked, keyed, 1, query_id="key", filters="filters", filter_columns=("article_key", "source"), metric=metric)
    answers = hits.select(F.substring_index("key", "|", 1).cast("long").alias("_question"), "doc_id")
    answered = questions.join(answers, "_question").select(*same, "doc_id")
    answered = F.broadcast(answered) if at_most(questions, FEW_QUESTIONS) else answered  # a question of many requests then stays spread
    content = chunks.select("doc_id", F.col("text").alias("content"), F.col("source").alias("found_source"), "page")
    return (
        named.select("query_id", "article_number", *same)
        .join(answered, same, "left")
        .join(content, "doc_id", "left")
        .select(
            "query_id",
            "article_number",
            F.col("doc_id").isNotNull().alias("found"),
            F.coalesce("content", F.lit("")).alias("content"),
            F.coalesce("found_source", F.lit("")).alias("source"),
            F.coalesce(F.col("page").cast("string"), F.lit("")).alias("page"),
        )
    )


def _articles(keyed: DataFrame) -> DataFrame:
    """(_article, _source, _known) of all conditions that a chunk with a vector meets; an empty one means any."""
    named = keyed.filter(F.col("embedding").isNotNull()).select("article_key", "source").distinct()
    either = lambda column: F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce(F.col(column), F.lit("")))))
    met = named.select("source", either("article_key").alias("_article")).select("_article", either("source").alias("_source"))
    return met.distinct().withColumn("_known", F.lit(True))
