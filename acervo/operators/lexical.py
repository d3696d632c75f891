"""BM25 keyword search over postings kept as ordinary tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import col
from acervo.functions.tokens import TOKEN_PATTERN, is_term, tokenize
from acervo.operators.ranking import small_hits, top_k

# Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
BROADCAST_ROWS = 500_000  # (query, term) rows; about 50 MB
MANY_QUERIES = 64
PAIRS, MOST_PARTS = 1_000_000, 20_000  # (query, document) pairs that a task sums at a time, 285 to 369 MB measured; tasks at most
PLACES = 9  # scores are compared rounded, so copies of a text tie and the id decides


class LexicalIndex(NamedTuple):
    """postings(doc_id, dl, term, tf, …) and corpus(n_docs)."""

    postings: DataFrame
    corpus: DataFrame


def term_postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str = TOKEN_PATTERN,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, dl, term, tf): one row per distinct term of a document.

    Terms are counted inside the row, as runs of its sorted tokens, so building
    postings needs no shuffle; the length rides along, so scoring needs no join.
    """
    tokens = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.sort_array(tokenize(text, pattern)).alias("_sorted"))
    opens_run = lambda t, i: F.when((i == 0) | (t != F.get("_sorted", i - 1)), i)
    runs = tokens.withColumn("_starts", F.filter(F.transform("_sorted", opens_run), lambda i: i.isNotNull()))
    counted = F.transform(
        "_starts",
        lambda start, j: F.struct(
            F.get("_sorted", start).alias("term"),
            (F.coalesce(F.get("_starts", j + 1), F.size("_sorted")) - start).alias("tf"),
        ),
    )
    # explode_outer: a plain explode would add a filter on the tokens and tokenise twice
    exploded = runs.select("doc_id", *keep, F.size("_sorted").alias("dl"), F.explode_outer(counted).alias("_run"))
    return exploded.select("doc_id", *keep, "dl", "_run.term", "_run.tf").filter(F.col("term").isNotNull())


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str = TOKEN_PATTERN,
                keep: tuple[str, ...] = ()) -> LexicalIndex:
    """Index of ``docs``; ``keep`` names metadata columns to filter on.

    The index is lazy: searching it directly reads the texts twice (term
    statistics, then scoring).  ``save_index`` writes it for repeated use.
    """
    return LexicalIndex(term_postings(docs, doc_id, text, pattern, keep), docs.agg(F.count("*").alias("n_docs")))


def term_counts(index: LexicalIndex) -> DataFrame:
    """(term, df, ctf): documents that hold the term, and its occurrences."""
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))


def term_stats(index: LexicalIndex) -> DataFrame:
    """(term, df, ctf, idf): a negative idf becomes EPSILON × the mean idf of all terms."""
    n = index.corpus.scalar()
    # "+ 0 * ctf" keeps both counts in every reader of term_counts, so that they share one shuffle
    idf = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5) + 0.0 * F.col("ctf")
    raw = term_counts(index).withColumn("_idf", idf)
    mean = raw.agg(F.avg("_idf")).scalar()
    floor = F.when(F.col("_idf") < 0, EPSILON * mean).otherwise(F.col("_idf"))
    return raw.select("term", "df", "ctf", floor.alias("idf"))


def average_length(index: LexicalIndex) -> Column:
    """Mean document length, as a one-row subquery over the term counts."""
    totals = term_counts(index).agg(F.sum(F.col("ctf") + 0 * F.col("df")).alias("terms"))
    return totals.scalar() / index.corpus.scalar()


def corpus_stats(index: LexicalIndex) -> DataFrame:
    """One row: documents, mean length, vocabulary."""
    vocabulary = term_counts(index).agg(F.count_if((F.col("ctf") > 0) & (F.col("df") > 0))).scalar()
    return index.corpus.select("n_docs", average_length(index).alias("avgdl"), vocabulary.alias("vocabulary"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text", pattern: str = TOKEN_PATTERN) -> DataFrame:
    """(query_id, term, qtf); a repeated query term counts each time."""
    return (
        queries.select(F.col(query_id).alias("query_id"), F.explode_outer(tokenize(text, pattern)).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def wanted_values(queries: DataFrame, query_id: str, filters: str, columns: tuple[str, ...]) -> DataFrame:
    """(query_id, _wanted_<column>…): what each query asks of the columns; "" where it asks nothing."""
    return queries.select(F.col(query_id).alias("query_id"), *[
        F.coalesce(F.try_element_at(F.col(filters), F.lit(c)), F.lit("")).alias(f"_wanted_{c}") for c in columns
    ])


def pair_parts(spark, pairs: int) -> int:
    """Partitions that hold at most about ``PAIRS`` of so many (query, document) pairs each.

    The number is fixed beforehand: adaptive execution would join partitions by the bytes of the postings,
    of which each may make a pair with every query.
    """
    return max(spark.sparkContext.defaultParallelism, min(MOST_PARTS, -(-pairs // PAIRS)))


def bm25_scores(terms: DataFrame, index: LexicalIndex, where: Column | None = None, *, small: bool = True, many: int = 0,
                wanted: DataFrame | None = None, filter_columns: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, score > 0) for query terms (query_id, term, qtf).

    ``wanted`` (see ``wanted_values``) holds conditions of single queries on ``filter_columns`` of the index.

    ``small`` says that the terms are known to be at most ``BROADCAST_ROWS`` rows.
    With few queries the (query, document) sums combine in the scan's own tasks.
    With ``many``, the number of queries, those pairs would outgrow the index, so the postings of the
    queried terms are put together by document first; the sums and the first cut
    to k rows then happen without a further shuffle.
    """
    avgdl = average_length(index)
    postings = index.postings if where is None else index.postings.filter(where)
    weighted = terms.join(term_stats(index), "term")
    fits = F.lit(True)
    if wanted is not None:
        weighted = weighted.join(wanted, "query_id")
        for c in filter_columns:
            asked_value = F.col(f"_wanted_{c}")
            fits = fits & ((asked_value == "") | (F.coalesce(F.col(c).cast("string"), F.lit("")) == asked_value))
    if small:  # else both sides shuffle on term, and AQE splits hot terms
        weighted = F.broadcast(weighted)
        if many:
            parts = pair_parts(terms.sparkSession, many * index.corpus.first()[0])
            asked = F.broadcast(terms.select("term").distinct())
            postings = postings.join(asked, "term", "left_semi").repartition(parts, "doc_id")
    saturation = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    return (
        postings.join(weighted, "term")
        .filter(fits)
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("qtf") * F.col("idf") * saturation).alias("_score"))
        .filter(F.col("_score") > 0)
    )


def bm25_search(
    queries: DataFrame,
    index: LexicalIndex,
    k: int,
    *,
    query_id: str = "query_id",
    text: str = "text",
    pattern: str = TOKEN_PATTERN,
    where: Column | None = None,
    filters: str | None = None,
    filter_columns: tuple[str, ...] = (),
) -> DataFrame:
    """(query_id, doc_id, score, rank): best ``k`` of every query, score to 4 places.

    ``where`` is a condition on the index's kept columns, the same for all queries;
    ``filters`` names a map<string,string> column of the queries, each one's own equality
    conditions on ``filter_columns``.  Both are applied before ranking, so filtered lists
    still fill up to ``k``.
    """
    terms = query_terms(queries, query_id, text, pattern)
    rows, asked = terms.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.count_distinct("query_id")).first()
    small = rows <= BROADCAST_ROWS
    wanted = wanted_values(queries, query_id, filters, filter_columns) if filters else None
    scored = bm25_scores(terms, index, where, small=small, many=asked if asked > MANY_QUERIES else 0, wanted=wanted, filter_columns=filter_columns)
    best = top_k(
        scored.withColumn("_score", F.round("_score", PLACES)),
        ["query_id"], [F.col("_score").desc(), F.col("doc_id")], k,
    )
    hits = best.select("query_id", "doc_id", F.round("_score", 4).alias("score"), "rank")
    return small_hits(hits, asked, k) if small else hits


def stringly_filter(filters: dict[str, str]) -> Column:
    """``str(a) == str(b)`` on every entry; a missing value counts as ""."""
    condition = F.lit(True)
    for name, value in filters.items():
        condition = condition & (F.coalesce(col(name).cast("string"), F.lit("")) == str(value))
    return condition


def save_index(index: LexicalIndex, path: str) -> None:
    """Write the index; an older one at ``path`` is replaced (that is also how it is invalidated)."""
    index.postings.write.mode("overwrite").parquet(f"{path}/postings")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def load_index(spark, path: str) -> LexicalIndex:
    return LexicalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus"))


def index_exists(spark, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/corpus/_SUCCESS")
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def load_or_build(docs: DataFrame, path: str, **options) -> LexicalIndex:
    """Stored index when there is one, else build it, save it and read it back."""
    spark = docs.sparkSession
    if not index_exists(spark, path):
        save_index(build_index(docs, **options), path)
    return load_index(spark, path)


def invalidate_index(spark, path: str) -> None:
    """Drop a stored index."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
