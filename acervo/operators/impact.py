"""BM25 keyword search over postings in blocks of like impact.

A posting's impact is its part of the score without the term's weight, which is fixed once
the mean length is known.  The postings of a term lie in blocks, each with its largest
impact, so a search can tell without reading a block what its documents can reach:

1. The rarest terms of a query give partial scores; the k-th of them is a score that the
   k-th result reaches at least.
2. Terms whose largest scores together stay below it cannot bring a document in on their
   own.  Only the blocks of the other terms are read, and of these only the blocks whose
   documents can still reach it.
3. What was read gives a closer bound, and what the terms left out add is looked up only
   for the documents that can still reach it.

The result is the one of ``operators.lexical.bm25_search``.  There is no probe of sizes: the
plan is the same for one query or a million, and joins follow the statistics.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.functions.tokens import TOKEN_PATTERN
from acervo.operators.lexical import B, K1, PLACES, LexicalIndex, pair_parts, query_terms, term_postings, term_stats, wanted_values
from acervo.operators.ranking import top_k
from acervo.session import written

#: Postings of a term that stay in one block; more are dealt by impact, in steps of 1 / LEVELS, and by a hash of the document.
BLOCK, LEVELS = 512, 8
#: Postings of the rarest terms of a query that are read for its first bound.
LEAD = 5_000
#: Slack of bounds, far below the rounding of scores.
SLACK = 1e-6


class ImpactIndex(NamedTuple):
    """blocks(term, level, part, top, postings of (doc_id, impact, kept columns)) and terms(term, df, idf, top)."""

    blocks: DataFrame
    terms: DataFrame


def build_impacts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str = TOKEN_PATTERN, keep: tuple[str, ...] = (), path: str | None = None) -> ImpactIndex:
    """Index of ``docs``, written to ``path`` or the shared folder; ``keep`` names columns to filter on.

    Texts are tokenised once.  A term with a third of all postings is dealt to many blocks.
    """
    spark = docs.sparkSession
    postings = written(term_postings(docs, doc_id, text, pattern, keep), "impact-postings")
    corpus = docs.agg(F.count("*").alias("n_docs"))
    stats = written(term_stats(LexicalIndex(postings, corpus)), "impact-terms")
    mean = stats.agg(F.sum("ctf")).scalar() / corpus.scalar()
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    # only the terms of many blocks need their number of postings: the join is with few rows
    many = stats.where(F.col("df") > BLOCK).select("term", F.ceil(F.col("df") / (8 * BLOCK)).alias("parts"))
    placed = postings.select("term", "doc_id", *keep, impact.alias("impact")).join(many, "term", "left").select(
        "term", F.when(F.col("parts").isNull(), 0).otherwise(F.floor(F.col("impact") * LEVELS)).cast("int").alias("level"),
        F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.struct("doc_id", "impact", *keep).alias("posting"))
    blocks = placed.groupBy("term", "level", "part").agg(F.max("posting.impact").alias("top"), F.collect_list("posting").alias("postings"))
    if path is None:
        stored = written(blocks, "impact-blocks")
    else:
        # by term within a file, so that row groups of other terms are skipped
        blocks.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/blocks")
        stored = spark.read.parquet(f"{path}/blocks")
    terms = stats.join(stored.groupBy("term").agg(F.max("top").alias("top")), "term").select("term", "df", "idf", "top")
    if path is None:
        return ImpactIndex(stored, written(terms, "impact-tops"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    return load_impacts(spark, path)


def load_impacts(spark: SparkSession, path: str) -> ImpactIndex:
    return ImpactIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"))


def _sums(asked: DataFrame, index: ImpactIndex, fits: Column, columns: list[str], blocks: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score) of the asked terms (…, df), summed in tasks of a bounded number of postings."""
    postings = asked.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    rows = _contributions(asked, index, fits, columns, blocks).repartition(pair_parts(asked.sparkSession, postings), "query_id", "doc_id")
    return rows.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def _contributions(asked: DataFrame, index: ImpactIndex, fits: Column, columns: list[str], blocks: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score): what each posting of the asked terms adds."""
    joined = index.blocks.join(asked, "term")
    if blocks is not None:
        joined = joined.where(blocks)
    rows = joined.select("query_id", "weight", *columns, F.explode("postings").alias("p"))
    return rows.where(fits).select("query_id", F.col("p.doc_id").alias("doc_id"), (F.col("weight") * F.col("p.impact")).alias("score"))


def impact_search(
    queries: DataFrame, index: ImpactIndex, k: int, *, query_id: str = "query_id", text: str = "text", pattern: str = TOKEN_PATTERN,
    where: Column | None = None, filters: str | None = None, filter_columns: tuple[str, ...] = (),
) -> DataFrame:
    """(query_id, doc_id, score, rank): best ``k`` of every query, as ``bm25_search`` gives them.

    ``where`` is a condition on ``p.<kept column>``; ``filters`` names a map<string,string>
    column of the queries with conditions on ``filter_columns``.  Both apply before ranking.
    """
    per_query = Window.partitionBy("query_id")
    terms = query_terms(queries, query_id, text, pattern).join(index.terms, "term").withColumn("weight", F.col("qtf") * F.col("idf"))
    fits, columns = (where if where is not None else F.lit(True)), []
    if filters:
        terms = terms.join(wanted_values(queries, query_id, filters, filter_columns), "query_id")
        columns = [f"_wanted_{c}" for c in filter_columns]
        for c, name in zip(filter_columns, columns):
            fits = fits & ((F.col(name) == "") | (F.coalesce(F.col(f"p.{c}").cast("string"), F.lit("")) == F.col(name)))
    reach = F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))
    lead = per_query.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.withColumn("reach", reach).withColumn("_read", F.sum("df").over(lead)).withColumn("_nth", F.row_number().over(per_query.orderBy("df", "term")))
    terms = written(terms.drop("top"), "impact-query-terms")

    # a lower bound of the k-th score; terms with a negative weight may take away what they can at most
    partial = _sums(terms.where((F.col("_read") <= LEAD) | (F.col("_nth") == 1)), index, fits, columns)
    kth = top_k(partial, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    loss = F.sum(F.least(F.col("weight") * (K1 + 1), F.lit(0.0))).over(per_query)
    below = F.sum("reach").over(per_query.orderBy("reach", "term").rowsBetween(Window.unboundedPreceding, 0))
    bounded = terms.join(kth, "query_id", "left").withColumn("bound", F.greatest(F.coalesce(F.col("kth") + loss, F.lit(0.0)), F.lit(0.0)) - SLACK)
    bounded = bounded.withColumn("all", F.sum("reach").over(per_query)).withColumn("needed", below >= F.col("bound"))
    bounded = written(bounded.withColumn("rest", F.sum(F.when(~F.col("needed"), F.col("reach")).otherwise(0.0)).over(per_query)), "impact-bounds")

    needed = bounded.where("needed").select("term", "query_id", "df", "weight", "reach", "bound", "all", "rest", *columns)
    able = F.greatest(F.col("weight") * F.col("top"), F.lit(0.0)) + F.col("all") - F.col("reach") >= F.col("bound")
    read = written(_sums(needed, index, fits, columns, able), "impact-read")
    # what has been read bounds the k-th score much closer
    again = top_k(read, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("again"))
    limits = bounded.withColumn("loss", loss).groupBy("query_id").agg(F.max("bound").alias("bound"), F.max("rest").alias("rest"), F.max("loss").alias("loss")).join(again, "query_id", "left")
    limits = limits.select("query_id", "rest", F.greatest("bound", F.coalesce(F.col("again") + F.col("loss") - SLACK, F.col("bound"))).alias("bound"))
    candidates = written(read.join(limits, "query_id").where(F.col("score") + F.col("rest") >= F.col("bound")).select("query_id", "doc_id", "score"), "impact-candidates")
    # each posting of the terms left out is read once and meets the candidates that ask for it
    others = bounded.where("not needed").select("query_id", "term", "weight")
    pairs = candidates.select("query_id", "doc_id").join(others, "query_id")
    postings = index.blocks.join(others.select("term").distinct(), "term", "left_semi").select("term", F.explode("postings").alias("p")).select("term", F.col("p.doc_id").alias("doc_id"), F.col("p.impact").alias("impact"))
    more = pairs.join(postings, ["term", "doc_id"]).select("query_id", "doc_id", (F.col("weight") * F.col("impact")).alias("score"))
    scored = candidates.unionByName(more).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), PLACES).alias("_score")).where(F.col("_score") > 0)
    best = top_k(scored, ["query_id"], [F.col("_score").desc(), F.col("doc_id")], k)
    return best.select("query_id", "doc_id", F.round("_score", 4).alias("score"), "rank")
