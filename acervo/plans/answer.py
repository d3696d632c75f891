"""Questions to checked answers: grade, search again when needed, generate, validate."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.answers import (
    MAX_RETRIES,
    NO_DOCUMENTS,
    extract_sources,
    generation_mode,
    grade_quality,
    low_confidence_note,
    reflect,
    validate_answer,
)
from acervo.functions.questions import assess_complexity, distinct_articles
from acervo.functions.replies import parse_fenced_json
from acervo.operators.evaluate import context_piece, joined_context
from acervo.operators.models import TextFunction, model_map
from acervo.session import cut_lineage

SUB_QUERIES = 3


def plan_queries(queries: DataFrame, fn: TextFunction) -> DataFrame:
    """Adds complexity, article_numbers, sub_queries (≤ 3), strategy and use_planner.

    Only queries that are not simple go to the model; where it fails the query
    stands for itself with strategy full.
    """
    assessed = queries.withColumn("complexity", assess_complexity("text")).withColumn("article_numbers", distinct_articles("text"))
    hard = F.col("complexity") != "simple"
    reply = model_map(F.when(hard, F.col("text")), lambda prompts: [None if p is None else fn([p])[0] for p in prompts])
    parsed = assessed.withColumn("_reply", reply).withColumn("_plan", parse_fenced_json("_reply"))
    given = F.slice(F.coalesce("_plan.sub_queries", F.array().cast("array<string>")), 1, SUB_QUERIES)
    own = F.array("text")
    failed = hard & F.col("_reply").isNull()
    return parsed.select(
        *queries.columns,
        F.when(hard & ~failed, F.coalesce("_plan.complexity", "complexity")).otherwise(F.col("complexity")).alias("complexity"),
        "article_numbers",
        F.when(hard & ~failed & (F.size(given) > 0), given).otherwise(own).alias("sub_queries"),
        F.when(failed, "full").when(hard, F.coalesce("_plan.strategy", F.lit("hybrid"))).otherwise("hybrid").alias("strategy"),
        (hard & ~failed).alias("use_planner"),
    )


def corrective_loop(
    queries: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    grade: Callable[[DataFrame, DataFrame], DataFrame],
    rewrite: Callable[[DataFrame], DataFrame],
    max_retries: int = MAX_RETRIES,
) -> tuple[DataFrame, DataFrame]:
    """(graded queries, hits): search, grade, and search again for what is not good enough.

    ``search`` maps queries to hits; ``grade`` maps (queries, hits) to (query_id,
    score); ``rewrite`` returns queries with a new text (and embedding).  The loop
    runs at most 1 + ``max_retries`` times, each time on the rows still open;
    rows and hits are checkpointed per round, so plans do not nest.
    """
    open_rows = cut_lineage(queries.withColumn("retries", F.lit(0)))
    done_rows, done_hits = [], []
    for round_no in range(max_retries + 1):
        hits = cut_lineage(search(open_rows))
        scores = grade(open_rows, hits)
        graded = open_rows.join(scores, "query_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        graded = cut_lineage(graded.withColumn("quality", grade_quality("score")))
        good = F.col("quality") == "correct" if round_no < max_retries else F.lit(True)
        settled = graded.filter(good)
        done_rows.append(settled)
        done_hits.append(hits.join(settled.select("query_id"), "query_id", "left_semi"))
        unsettled = graded.filter(~good)
        if round_no == max_retries or unsettled.isEmpty():
            break
        next_round = rewrite(unsettled).withColumn("retries", F.col("retries") + 1)
        open_rows = cut_lineage(next_round.select(*open_rows.columns))
    rows, found = done_rows[0], done_hits[0]
    for more_rows, more_hits in zip(done_rows[1:], done_hits[1:]):
        rows, found = rows.unionByName(more_rows), found.unionByName(more_hits)
    return rows, found


def answer_until_valid(
    queries: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    fn: TextFunction,
    rewrite: Callable[[DataFrame], DataFrame],
    *,
    max_iterations: int = MAX_RETRIES,
    k: int | None = None,
) -> DataFrame:
    """(query_id, answer, mode, n_docs, sources, score, feedback, iteration_count): answers whose reflection says so are final.

    ``queries`` has (query_id, text, score, …).  ``search`` maps queries to ranked hits as
    ``answer_batch`` takes them; ``rewrite`` gets the queries whose answer is to be retried, with the
    ``feedback`` of the reflection, and returns them with a new text.  The last round
    takes the draft with a note.  Rounds are checkpointed: each prompt reaches the model once, and
    only queries still open are searched and answered again.
    """
    columns = queries.columns
    open_rows = cut_lineage(queries)
    done = []
    for iteration in range(max_iterations + 1):
        asked = open_rows.withColumn("iteration", F.lit(iteration)).withColumn("max_iterations", F.lit(max_iterations))
        answers = cut_lineage(answer_batch(asked, search(open_rows), fn, k=k))
        final = answers.filter(F.col("reflection.route") == "END")
        done.append(final.select(
            "query_id", F.col("reflection.final_answer").alias("answer"), "mode", "n_docs", "sources",
            F.col("reflection.score").alias("score"), F.col("reflection.feedback").alias("feedback"), F.col("reflection.iteration_count").alias("iteration_count")))
        again = answers.filter(F.col("reflection.route") != "END").select("query_id", F.col("reflection.feedback").alias("feedback"))
        if iteration == max_iterations or again.isEmpty():
            break
        open_rows = cut_lineage(rewrite(open_rows.join(again, "query_id")).select(columns))
    return reduce(DataFrame.unionByName, done)


def answer_batch(queries: DataFrame, documents: DataFrame, fn: TextFunction, *, k: int | None = None) -> DataFrame:
    """Answers with mode, sources, validation and reflection.

    ``queries`` has (query_id, text, score, iteration, max_iterations); ``documents``
    the ranked hits with source, article_number, section_number, chunk_index, page, text.
    A query above 0.8 takes one model pass, the others two, and those without
    documents none.  ``k`` bounds the hits of a query that are put together.
    """
    documents = documents if k is None else documents.filter(F.col("rank") <= k)
    row = F.struct("rank", "source", "article_number", "page", context_piece().alias("piece"))
    gathered = documents.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("documents"))
    # one pass over the hits gives the context, the first documents and their number
    rows = queries.join(gathered, "query_id", "left").withColumn("context", joined_context(F.col("documents")))
    rows = rows.withColumn("n_docs", F.greatest(F.size("documents"), F.lit(0)))
    rows = rows.withColumn("mode", generation_mode("score", "n_docs"))
    prompt = F.concat(F.lit("Consulta: "), F.col("text"), F.lit("\n\nContexto:\n"), F.col("context"))
    two_pass = F.col("mode").startswith("rethinking")
    passages = model_map(F.when(two_pass, prompt), _optional(fn))
    rows = rows.withColumn("passages", passages)
    second = F.concat(
        F.lit("Consulta: "), F.col("text"), F.lit("\n\nPasajes relevantes identificados:\n"), F.col("passages"),
        F.lit("\n\nContexto completo de referencia:\n"), F.col("context"),
    )
    final_prompt = F.when(F.col("mode") == "direct", prompt).when(two_pass, second)
    rows = rows.withColumn("_reply", model_map(final_prompt, _optional(fn)))
    draft = (
        F.when(F.col("mode") == "no_docs", NO_DOCUMENTS)
        .when(F.col("mode") == "rethinking_low_confidence", F.concat("_reply", low_confidence_note("score")))
        .otherwise(F.col("_reply"))
    )
    rows = rows.withColumn("draft", draft)
    rows = rows.withColumn("sources", _sources(F.col("draft"))).withColumn("verdict", validate_answer("draft", F.coalesce("context", F.lit(""))))
    reflected = rows.withColumn("reflection", reflect(F.col("verdict"), "draft", "iteration", "max_iterations"))
    return reflected.select("query_id", "mode", "n_docs", "draft", "sources", "verdict", "reflection")


def _sources(draft: Column) -> Column:
    return F.when(F.col("mode") == "no_docs", extract_sources(F.lit(""))).otherwise(
        extract_sources(draft, F.col("documents"))
    )


def _optional(fn: TextFunction) -> TextFunction:
    def call(prompts: list[str]) -> list[str]:
        asked = [p for p in prompts if p is not None]
        replies = iter(fn(asked) if asked else [])
        return [None if p is None else next(replies) for p in prompts]

    return call
