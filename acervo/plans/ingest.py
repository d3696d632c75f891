"""Documents to indexed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.cleaning import clean
from acervo.functions.metadata import extract_metadata
from acervo.functions.replies import parse_batch_json
from acervo.functions.text import blank
from acervo.operators.chunking import adaptive_chunk
from acervo.operators.filters import union_augmented
from acervo.operators.models import TextFunction, model_map
from acervo.sources.files import read_files
from acervo.sources.tables import upsert, with_chunk_id

QUESTIONS, BATCH, PROMPT_CHARS = 3, 5, 1500  # fixed values


def prepare_chunks(documents: DataFrame, profile: Column | str = "default") -> DataFrame:
    """Clean → adaptive chunks → metadata → id, for (source, text, …)."""
    cleaned = documents.withColumn("text", clean("text", profile))
    chunks = adaptive_chunk(cleaned)
    meta = extract_metadata("text", source=F.col("source"), chunk_index=F.col("chunk_index"))
    return with_chunk_id(chunks.withColumn("meta", meta))


def ingest(documents: DataFrame, collection: DataFrame | None = None, profile: Column | str = "default") -> tuple[DataFrame, DataFrame]:
    """(new collection snapshot, one result row per document).

    ``documents`` has (doc_id, source, text).  A document whose text is blank
    becomes a failed row; the others go on.
    """
    empty = blank("text")
    chunks = prepare_chunks(documents.filter(~empty), profile)
    snapshot = chunks if collection is None else upsert(collection, chunks, arrival=F.col("doc_id"))
    counts = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"),
        F.first("document_type").alias("document_type"),
        F.first("chunking_confidence").alias("confidence"),
    )
    results = documents.select("doc_id", "source", empty.alias("_empty")).join(counts, "doc_id", "left")
    done = F.coalesce("chunk_count", F.lit(0))
    return snapshot, results.select(
        "doc_id",
        "source",
        (done > 0).alias("success"),
        done.alias("chunk_count"),
        "document_type",
        "confidence",
        F.when(F.col("_empty") | (done == 0), F.array(F.concat(F.lit("Documento vacío o no legible: "), "source")))
        .otherwise(F.array().cast("array<string>"))
        .alias("errors"),
    )


def ingest_files(spark: SparkSession, path: str, collection: DataFrame | None = None, *, pattern: str = "*",
                 profile: Column | str = "default") -> tuple[DataFrame, DataFrame]:
    """Files below ``path`` → (collection snapshot, one result row per file).

    Files of text are ingested; files that need a parser, or cannot be read,
    come out as failed rows with their error.
    """
    files = read_files(spark, path, pattern)
    texts = files.filter("success AND text IS NOT NULL").select(
        F.col("path").alias("doc_id"), F.substring_index("path", "/", -1).alias("source"), "text"
    )
    snapshot, results = ingest(texts, collection, profile)
    done = results.select(F.col("doc_id").alias("path"), "success", "chunk_count", "document_type", "confidence", "errors")
    no_text = F.array(F.concat(F.lit("Sin texto; requiere el loader "), F.coalesce("loader", F.lit("?"))))
    rest = files.filter("NOT success OR text IS NULL").select(
        "path", F.lit(False).alias("success"), F.lit(0).cast("long").alias("chunk_count"),
        F.when(F.size("errors") > 0, F.col("errors")).otherwise(no_text).alias("errors"),
    )
    return snapshot, done.unionByName(rest, allowMissingColumns=True)


def batch_prompts(chunks: DataFrame, questions: int = QUESTIONS, batch: int = BATCH, key: str = "doc_id") -> DataFrame:
    """(key, batch_no, prompt, members): chunks of a document in groups of ``batch``, each cut to 1500 characters.

    chunk_index is dense from 0 per document, so a group is an integer division
    and holds at most ``batch`` chunks; ``members`` carries their rows.
    """
    group = F.floor(F.col("chunk_index") / batch).cast("int").alias("batch_no")
    local = F.pmod("chunk_index", F.lit(batch)).cast("int")
    snippet = F.translate(F.substring("text", 1, PROMPT_CHARS), "\n", " ")
    row = F.struct(
        local.alias("local"), F.format_string("\n[CHUNK %d]\n%s", local, snippet).alias("body"),
        F.struct(*[c for c in chunks.columns if c != key]).alias("row"),
    )
    gathered = chunks.groupBy(key, group).agg(F.array_sort(F.collect_list(row), _by_local).alias("members"))
    head = F.format_string(f"Genera exactamente {questions} preguntas para cada uno de los siguientes %d fragmentos.", F.size("members"))
    body = F.array_join(F.concat(F.array(head), F.transform("members", lambda m: m["body"])), "\n")
    return gathered.select(key, "batch_no", body.alias("prompt"), F.transform("members", lambda m: m["row"]).alias("members"))


def _by_local(a: Column, b: Column) -> Column:
    return a["local"] - b["local"]


def explode_questions(chunks: DataFrame, fn: TextFunction, questions: int = QUESTIONS, batch: int = BATCH, key: str = "doc_id") -> DataFrame:
    """Question rows: the chunk's columns with text replaced, parent_chunk_index and the augmentation flags.

    One model call per group of ``batch`` chunks; a failed call gives no rows.
    """
    asked = batch_prompts(chunks, questions, batch, key)
    replies = asked.withColumn("_reply", model_map("prompt", fn)).filter(F.col("_reply").isNotNull())
    # the outer form: a plain explode adds a filter on the map and parses the reply again
    answers = replies.select(key, "members", F.explode_outer(parse_batch_json("_reply")).alias("_local", "_questions"))
    rows = answers.select(key, F.get("members", F.col("_local")).alias("_row"), F.posexplode("_questions").alias("question_no", "_question"))
    return (
        rows.filter(F.col("_row").isNotNull()).select(key, "_row.*", "question_no", "_question")
        .withColumn("text", F.col("_question"))
        .withColumn("augmentation_type", F.lit("question"))
        .withColumn("parent_chunk_index", F.col("chunk_index"))
        .withColumn("is_augmented_question", F.lit(True))
        .drop("_question")
    )


def augment_and_index(chunks: DataFrame, collection: DataFrame, fn: TextFunction, questions: int = QUESTIONS) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, counts): originals and generated questions, both indexed.

    Question rows get their own ids, so they do not replace the chunk they ask about.
    """
    generated = explode_questions(chunks, fn, questions)
    question_id = F.concat_ws("::q", "id", F.col("question_no").cast("string"))
    everything = union_augmented(chunks, generated.withColumn("id", question_id))
    counts = everything.agg(
        F.count_if(~F.coalesce("is_augmented_question", F.lit(False))).alias("original_chunks"),
        F.count_if(F.coalesce("is_augmented_question", F.lit(False))).alias("questions_added"),
        F.count("*").alias("total_indexed"),
    )
    return upsert(collection, everything, arrival=F.col("chunk_index")), counts

