"""Tables on a shared file system."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.functions.metadata import chunk_id
from acervo.session import scratch_path


# ── Collections of chunks ─────────────────────────────────────────────────────

def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """Adds ``id``; chunks that carry a ``doc_id`` are kept apart by it, as indexes restart in every document."""
    return chunks.withColumn("id", chunk_id("source", "chunk_index", "text", "doc_id" if "doc_id" in chunks.columns else None))


def latest_per_key(rows: DataFrame, key: str, arrival: Column) -> DataFrame:
    """One row per key, the last to arrive.  An aggregate, so copies of a key combine before the shuffle.

    Rows that arrive together are ordered by a hash of their values, so reruns agree.
    """
    body = [c for c in rows.columns if c != key]
    hashable = [f.name for f in rows.schema if f.name in body and "map<" not in f.dataType.simpleString()]
    order = F.struct(arrival.alias("at"), F.xxhash64(*hashable).alias("tie")) if hashable else arrival
    return rows.groupBy(key).agg(F.max_by(F.struct(*body), order).alias("_row")).select(key, "_row.*")


def upsert(existing: DataFrame, incoming: DataFrame, *, key: str = "id", arrival: Column | None = None, dedup: bool = True) -> DataFrame:
    """New snapshot: incoming rows replace those of the same key; ``dedup=False`` just appends."""
    if not dedup:
        return existing.unionByName(incoming, allowMissingColumns=True)
    fresh = latest_per_key(incoming, key, arrival if arrival is not None else F.lit(0))
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a table whose new content is computed from the old one.

    The new snapshot is written beside it first, so the old files are not read
    while they are being removed.
    """
    spark = df.sparkSession
    staged = scratch_path(spark, "staged")
    df.write.parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").parquet(path)


def append_delta(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add a batch to a collection kept as deltas; writing the same batch again replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_collection(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """A collection kept as deltas: per key the row of the newest batch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return latest_per_key(rows, key, F.col("batch"))


def compact_collection(spark: SparkSession, path: str, target: str, key: str = "id") -> None:
    """Write the current rows of a delta collection as one table elsewhere."""
    read_collection(spark, path, key).drop("batch").write.mode("overwrite").parquet(target)


def list_sources(chunks: DataFrame) -> DataFrame:
    """(source, chunks, total_chunks), one row per distinct source in order; a missing source is "unknown"."""
    total = chunks.agg(F.count("*")).scalar()
    name = F.coalesce("source", F.lit("unknown")).alias("source")
    return chunks.groupBy(name).agg(F.count("*").alias("chunks")).withColumn("total_chunks", total).orderBy("source")


def deindex(chunks: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks without those of the given documents."""
    return chunks.join(documents.select(key).distinct(), key, "left_anti")


# ── The relational tables ─────────────────────────────────────────────────────

_TIMES = "created_at timestamp, updated_at timestamp"
_SCHEMAS = {
    "sessions": "id string, user_identifier string, title string, is_active boolean, deleted_at timestamp, "
                "total_messages int, total_documents int",
    "messages": "id string, session_id string, role string, content string, "
                "sources array<struct<source:string,article:string,page:string>>, retrieval_strategy string, "
                "iteration_count int, reflection_score double, response_time_ms int",
    "documents": "id string, session_id string, filename string, file_hash string, mime_type string, "
                 "file_size_bytes bigint, document_type string, loader_used string, cleaner_profile string, "
                 "required_ocr boolean, chunk_count int, page_count int, chroma_collection string, is_indexed boolean, "
                 "deleted_at timestamp, classifier_confidence double, classifier_reasoning string",
    "chunks": "id string, document_id string, chroma_id string, chunk_index int, content_preview string, "
              "content_length int, page string, article_number string, document_type string, loader_type string",
    "query_logs": "id string, session_id string, message_id string, query_text string, query_hash string, "
                  "active_query string, retrieval_strategy string, docs_retrieved int, docs_after_rerank int, "
                  "top_sources array<struct<source:string,article:string,page:string>>, retrieval_time_ms int, "
                  "generation_time_ms int, total_time_ms int, reflection_score double, iteration_count int, "
                  "was_reformulated boolean",
    "reflection_logs": "id string, session_id string, message_id string, score double, is_grounded boolean, "
                       "has_hallucination boolean, feedback string, reformulated_query string",
    "user_profiles": "id string, user_identifier string, preferred_profile string, custom_system_prompt string, "
                     "is_active boolean",
    "session_memory": "id string, session_id string, key string, value string",
}
SCHEMAS: dict[str, str] = {name: f"{columns}, {_TIMES}" for name, columns in _SCHEMAS.items()}
# Tables that grow with time are stored by day; a read of recent days then skips the rest.
DAILY = {"messages", "query_logs", "reflection_logs"}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns, order and types of ``table``; missing columns become null."""
    fields = T.StructType.fromDDL(SCHEMAS[table]).fields
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def append_table(df: DataFrame, root: str, table: str) -> None:
    rows = conform(df, table)
    if table in DAILY:
        rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(f"{root}/{table}")
    else:
        rows.write.mode("append").parquet(f"{root}/{table}")


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table] + (", day date" if table in DAILY else "")).parquet(f"{root}/{table}")


# Unique columns besides the id, and references (table, column, table referred to, what its deletion does).
UNIQUE: dict[str, list[list[str]]] = {
    "documents": [["session_id", "file_hash"]], "chunks": [["chroma_id"]], "user_profiles": [["user_identifier"]], "session_memory": [["session_id", "key"]],
}
REFERENCES = [
    ("messages", "session_id", "sessions", "cascade"), ("documents", "session_id", "sessions", "set null"), ("chunks", "document_id", "documents", "cascade"),
    ("query_logs", "session_id", "sessions", "set null"), ("query_logs", "message_id", "messages", "set null"),
    ("reflection_logs", "session_id", "sessions", "set null"), ("reflection_logs", "message_id", "messages", "set null"),
    ("session_memory", "session_id", "sessions", "cascade"),
]


def key_violations(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, constraint, violations): surplus rows of unique keys, rows that refer to nothing, over all tables of ``root``.

    Nulls violate nothing, as in a database.  Keys and references are counted before they meet, so one
    key with a third of all rows is one row in the shuffle.
    """
    found = []
    for table in SCHEMAS:
        for key in [["id"], *UNIQUE.get(table, [])]:
            sizes = read_table(spark, root, table).select(*key).dropna().groupBy(*key).agg(F.count("*").alias("n"))
            found.append(sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
                F.lit(table).alias("table_name"), F.lit(f"unique {', '.join(key)}").alias("constraint"), "violations"))
    for table, column, parent, _ in REFERENCES:
        uses = read_table(spark, root, table).where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n"))
        orphans = uses.join(read_table(spark, root, parent).select("id"), "id", "left_anti")
        found.append(orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
            F.lit(table).alias("table_name"), F.lit(f"{column} in {parent}").alias("constraint"), "violations"))
    return reduce(DataFrame.unionByName, found)


def delete_rows(spark: SparkSession, root: str, table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables as they are after rows of ``table`` (ids: id) have been deleted: rows that refer to them go or lose the reference."""
    gone = ids.select("id").distinct()
    after = {table: read_table(spark, root, table).join(gone, "id", "left_anti")}
    pending = [(table, gone)]
    while pending:  # the references have no cycle: at most as many steps as references
        parent, lost = pending.pop(0)
        for child, column, of, rule in REFERENCES:
            if of != parent:
                continue
            rows = after[child] if child in after else read_table(spark, root, child)
            keyed = lost.select(F.col("id").alias(column))
            if rule == "cascade":
                pending.append((child, rows.join(keyed, column, "left_semi").select("id")))
                after[child] = rows.join(keyed, column, "left_anti").select(rows.columns)
            else:
                marked = rows.join(keyed.withColumn("_gone", F.lit(True)), column, "left")
                after[child] = marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(rows.columns)
    return after
