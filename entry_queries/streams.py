"""Streams over the given tables: a file is read as a stream, written as a table, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.session import prepare, scratch_path
from acervo.streaming import jobs
from entry_queries.inputs import LOGS_CTE, MEMORY_SQL, logs_of, messages_of, operations_of
from entry_queries.registry import query
from entry_queries.tables import _QUALITY_SQL


def _stream(spark, sf, name, at_once=False):
    """A given table, one file or a folder of files, as a stream; a pattern as path takes both.

    ``at_once`` takes all files in one micro-batch, for jobs whose events follow the order in which rows
    arrive: the files of a table hold its rows in no order.
    """
    path = f"{sf.rstrip('/')}/{name}.parquet"
    given = prepare(spark).read.parquet(path)
    options = {"per_trigger": max(1, len(given.inputFiles()))} if at_once else {}
    return jobs.file_stream(spark, given.schema, f"{path[:-1]}[{path[-1]}]", **options)


def _paths(spark, name):
    return scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")


@query("session_memory_stream", MEMORY_SQL)
def memory(spark, sf):
    """ST2: last value per session and key after the last clear."""
    out, checkpoint = _paths(spark, "memory")
    changes = jobs.session_memory_stream(operations_of(_stream(spark, sf, "events")))
    jobs.write_stream(changes, out, checkpoint).awaitTermination()
    return jobs.memory_from_changes(spark.read.schema(jobs.MEMORY_OUTPUT).parquet(out))


@query("session_memory_updates", MEMORY_SQL)
def memory_updates(spark, sf):
    """ST2 in update mode: one state entry per session and key."""
    out, checkpoint = _paths(spark, "memory-updates")
    changes = jobs.session_memory_updates(operations_of(_stream(spark, sf, "events")))
    jobs.write_updates(changes, out, checkpoint).awaitTermination()
    return jobs.memory_from_changes(spark.read.schema(jobs.MEMORY_OUTPUT).parquet(f"{out}/*"))


@query(
    "session_counters_stream",
    "SELECT user_id AS session_id, count(*) FILTER (event_type = 'click') AS total_messages, sum(event_id % 3)::BIGINT AS total_documents FROM events GROUP BY 1",
)
def counters(spark, sf):
    """ST3: running totals in update mode; the newest batch per session counts."""
    out, checkpoint = _paths(spark, "counters")
    changes = _stream(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), (F.col("event_type") == "click").cast("long").alias("messages"), (F.col("event_id") % 3).alias("documents"))
    jobs.write_updates(jobs.session_counters_stream(changes), out, checkpoint).awaitTermination()
    rows = spark.read.parquet(f"{out}/*")
    newest = rows.groupBy("session_id").agg(F.max_by(F.struct("total_messages", "total_documents"), "batch_id").alias("t"))
    return newest.select("session_id", "t.*")


@query(
    "rolling_quality_stream",
    f"""WITH {LOGS_CTE}, w AS (SELECT logs.*, unnest(generate_series(date_trunc('day', created_at) - INTERVAL 6 DAY, date_trunc('day', created_at), INTERVAL 1 DAY)) AS window_start FROM logs WHERE reflection_score IS NOT NULL)
      SELECT strftime(window_start, '%Y-%m-%d') AS day, {_QUALITY_SQL} FROM w GROUP BY window_start
      HAVING window_start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def rolling(spark, sf):
    """ST4: windows leave the stream once the watermark (one day) has passed them."""
    out, checkpoint = _paths(spark, "quality")
    logs = logs_of(_stream(spark, sf, "events", at_once=True)).withColumn("created_at", F.col("created_at").cast("timestamp"))
    jobs.write_stream(jobs.rolling_quality(logs, delay="1 day"), out, checkpoint).awaitTermination()
    report = spark.read.parquet(out)
    return report.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start", "window_end")


@query(
    "context_compaction",
    """WITH RECURSIVE m AS (
        SELECT conv_id AS s, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS i FROM conversations
      ), r AS (
        SELECT DISTINCT conv_id AS s, 0::BIGINT AS i, 0::BIGINT AS seq, 0::BIGINT AS tokens, []::BIGINT[] AS seqs, []::BIGINT[] AS sizes, NULL::BIGINT[] AS removed FROM conversations
        UNION ALL
        SELECT s, i, seq, tokens, CASE WHEN passed THEN held[len(held) - 3:] ELSE held END, CASE WHEN passed THEN lengths[len(held) - 3:] ELSE lengths END,
          CASE WHEN passed THEN held[:len(held) - 4] END
        FROM (SELECT *, tokens > 500 AND len(held) > 4 AS passed FROM (SELECT *, list_sum(lengths)::BIGINT // 4 AS tokens FROM (
          SELECT m.s, m.i, m.turn AS seq, list_append(r.seqs, m.turn) AS held, list_append(r.sizes, m.n) AS lengths FROM r JOIN m ON m.s = r.s AND m.i = r.i + 1)))
      )
      SELECT s AS session_id, seq, tokens AS estimated_tokens, array_to_string(removed, ',') AS removed FROM r WHERE removed IS NOT NULL""",
)
def compaction(spark, sf):
    """ST5: an event each time a session passes 500 tokens with more than four messages."""
    out, checkpoint = _paths(spark, "compaction")
    events = jobs.compaction_stream(messages_of(_stream(spark, sf, "conversations", at_once=True)), keep=4, threshold=500)
    jobs.write_stream(events, out, checkpoint).awaitTermination()
    rows = spark.read.schema(jobs.COMPACTION_OUTPUT).parquet(out)
    return rows.select(F.col("session_id").cast("long"), "seq", "estimated_tokens", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


@query("ingest_stream")
def ingested(spark, sf):
    """ST1: documents as they arrive → one table of chunks; exact copies are dropped."""
    out, checkpoint = _paths(spark, "collection")
    docs = _stream(spark, sf, "documents").select(
        "doc_id", "source", "text", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("arrived_at"))
    jobs.ingest_stream(docs, out, checkpoint).awaitTermination()
    chunks = jobs.ingested_chunks(spark, out)
    return chunks.groupBy("source").agg(F.count_distinct("id").alias("ids"), F.count("*").alias("chunks"))
