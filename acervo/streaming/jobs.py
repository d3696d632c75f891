"""Streams over files of documents, messages, memory operations and query logs.

Every job takes a streaming DataFrame and a checkpoint folder, which must lie on
storage all executors share, and returns a started query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from acervo.operators.logs import quality_aggregates
from acervo.operators.sessions import CHARS_PER_TOKEN, KEEP_LAST, THRESHOLD_TOKENS
from acervo.plans.ingest import prepare_chunks
from acervo.session import cut_lineage
from acervo.sources.tables import append_delta, latest_per_key, read_collection


def file_stream(spark: SparkSession, schema, path: str, *, fmt: str = "parquet", per_trigger: int = 1000, **options: str) -> DataFrame:
    """New files of a folder as a stream, at most ``per_trigger`` files per micro-batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).options(**options).load(path)


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there now, batch by batch, through ``sink``."""
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(sink).start()
    )


# ── New documents ─────────────────────────────────────────────────────────────

def ingest_stream(documents: DataFrame, collection: str, checkpoint: str, *, arrived: str = "arrived_at",
                  days: int | None = None) -> StreamingQuery:
    """Documents (doc_id, source, text, arrived_at) → chunks in the collection at ``collection``.

    A copy (same content hash, and session_id where there is one) of any document seen
    before is dropped; with ``days``, of one that arrived within so many days.  Copies inside a micro-batch combine
    on the map side, and earlier ones are found by an anti-join with the stored
    hashes, so a much-copied document does not pile up in one task or state
    partition.  Each micro-batch adds its own delta, so the cost follows the new
    documents and not the collection; a batch that is run again replaces its
    delta; ``read_collection`` lets the newest batch win per chunk id.
    """
    keys = [c for c in ("session_id", "file_hash") if c == "file_hash" or c in documents.columns]
    seen, chunks = f"{collection}/hashes", f"{collection}/chunks"

    def add(batch: DataFrame, batch_id: int) -> None:
        hashed = batch.withColumn("file_hash", F.sha2("text", 256))
        body = [c for c in hashed.columns if c not in keys]
        once = hashed.groupBy(*keys).agg(F.min_by(F.struct(*body), F.struct(arrived, "doc_id")).alias("_doc")).select(*keys, "_doc.*")
        if batch_id > 0:
            known = batch.sparkSession.read.option("basePath", seen).parquet(f"{seen}/batch=*").filter(F.col("batch") < batch_id)
            if days is not None:
                known = known.filter(F.col(arrived) >= batch.agg(F.min(arrived) - F.make_dt_interval(F.lit(days))).scalar())
            once = once.join(known.select(*keys), keys, "left_anti")
        once = cut_lineage(once)  # read for the chunks and for the hashes
        append_delta(latest_per_key(prepare_chunks(once), "id", F.struct(arrived, "doc_id")), chunks, batch_id)
        append_delta(once.select(*keys, arrived), seen, batch_id)

    return run_available(documents, checkpoint, add)


def ingested_chunks(spark: SparkSession, collection: str) -> DataFrame:
    """Current chunks of a collection filled by ``ingest_stream``."""
    return read_collection(spark, f"{collection}/chunks")


# ── Session memory ────────────────────────────────────────────────────────────

MEMORY_OUTPUT = "session_id string, key string, value string, seq bigint, cleared boolean"


def session_memory_stream(operations: DataFrame) -> DataFrame:
    """Memory operations → changes: a row per key set, or one cleared row per clear.

    The state of a session is the sequence of its last clear and the last value
    of each key; operations may arrive in any order.
    """

    def apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cleared, keys, values, seqs = state.get if state.exists else (-1, [], [], [])
        memory = {k: (s, v) for k, v, s in zip(keys, values, seqs)}
        before, was_cleared = dict(memory), cleared
        for ops in batches:
            for op, name, value, seq in zip(ops["op"], ops["key"], ops["value"], ops["seq"]):
                if op == "clear":
                    cleared = max(cleared, int(seq))
                elif int(seq) > memory.get(name, (-1, None))[0]:
                    memory[name] = (int(seq), value)
        memory = {k: v for k, v in memory.items() if v[0] > cleared}
        state.update((cleared, list(memory), [v for _, v in memory.values()], [s for s, _ in memory.values()]))
        rows = [(str(key[0]), None, None, cleared, True)] if cleared > was_cleared else []
        rows += [(str(key[0]), k, v, s, False) for k, (s, v) in memory.items() if before.get(k) != (s, v)]
        yield pd.DataFrame(rows, columns=["session_id", "key", "value", "seq", "cleared"])

    return operations.groupBy("session_id").applyInPandasWithState(
        apply,
        outputStructType=MEMORY_OUTPUT,
        stateStructType="cleared bigint, keys array<string>, vals array<string>, seqs array<bigint>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def session_memory_updates(operations: DataFrame) -> DataFrame:
    """Memory operations → the newest value of each (session, key), and of each session the newest clear (update mode).

    A clear is kept under the key null.  The state is one entry per session and key, so a batch rewrites
    the entries it changes and nothing else; copies of a key combine before the shuffle, and no
    row passes through Python.  Write it with ``write_updates``; ``memory_from_changes`` reads it.
    """
    cleared = F.col("op") == "clear"
    rows = operations.select("session_id", F.when(~cleared, F.col("key")).alias("key"), F.struct("seq", F.when(~cleared, F.col("value")).alias("value")).alias("_last"), cleared.alias("cleared"))
    last = rows.groupBy("session_id", "key", "cleared").agg(F.max("_last").alias("_last"))
    return last.select(F.col("session_id").cast("string").alias("session_id"), "key", F.col("_last.value").alias("value"), F.col("_last.seq").cast("long").alias("seq"), "cleared")


def memory_from_changes(changes: DataFrame) -> DataFrame:
    """Changes written by the stream → the keys that are set now."""
    clears = changes.filter("cleared").groupBy("session_id").agg(F.max("seq").alias("_clear"))
    last = changes.filter("NOT cleared").groupBy("session_id", "key").agg(F.max(F.struct("seq", "value")).alias("_last"))
    return (
        last.join(clears, "session_id", "left")
        .filter(F.col("_clear").isNull() | (F.col("_last.seq") > F.col("_clear")))
        .select("session_id", "key", F.col("_last.value").alias("value"), F.col("_last.seq").alias("seq"))
    )


# ── Counters, quality, context size ───────────────────────────────────────────

def session_counters_stream(changes: DataFrame) -> DataFrame:
    """Running totals per session (update mode)."""
    return changes.groupBy("session_id").agg(
        F.sum("messages").alias("total_messages"), F.sum("documents").alias("total_documents")
    )


def rolling_quality(logs: DataFrame, period: str = "7 days", step: str = "1 day", delay: str | None = None) -> DataFrame:
    """The quality report over a moving period; with ``delay`` it runs on a stream and drops later rows.

    Works alike on a batch and on a stream.
    """
    rows = logs.withWatermark("created_at", delay) if delay else logs
    scored = rows.filter(F.col("reflection_score").isNotNull())
    report = scored.groupBy(F.window("created_at", period, step)).agg(*quality_aggregates())
    return report.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *report.columns[1:])


COMPACTION_OUTPUT = "session_id string, seq bigint, estimated_tokens bigint, removed array<bigint>"


def compaction_stream(messages: DataFrame, *, keep: int = KEEP_LAST, threshold: int = THRESHOLD_TOKENS) -> DataFrame:
    """One event each time a session passes the threshold: the messages that leave for the summary.

    State per session: seq and length of the messages still held, which the
    compaction itself keeps short; their sum runs along.
    """

    def apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, sizes = state.get if state.exists else ([], [])
        held = list(zip(seqs, sizes))
        total = sum(sizes)
        events = []
        arrived = sorted(
            (int(s), len(c or "")) for rows in batches for s, c in zip(rows["seq"], rows["content"])
        )
        for message in arrived:
            held.append(message)
            total += message[1]
            tokens = total // CHARS_PER_TOKEN
            if tokens > threshold and len(held) > keep:
                gone, held = held[:-keep], held[-keep:]
                total = sum(size for _, size in held)
                events.append((str(key[0]), message[0], tokens, [s for s, _ in gone]))
        state.update(([s for s, _ in held], [n for _, n in held]))
        yield pd.DataFrame(events, columns=["session_id", "seq", "estimated_tokens", "removed"])

    return messages.groupBy("session_id").applyInPandasWithState(
        apply,
        outputStructType=COMPACTION_OUTPUT,
        stateStructType="seqs array<bigint>, sizes array<bigint>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-mode stream → parquet files (exactly once), for what is available now."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update-mode stream → one parquet folder per micro-batch; readers take the newest row per key.

    Writing a batch again after a failure replaces its own folder.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_available(stream, checkpoint, sink, mode="update")
