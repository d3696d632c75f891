"""Sessions and messages: history, counters, context size, changes to the tables.

Message rows have session_id, message_id, role, content, created_at and seq, a
number that orders the messages of a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.operators.ranking import top_k

# Fixed values.
THRESHOLD_TOKENS, KEEP_LAST, CHARS_PER_TOKEN, MESSAGE_CHARS = 8000, 8, 4, 800
TITLE_CHARS, DEFAULT_PROFILE = 500, "general-dev"


def last_n_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` of each session, in ascending order."""
    newest = top_k(messages, ["session_id"], [F.col("seq").desc()], n, "_newest").drop("_newest")
    return newest.orderBy("session_id", "seq")


def session_with_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions that are not deleted, each with its messages as rows in order (one row when it has none).

    Rows, not a nested array: a session may hold any number of messages.
    """
    kept = sessions.filter(F.col("deleted_at").isNull())
    body = messages.select("session_id", "seq", "role", "content")
    return kept.join(body, "session_id", "left").orderBy("session_id", "seq")


def conversation_tokens(messages: DataFrame, threshold: int = THRESHOLD_TOKENS) -> DataFrame:
    """Per session: messages, estimated tokens (characters // 4), whether it passes the threshold."""
    tokens = F.floor(F.coalesce(F.sum(F.length("content")), F.lit(0)) / CHARS_PER_TOKEN)
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"), tokens.alias("estimated_tokens"), (tokens > threshold).alias("needs_compression")
    )


def format_message(role: Column, content: Column, limit: int = MESSAGE_CHARS) -> Column:
    """``ROLE: text``; long texts cut with a mark."""
    cut = F.concat(F.substring(content, 1, limit), F.lit("... [truncado]"))
    return F.concat(F.upper(role), F.lit(": "), F.when(F.length(content) > limit, cut).otherwise(content))


def format_messages(messages: DataFrame, per_piece: int = 1000) -> DataFrame:
    """(session_id, piece, text): messages in order, one line each.

    ``seq`` is dense from 0; an ordinary session is one piece, a longer one comes
    in pieces of ``per_piece`` messages.
    """
    piece = F.floor(F.col("seq") / per_piece).cast("int").alias("piece")
    line = format_message(F.col("role"), F.col("content")).alias("line")
    gathered = messages.groupBy("session_id", piece).agg(F.array_sort(F.collect_list(F.struct("seq", line))).alias("_rows"))
    return gathered.select("session_id", "piece", F.array_join(F.transform("_rows", lambda r: r["line"]), "\n").alias("text"))


def keep_last_n(messages: DataFrame, keep: int = KEEP_LAST, threshold: int = THRESHOLD_TOKENS) -> DataFrame:
    """Messages with ``to_summarise``: true for those older than the newest ``keep`` of a session
    above the threshold that has more than ``keep`` messages.

    The cut point is the smallest seq among the newest ``keep`` (one small row
    per session); no window runs over a whole session.
    """
    sizes = conversation_tokens(messages, threshold)
    newest = top_k(messages.select("session_id", "seq"), ["session_id"], [F.col("seq").desc()], keep, "_newest")
    cuts = newest.groupBy("session_id").agg(F.min("seq").alias("_cut"))
    over = sizes.filter(F.col("needs_compression") & (F.col("message_count") > keep)).select("session_id").join(cuts, "session_id")
    return messages.join(over, "session_id", "left").withColumn(
        "to_summarise", F.coalesce(F.col("seq") < F.col("_cut"), F.lit(False))
    ).drop("_cut")


def summary_message(summary: Column, keep: int = KEEP_LAST) -> Column:
    return F.concat(
        F.lit("[RESUMEN DE CONVERSACIÓN ANTERIOR]\n"), summary,
        F.lit(f"\n[FIN DEL RESUMEN — Los últimos {keep} mensajes siguen completos]"),
    )


def session_counters(changes: DataFrame, every: str = "1 hour") -> DataFrame:
    """Running totals per session over (session_id, created_at, change_id, messages, documents).

    Two levels: totals per session and hour are few and get a running sum; rows
    get a running sum within their hour.  A session with a third of all rows is
    spread over its hours.
    """
    slot = F.date_trunc(every.split()[-1], "created_at")
    rows = changes.withColumn("_slot", slot)
    per_slot = rows.groupBy("session_id", "_slot").agg(F.sum("messages").alias("_m"), F.sum("documents").alias("_d"))
    earlier = Window.partitionBy("session_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slot.select(
        "session_id", "_slot",
        F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_m0"),
        F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_d0"),
    )
    within = Window.partitionBy("session_id", "_slot").orderBy("created_at", "change_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_m", F.sum("messages").over(within)).withColumn("_d", F.sum("documents").over(within))
    return summed.join(starts, ["session_id", "_slot"]).select(
        "session_id", "created_at", "change_id",
        (F.col("_m0") + F.col("_m")).alias("total_messages"),
        (F.col("_d0") + F.col("_d")).alias("total_documents"),
    )


# ── Histories ─────────────────────────────────────────────────────────────────

# The order of each history; names with a minus are descending.
HISTORIES = {
    "messages": ["session_id", "seq"], "chunks": ["document_id", "chunk_index"],
    "query_logs": ["session_id", "-created_at", "-id"], "user_profiles": ["user_identifier"],
}


def history(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` in the total order of their kind: messages and chunks ascending, query logs newest first, profiles by user."""
    return rows.orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in HISTORIES[kind]])


# ── Session memory ────────────────────────────────────────────────────────────

def session_memory(operations: DataFrame) -> DataFrame:
    """(session_id, op, key, value, seq) with op save or clear → the keys that are set now.

    Saves are reduced to the last one per key before they meet the clears.
    """
    saves = operations.filter(F.col("op") == "save").groupBy("session_id", "key").agg(
        F.max(F.struct("seq", "value")).alias("_last")
    )
    clears = operations.filter(F.col("op") == "clear").groupBy("session_id").agg(F.max("seq").alias("_clear"))
    return (
        saves.join(clears, "session_id", "left")
        .filter(F.col("_clear").isNull() | (F.col("_last.seq") > F.col("_clear")))
        .select("session_id", "key", F.col("_last.value").alias("value"), F.col("_last.seq").alias("seq"))
    )


def sync_memory(memory: DataFrame, synced: DataFrame) -> DataFrame:
    """New snapshot of the memory (session_id, key, value, seq): a session that is synced has what it is given and nothing else."""
    last = synced.groupBy("session_id", "key").agg(F.max(F.struct("seq", "value")).alias("_last"))
    kept = memory.join(synced.select("session_id").distinct(), "session_id", "left_anti")
    return kept.select("session_id", "key", "value", "seq").unionByName(
        last.select("session_id", "key", F.col("_last.value").alias("value"), F.col("_last.seq").alias("seq"))
    )


def context_keys(memory: DataFrame) -> DataFrame:
    """Keys set per session, as counts and rows: (session_id, key, count)."""
    counts = memory.groupBy("session_id").agg(F.count("*").alias("count"))
    return memory.select("session_id", "key").join(counts, "session_id")


# ── Changes to the tables: each returns the new snapshot ──────────────────────

def insert_rows(table: DataFrame, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Append; missing columns take their default (``F.expr("uuid()")`` for ids, say)."""
    filled = rows
    for name, value in defaults.items():
        given = F.coalesce(F.col(name), value) if name in rows.columns else value
        filled = filled.withColumn(name, given.cast(table.schema[name].dataType))
    return table.unionByName(filled.select(*[c for c in table.columns if c in filled.columns]), allowMissingColumns=True)


def update_title(sessions: DataFrame, titles: DataFrame, now: Column) -> DataFrame:
    """Set titles (session_id, new_title), cut to 500, on sessions that are not deleted.

    Of several titles for a session the last by ``seq`` counts, or the greatest where there is no such column.
    """
    order = "seq" if "seq" in titles.columns else "new_title"
    last = titles.groupBy("session_id").agg(F.max_by("new_title", order).alias("new_title"))
    joined = sessions.join(last, "session_id", "left")
    hit = F.col("new_title").isNotNull() & F.col("deleted_at").isNull()
    return joined.withColumn("title", F.when(hit, F.substring("new_title", 1, TITLE_CHARS)).otherwise(F.col("title"))).withColumn(
        "updated_at", F.when(hit, now).otherwise(F.col("updated_at"))
    ).drop("new_title")


def increment(sessions: DataFrame, deltas: DataFrame, now: Column) -> DataFrame:
    """Add (session_id, messages, documents) deltas, summed per session first."""
    sums = deltas.groupBy("session_id").agg(F.sum("messages").alias("_m"), F.sum("documents").alias("_d"))
    joined = sessions.join(sums, "session_id", "left")
    hit = (F.coalesce("_m", F.lit(0)) != 0) | (F.coalesce("_d", F.lit(0)) != 0)
    return (
        joined.withColumn("total_messages", F.col("total_messages") + F.coalesce("_m", F.lit(0)))
        .withColumn("total_documents", F.col("total_documents") + F.coalesce("_d", F.lit(0)))
        .withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
        .drop("_m", "_d")
    )


def soft_delete(sessions: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Mark sessions deleted and inactive; ``deleted_now`` tells which rows were hit."""
    joined = sessions.join(ids.select("session_id").distinct().withColumn("_hit", F.lit(True)), "session_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("deleted_at").isNull()
    marked = joined.withColumn("deleted_now", hit)
    return marked.withColumn("deleted_at", F.when(F.col("deleted_now"), now).otherwise(F.col("deleted_at"))).withColumn(
        "is_active", F.when(F.col("deleted_now"), F.lit(False)).otherwise(F.col("is_active"))
    ).drop("_hit")


def upsert_profiles(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or update by user; of several changes the last (by seq) counts; the row becomes active.

    Columns of ``profiles`` that a change does not carry keep their values; new users have null there.
    """
    given = [c for c in changes.columns if c not in ("user_identifier", "seq", "is_active")]
    last = changes.groupBy("user_identifier").agg(F.max_by(F.struct(*given), "seq").alias("_new"))
    joined = profiles.join(last, "user_identifier", "full")
    changed = F.col("_new").isNotNull()
    value = lambda c: F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)) if c in given else F.col(c)
    return joined.select(*[
        (changed | F.col("is_active") if c == "is_active" else value(c)).alias(c) for c in profiles.columns
    ])


def deactivate_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    hit = profiles.join(users.select("user_identifier").distinct().withColumn("_hit", F.lit(True)), "user_identifier", "left")
    return hit.withColumn("is_active", F.col("is_active") & F.col("_hit").isNull()).drop("_hit")


def preferred_or_default(users: DataFrame, profiles: DataFrame, default: str = DEFAULT_PROFILE) -> DataFrame:
    """Profile of each user; inactive or missing gives the default."""
    active = profiles.filter("is_active").groupBy("user_identifier").agg(F.max("preferred_profile").alias("preferred_profile"))
    joined = users.join(active, "user_identifier", "left")
    return joined.withColumn("preferred_profile", F.coalesce("preferred_profile", F.lit(default)))


def delete_cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children of deleted parents go too."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def delete_set_null(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows of deleted parents stay, their reference becomes null."""
    gone = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
    return rows.join(gone, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")
