"""Files, sheets, pages, collections, sessions and logs."""

from __future__ import annotations


from pyspark.sql import functions as F

from acervo.functions import metadata

from acervo.operators import filters, logs, pages, sessions as se, sheets
from acervo.operators.evaluate import json_report, rag_scores
from acervo.plans.answer import answer_batch, answer_until_valid, corrective_loop, plan_queries
from acervo.plans.ingest import augment_and_index, ingest
from acervo.session import cut_lineage, scratch_path
from acervo.sources import files, store, tables
from entry_queries.inputs import (
    LINES_CTE, LOGS_CTE, MEMORY_SQL, VECTOR_CTE, knn_cte, P, PAGES_CTE, REF_TS, SESSIONS_CTE, SHEET_COLUMNS, SHEET_CTE,
    both_queries, documents, line_chunks, memory_operations, messages, now, page_rows, query_logs,
    sessions, sheet_rows, table, vector_queries, vectors,
)
from entry_queries.registry import SQL, query
from entry_queries.text import _pairs, question_model
from acervo.operators.fusion import hybrid_search
from acervo.operators.lexical import build_index
from acervo.operators.vector import knn

_NOW = f"TIMESTAMP '{REF_TS}'"


# ── Files ─────────────────────────────────────────────────────────────────────

@query(
    "read_files",
    """SELECT source, sum(length(text) + 1)::BIGINT AS characters, true AS success, 0::BIGINT AS errors
       FROM documents GROUP BY source""",
)
def read_files(spark, sf):
    """The documents written as text files below a folder per source, then read as files with their texts."""
    path = scratch_path(spark, "texts")
    documents(spark, sf).select("source", "text").write.partitionBy("source").text(path)
    rows = files.read_files(spark, path, "*.txt").withColumn("source", F.regexp_extract("path", "source=([^/]*)/", 1))
    return rows.groupBy("source").agg(
        F.sum(F.length("text")).alias("characters"), F.bool_and("success").alias("success"), F.sum(F.size("errors")).alias("errors"))


_MAGIC = {
    0: "25504446", 1: "504B0304776F72642F", 2: "504B0304786C2F", 3: "FFD8FF", 4: "89504E470D0A1A0A", 5: "49492A00",
    6: "5249464600000000" + "57454250", 7: "424D", 8: "", 9: "D0CF11E0A1B11AE1" + "WordDocument".encode("utf-16-le").hex().upper(),
}


@query(
    "detect_mime",
    """SELECT doc_id, ['application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet',
        'image/jpeg', 'image/png', 'image/tiff', 'image/webp', 'image/bmp', 'application/octet-stream', 'application/msword'][doc_id % 10 + 1] AS mime,
      ['PDF', 'Word (.docx)', 'Excel (.xlsx)', 'Imagen JPEG', 'Imagen PNG', 'Imagen TIFF', 'Imagen WebP', 'Imagen BMP', 'Desconocido (application/octet-stream)', 'Word (.doc, legacy)'][doc_id % 10 + 1] AS label,
      doc_id % 10 <> 8 AS is_supported FROM documents""",
)
def mimes(spark, sf):
    """Documents behind the leading bytes of ten file types."""
    magic = F.create_map(*[x for k, v in _MAGIC.items() for x in (F.lit(k), F.lit(v))])
    content = F.concat(F.unhex(F.element_at(magic, F.col("doc_id").cast("int") % 10)), F.encode(F.lit("x"), "UTF-8"), F.encode("text", "UTF-8"))
    rows = documents(spark, sf).select("doc_id", files.detect_mime(content).alias("m"))
    return rows.select("doc_id", "m.mime", "m.label", "m.is_supported")


@query("detect_many", "SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id % 10 <> 8")
def supported(spark, sf):
    """Unsupported rows dropped."""
    magic = F.create_map(*[x for k, v in _MAGIC.items() for x in (F.lit(k), F.lit(v))])
    content = F.concat(F.unhex(F.element_at(magic, F.col("doc_id").cast("int") % 10)), F.encode(F.lit("x"), "UTF-8"), F.encode("text", "UTF-8"))
    rows = documents(spark, sf).select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return files.detect_many(rows).select("path")


@query(
    "upload_gate",
    r"""SELECT page_id, name FROM (SELECT page_id, substring(url, 8) || ['.PDF', '.docx', '.exe', '', '.tiff', '.tar.gz', '.Jpeg'][page_id % 7 + 1] AS name FROM pages)
        WHERE regexp_matches(lower(regexp_extract(name, '[^/]*$')), '^.+\.(pdf|docx|xlsx|xls|jpg|jpeg|png|tiff|webp)$')""",
)
def gated(spark, sf):
    """S3."""
    ends = F.array(*[F.lit(e) for e in [".PDF", ".docx", ".exe", "", ".tiff", ".tar.gz", ".Jpeg"]])
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.expr("substring(url, 8)"), F.get(ends, F.col("page_id").cast("int") % 7)).alias("name"))
    return files.upload_gate(rows, "name")


@query(
    "file_fingerprint",
    """SELECT session_id, file_hash, path FROM (SELECT source AS session_id, sha256(text) AS file_hash, min(doc_id) AS path FROM documents GROUP BY 1, 2)
       WHERE (session_id, file_hash) NOT IN (SELECT source, sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""",
)
def fingerprints(spark, sf):
    """First copy per session, without what is known."""
    docs = documents(spark, sf).select(F.col("source").alias("session_id"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("path"))
    hashed = files.file_fingerprint(docs).drop("content")
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("path"))
    return files.new_files(hashed, hashed.join(toxic, "path", "left_semi"))


@query(
    "search_text_files",
    "SELECT source || '/n' || doc_id || '.md' AS path FROM documents WHERE contains('n' || doc_id, '12') OR contains(lower(text), '12')",
)
def searched(spark, sf):
    """S13 on documents as files, whole texts."""
    rows = documents(spark, sf).select(F.concat("source", F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return files.search_texts(rows, "12", None)


@query("write_json_report")
def report(spark, sf):
    """The report written and read back."""
    path = scratch_path(spark, "report")
    scored = rag_scores(_pairs(spark, sf)).withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    json_report(scored, "key").write.text(path)
    return spark.read.text(path)


@query("relational_tables", "SELECT conv_id::VARCHAR AS session_id, count(*) AS n, min(turn)::INTEGER AS first FROM conversations GROUP BY 1")
def relational(spark, sf):
    """Messages appended to the stored table and read back."""
    root = scratch_path(spark, "tables")
    rows = messages(spark, sf).select(
        F.concat_ws("-", "session_id", "seq").alias("id"), F.col("session_id").cast("string"), "role", "content",
        F.col("seq").cast("int").alias("iteration_count"), now().alias("created_at"))
    tables.append_table(rows, root, "messages")
    stored = tables.read_table(spark, root, "messages")
    return stored.groupBy("session_id").agg(F.count("*").alias("n"), F.min("iteration_count").alias("first"))


def _eight_tables(spark, sf, root):
    text = lambda *names: F.concat_ws("-", *[F.col(n).cast("string") for n in names])
    events = table(spark, sf, "events")
    rows = {
        "sessions": table(spark, sf, "customer").select(text("c_custkey").alias("id"), F.col("c_mktsegment").alias("user_identifier"), F.col("c_name").alias("title")),
        "messages": messages(spark, sf).select(text("session_id", "seq").alias("id"), text("session_id").alias("session_id"), "role", "content", now().alias("created_at")),
        "documents": documents(spark, sf).select(text("doc_id").alias("id"), (F.col("doc_id") % 200).cast("string").alias("session_id"), F.col("source").alias("filename"), F.md5("text").alias("file_hash")),
        "chunks": table(spark, sf, "lineitem").select(text("l_orderkey", "l_linenumber", "l_partkey").alias("id"), text("l_orderkey").alias("document_id"), text("l_partkey", "l_suppkey").alias("chroma_id"), F.col("l_linenumber").alias("chunk_index")),
        "query_logs": events.select(text("event_id").alias("id"), text("user_id").alias("session_id"), F.concat((F.col("event_id") % 50).cast("string"), F.lit("-0")).alias("message_id"), F.col("ts").alias("created_at")),
        "reflection_logs": events.where("event_type = 'error'").select(text("event_id").alias("id"), text("user_id").alias("session_id"), F.lit(None).cast("string").alias("message_id"), F.col("ts").alias("created_at")),
        "user_profiles": table(spark, sf, "supplier").select(text("s_suppkey").alias("id"), text("s_nationkey").alias("user_identifier"), F.col("s_name").alias("preferred_profile")),
        "session_memory": table(spark, sf, "part").select(text("p_partkey").alias("id"), text("p_size").alias("session_id"), F.col("p_brand").alias("key"), F.col("p_name").alias("value")),
    }
    for name, df in rows.items():
        tables.append_table(df, root, name)


_EIGHT_CTE = """
sessions AS (SELECT c_custkey::VARCHAR AS id FROM customer),
messages AS (SELECT conv_id || '-' || turn AS id, conv_id::VARCHAR AS session_id FROM conversations),
docs AS (SELECT doc_id::VARCHAR AS id, (doc_id % 200)::VARCHAR AS session_id, md5(text) AS file_hash FROM documents),
chunks AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_orderkey::VARCHAR AS document_id, l_partkey || '-' || l_suppkey AS chroma_id FROM lineitem),
query_logs AS (SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS session_id, event_id % 50 || '-0' AS message_id FROM events),
reflection_logs AS (SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS session_id, NULL::VARCHAR AS message_id FROM events WHERE event_type = 'error'),
profiles AS (SELECT s_suppkey::VARCHAR AS id, s_nationkey::VARCHAR AS user_identifier FROM supplier),
memory AS (SELECT p_partkey::VARCHAR AS id, p_size::VARCHAR AS session_id, p_brand AS key FROM part)
"""
_AT = {"documents": "docs", "user_profiles": "profiles", "session_memory": "memory"}


def _violations_sql() -> str:
    parts = []
    for name in tables.SCHEMAS:
        for key in [["id"], *tables.UNIQUE.get(name, [])]:
            known = " AND ".join(f"{c} IS NOT NULL" for c in key)
            parts.append(f"SELECT '{name}' AS table_name, 'unique {', '.join(key)}' AS \"constraint\", (count(*) - count(DISTINCT ({', '.join(key)},)))::BIGINT AS violations FROM {_AT.get(name, name)} WHERE {known}")
    for name, column, parent, _ in tables.REFERENCES:
        parts.append(f"SELECT '{name}', '{column} in {parent}', count(*) FROM {_AT.get(name, name)} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {_AT.get(parent, parent)})")
    return f"WITH {_EIGHT_CTE} " + " UNION ALL ".join(parts)


@query("relational_keys", _violations_sql())
def relational_keys(spark, sf):
    """All eight tables written, read back and held against their keys and references."""
    root = scratch_path(spark, "eight")
    _eight_tables(spark, sf, root)
    return tables.key_violations(spark, root)


@query(
    "relational_delete",
    f"""WITH {_EIGHT_CTE}, gone AS (SELECT id FROM sessions WHERE id::BIGINT % 4 = 1), lost AS (SELECT id FROM messages WHERE session_id IN (SELECT id FROM gone))
      SELECT 'sessions' AS table_name, count(*) AS n, 0::BIGINT AS unlinked FROM sessions WHERE id NOT IN (SELECT id FROM gone)
      UNION ALL SELECT 'messages', count(*), 0 FROM messages WHERE session_id NOT IN (SELECT id FROM gone)
      UNION ALL SELECT 'documents', count(*), count(*) FILTER (session_id IN (SELECT id FROM gone)) FROM docs
      UNION ALL SELECT 'query_logs', count(*), count(*) FILTER (session_id IN (SELECT id FROM gone)) FROM query_logs
      UNION ALL SELECT 'reflection_logs', count(*), count(*) FILTER (session_id IN (SELECT id FROM gone)) FROM reflection_logs
      UNION ALL SELECT 'session_memory', count(*), 0 FROM memory WHERE session_id NOT IN (SELECT id FROM gone)""",
)
def relational_delete(spark, sf):
    """A quarter of the sessions deleted with what refers to them."""
    root = scratch_path(spark, "eight")
    _eight_tables(spark, sf, root)
    gone = tables.read_table(spark, root, "sessions").where("cast(id as bigint) % 4 = 1")
    after = tables.delete_rows(spark, root, "sessions", gone)
    out = None
    for name, rows in after.items():
        unlinked = F.count_if(F.col("session_id").isNull()) if "session_id" in rows.columns else F.lit(0)
        part = rows.agg(F.count("*").alias("n"), unlinked.cast("long").alias("unlinked")).select(F.lit(name).alias("table_name"), "n", "unlinked")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "count_chunks_and_messages",
    """SELECT 'document' AS kind, l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 2
      UNION ALL SELECT 'session', conv_id, count(*) FROM conversations GROUP BY 2""",
)
def counted_parts(spark, sf):
    """A4: chunks of each document, messages of each session."""
    chunks = logs.count_by(table(spark, sf, "lineitem"), "l_orderkey").select(F.lit("document").alias("kind"), F.col("l_orderkey").alias("key"), "n")
    turns = logs.count_by(messages(spark, sf), "session_id").select(F.lit("session").alias("kind"), F.col("session_id").alias("key"), "n")
    return chunks.unionByName(turns)


# ── Sheets ────────────────────────────────────────────────────────────────────

_SHEET_KEYS = ["sheet", "row_no"]


@query("read_sheet", f"WITH {SHEET_CTE} SELECT sheet, row_no, parte, marca, estado FROM sheet")
def sheet(spark, sf):
    """S5."""
    return sheets.read_sheet(sheet_rows(spark, sf), SHEET_COLUMNS)


@query(
    "rows_to_paragraph",
    f"""WITH {SHEET_CTE} SELECT sheet, row_no, concat_ws(' | ', CASE WHEN trim(parte) <> '' THEN 'parte: ' || trim(parte) END, CASE WHEN trim(marca) <> '' THEN 'marca: ' || trim(marca) END,
        CASE WHEN trim(estado) <> '' THEN 'estado: ' || trim(estado) END) AS line FROM sheet""",
)
def paragraphs(spark, sf):
    """P21."""
    rows = sheets.read_sheet(sheet_rows(spark, sf), SHEET_COLUMNS)
    return rows.select(*_SHEET_KEYS, sheets.rows_to_paragraph(SHEET_COLUMNS).alias("line"))


@query("row_groups", f"WITH {SHEET_CTE} SELECT sheet, row_no, position, block, row_start, row_end FROM blocks")
def blocks(spark, sf):
    """W5."""
    rows = sheets.row_groups(sheets.read_sheet(sheet_rows(spark, sf), SHEET_COLUMNS))
    return rows.select(*_SHEET_KEYS, F.col("position").cast("long"), "block", "row_start", "row_end")


_HEADER_SQL = "'[Hoja: ' || sheet || ' | Filas: ' || row_start || '–' || row_end || ' | Fuente: ' || 'libro.xlsx]' || chr(10)"


@query(
    "sheet_to_chunks",
    f"""WITH {SHEET_CTE}, p AS (SELECT *, concat_ws(' | ', CASE WHEN trim(parte) <> '' THEN 'parte: ' || trim(parte) END, CASE WHEN trim(marca) <> '' THEN 'marca: ' || trim(marca) END,
        CASE WHEN trim(estado) <> '' THEN 'estado: ' || trim(estado) END) AS line FROM blocks)
      SELECT sheet, (substring(sheet, 2)::INTEGER * 1000 + block)::INTEGER AS chunk_index, row_start, row_end, 'parte, marca, estado' AS columns,
        md5({_HEADER_SQL} || string_agg(line, chr(10) ORDER BY position)) AS text FROM p GROUP BY sheet, block, row_start, row_end""",
)
def sheet_chunks(spark, sf):
    """T6, P23."""
    rows = sheets.read_sheet(sheet_rows(spark, sf), SHEET_COLUMNS)
    chunks = sheets.sheet_to_chunks(rows, SHEET_COLUMNS, F.lit("libro.xlsx"), sheet_index=F.expr("substring(sheet, 2)").cast("int"))
    return chunks.select("sheet", "chunk_index", "row_start", "row_end", "columns", F.md5("text").alias("text"))


@query(
    "rows_to_markdown_table",
    f"""WITH {SHEET_CTE} SELECT sheet, block AS chunk_index, md5({_HEADER_SQL} || '| parte | marca | estado |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
        string_agg('| ' || trim(parte) || ' | ' || trim(marca) || ' | ' || trim(estado) || ' |', chr(10) ORDER BY position)) AS text FROM blocks GROUP BY sheet, block, row_start, row_end""",
)
def markdown_tables(spark, sf):
    """P22."""
    rows = sheets.read_sheet(sheet_rows(spark, sf), SHEET_COLUMNS)
    chunks = sheets.sheet_to_chunks(rows, SHEET_COLUMNS, F.lit("libro.xlsx"), markdown=True)
    return chunks.select("sheet", "chunk_index", F.md5("text").alias("text"))


@query(
    "word_table",
    """WITH r AS (SELECT l_orderkey, trim(l_returnflag) AS a, l_linestatus || ' x' AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
      SELECT l_orderkey, CASE WHEN count(*) = 1 THEN max(a || ' | ' || b) ELSE
        string_agg('| ' || a || ' | ' || b || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY i) END AS md FROM r GROUP BY l_orderkey""",
)
def word_tables(spark, sf):
    """P22, word variant: newlines in cells, and one-row tables."""
    li = table(spark, sf, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                   F.array(F.concat(F.lit(" "), "l_returnflag"), F.concat("l_linestatus", F.lit("\nx"))).alias("cells"))
    gathered = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return gathered.select("l_orderkey", sheets.word_table(F.transform("rows", lambda r: r["cells"])).alias("md"))


# ── Pages ─────────────────────────────────────────────────────────────────────

@query(
    "stitch_pages",
    f"""WITH {PAGES_CTE} SELECT doc_id, md5(string_agg('[Página ' || page_no || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no)) AS text, count(*)::INTEGER AS pages_processed
        FROM page_rows WHERE trim(text, ' ' || chr(10)) <> '' GROUP BY doc_id""",
)
def stitched(spark, sf):
    """S6."""
    return pages.stitch_pages(page_rows(spark, sf)).withColumn("text", F.md5("text"))


_QUALITY_CTE = f"""
{PAGES_CTE}, q AS (SELECT doc_id, count(*) AS n, avg(length(trim(text, ' ' || chr(10) || chr(9) || chr(13)))) AS a, count(*) FILTER (length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) >= 50) AS t, bool_or(has_fonts) AS f FROM page_rows GROUP BY 1),
c AS (SELECT *, CASE WHEN a >= 50 THEN 0.5 + 0.3 * least(a / 150, 1.0) + 0.2 * (t / n) ELSE 0.5 + 0.3 * (1.0 - least(a / 50, 1.0)) + 0.2 * (1.0 - t / n) END AS b FROM q),
quality AS (SELECT doc_id, a >= 50 AS is_native, round(a, 2) AS avg_chars_per_page, n AS total_pages, t AS pages_with_text, n - t AS pages_without_text,
   round(CASE WHEN f AND a >= 50 THEN least(b + 0.15, 1.0) WHEN NOT f AND a < 50 THEN least(b + 0.1, 1.0) ELSE b END, 3) AS confidence FROM c)
"""


def _quality(spark, sf):
    return pages.text_quality(page_rows(spark, sf))


@query(
    "text_quality",
    f"""WITH {_QUALITY_CTE} SELECT *, CASE WHEN is_native THEN 'native' ELSE 'scanned' END || CASE WHEN confidence >= 0.8 THEN '_high_confidence' ELSE '_low_confidence' END AS quality_label FROM quality""",
)
def quality(spark, sf):
    """A8, on the texts of the pages."""
    return _quality(spark, sf).select(
        "doc_id", "is_native", "avg_chars_per_page", "total_pages", "pages_with_text", "pages_without_text", "confidence", "quality_label")


@query(
    "classify_batch",
    f"""WITH {_QUALITY_CTE} SELECT d.doc_id, CASE WHEN is_native THEN 'native' ELSE 'scanned' END AS class FROM documents d LEFT JOIN quality q USING (doc_id)""",
)
def batch_classes(spark, sf):
    """Documents without pages count as scanned."""
    return pages.classify_batch(documents(spark, sf), _quality(spark, sf))


@query("pages_processed", "SELECT source, count(DISTINCT CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 END) AS pages_processed FROM documents GROUP BY source")
def page_counts(spark, sf):
    """A10."""
    docs = documents(spark, sf).select("source", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7).alias("page"))
    return pages.pages_processed(docs)


def _boxes(spark, sf):
    """Order lines as text boxes of a page per order, placed by quantity and price."""
    li = table(spark, sf, "lineitem")
    x, y = F.col("l_extendedprice") / 100, F.col("l_quantity") * 4
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(1000.0).alias("page_height"),
        F.array(F.array(x, y), F.array(x + 10, y), F.array(x + 10, y + 8), F.array(x, y + 8)).alias("bbox"),
        F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_partkey").cast("string")).alias("text"),
        (F.col("l_discount") * 10).alias("conf"), "l_linenumber", "l_partkey", "l_suppkey",
    )


@query(
    "ocr_confidence_filter",
    "SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount * 10 >= 0.4 AND l_returnflag <> 'N'",
)
def confident_boxes(spark, sf):
    """F6."""
    return pages.ocr_confidence_filter(_boxes(spark, sf)).select("doc_id", "l_linenumber", "l_partkey", "l_suppkey")


@query("ocr_line_groups")
def ocr_lines(spark, sf):
    """W8."""
    return pages.ocr_line_groups(_boxes(spark, sf))


@query(
    "docx_blocks_to_text",
    f"""WITH {LINES_CTE} SELECT source AS doc_id, (chunk_index // 2000)::INTEGER AS piece, md5(string_agg(CASE WHEN chunk_index % 4 = 0 THEN chr(10) || chr(10) || trim(text) || chr(10)
        WHEN chunk_index % 4 = 1 THEN '  - ' || trim(text) ELSE trim(text) END, chr(10) ORDER BY chunk_index)) AS text FROM lines WHERE trim(text) <> '' GROUP BY 1, 2""",
)
def docx_text(spark, sf):
    """Lines as blocks with styles."""
    style = F.when(F.col("chunk_index") % 4 == 0, "Heading 1").when(F.col("chunk_index") % 4 == 1, "List Bullet").otherwise("Normal")
    blocks_ = line_chunks(spark, sf).select(F.col("source").alias("doc_id"), F.col("chunk_index").alias("block_no"), style.alias("style"), "text")
    return pages.docx_blocks_to_text(blocks_).withColumn("text", F.md5("text"))


# ── Collections ───────────────────────────────────────────────────────────────

@query(
    "upsert_chunks",
    """WITH old AS (SELECT doc_id AS id, lang AS text, 0 AS v FROM documents), inc AS (SELECT l_partkey AS id, arg_max(l_returnflag || l_linenumber || '-' || l_orderkey, l_orderkey * 1000000 + l_suppkey * 1000 + l_linenumber * 100 + l_quantity) AS text, 1 AS v FROM lineitem GROUP BY 1)
      SELECT * FROM old WHERE id NOT IN (SELECT id FROM inc) UNION ALL SELECT * FROM inc""",
)
def upserted(spark, sf):
    """Many incoming rows per id; the last to arrive wins."""
    old = documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("text"), F.lit(0).alias("v"))
    arrival = F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")
    new = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"), F.concat("l_returnflag", "l_linenumber", F.lit("-"), "l_orderkey").alias("text"), F.lit(1).alias("v"), arrival.alias("_arrival"))
    return tables.upsert(old, new, arrival=F.col("_arrival")).select("id", "text", "v")


@query("append_chunks", "SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM labels")
def appended(spark, sf):
    """S8 without dedupe."""
    return tables.upsert(documents(spark, sf).select(F.col("doc_id").alias("id")), table(spark, sf, "labels").select(F.col("doc_id").alias("id")), dedup=False)


@query(
    "list_sources",
    "SELECT coalesce(s, 'unknown') AS source, count(*) AS chunks, (SELECT count(*) FROM documents) AS total_chunks FROM (SELECT CASE WHEN doc_id % 13 > 0 THEN source END AS s FROM documents) GROUP BY 1",
)
def sources(spark, sf):
    """S9."""
    return tables.list_sources(documents(spark, sf).select(F.when(F.col("doc_id") % 13 > 0, F.col("source")).alias("source")))


@query(
    "store_changes",
    """WITH piece AS (
        SELECT doc_id, c AS chunk_index, substr(text, 400 * c + 1, 400) AS text FROM documents, LATERAL (SELECT unnest(range((length(text) + 399) // 400)) AS c)
        WHERE doc_id % 7 <> 0 AND (doc_id % 3 <> 0 OR c < (length(text) + 799) // 800))
      SELECT doc_id, chunk_index, md5(CASE WHEN doc_id % 5 = 1 AND chunk_index = 0 THEN 'new' ELSE text END) AS text FROM piece""",
)
def stored_changes(spark, sf):
    """Chunks of all documents; a third get shorter, some are deleted, some first chunks rewritten, one batch after another."""
    path = scratch_path(spark, "store")
    docs = documents(spark, sf).select("doc_id", "text")
    cut = lambda df, share: df.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / (400 * share)) - 1)).alias("chunk_index")).where(
        "length(text) > 0").select("doc_id", "chunk_index", F.substring("text", F.col("chunk_index").cast("int") * 400 + 1, F.lit(400)).alias("text"))
    store.create_store(cut(docs, 1), path, key=["doc_id", "chunk_index"], owner=["doc_id"], buckets=16)
    store.add_changes(cut(docs.where("doc_id % 3 = 0"), 2), path, 0, whole_owner=True)
    store.add_changes(cut(docs.where("doc_id % 7 = 0"), 1).withColumn("gone", F.lit(True)), path, 1, deleted="gone")
    store.compact_store(spark, path)
    firsts = store.read_store(spark, path).where("doc_id % 5 = 1 and chunk_index = 0")
    store.add_changes(firsts.withColumn("text", F.lit("new")), path, 2)
    return store.read_store(spark, path).withColumn("text", F.md5("text"))


@query(
    "store_partial",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'renamed' ELSE c_name END AS title, c_nationkey AS owner FROM customer WHERE c_custkey % 9 <> 0""",
)
def stored_partial(spark, sf):
    """Titles set by key, other columns kept; D3, D5: rows deleted; each merge rewrites its buckets only."""
    path = scratch_path(spark, "store")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("owner"))
    store.create_store(rows, path, key=["id"], owner=["id"], buckets=8)
    store.merge_store(rows.where("id % 4 = 0").select("id", F.lit("renamed").alias("title")), path)
    store.merge_store(rows.where("id % 9 = 0").select("id", F.lit(True).alias("gone")), path, deleted="gone")
    store.vacuum_store(spark, path)
    return store.read_store(spark, path)


@query("deindex_document", "SELECT l_orderkey AS document_id, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def deindexed(spark, sf):
    """D5."""
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber", "l_partkey")
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    return tables.deindex(chunks, gone)


@query("metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3'")
def filtered(spark, sf):
    """an empty value is ignored."""
    return documents(spark, sf).filter(filters.metadata_filter({"lang": "en", "source": "src3", "text": ""})).select("doc_id")


@query("metadata_map_filter", "SELECT doc_id FROM documents WHERE (doc_id % 2 = 0 OR lang = 'en') AND (doc_id % 3 > 0 OR false)")
def map_filtered(spark, sf):
    """F1 per row, on maps."""
    docs = documents(spark, sf)
    meta = F.create_map(F.lit("lang"), F.col("lang"))
    wanted = F.create_map(F.lit("lang"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("en"), F.lit("absent"), F.when(F.col("doc_id") % 3 > 0, "").otherwise("x"))
    return docs.filter(filters.metadata_map_filter(meta, wanted)).select("doc_id")


@query(
    "union_augmented",
    "SELECT doc_id, false AS q, 0 AS parent FROM documents UNION ALL SELECT item_id, true, item_id FROM benchmark",
)
def augmented(spark, sf):
    """U-1, F11."""
    originals = documents(spark, sf).select("doc_id")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("is_augmented_question"), F.col("item_id").alias("parent"))
    everything = filters.union_augmented(originals, asked)
    first, second = filters.exclude_augmented(everything), filters.only_questions(everything)
    rows = first.unionByName(second)
    return rows.select("doc_id", F.coalesce("is_augmented_question", F.lit(False)).alias("q"), F.coalesce("parent", F.lit(0)).alias("parent"))


# ── Logs ──────────────────────────────────────────────────────────────────────

_SINCE = "WHERE created_at >= {now} - INTERVAL {days} DAY"


@query("last_n_days", f"WITH {LOGS_CTE} SELECT log_id FROM logs {_SINCE.format(now=_NOW, days=7)}")
def recent(spark, sf):
    """F7."""
    return filters.last_n_days(query_logs(spark, sf), 7, now()).select("log_id")


_QUALITY_SQL = """count(*) AS total_queries, round(coalesce(avg(reflection_score), 0), 3) AS avg_reflection_score, round(coalesce(avg(iteration_count), 0), 2) AS avg_iterations,
  round(count(*) FILTER (was_reformulated) * 100.0::DOUBLE / count(*), 1) AS reformulated_pct, round(count(*) FILTER (reflection_score < 0.6) * 100.0::DOUBLE / count(*), 1) AS low_score_pct"""


@query("quality_metrics", f"WITH {LOGS_CTE} SELECT {_QUALITY_SQL}, 7 AS period_days FROM logs {_SINCE.format(now=_NOW, days=7)} AND reflection_score IS NOT NULL")
def quality_report(spark, sf):
    """A1."""
    return logs.quality_metrics(query_logs(spark, sf), now(), 7)


@query(
    "top_queries",
    f"""WITH {LOGS_CTE} SELECT substring(query_text, 1, 100) AS query, frequency, avg_score FROM (
        SELECT query_text, query_hash, count(*) AS frequency, round(coalesce(avg(reflection_score), 0), 3) AS avg_score FROM logs {_SINCE.format(now=_NOW, days=30)}
        GROUP BY 1, 2 ORDER BY frequency DESC, query_hash LIMIT 10)""",
)
def frequent(spark, sf):
    """A2, P16."""
    return logs.top_queries(query_logs(spark, sf), now())


@query(
    "strategy_performance",
    f"""WITH {LOGS_CTE} SELECT retrieval_strategy AS strategy, count(*) AS total_queries, round(avg(reflection_score), 3) AS avg_score, round(avg(total_time_ms), 0) AS avg_time_ms,
        round(avg(iteration_count), 2) AS avg_iterations FROM logs WHERE retrieval_strategy IS NOT NULL AND reflection_score IS NOT NULL GROUP BY 1""",
)
def performance(spark, sf):
    """A3."""
    return logs.strategy_performance(query_logs(spark, sf))


@query("count_by", "SELECT user_identifier, count(*) AS n FROM (SELECT c_mktsegment AS user_identifier, c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0) GROUP BY 1")
def counted(spark, sf):
    """Active sessions per user."""
    return logs.count_by(filters.active_only(sessions(spark, sf)), "user_identifier")


@query(
    "corpus_summary",
    """WITH d AS (SELECT o_orderstatus AS document_type, o_orderpriority AS loader_used, o_custkey % 10 AS chunk_count FROM orders)
      SELECT 'total' AS dimension, '' AS value, count(*) AS documents, sum(chunk_count)::BIGINT AS chunks FROM d
      UNION ALL SELECT 'document_type', document_type, count(*), sum(chunk_count)::BIGINT FROM d GROUP BY 2
      UNION ALL SELECT 'loader_used', loader_used, count(*), sum(chunk_count)::BIGINT FROM d GROUP BY 2""",
)
def corpus(spark, sf):
    """A5."""
    docs = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("document_type"), F.col("o_orderpriority").alias("loader_used"), (F.col("o_custkey") % 10).alias("chunk_count"))
    return logs.corpus_summary(docs)


@query(
    "batch_summary",
    """SELECT count(*) AS total, count(*) FILTER (n_chars > 100) AS successful, count(*) FILTER (n_chars <= 100) AS failed,
        (sum(n_chars // 1100) FILTER (n_chars > 100))::BIGINT AS total_chunks, NULL::VARCHAR AS error FROM documents""",
)
def batch(spark, sf):
    """A11."""
    return logs.batch_summary(documents(spark, sf).select((F.col("n_chars") > 100).alias("success"), F.floor(F.col("n_chars") / 1100).alias("chunk_count")))


@query(
    "find_similar_query",
    f"""WITH {LOGS_CTE}, newest AS (SELECT query_hash, max(struct_pack(c := created_at, l := log_id, s := reflection_score)) AS m FROM logs WHERE reflection_score >= 0.8 GROUP BY 1)
      SELECT q.log_id AS query_id, q.query_hash, m.l AS log_id, m.s AS log_score FROM logs q LEFT JOIN newest USING (query_hash)""",
)
def similar(spark, sf):
    """Every logged query looks for a good earlier or later answer to the same text."""
    asked = query_logs(spark, sf).select(F.col("log_id").alias("query_id"), "query_text")
    return logs.find_similar_query(asked, query_logs(spark, sf)).select("query_id", "query_hash", "log_id", "log_score")


@query(
    "query_hash",
    f"WITH {LOGS_CTE} SELECT log_id, query_hash, active_query IS NOT NULL AND trim(active_query) <> trim(query_text) AS was_reformulated FROM logs",
)
def hashes(spark, sf):
    """P16, P17."""
    return query_logs(spark, sf).select("log_id", metadata.query_hash("query_text").alias("query_hash"), metadata.was_reformulated("query_text", "active_query").alias("was_reformulated"))


@query(
    "node_summary",
    """WITH e AS (SELECT user_id AS run, event_type AS node, epoch_ms(ts) AS start_ms, epoch_ms(ts) + floor(value)::BIGINT AS end_ms, event_id % 5 AS docs FROM events),
      n AS (SELECT run, node, min(start_ms) AS first_ms, sum(end_ms - start_ms)::BIGINT AS ms, sum(docs)::BIGINT AS docs FROM e GROUP BY 1, 2)
      SELECT run, sum(ms)::BIGINT AS total_ms, '=== Metrics ===' || chr(10) || string_agg('  ' || node || ': ' || ms || 'ms | docs: ' || docs, chr(10) ORDER BY first_ms, node) || chr(10) || '  TOTAL: ' || sum(ms)::BIGINT || 'ms' AS summary FROM n GROUP BY run""",
)
def nodes(spark, sf):
    """Users as runs, event types as nodes."""
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("node"), start.alias("start_ms"),
        (start + F.floor("value")).alias("end_ms"), (F.col("event_id") % 5).alias("docs"))
    return logs.node_summary(rows)


@query(
    "rolling_quality",
    f"""WITH {LOGS_CTE}, w AS (SELECT logs.*, unnest(generate_series(date_trunc('day', created_at) - INTERVAL 6 DAY, date_trunc('day', created_at), INTERVAL 1 DAY)) AS window_start FROM logs WHERE reflection_score IS NOT NULL)
      SELECT strftime(window_start, '%Y-%m-%d') AS day, {_QUALITY_SQL} FROM w GROUP BY window_start""",
)
def rolling(spark, sf):
    """ST4, batch twin: seven days, moved by one."""
    from acervo.streaming.jobs import rolling_quality

    report_ = rolling_quality(query_logs(spark, sf))
    return report_.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start", "window_end")


# ── Sessions ──────────────────────────────────────────────────────────────────

@query("not_deleted", f"WITH {SESSIONS_CTE} SELECT session_id, is_active FROM sessions WHERE deleted_at IS NULL")
def kept(spark, sf):
    """F4."""
    return filters.not_deleted(sessions(spark, sf)).select("session_id", "is_active")


@query("last_n_messages", "SELECT conv_id AS session_id, turn AS seq, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_messages(spark, sf):
    """J13."""
    return se.last_n_messages(messages(spark, sf), 3).select("session_id", "seq", "role")


@query(
    "session_with_messages",
    f"WITH {SESSIONS_CTE} SELECT session_id, title, turn AS seq, role, md5(text) AS content FROM sessions LEFT JOIN conversations ON session_id = conv_id WHERE deleted_at IS NULL",
)
def with_messages(spark, sf):
    """J14."""
    return se.session_with_messages(sessions(spark, sf), messages(spark, sf)).select("session_id", "title", "seq", "role", F.md5("content").alias("content"))


@query("history", "SELECT conv_id AS session_id, turn AS seq, role, md5(text) AS content FROM conversations")
def history(spark, sf):
    """L2: all messages in a total order."""
    return se.history(messages(spark, sf), "messages").select("session_id", "seq", "role", F.md5("content").alias("content"))


@query("history_logs", "SELECT user_id AS session_id, event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events")
def history_logs(spark, sf):
    """L2: query logs, the newest first."""
    logs = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return se.history(logs, "query_logs").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("history_chunks", f"WITH {LINES_CTE} SELECT source AS document_id, chunk_index, md5(text) AS text FROM lines")
def history_chunks(spark, sf):
    """L2: chunks of each document by index."""
    chunks = line_chunks(spark, sf).select(F.col("source").alias("document_id"), "chunk_index", F.md5("text").alias("text"))
    return se.history(chunks, "chunks")


@query("history_profiles", "SELECT c_name AS user_identifier, c_mktsegment AS preferred_profile FROM customer")
def history_profiles(spark, sf):
    """L2: profiles by user."""
    return se.history(_profiles(spark, sf), "user_profiles").select("user_identifier", "preferred_profile")


@query(
    "sync_memory",
    """WITH m AS (SELECT conv_id AS session_id, role AS key, arg_max(text, turn) AS value, max(turn) AS seq FROM conversations GROUP BY ALL),
      s AS (SELECT conv_id AS session_id, 'turn ' || turn % 3 AS key, arg_max(text, turn) AS value, max(turn) AS seq FROM conversations WHERE conv_id % 3 = 0 GROUP BY ALL)
      SELECT session_id, key, md5(value) AS value, seq FROM (SELECT * FROM m WHERE session_id NOT IN (SELECT session_id FROM s) UNION ALL SELECT * FROM s)""",
)
def synced_memory(spark, sf):
    """ST2: every third session is replaced as a whole."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "role", "text", F.col("turn").alias("seq"))
    memory = rows.groupBy("session_id", F.col("role").alias("key")).agg(F.max_by("text", "seq").alias("value"), F.max("seq").alias("seq"))
    synced = rows.filter("session_id % 3 = 0").select("session_id", F.concat(F.lit("turn "), F.col("seq") % 3).alias("key"), F.col("text").alias("value"), "seq")
    return se.sync_memory(memory, synced).withColumn("value", F.md5("value"))


@query(
    "paginate",
    f"""WITH {SESSIONS_CTE}, s AS (SELECT * FROM sessions WHERE deleted_at IS NULL AND is_active)
      SELECT session_id, title, (SELECT count(*) FROM s) AS total, 60 < (SELECT count(*) FROM s) AS has_more FROM (SELECT * FROM s ORDER BY updated_at DESC, session_id LIMIT 20 OFFSET 40)""",
)
def page_of_sessions(spark, sf):
    """L1."""
    rows = filters.active_only(sessions(spark, sf))
    return filters.paginate(rows, [F.col("updated_at").desc(), F.col("session_id")], 20, 40).select("session_id", "title", "total", "has_more")


@query(
    "conversation_tokens",
    "SELECT conv_id AS session_id, count(*) AS message_count, sum(length(text))::BIGINT // 4 AS estimated_tokens, sum(length(text)) // 4 > 900 AS needs_compression FROM conversations GROUP BY 1",
)
def token_counts(spark, sf):
    """A13, with a threshold that the data reach."""
    return se.conversation_tokens(messages(spark, sf), 900)


@query(
    "keep_last_n",
    """SELECT conv_id AS session_id, turn AS seq, coalesce(t > 500 AND n > 4 AND r > 4, false) AS to_summarise FROM (
        SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) // 4 AS t, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)""",
)
def kept_messages(spark, sf):
    """W6."""
    return se.keep_last_n(messages(spark, sf), 4, 500).select("session_id", "seq", "to_summarise")


@query(
    "format_messages",
    """SELECT conv_id AS session_id, (turn // 1000)::INTEGER AS piece, md5(string_agg(upper(role) || ': ' || CASE WHEN length(text) > 800 THEN substring(text, 1, 800) || '... [truncado]' ELSE text END, chr(10) ORDER BY turn)) AS text
       FROM conversations GROUP BY 1, 2""",
)
def formatted(spark, sf):
    """P40."""
    return se.format_messages(messages(spark, sf)).withColumn("text", F.md5("text"))


@query(
    "session_counters",
    """SELECT user_id AS session_id, event_id AS change_id, (sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w)::BIGINT AS total_messages,
        (sum(event_id % 3) OVER w)::BIGINT AS total_documents FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def counters(spark, sf):
    """W9."""
    changes = table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("change_id"),
        (F.col("event_type") == "click").cast("long").alias("messages"), (F.col("event_id") % 3).alias("documents"))
    return se.session_counters(changes).select("session_id", "change_id", "total_messages", "total_documents")


@query("session_memory", MEMORY_SQL)
def memory(spark, sf):
    """ST2, batch twin."""
    return se.session_memory(memory_operations(spark, sf))


@query("context_keys", f"WITH m AS ({MEMORY_SQL}) SELECT session_id, key, count(*) OVER (PARTITION BY session_id) AS count FROM m")
def keys(spark, sf):
    """ST2: keys that are set, with their number."""
    return se.context_keys(se.session_memory(memory_operations(spark, sf)))


@query(
    "referential_delete",
    """WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
      SELECT 'cascade' AS rule, l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone) GROUP BY 2
      UNION ALL SELECT 'set null', CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM gone) THEN l_orderkey END, count(*) FROM lineitem GROUP BY 2""",
)
def referential(spark, sf):
    """J16."""
    li = table(spark, sf, "lineitem").select("l_orderkey")
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    cascade = se.delete_cascade(li, gone, "l_orderkey").withColumn("rule", F.lit("cascade"))
    nulled = se.delete_set_null(li, gone, "l_orderkey").withColumn("rule", F.lit("set null"))
    return cascade.unionByName(nulled).groupBy("rule", "l_orderkey").agg(F.count("*").alias("n"))


@query(
    "insert_rows",
    f"""WITH {SESSIONS_CTE} SELECT session_id, title, is_active, total_messages FROM sessions
      UNION ALL SELECT 1000000 + o_orderkey, o_orderpriority, true, 0 FROM orders""",
)
def inserted(spark, sf):
    """New sessions with defaults."""
    new = table(spark, sf, "orders").select((F.lit(1000000) + F.col("o_orderkey")).alias("session_id"), F.col("o_orderpriority").alias("title"))
    defaults = {"is_active": F.lit(True), "total_messages": F.lit(0), "total_documents": F.lit(0), "updated_at": now()}
    return se.insert_rows(sessions(spark, sf), new, defaults).select("session_id", "title", "is_active", "total_messages")


@query(
    "update_title",
    f"""WITH {SESSIONS_CTE}, t AS (SELECT doc_id AS session_id, substring(text, 1, 500) AS new_title FROM documents)
      SELECT session_id, md5(CASE WHEN new_title IS NOT NULL AND deleted_at IS NULL THEN new_title ELSE title END) AS title,
        strftime(CASE WHEN new_title IS NOT NULL AND deleted_at IS NULL THEN {_NOW} ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM sessions LEFT JOIN t USING (session_id)""",
)
def retitled(spark, sf):
    """D2."""
    titles = documents(spark, sf).select(F.col("doc_id").alias("session_id"), F.col("text").alias("new_title"))
    rows = se.update_title(sessions(spark, sf), titles, now())
    return rows.select("session_id", F.md5("title").alias("title"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query(
    "increment",
    f"""WITH {SESSIONS_CTE}, d AS (SELECT user_id AS session_id, count(*) AS m, sum(event_id % 2)::BIGINT AS d FROM events GROUP BY 1)
      SELECT session_id, total_messages + coalesce(m, 0) AS total_messages, total_documents + coalesce(d, 0) AS total_documents FROM sessions LEFT JOIN d USING (session_id)""",
)
def incremented(spark, sf):
    """Many deltas per session in one pass."""
    deltas = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.lit(1).alias("messages"), (F.col("event_id") % 2).alias("documents"))
    return se.increment(sessions(spark, sf), deltas, now()).select("session_id", "total_messages", "total_documents")


@query(
    "soft_delete",
    f"""WITH {SESSIONS_CTE}, g AS (SELECT DISTINCT user_id AS session_id FROM events WHERE event_type = 'error')
      SELECT session_id, g.session_id IS NOT NULL AND deleted_at IS NULL AS deleted_now, is_active AND NOT (g.session_id IS NOT NULL AND deleted_at IS NULL) AS is_active,
        strftime(CASE WHEN g.session_id IS NOT NULL AND deleted_at IS NULL THEN {_NOW} ELSE deleted_at END, '%Y-%m-%d') AS deleted_at FROM sessions LEFT JOIN g USING (session_id)""",
)
def deleted(spark, sf):
    """D3."""
    ids = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("session_id"))
    rows = se.soft_delete(sessions(spark, sf), ids, now())
    return rows.select("session_id", "deleted_now", "is_active", F.date_format("deleted_at", "yyyy-MM-dd").alias("deleted_at"))


def _profiles(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("user_identifier"), F.col("c_mktsegment").alias("preferred_profile"),
        F.lit(None).cast("string").alias("custom_system_prompt"), (F.col("c_custkey") % 5 != 0).alias("is_active"))


_PROFILES_CTE = """
profiles AS (SELECT c_name AS user_identifier, c_mktsegment AS preferred_profile, c_custkey % 5 <> 0 AS is_active FROM customer),
last AS (SELECT user_identifier, arg_max(o_orderpriority, o_orderkey) AS preferred_profile, true AS is_active FROM (
    SELECT CASE WHEN o_custkey % 2 = 0 THEN c_name ELSE 'new ' || c_name END AS user_identifier, o_orderpriority, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1)
"""


@query("upsert_profiles", f"WITH {_PROFILES_CTE} SELECT * FROM last UNION ALL SELECT * FROM profiles WHERE user_identifier NOT IN (SELECT user_identifier FROM last)")
def upserted_profiles(spark, sf):
    """Orders as profile changes, the last one per user counts; half of the users are new."""
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    who = F.when(F.col("o_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("new "), F.col("c_name")))
    changes = table(spark, sf, "orders").join(names, "o_custkey").select(
        who.alias("user_identifier"), F.col("o_orderpriority").alias("preferred_profile"), F.lit(None).cast("string").alias("custom_system_prompt"), F.col("o_orderkey").alias("seq"))
    return se.upsert_profiles(_profiles(spark, sf), changes).select("user_identifier", "preferred_profile", "is_active")


@query(
    "preferred_or_default",
    f"""WITH {_PROFILES_CTE}, off AS (SELECT DISTINCT c_name AS u FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P')
      SELECT c_name AS user_identifier, CASE WHEN is_active AND c_name NOT IN (SELECT u FROM off) THEN preferred_profile ELSE 'general-dev' END AS preferred_profile
      FROM customer JOIN profiles ON c_name = user_identifier""",
)
def preferred(spark, sf):
    """Inactive and deactivated users get the default."""
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("user_identifier"))
    off = table(spark, sf, "orders").filter("o_orderstatus = 'P'").join(names, "o_custkey")
    profiles = se.deactivate_profiles(_profiles(spark, sf), off)
    return se.preferred_or_default(names.select("user_identifier"), profiles)


# ── Jobs ──────────────────────────────────────────────────────────────────────

@query("ingest")
def ingested(spark, sf):
    """One result row per document; planted blanks fail."""
    docs = documents(spark, sf).select("doc_id", "source", F.when(F.col("doc_id") % 50 == 7, " \n").otherwise(F.col("text")).alias("text"))
    _, results = ingest(docs)
    return results.select("doc_id", "success", "chunk_count", "document_type", F.size("errors").alias("errors"))


@query("augment_and_index", f"WITH {LINES_CTE} SELECT count(*) AS original_chunks, 2 * count(*) AS questions_added, 3 * count(*) AS total_indexed FROM lines")
def augmented_index(spark, sf):
    """Counts of originals, questions and the sum."""
    chunks = line_chunks(spark, sf).withColumn("doc_id", F.col("source")).withColumn("id", F.concat_ws("::", "source", "chunk_index"))
    _, counts = augment_and_index(chunks, chunks.limit(0), question_model)
    return counts


def _hybrid(spark, sf, k=5):
    index = build_index(documents(spark, sf), pattern=P)
    return hybrid_search(both_queries(spark, sf), k, vectors=vectors(spark, sf), index=index, pattern=P)


def _ranked_documents(spark, sf):
    body = documents(spark, sf).select("doc_id", "source", F.lit("").alias("article_number"), F.lit("").alias("section_number"),
                                       F.col("doc_id").alias("chunk_index"), F.lit("").alias("page"), "text")
    return _hybrid(spark, sf).join(body, "doc_id")


def answer_model(prompts: list[str]) -> list[str]:
    """First line of the context after the question; a stand-in for a chat model."""
    return [p.split("]\n", 1)[-1].split("\n")[0] for p in prompts]


@query("answer_batch")
def answered(spark, sf):
    """Two passes, one pass or none by score."""
    asked = both_queries(spark, sf).select(
        "query_id", "text", ((F.col("query_id") % 11) / 10).alias("score"), F.lit(0).alias("iteration"), F.lit(2).alias("max_iterations"))
    rows = answer_batch(asked, _ranked_documents(spark, sf), answer_model)
    return rows.select("query_id", "mode", "n_docs", F.md5("draft").alias("draft"), F.size("sources").alias("sources"), "verdict.is_valid", "reflection.route")


@query("answer_until_valid")
def answered_until_valid(spark, sf):
    """Answers that the reflection sends back are searched and written again, twice at most."""
    asked = both_queries(spark, sf).withColumn("score", (F.col("query_id") % 11) / 10)
    found = cut_lineage(_ranked_documents(spark, sf))
    shorter = lambda rows: rows.withColumn("text", F.substring_index("text", " ", 12))
    rows = answer_until_valid(asked, lambda q: found.join(q.select("query_id"), "query_id", "left_semi"), answer_model, shorter, k=5)
    return rows.select("query_id", "mode", "n_docs", F.md5("answer").alias("answer"), "score", "iteration_count")


_COMPLEXITY_SQL = SQL["assess_complexity"]


@query(
    "plan_query",
    f"""WITH c AS ({_COMPLEXITY_SQL}), p AS (SELECT conv_id, turn, text, complexity, complexity <> 'simple' AS hard, length(text) % 5 = 0 AS fails FROM c JOIN conversations USING (conv_id, turn))
      SELECT conv_id || '/' || turn AS query_id, complexity, CASE WHEN hard AND NOT fails THEN 'a|b|c' ELSE text END AS sub_queries,
        CASE WHEN hard AND fails THEN 'full' ELSE 'hybrid' END AS strategy, hard AND NOT fails AS use_planner FROM p""",
)
def planned(spark, sf):
    """Hard messages get up to three sub-queries from the model; some calls fail."""
    def model(prompts):
        if len(prompts[0]) % 5 == 0:
            raise ValueError("refused")
        return ['```json {"sub_queries": ["a", "b", "c", "d"], "strategy": "hybrid"} ```' for _ in prompts]

    c = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), "text")
    rows = plan_queries(c, model)
    return rows.select("query_id", "complexity", F.array_join("sub_queries", "|").alias("sub_queries"), "strategy", "use_planner")


@query(
    "corrective_loop",
    f"""WITH {VECTOR_CTE}, r AS (SELECT vec_id * 10 + n AS query_id, list_transform(embedding, lambda x: (x * pow(0.5, n))::FLOAT) AS embedding FROM embeddings CROSS JOIN range(3) t(n)),
      {knn_cte('k', 'r', 'vd', 5)},
      s AS (SELECT query_id // 10 AS query_id, query_id % 10 AS n, greatest(0.0, 1.9 - distance) AS score FROM k WHERE rank = 5),
      done AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS first FROM s WHERE score > 0.7 OR n = 2)
      SELECT query_id, n AS retries, CASE WHEN score > 0.7 THEN 'correct' WHEN score >= 0.3 THEN 'ambiguous' ELSE 'incorrect' END AS quality, round(score, 4) AS score, 5 AS hits FROM done WHERE first = 1""",
)
def corrected(spark, sf):
    """Nearest neighbours graded by distance; the rest is searched again with the nearest vector, at most twice."""
    docs = vectors(spark, sf)

    def search(asked):
        return knn(asked, docs, 5)

    def grade(asked, hits):
        wide = hits.filter("rank = 5").select("query_id", F.greatest(F.lit(0.0), 1.9 - F.col("distance")).alias("score"))
        return wide

    def rewrite(asked):
        return asked.withColumn("embedding", F.transform("embedding", lambda x: (x * 0.5).cast("float")))

    rows, hits = corrective_loop(vector_queries(spark, sf), search, grade, rewrite)
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    return rows.join(found, "query_id").select("query_id", "retries", "quality", F.round("score", 4).alias("score"), "hits")


