"""Inputs that the queries derive from the given tables, once in Spark and once in SQL.

Each pair builds the same rows.  ``*_CTE`` strings are bodies of SQL WITH clauses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.metadata import query_hash
from acervo.functions.tokens import PLAIN_TOKEN_PATTERN, STOPWORDS
from acervo.session import prepare

REF_TS = "2024-01-31"
P = PLAIN_TOKEN_PATTERN
WIDE = {"documents", "pages", "conversations", "lineitem", "events", "orders"}


def table(spark: SparkSession, sf_dir: str, name: str, deal: bool = True) -> DataFrame:
    """A given table; one that is a single file, which one task would scan, is dealt to all cores.

    Without ``deal`` it is read as it lies, for queries that shuffle its rows at once.
    """
    df = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    alone = deal and name in WIDE and len(df.inputFiles()) == 1
    return df.repartition(spark.sparkContext.defaultParallelism) if alone else df


def now() -> Column:
    return F.to_timestamp(F.lit(f"{REF_TS} 00:00:00"))


# ── Keyword search ────────────────────────────────────────────────────────────

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def sql_tokens(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '{P}'), "
        f"lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"
    )


BM25_CTE = f"""
docs_tok AS (SELECT doc_id, lang, source, {sql_tokens('text')} AS toks FROM documents),
post AS (SELECT doc_id, lang, source, dl, term, count(*) AS tf
         FROM (SELECT doc_id, lang, source, len(toks) AS dl, unnest(toks) AS term FROM docs_tok) GROUP BY ALL),
size AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM docs_tok),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM post GROUP BY term),
raw AS (SELECT term, df, ctf, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, size),
idf AS (SELECT term, df, ctf, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf
       FROM (SELECT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL)
"""


def bm25_ranked_cte(name: str, k: int, where: str = "true") -> str:
    return f"""
{name}_s AS (SELECT query_id, doc_id,
    round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS s
  FROM post JOIN idf USING (term) JOIN qt USING (term) CROSS JOIN size WHERE {where} GROUP BY ALL HAVING s > 0),
{name} AS (SELECT query_id, doc_id, round(s, 4) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {k})
"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ── Vectors ───────────────────────────────────────────────────────────────────

def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def both_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts with the vector of the same number."""
    return text_queries(spark, sf).join(vector_queries(spark, sf).drop("label"), "query_id")


def sql_l2sq(a: str, b: str) -> str:
    return f"round(pow(list_distance({a}::DOUBLE[], {b}::DOUBLE[]), 2), 9)"


def knn_cte(name: str, queries: str, docs: str, k: int, where: str = "true") -> str:
    """``queries`` (query_id, embedding, …) against ``docs`` (doc_id, embedding, …)."""
    return f"""
{name} AS (SELECT * FROM (
    SELECT query_id, doc_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank
    FROM (SELECT q.query_id, d.doc_id, {sql_l2sq('q.embedding', 'd.embedding')} AS distance
          FROM {queries} q CROSS JOIN {docs} d WHERE {where})) WHERE rank <= {k})
"""


VECTOR_CTE = """
vq AS (SELECT vec_id AS query_id, embedding, label FROM embeddings),
vd AS (SELECT vec_id AS doc_id, embedding, label FROM embeddings),
bq AS (SELECT item_id AS query_id, b.text, e.embedding FROM benchmark b JOIN embeddings e ON item_id = vec_id)
"""


def _with_vector(rows: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Every row of ``rows`` (doc_id, …) with one of the vectors: numbers beyond the last vector begin again at the first."""
    given = vectors(spark, sf).withColumnRenamed("doc_id", "vec_id")
    return rows.withColumn("vec_id", F.col("doc_id") % given.agg(F.count("*")).scalar()).join(given, "vec_id").drop("vec_id")


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as chunks with a vector."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return _with_vector(docs, spark, sf).select(
        "doc_id", "embedding", "source",
        F.floor(F.col("doc_id") / 20).alias("chunk_index"),
        "text",
        F.col("label").cast("string").alias("article_number"),
        (F.col("doc_id") % 7).cast("string").alias("page"),
    )


def summary_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All labelled documents as summaries with a vector: some know their article, some only their page, some neither."""
    return _with_vector(table(spark, sf, "labels"), spark, sf).select(
        "doc_id", "embedding",
        F.when(F.col("quality") == 1, F.col("label").cast("string")).otherwise("").alias("article_number"),
        F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 7).cast("string")).otherwise("").alias("page"),
    )


CHUNK_CTE = """
vc AS (SELECT d.doc_id, e.embedding, d.source, d.doc_id // 20 AS chunk_index, d.text,
              e.label::VARCHAR AS article_number, (d.doc_id % 7)::VARCHAR AS page
       FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)),
vs AS (SELECT l.doc_id, e.embedding,
              CASE WHEN quality = 1 THEN e.label::VARCHAR ELSE '' END AS article_number,
              CASE WHEN l.doc_id % 3 > 0 THEN (l.doc_id % 7)::VARCHAR ELSE '' END AS page
       FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id % (SELECT count(*) FROM embeddings))
"""


# ── Texts ─────────────────────────────────────────────────────────────────────

def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the documents as chunks (source, chunk_index, text)."""
    docs = table(spark, sf, "documents")
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"),
        F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"),
    ).withColumn("chunk_index", F.col("chunk_index").cast("long"))


LINES_CTE = r"""
lines AS (SELECT 'd' || doc_id AS source, unnest(range(len(parts))) AS chunk_index, unnest(parts) AS text
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
"""

# Marks planted in the documents, so that every cleaning rule has work: (found, put).
_NOISE = [
    (". ", ".  \r\n\r\n\r\n\r\n- 12 -\r\n"),
    (" the ", " the-\r\nl "),
    (" de ", " de-\nl  "),
    (" and ", " | aaaaaand\x07 "),
    (" of ", "\n###   of\n```python\nof CLÁUSULA12 "),
]


def noisy(text: Column | str = "text") -> Column:
    result = F.col(text) if isinstance(text, str) else text
    for found, put in _NOISE:
        result = F.replace(result, F.lit(found), F.lit(put))
    return result


def _sql_literal(value: str) -> str:
    parts = []
    for piece in value.replace("\r", "\0r\0").replace("\n", "\0n\0").replace("\x07", "\0a\0").split("\0"):
        parts.append({"r": "chr(13)", "n": "chr(10)", "a": "chr(7)"}.get(piece) if piece in ("r", "n", "a") else f"'{piece}'")
    return "(" + " || ".join(parts) + ")"


def sql_noisy(text: str = "text") -> str:
    result = text
    for found, put in _NOISE:
        result = f"replace({result}, {_sql_literal(found)}, {_sql_literal(put)})"
    return result


def noisy_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", noisy().alias("text"))


def legal_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines written out as chunks of a legal text."""
    li = table(spark, sf, "lineitem")
    num = lambda c: F.col(c).cast("string")
    text = F.concat(
        F.lit("[Página "), num("l_linenumber"), F.lit("]\nCAPÍTULO "),
        F.when(F.col("l_linestatus") == "O", "IV – GENERALIDADES").otherwise("2"),
        F.lit("\nSECCIÓN "), num("l_suppkey"), F.lit("\nArtículo "),
        F.when(F.col("l_suppkey") % 10 == 0, "único").otherwise(F.concat(num("l_orderkey"), F.lit("."), num("l_linenumber"))),
        F.when(F.col("l_returnflag") == "R", "° ").otherwise(". "),
        F.lit("Entrega del pedido "), num("l_partkey"), F.lit(" en plazo. "),
        F.when(F.col("l_linenumber") > 3, F.concat(F.lit("PARÁGRAFO "), num("l_linenumber"))).when(
            F.col("l_linenumber") > 1, "Parágrafo.").otherwise(""),
        F.when(F.col("l_returnflag") == "A", "\nSegún el Decreto número 1072 del 2015 y la Ley 9 de 1999.")
        .when(F.col("l_returnflag") == "N", "\nSegún la Ley 1562 de 2012.").otherwise(""),
    )
    return li.select(
        F.concat(F.lit("pedido "), num("l_orderkey"), F.lit("/a.pdf")).alias("source"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("long").alias("chunk_index"),
        F.col("l_partkey").alias("part_id"),
        text.alias("text"),
    )


LEGAL_CTE = """
legal AS (SELECT 'pedido ' || l_orderkey || '/a.pdf' AS source, l_orderkey AS order_id,
    l_linenumber::BIGINT AS chunk_index, l_partkey AS part_id,
    '[Página ' || l_linenumber || ']' || chr(10) || 'CAPÍTULO ' ||
    CASE WHEN l_linestatus = 'O' THEN 'IV – GENERALIDADES' ELSE '2' END ||
    chr(10) || 'SECCIÓN ' || l_suppkey || chr(10) || 'Artículo ' ||
    CASE WHEN l_suppkey % 10 = 0 THEN 'único' ELSE l_orderkey || '.' || l_linenumber END ||
    CASE WHEN l_returnflag = 'R' THEN '° ' ELSE '. ' END ||
    'Entrega del pedido ' || l_partkey || ' en plazo. ' ||
    CASE WHEN l_linenumber > 3 THEN 'PARÁGRAFO ' || l_linenumber WHEN l_linenumber > 1 THEN 'Parágrafo.' ELSE '' END ||
    CASE WHEN l_returnflag = 'A' THEN chr(10) || 'Según el Decreto número 1072 del 2015 y la Ley 9 de 1999.'
         WHEN l_returnflag = 'N' THEN chr(10) || 'Según la Ley 1562 de 2012.' ELSE '' END AS text
  FROM lineitem)
"""


# ── Sheets and pages ──────────────────────────────────────────────────────────

SHEET_COLUMNS = ["parte", "marca", "estado"]


def sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a sheet per supplier, with empty cells and empty rows."""
    return table(spark, sf, "lineitem", deal=False).select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sheet"),
        (F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).alias("row_no"),
        F.when(F.col("l_quantity") > 10, F.col("l_partkey")).alias("parte"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("marca"),
        F.when(F.col("l_linestatus") != "O", F.concat(F.lit(" "), F.col("l_linestatus"))).alias("estado"),
    )


SHEET_CTE = """
cells AS (SELECT 'S' || l_suppkey AS sheet,
    l_orderkey * 1000000000 + l_partkey * 1000 + l_linenumber * 100 + l_quantity::BIGINT AS row_no,
    coalesce(CASE WHEN l_quantity > 10 THEN l_partkey END::VARCHAR, '') AS parte,
    coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, '') AS marca,
    coalesce(CASE WHEN l_linestatus <> 'O' THEN ' ' || l_linestatus END, '') AS estado FROM lineitem),
sheet AS (SELECT * FROM cells WHERE parte || marca || estado <> ''),
blocks AS (SELECT *, ((position - 1) // 20)::INTEGER AS block, ((position - 1) // 20 * 20 + 1)::INTEGER AS row_start,
              least((position - 1) // 20 * 20 + 20, n)::INTEGER AS row_end
           FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row_no) AS position,
                        count(*) OVER (PARTITION BY sheet) AS n FROM sheet))
"""

PAGES_PER_DOC = 20


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as pages of documents of twenty; every seventh page is blank."""
    body = F.regexp_replace("html", "<[^>]*>", " ")
    return table(spark, sf, "pages").select(
        F.floor(F.col("page_id") / PAGES_PER_DOC).alias("doc_id"),
        (F.col("page_id") % PAGES_PER_DOC + 1).alias("page_no"),
        F.when(F.col("page_id") % 7 == 0, "  \n").otherwise(body).alias("text"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"),
        F.col("url").contains("ref=").alias("has_fonts"),
    )


PAGES_CTE = """
page_rows AS (SELECT page_id // 20 AS doc_id, page_id % 20 + 1 AS page_no,
    CASE WHEN page_id % 7 = 0 THEN '  ' || chr(10) ELSE regexp_replace(html, '<[^>]*>', ' ', 'g') END AS text,
    regexp_extract(html, '<title>([^<]*)', 1) AS title, contains(url, 'ref=') AS has_fonts FROM pages)
"""


# ── Logs and sessions ─────────────────────────────────────────────────────────

def query_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as query logs."""
    return logs_of(table(spark, sf, "events"))


def logs_of(ev: DataFrame) -> DataFrame:
    text = F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" "), F.col("props"))
    return ev.select(
        F.col("event_id").alias("log_id"),
        F.col("user_id").alias("session_id"),
        text.alias("query_text"),
        query_hash(text).alias("query_hash"),
        F.when(F.col("event_id") % 3 == 0, F.lower(text)).when(F.col("event_id") % 3 == 1, F.trim(text)).alias("active_query"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("retrieval_strategy"),
        F.when(F.col("event_id") % 11 > 0, F.least(F.col("value") / 500, F.lit(1.0))).alias("reflection_score"),
        F.col("value").alias("total_time_ms"),
        (F.col("event_id") % 4 + 1).alias("iteration_count"),
        (F.col("event_id") % 3 == 0).alias("was_reformulated"),
        F.col("ts").alias("created_at"),
    )


LOGS_CTE = """
logs AS (SELECT event_id AS log_id, user_id AS session_id, query_text, md5(trim(lower(query_text))) AS query_hash,
    CASE event_id % 3 WHEN 0 THEN lower(query_text) WHEN 1 THEN trim(query_text) END AS active_query,
    CASE WHEN event_type <> 'signup' THEN event_type END AS retrieval_strategy,
    CASE WHEN event_id % 11 > 0 THEN least(value / 500, 1.0) END AS reflection_score,
    value AS total_time_ms, event_id % 4 + 1 AS iteration_count, event_id % 3 = 0 AS was_reformulated, ts AS created_at
  FROM (SELECT *, ' ' || upper(event_type[1]) || event_type[2:] || ' ' || props AS query_text FROM events))
"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return messages_of(table(spark, sf, "conversations"))


def messages_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as sessions; some deleted, some inactive."""
    base = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("session_id"),
        F.col("c_mktsegment").alias("user_identifier"),
        F.col("c_name").alias("title"),
        (F.col("c_custkey") % 5 != 0).alias("is_active"),
        F.when(F.col("c_custkey") % 7 == 0, base).alias("deleted_at"),
        (F.col("c_custkey") % 9).alias("total_messages"),
        (F.col("c_custkey") % 4).alias("total_documents"),
        (base + F.make_dt_interval(F.lit(0), F.lit(0), F.col("c_nationkey").cast("int"))).alias("updated_at"),
    )


SESSIONS_CTE = """
sessions AS (SELECT c_custkey AS session_id, c_mktsegment AS user_identifier, c_name AS title,
    c_custkey % 5 <> 0 AS is_active, CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-01-01' END AS deleted_at,
    c_custkey % 9 AS total_messages, c_custkey % 4 AS total_documents,
    TIMESTAMP '2024-01-01' + to_minutes(c_nationkey) AS updated_at FROM customer)
"""


def memory_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as operations on session memory: errors clear, the rest save."""
    return operations_of(table(spark, sf, "events"))


def operations_of(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("event_type") == "error", "clear").otherwise("save").alias("op"),
        F.when(F.col("event_type") != "error", F.concat("event_type", F.col("event_id") % 5)).alias("key"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("value"),
        F.col("event_id").alias("seq"),
    )


MEMORY_SQL = """
WITH ops AS (SELECT user_id::VARCHAR AS session_id, event_type = 'error' AS is_clear,
        event_type || event_id % 5 AS key, props AS value, event_id AS seq FROM events),
clears AS (SELECT session_id, max(seq) AS c FROM ops WHERE is_clear GROUP BY 1),
saves AS (SELECT session_id, key, arg_max(value, seq) AS value, max(seq) AS seq FROM ops WHERE NOT is_clear GROUP BY 1, 2)
SELECT session_id, key, value, seq FROM saves LEFT JOIN clears USING (session_id) WHERE c IS NULL OR seq > c
"""
