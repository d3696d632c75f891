"""Search: keyword, vector, fused, hierarchical, parent/child, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.vectors import cosine
from acervo.operators.cells import build_cells, knn_cells, wide_enough, width_recall
from acervo.operators.evaluate import evaluate_retrieval
from acervo.operators.fusion import first_occurrence, hybrid_search, multi_query_union, rrf_fuse, union_counts
from acervo.operators.hierarchy import hierarchical_search
from acervo.operators.impact import build_impacts, impact_search
from acervo.operators.lexical import (
    bm25_search, build_index, corpus_stats, load_index, save_index, stringly_filter, term_stats,
)
from acervo.operators.lookup import article_lookup
from acervo.operators.models import candidate_budget, hashed_embedding, rerank, token_overlap
from acervo.operators.neighbours import neighbour_frame, neighbour_rows, neighbour_window
from acervo.operators.parents import link_parents, parent_child_search
from acervo.operators.ranking import first_wins, rank_in_list, top_k
from acervo.operators.routing import centroids, semantic_route
from acervo.operators.vector import knn, knn_scored
from acervo.plans.search import (
    Corpus, article_lookup_tool, enriched_search, evaluate_strategies, hybrid_search_tool, multi_query_fusion, search,
    semantic_search_tool,
)
from acervo.session import cut_lineage, scratch_path
from entry_queries.inputs import (
    BM25_CTE, CHUNK_CTE, LINES_CTE, P, VECTOR_CTE, bm25_ranked_cte, both_queries, documents, knn_cte, legal_chunks,
    line_chunks, sql_l2sq, summary_vectors, table, text_queries, vector_chunks, vector_queries, vectors, LEGAL_CTE,
)
from entry_queries.registry import query


def index_of(spark, sf):
    return build_index(documents(spark, sf), pattern=P)


# ── Keyword search ────────────────────────────────────────────────────────────

@query("bm25_search", f"WITH {BM25_CTE}, {bm25_ranked_cte('b', 10)} SELECT query_id, doc_id, score, rank FROM b")
def bm25(spark, sf) -> DataFrame:
    """The ten best documents of every benchmark text."""
    return bm25_search(text_queries(spark, sf), index_of(spark, sf), 10, pattern=P)


@query(
    "bm25_filtered",
    f"WITH {BM25_CTE}, {bm25_ranked_cte('b', 5, where=chr(40) + 'lang = ' + chr(39) + 'es' + chr(39) + chr(41))} "
    "SELECT query_id, doc_id, score, rank FROM b",
)
def bm25_filtered(spark, sf):
    """filtered before ranking, statistics of the whole corpus."""
    index = build_index(documents(spark, sf), pattern=P, keep=("lang",))
    return bm25_search(text_queries(spark, sf), index, 5, pattern=P, where=stringly_filter({"lang": "es"}))


@query(
    "bm25_filtered_per_query",
    f"""WITH {BM25_CTE}, {bm25_ranked_cte('b', 5, where="(['', 'en', 'es', 'fr'][query_id % 4 + 1] = '' OR lang = ['', 'en', 'es', 'fr'][query_id % 4 + 1])")}
    SELECT query_id, doc_id, score, rank FROM b""",
)
def bm25_own_filters(spark, sf):
    """every query with its own condition, every fourth without one."""
    index = build_index(documents(spark, sf), pattern=P, keep=("lang",))
    lang = F.element_at(F.array(*map(F.lit, ("", "en", "es", "fr"))), (F.col("query_id") % 4 + 1).cast("int"))
    asked = text_queries(spark, sf).withColumn("filters", F.create_map(F.lit("lang"), lang))
    return bm25_search(asked, index, 5, pattern=P, filters="filters", filter_columns=("lang",))


@query("bm25_impact", f"WITH {BM25_CTE}, {bm25_ranked_cte('b', 10)} SELECT query_id, doc_id, score, rank FROM b")
def bm25_by_impact(spark, sf):
    """J6, S12 by blocks of like impact: blocks that cannot reach the tenth score are not read."""
    return impact_search(text_queries(spark, sf), build_impacts(documents(spark, sf), pattern=P), 10, pattern=P)


@query(
    "bm25_impact_filtered",
    f"""WITH {BM25_CTE}, {bm25_ranked_cte('b', 5, where="(['', 'en', 'es', 'fr'][query_id % 4 + 1] = '' OR lang = ['', 'en', 'es', 'fr'][query_id % 4 + 1])")}
    SELECT query_id, doc_id, score, rank FROM b""",
)
def bm25_by_impact_filtered(spark, sf):
    """J6 with F2 by impact, from a stored index."""
    index = build_impacts(documents(spark, sf), pattern=P, keep=("lang",), path=scratch_path(spark, "impacts"))
    lang = F.element_at(F.array(*map(F.lit, ("", "en", "es", "fr"))), (F.col("query_id") % 4 + 1).cast("int"))
    asked = text_queries(spark, sf).withColumn("filters", F.create_map(F.lit("lang"), lang))
    return impact_search(asked, index, 5, pattern=P, filters="filters", filter_columns=("lang",))


@query("bm25_term_stats", f"WITH {BM25_CTE} SELECT term, df, ctf, round(idf, 6) AS idf FROM idf")
def bm25_terms(spark, sf):
    """Document frequency and idf of every term."""
    return term_stats(index_of(spark, sf)).select("term", "df", F.col("ctf").cast("long"), F.round("idf", 6).alias("idf"))


@query(
    "bm25_corpus_stats",
    f"WITH {BM25_CTE} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM idf) AS vocabulary FROM size",
)
def bm25_corpus(spark, sf):
    stats = corpus_stats(index_of(spark, sf))
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), "vocabulary")


@query("bm25_saved_index", f"WITH {BM25_CTE}, {bm25_ranked_cte('b', 10)} SELECT query_id, doc_id, score, rank FROM b")
def bm25_saved(spark, sf):
    """The index written, read back and searched."""
    path = scratch_path(spark, "bm25")
    save_index(index_of(spark, sf), path)
    return bm25_search(text_queries(spark, sf), load_index(spark, path), 10, pattern=P)


# ── Vectors ───────────────────────────────────────────────────────────────────

@query("knn", f"WITH {VECTOR_CTE}, {knn_cte('k', 'vq', 'vd', 10)} SELECT query_id, doc_id, round(distance, 6) AS distance, rank FROM k")
def knn_all(spark, sf):
    """Every vector against every vector."""
    return knn(vector_queries(spark, sf), vectors(spark, sf), 10).withColumn("distance", F.round("distance", 6))


@query("knn_cells_exact", f"WITH {VECTOR_CTE}, {knn_cte('k', 'vq', 'vd', 10)} SELECT query_id, doc_id, round(distance, 6) AS distance, rank FROM k")
def knn_by_cells(spark, sf):
    """J4 by the cell index, with the cells that the triangle inequality does not rule out."""
    index = build_cells(vectors(spark, sf))
    return knn_cells(vector_queries(spark, sf), index, 10, 8, exact=True).withColumn("distance", F.round("distance", 6))


@query(
    "knn_cells_filtered",
    f"WITH {VECTOR_CTE}, {knn_cte('k', 'vq', 'vd', 5, 'q.label = d.label')} SELECT query_id, doc_id, rank FROM k",
)
def knn_by_cells_in_label(spark, sf):
    """J4 with F1 by the cell index, written and read back."""
    path = scratch_path(spark, "cell-index")
    index = build_cells(vectors(spark, sf), keep=("label",), path=path)
    asked = vector_queries(spark, sf).withColumn("filters", F.create_map(F.lit("label"), F.col("label").cast("string")))
    return knn_cells(asked, index, 5, 4, filters="filters", filter_columns=("label",), exact=True).select("query_id", "doc_id", "rank")


@query("knn_cells_recall")
def knn_cells_recall(spark, sf):
    """Recall at 10 of the cell index, over every vector as a query, at the width that a sample of queries asks for."""
    index = build_cells(vectors(spark, sf))
    width = wide_enough(width_recall(index, 10))
    asked = vector_queries(spark, sf)
    true = knn(asked, vectors(spark, sf), 10).select("query_id", "doc_id")
    found = knn_cells(asked, index, 10, width).select("query_id", "doc_id", F.lit(1).alias("hit"))
    share = true.join(found, ["query_id", "doc_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
    return share.withColumn("width", F.lit(width)).withColumn("cells", F.lit(index.cells.count()))


@query(
    "knn_scored",
    f"WITH {VECTOR_CTE}, {knn_cte('k', 'vq', 'vd', 5)} SELECT query_id, doc_id, round(1.0 / (1.0 + distance), 4) AS score, rank FROM k",
)
def knn_with_score(spark, sf):
    """J5."""
    return knn_scored(vector_queries(spark, sf), vectors(spark, sf), 5).select("query_id", "doc_id", "score", "rank")


@query(
    "knn_filtered",
    f"WITH {VECTOR_CTE}, {knn_cte('k', 'vq', 'vd', 5, 'q.label = d.label')} SELECT query_id, doc_id, rank FROM k",
)
def knn_in_label(spark, sf):
    """J4 with F1: each query searches the vectors of its own label."""
    asked = vector_queries(spark, sf).withColumn("filters", F.create_map(F.lit("label"), F.col("label").cast("string")))
    hits = knn(asked, vectors(spark, sf), 5, filters="filters", filter_columns=("label",))
    return hits.select("query_id", "doc_id", "rank")


@query(
    "knn_cosine",
    f"""WITH {VECTOR_CTE}, d AS (SELECT q.query_id, d.doc_id,
      round(greatest(1 - list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 0), 9) AS distance FROM vq q CROSS JOIN vd d)
      SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM d) WHERE rank <= 5""",
)
def knn_by_cosine(spark, sf):
    hits = knn(vector_queries(spark, sf), vectors(spark, sf), 5, metric="cosine")
    return hits.select("query_id", "doc_id", "rank")


@query(
    "cosine_to_centroid",
    """WITH c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (
        SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM embeddings)
        GROUP BY label, pos) GROUP BY label)
      SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS cosine FROM embeddings JOIN c USING (label)""",
)
def cosine_own_centroid(spark, sf):
    """P18, A7."""
    e = table(spark, sf, "embeddings")
    c = centroids(e, "label")
    return e.join(c, "label").select("vec_id", F.round(cosine("embedding", "centroid"), 6).alias("cosine"))


@query(
    "centroids",
    """SELECT label, pos - 1 AS pos, round(avg(x::DOUBLE), 6) AS mean FROM (
        SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY label, pos""",
)
def label_centroids(spark, sf):
    """Mean vector per label, one row per position."""
    c = centroids(table(spark, sf, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "mean")).select(
        "label", F.col("pos").cast("long"), F.round("mean", 6).alias("mean"))


@query(
    "semantic_route",
    """WITH c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (
        SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM embeddings)
        GROUP BY label, pos) GROUP BY label),
      s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], centroid) AS score FROM embeddings CROSS JOIN c)
      SELECT vec_id, category, round(score, 4) AS confidence FROM (
        SELECT vec_id, label::VARCHAR AS category, score,
               row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS r FROM s) WHERE r = 1""",
)
def routed(spark, sf):
    """Nearest label centroid of every vector."""
    e = table(spark, sf, "embeddings")
    centers = centroids(e, "label").withColumn("category", F.col("label").cast("string"))
    return semantic_route(e, centers, order="label").select("vec_id", "category", "confidence")


# ── Fusion ────────────────────────────────────────────────────────────────────

_RRF = """
lists AS (SELECT query_id, doc_id, rank, 0 AS list_no FROM v UNION ALL SELECT query_id, doc_id, rank, 1 FROM b),
fused AS (SELECT query_id, doc_id, round(sum(1.0 / (rank + 60)), 12) AS s, min(list_no * 1000 + rank) AS first FROM lists GROUP BY ALL),
hybrid AS (SELECT query_id, doc_id, round(s, 6) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first) AS rank FROM fused) WHERE rank <= {k})
"""


@query(
    "hybrid_search",
    f"WITH {BM25_CTE}, {bm25_ranked_cte('b', 30)}, {VECTOR_CTE}, {knn_cte('v', 'bq', 'vd', 30)}, {_RRF.format(k=10)} "
    "SELECT query_id, doc_id, score, rank FROM hybrid",
)
def hybrid(spark, sf):
    """Both sides fetch three times k."""
    return hybrid_search(both_queries(spark, sf), 10, vectors=vectors(spark, sf), index=index_of(spark, sf), pattern=P)


@query(
    "rrf_fuse_weighted",
    f"""WITH {VECTOR_CTE}, {knn_cte('a', 'vq', 'vd', 8)}, {knn_cte('s', 'vq', 'vd', 8, 'q.label = d.label')},
      lists AS (SELECT query_id, doc_id, rank, 0 AS list_no, 1.0 AS w FROM a UNION ALL SELECT query_id, doc_id, rank, 1, 0.5 FROM s),
      fused AS (SELECT query_id, doc_id, round(sum(w / (rank + 60)), 12) AS f, min(list_no * 1000 + rank) AS first FROM lists GROUP BY ALL)
      SELECT query_id, doc_id, round(f, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, first) AS rank FROM fused) WHERE rank <= 6""",
)
def rrf(spark, sf):
    """J7 with weights: all vectors against those of the query's label."""
    asked = vector_queries(spark, sf).withColumn("filters", F.create_map(F.lit("label"), F.col("label").cast("string")))
    wide = knn(asked, vectors(spark, sf), 8)
    own = knn(asked, vectors(spark, sf), 8, filters="filters", filter_columns=("label",))
    return rrf_fuse([wide, own], 6, [1.0, 0.5])


@query(
    "rank_in_list",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events",
)
def ranks(spark, sf):
    """W1 over every event of every user."""
    ev = table(spark, sf, "events")
    order = [F.col("value").desc(), F.col("event_id")]
    return rank_in_list(ev, ["user_id"], order, bucket=-F.floor("value")).select("user_id", "event_id", "rank")


@query(
    "top_k_per_query",
    """SELECT user_id, event_id, value, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3""",
)
def best_three(spark, sf):
    """W2."""
    ev = table(spark, sf, "events")
    return top_k(ev, ["user_id"], [F.col("value").desc(), F.col("event_id")], 3).select("user_id", "event_id", "value", "rank")


@query(
    "first_wins_dedupe",
    """SELECT text_hash, doc_id, source FROM (SELECT md5(text) AS text_hash, doc_id, source,
         row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1""",
)
def first_copies(spark, sf):
    """The first of every group of equal texts."""
    docs = documents(spark, sf).select(F.md5("text").alias("text_hash"), "doc_id", "source")
    return first_wins(docs, ["text_hash"], [F.col("source"), F.col("doc_id")]).select("text_hash", "doc_id", "source")


def hier_cte(k: int = 8) -> str:
    """SQL of hierarchical_search with ``k`` chunks: relation ``hier``."""
    return f"""
{knn_cte('plain', 'vq', 'vc', k)},
{knn_cte('found', 'vq', 'vs', 4)},
leads AS (SELECT f.query_id, f.rank AS lead, s.article_number, s.page, q.embedding,
                 greatest(1, {k} // count(*) OVER (PARTITION BY f.query_id)) AS share
          FROM found f JOIN vs s USING (doc_id) JOIN vq q USING (query_id)),
cand AS (
  SELECT l.query_id, l.lead, l.share, d.doc_id, 1 AS tier, {sql_l2sq('l.embedding', 'd.embedding')} AS distance
  FROM leads l JOIN vc d ON l.article_number <> '' AND l.article_number = d.article_number
  UNION ALL
  SELECT l.query_id, l.lead, l.share, d.doc_id, 2, {sql_l2sq('l.embedding', 'd.embedding')}
  FROM leads l JOIN vc d ON l.page <> '' AND l.page = d.page
  UNION ALL
  SELECT l.query_id, l.lead, l.share, p.doc_id, 3, p.distance FROM leads l JOIN plain p USING (query_id)),
tiered AS (SELECT *, min(tier) OVER (PARTITION BY query_id, lead) AS best,
                  row_number() OVER (PARTITION BY query_id, lead, tier ORDER BY distance, doc_id) AS rank FROM cand),
chosen AS (SELECT query_id, doc_id, lead, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY lead, rank) AS r
    FROM tiered WHERE tier = best AND rank <= share) WHERE r = 1),
extra AS (SELECT p.query_id, p.doc_id, 5 AS lead, p.rank FROM plain p
          WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.query_id = p.query_id AND c.doc_id = p.doc_id)),
hier AS (SELECT query_id, doc_id, rank FROM (
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY lead, rank, doc_id) AS rank
    FROM (SELECT * FROM chosen UNION ALL SELECT * FROM extra)) WHERE rank <= {k})
"""


@query("hierarchical_search", f"WITH {VECTOR_CTE}, {CHUNK_CTE}, {hier_cte()} SELECT query_id, doc_id, rank FROM hier")
def hierarchical(spark, sf):
    """J9 for every vector as a query."""
    return hierarchical_search(vector_queries(spark, sf), summary_vectors(spark, sf), vector_chunks(spark, sf))


@query(
    "full_search",
    f"""WITH {BM25_CTE}, {bm25_ranked_cte('b', 30)}, vq AS (SELECT item_id AS query_id, b.text, e.embedding FROM benchmark b JOIN embeddings e ON item_id = vec_id),
      vd AS (SELECT vec_id AS doc_id, embedding FROM embeddings), {CHUNK_CTE}, {knn_cte('v', 'vq', 'vd', 30)}, {_RRF.format(k=10)}, {hier_cte()},
      both_lists AS (SELECT query_id, doc_id, rank, 0 AS l FROM hybrid UNION ALL SELECT query_id, doc_id, rank, 1 FROM hier),
      once AS (SELECT query_id, doc_id, min(l * 1000 + rank) AS seen FROM both_lists GROUP BY ALL)
      SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS rank FROM once""",
)
def full(spark, sf):
    """Hybrid, then hierarchical, each row once."""
    asked = both_queries(spark, sf)
    first = hybrid_search(asked, 10, vectors=vectors(spark, sf), index=index_of(spark, sf), pattern=P)
    second = hierarchical_search(asked, summary_vectors(spark, sf), vector_chunks(spark, sf))
    return first_occurrence([first, second])


# ── Parents, neighbours, lookup ───────────────────────────────────────────────

def _parts_as_parents(spark, sf):
    """Suppliers as parents of the vectors with the same number modulo their count; some unknown."""
    docs = documents(spark, sf).select(F.col("source").alias("parent_id"), "text", "doc_id")
    return docs.groupBy("parent_id").agg(F.min_by("text", "doc_id").alias("text"))


@query(
    "parent_child_search",
    f"""WITH {VECTOR_CTE}, {CHUNK_CTE}, {knn_cte('k', 'vq', 'vc', 15)},
      parents AS (SELECT source AS parent_id, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),
      named AS (SELECT k.*, CASE WHEN doc_id % 9 > 0 THEN source END AS parent_id, source, chunk_index FROM k JOIN vc USING (doc_id)),
      once AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS r FROM named
               WHERE parent_id IS NOT NULL) WHERE r = 1),
      ranked AS (SELECT once.*, p.text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM once JOIN parents p USING (parent_id))
      SELECT query_id, n AS rank, parent_id, md5(text) AS parent_text, source AS matched_child_source,
             chunk_index AS matched_child_chunk, round(1.0 / (1.0 + distance), 4) AS relevance_score FROM ranked WHERE n <= 5""",
)
def parent_child(spark, sf):
    """Vectors are children, their source the parent; every ninth child has no parent."""
    children = vector_chunks(spark, sf).withColumn("parent_id", F.when(F.col("doc_id") % 9 > 0, F.col("source")))
    found = parent_child_search(vector_queries(spark, sf), children, _parts_as_parents(spark, sf), 5)
    return found.withColumn("parent_text", F.md5("parent_text"))


@query(
    "link_parents",
    f"""WITH {LEGAL_CTE},
      kids AS (SELECT source, order_id, chunk_index, part_id, CASE WHEN chunk_index = 7 THEN 'given' END AS given,
               CASE WHEN chunk_index % 2 = 0 THEN (part_id % 3)::VARCHAR ELSE '' END AS article_number, (part_id % 5)::VARCHAR AS section_number FROM legal),
      pars AS (SELECT 'pedido ' || o_orderkey || '/a.pdf' AS source, o_orderkey AS position, 'p' || o_orderkey || '.' || i AS parent_id,
               (i % 3)::VARCHAR AS article_number, (i % 4)::VARCHAR AS section_number, i FROM orders CROSS JOIN range(1, 4) t(i)),
      a AS (SELECT source, article_number, min(i) AS pos, arg_min(parent_id, i) AS pid FROM pars GROUP BY 1, 2),
      s AS (SELECT source, section_number, min(i) AS pos, arg_min(parent_id, i) AS pid FROM pars GROUP BY 1, 2)
      SELECT order_id, chunk_index, part_id, coalesce(given,
        CASE WHEN a.pos IS NULL THEN s.pid WHEN s.pos IS NULL OR a.pos <= s.pos THEN a.pid ELSE s.pid END) AS parent_id
      FROM kids LEFT JOIN a ON kids.source = a.source AND kids.article_number = a.article_number AND kids.article_number <> ''
                LEFT JOIN s ON kids.source = s.source AND kids.section_number = s.section_number""",
)
def linked(spark, sf):
    """Order lines find their order's first section by article, else by section."""
    kids = legal_chunks(spark, sf).select(
        "source", "order_id", "chunk_index", "part_id",
        F.when(F.col("chunk_index") == 7, "given").alias("parent_id"),
        F.when(F.col("chunk_index") % 2 == 0, (F.col("part_id") % 3).cast("string")).otherwise("").alias("article_number"),
        (F.col("part_id") % 5).cast("string").alias("section_number"),
    )
    parents = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("position")).select(
        F.concat(F.lit("pedido "), F.col("o_orderkey").cast("string"), F.lit("/a.pdf")).alias("source"),
        F.format_string("p%d.%d", "o_orderkey", "position").alias("parent_id"),
        "position",
        (F.col("position") % 3).cast("string").alias("article_number"),
        (F.col("position") % 4).cast("string").alias("section_number"),
    )
    return link_parents(kids, parents).select("order_id", "chunk_index", "part_id", "parent_id")


@query(
    "neighbour_range",
    f"""WITH {LINES_CTE}, hits AS (SELECT 'd' || doc_id AS source, 1 AS hit_index FROM labels)
      SELECT h.source, h.hit_index, l.chunk_index, md5(l.text) AS text FROM hits h JOIN lines l
      ON h.source = l.source AND l.chunk_index BETWEEN greatest(0, hit_index - 2) AND hit_index + 2""",
)
def neighbours_of_labels(spark, sf):
    """lines around the second line of every labelled document."""
    hits = table(spark, sf, "labels").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), F.lit(1).cast("long").alias("chunk_index"))
    rows = neighbour_rows(hits, line_chunks(spark, sf), 2)
    return rows.select("source", "hit_index", "chunk_index", F.md5("text").alias("text"))


@query(
    "neighbour_window_counts",
    f"""WITH {LINES_CTE}, n AS (SELECT l.source, l.chunk_index, count(*) AS n FROM lines l JOIN lines m ON l.source = m.source
          AND m.chunk_index BETWEEN greatest(0, l.chunk_index - 2) AND l.chunk_index + 2 GROUP BY 1, 2)
      SELECT source, chunk_index, n > 1 AS context_enriched, CASE WHEN n > 1 THEN 2 END AS context_window_size, CASE WHEN n > 1 THEN n END AS context_chunks_count FROM n""",
)
def neighbour_flags(spark, sf):
    """What surrounds each line, without the folded text."""
    lines = line_chunks(spark, sf)
    wide = neighbour_window(lines, lines, 2)
    return wide.select("source", "chunk_index", "context_enriched", "context_window_size", "context_chunks_count")


@query("neighbour_window")
def neighbour_texts(spark, sf):
    """Every line of every document with its surroundings folded in."""
    lines = line_chunks(spark, sf)
    wide = neighbour_window(lines, lines, 2)
    return wide.select("source", "chunk_index", "context_enriched", "context_chunks_count", F.md5("text").alias("text"))


@query(
    "neighbour_frame",
    f"""WITH {LINES_CTE} SELECT source, chunk_index, md5(string_agg(text, '|') OVER (PARTITION BY source ORDER BY chunk_index
        ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS neighbours FROM lines""",
)
def framed(spark, sf):
    """W7."""
    rows = neighbour_frame(line_chunks(spark, sf), 2)
    return rows.select("source", "chunk_index", F.md5(F.array_join("neighbours", "|")).alias("neighbours"))


@query(
    "article_lookup",
    f"""WITH {VECTOR_CTE}, {CHUNK_CTE},
      req AS (SELECT query_id, (query_id % 15)::VARCHAR || '.' AS article_number, CASE WHEN query_id % 2 = 0 THEN 'src' || query_id % 23 ELSE '' END AS source, embedding FROM vq),
      cand AS (SELECT r.query_id, d.doc_id, CASE WHEN trim(r.article_number, '.') = d.article_number THEN 1 ELSE 2 END AS tier,
                 {sql_l2sq('r.embedding', 'd.embedding')} AS distance
               FROM req r JOIN vc d ON r.source = '' OR r.source = d.source),
      best AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, distance, doc_id) AS n FROM cand) WHERE n = 1)
      SELECT query_id, r.article_number, b.doc_id IS NOT NULL AS found, md5(coalesce(text, '')) AS content, coalesce(d.source, '') AS source, coalesce(page, '') AS page
      FROM req r LEFT JOIN best b USING (query_id) LEFT JOIN vc d ON b.doc_id = d.doc_id""",
)
def lookup(spark, sf):
    """Article by number and source; misses fall back to the source, or stay not found."""
    requests = vector_queries(spark, sf).select(
        "query_id",
        F.concat((F.col("query_id") % 15).cast("string"), F.lit(".")).alias("article_number"),
        F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("src"), (F.col("query_id") % 23).cast("string"))).otherwise("").alias("source"),
        "embedding",
    )
    return article_lookup(requests, vector_chunks(spark, sf)).withColumn("content", F.md5("content"))


# ── Reranking and budgets ─────────────────────────────────────────────────────

@query(
    "rerank",
    f"""WITH {BM25_CTE}, {bm25_ranked_cte('b', 20)},
      qd AS (SELECT query_id, list(term) AS asked FROM qt GROUP BY 1),
      s AS (SELECT b.query_id, b.doc_id, b.rank, len(list_intersect(asked, toks)) / len(asked) AS s FROM b JOIN qd USING (query_id) JOIN docs_tok USING (doc_id))
      SELECT query_id, doc_id, rank, round(s, 4) AS rerank_score FROM (
        SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, rank) AS rank FROM s) WHERE rank <= 5""",
)
def reranked(spark, sf):
    """Keyword hits reordered by token overlap."""
    hits = bm25_search(text_queries(spark, sf), index_of(spark, sf), 20, pattern=P)
    asked = text_queries(spark, sf).withColumnRenamed("text", "query_text")
    rows = hits.join(asked, "query_id").join(documents(spark, sf).select("doc_id", "text"), "doc_id")
    return rerank(rows, token_overlap("query_text", "text"), 5).select("query_id", "doc_id", "rank", "rerank_score")


@query(
    "candidate_budget",
    """WITH hits AS (SELECT user_id AS query_id, event_id AS doc_id, value, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events) WHERE rank <= 20),
        n AS (SELECT query_id, count(*) AS n FROM hits GROUP BY 1),
        few AS (SELECT query_id, doc_id, rank, NULL::DOUBLE AS rerank_score FROM hits JOIN n USING (query_id) WHERE n <= 5),
        many AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, rank) AS rank, round(value, 4) AS rerank_score
                 FROM hits JOIN n USING (query_id) WHERE n > 5)
      SELECT * FROM few UNION ALL SELECT * FROM many WHERE rank <= 5""",
)
def budget(spark, sf):
    """L4: only users with more than five candidate events are reordered."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), "value")
    hits = top_k(ev, ["query_id"], [F.col("doc_id")], 20)
    return candidate_budget(hits, F.col("value")).select("query_id", "doc_id", "rank", "rerank_score")


# ── Several variants of a query ───────────────────────────────────────────────

_VARIANTS = f"""
{VECTOR_CTE}, {knn_cte('k0', 'vq', 'vd', 6)}, {knn_cte('k1', 'vq', 'vd', 6, 'q.label = d.label')},
hits AS (SELECT query_id, 0 AS variant_no, doc_id, rank FROM k0 UNION ALL SELECT query_id, 1, doc_id, rank FROM k1)
"""


def _variant_hits(spark, sf):
    asked = vector_queries(spark, sf).withColumn("filters", F.create_map(F.lit("label"), F.col("label").cast("string")))
    wide = knn(asked, vectors(spark, sf), 6).withColumn("variant_no", F.lit(0))
    own = knn(asked, vectors(spark, sf), 6, filters="filters", filter_columns=("label",)).withColumn("variant_no", F.lit(1))
    return wide.unionByName(own)


@query(
    "multi_query_union",
    f"""WITH {_VARIANTS}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY variant_no, rank) AS r FROM hits) WHERE r = 1)
      SELECT query_id, doc_id, variant_no, row_number() OVER (PARTITION BY query_id ORDER BY variant_no, rank) AS rank FROM once""",
)
def union_of_variants(spark, sf):
    """U-2, W3."""
    return multi_query_union(_variant_hits(spark, sf)).select("query_id", "doc_id", "variant_no", "rank")


@query(
    "multi_query_counts",
    f"""WITH {_VARIANTS} SELECT query_id, count(DISTINCT variant_no) AS variants, count(*) AS total_before_dedup,
        count(*) - count(DISTINCT doc_id) AS dedup_removed FROM hits GROUP BY query_id""",
)
def variant_counts(spark, sf):
    return union_counts(_variant_hits(spark, sf))


# ── Search quality ────────────────────────────────────────────────────────────

@query(
    "evaluate_retrieval",
    f"""WITH {VECTOR_CTE}, {knn_cte('k', 'vq', 'vd', 10)},
      rel AS (SELECT a.vec_id AS query_id, b.doc_id FROM embeddings a JOIN labels b ON a.label = b.doc_id % 10 WHERE b.quality = 1),
      f AS (SELECT k.query_id, min(rank) AS first FROM k SEMI JOIN rel USING (query_id, doc_id) GROUP BY 1),
      e AS (SELECT q.query_id, first, (SELECT count(*) FROM k WHERE k.query_id = q.query_id) AS docs FROM vq q LEFT JOIN f USING (query_id))
      SELECT count(*) AS total_queries, round(count(first) / count(*), 4) AS hit_rate,
             round(sum(coalesce(1.0 / first, 0)) / count(*), 4) AS mrr, round(sum(docs) / count(*), 1) AS mean_docs_returned FROM e""",
)
def retrieval_quality(spark, sf):
    """A6."""
    asked = vector_queries(spark, sf)
    good = table(spark, sf, "labels").filter("quality = 1").select((F.col("doc_id") % 10).cast("int").alias("label"), "doc_id")
    hits = cut_lineage(knn(asked, vectors(spark, sf), 10))
    named = hits.select("query_id", "doc_id").join(asked.select("query_id", "label"), "query_id")
    return evaluate_retrieval(asked, hits, named.join(good, ["label", "doc_id"], "left_semi").select("query_id", "doc_id"))


def _corpus(spark, sf) -> Corpus:
    return Corpus(vector_chunks(spark, sf), index_of(spark, sf), summary_vectors(spark, sf), pattern=P)


@query(
    "evaluate_strategies",
    f"""WITH {BM25_CTE}, {bm25_ranked_cte('b', 30)}, {VECTOR_CTE}, {CHUNK_CTE}, {knn_cte('v', 'bq', 'vc', 30)}, {_RRF.format(k=10)},
      hits AS (SELECT 'vector' AS strategy, query_id, doc_id, rank FROM v WHERE rank <= 10 UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM b WHERE rank <= 10
               UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hybrid),
      rel AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN labels ON quality = 1 AND doc_id % 3 = item_id % 3),
      f AS (SELECT strategy, query_id, min(rank) AS first FROM hits SEMI JOIN rel USING (query_id, doc_id) GROUP BY 1, 2),
      d AS (SELECT strategy, query_id, count(*) AS docs FROM hits GROUP BY 1, 2),
      e AS (SELECT s.strategy, q.query_id, first, coalesce(docs, 0) AS docs FROM (VALUES ('vector'), ('bm25'), ('hybrid')) s(strategy) CROSS JOIN bq q
            LEFT JOIN f ON f.strategy = s.strategy AND f.query_id = q.query_id LEFT JOIN d ON d.strategy = s.strategy AND d.query_id = q.query_id)
      SELECT strategy, count(*) AS total_queries, round(count(first) / count(*), 4) AS hit_rate,
             round(sum(coalesce(1.0 / first, 0)) / count(*), 4) AS mrr, round(sum(docs) / count(*), 1) AS mean_docs_returned FROM e GROUP BY strategy""",
)
def strategies(spark, sf):
    """Three strategies side by side."""
    asked = both_queries(spark, sf)
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")

    def relevant(hits):
        return hits.filter(F.col("doc_id") % 3 == F.col("query_id") % 3).select("query_id", "doc_id").join(good, "doc_id", "left_semi")

    return evaluate_strategies(asked, _corpus(spark, sf), relevant, ["vector", "bm25", "hybrid"])


def _family(spark, sf) -> Corpus:
    """The corpus with parents: the sources of the chunks; every ninth chunk has none."""
    chunks = vector_chunks(spark, sf).withColumn("parent_id", F.when(F.col("doc_id") % 9 > 0, F.col("source")))
    return Corpus(chunks, index_of(spark, sf), summary_vectors(spark, sf), _parts_as_parents(spark, sf), pattern=P)


_PARENT_CTE = """
named AS (SELECT v.query_id, rank, CASE WHEN doc_id % 9 > 0 THEN source END AS parent_id FROM {hits} v JOIN vc USING (doc_id)),
family AS (SELECT query_id, parent_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM named WHERE parent_id IS NOT NULL GROUP BY 1, 2)
"""


@query(
    "evaluate_all_strategies",
    f"""WITH {BM25_CTE}, {bm25_ranked_cte('b', 30)}, vq AS (SELECT item_id AS query_id, b.text, e.embedding FROM benchmark b JOIN embeddings e ON item_id = vec_id),
      {CHUNK_CTE}, {knn_cte('v', 'vq', 'vc', 30)}, {_RRF.format(k=10)}, {hier_cte(10)}, {_PARENT_CTE.format(hits='v')},
      words AS (SELECT query_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, regexp_matches(text, '\\d+\\.\\d+') AS dotted FROM vq),
      twice AS (SELECT query_id, doc_id, rank, 0 AS l FROM hybrid UNION ALL SELECT query_id, doc_id, rank, 1 FROM hier),
      once AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(l * 1000 + rank)) AS rank FROM twice GROUP BY 1, 2),
      hits AS (SELECT 'vector' AS strategy, query_id, doc_id::VARCHAR AS doc_id, rank FROM v WHERE rank <= 10 UNION ALL SELECT 'bm25', query_id, doc_id::VARCHAR, rank FROM b WHERE rank <= 10
               UNION ALL SELECT 'hybrid', query_id, doc_id::VARCHAR, rank FROM hybrid UNION ALL SELECT 'hierarchical', query_id, doc_id::VARCHAR, rank FROM hier WHERE rank <= 10
               UNION ALL SELECT 'full', query_id, doc_id::VARCHAR, rank FROM once WHERE rank <= 10 UNION ALL SELECT 'parent_child', query_id, doc_id, rank FROM family WHERE rank <= 10
               UNION ALL SELECT 'auto', query_id, doc_id::VARCHAR, rank FROM once JOIN words USING (query_id) WHERE NOT dotted AND n >= 20 AND rank <= 10
               UNION ALL SELECT 'auto', query_id, doc_id::VARCHAR, rank FROM hybrid JOIN words USING (query_id) WHERE dotted OR n < 20),
      f AS (SELECT strategy, query_id, min(rank) AS first FROM hits WHERE right(doc_id, 1)::INT % 3 = query_id % 3 GROUP BY 1, 2),
      d AS (SELECT strategy, query_id, count(*) AS docs FROM hits GROUP BY 1, 2),
      e AS (SELECT s.strategy, q.query_id, first, coalesce(docs, 0) AS docs FROM (SELECT DISTINCT strategy FROM hits) s CROSS JOIN vq q
            LEFT JOIN f ON f.strategy = s.strategy AND f.query_id = q.query_id LEFT JOIN d ON d.strategy = s.strategy AND d.query_id = q.query_id)
      SELECT strategy, count(*) AS total_queries, round(count(first) / count(*), 4) AS hit_rate,
             round(sum(coalesce(1.0 / first, 0)) / count(*), 4) AS mrr, round(sum(docs) / count(*), 1) AS mean_docs_returned FROM e GROUP BY strategy""",
)
def all_strategies(spark, sf):
    """All seven strategies; relevant is what ends in a digit that leaves the query's remainder by three."""
    digit = F.substring(F.col("doc_id").cast("string"), -1, 1).cast("int")
    relevant = lambda hits: hits.filter(digit % 3 == F.col("query_id") % 3).select("query_id", "doc_id")
    return evaluate_strategies(both_queries(spark, sf), _family(spark, sf), relevant, ["vector", "bm25", "hybrid", "hierarchical", "full", "parent_child", "auto"])


@query(
    "search_parent_child_filtered",
    f"""WITH {VECTOR_CTE}, {CHUNK_CTE}, {knn_cte('v', 'bq', 'vc', 15, "(q.query_id % 2 = 1 OR d.page = (q.query_id % 7)::VARCHAR)")}, {_PARENT_CTE.format(hits='v')}
      SELECT query_id, doc_id, rank FROM family WHERE rank <= 5""",
)
def parent_child_filtered(spark, sf):
    """Parents of the nearest children on the page that every second query asks for."""
    page = F.when(F.col("query_id") % 2 == 0, (F.col("query_id") % 7).cast("string")).otherwise("")
    asked = both_queries(spark, sf).withColumn("filters", F.create_map(F.lit("page"), page))
    found = search(asked, _family(spark, sf), "parent_child", k=5, filters="filters", filter_columns=("page",))
    return found.select("query_id", "doc_id", "rank")


# ── Jobs and tools ────────────────────────────────────────────────────────────

@query(
    "search_auto",
    f"""WITH {BM25_CTE}, {bm25_ranked_cte('b', 30)}, vq AS (SELECT item_id AS query_id, b.text, e.embedding FROM benchmark b JOIN embeddings e ON item_id = vec_id),
      {CHUNK_CTE}, {knn_cte('v', 'vq', 'vc', 30)}, {_RRF.format(k=10)}, {hier_cte(10)},
      words AS (SELECT query_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, regexp_matches(text, '\\d+\\.\\d+') AS dotted FROM vq),
      routes AS (SELECT query_id, CASE WHEN NOT dotted AND n >= 20 THEN 'full' ELSE 'hybrid' END AS strategy FROM words),
      both_lists AS (SELECT query_id, doc_id, rank, 0 AS l FROM hybrid UNION ALL
                     SELECT query_id, doc_id, rank, 1 FROM hier JOIN routes USING (query_id) WHERE strategy = 'full'),
      once AS (SELECT query_id, doc_id, min(l * 1000 + rank) AS seen FROM both_lists GROUP BY ALL)
      SELECT query_id, doc_id, rank, strategy FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS rank FROM once)
      JOIN routes USING (query_id) WHERE rank <= 10""",
)
def auto(spark, sf):
    """Every query by its own strategy."""
    return search(both_queries(spark, sf), _corpus(spark, sf), "auto").select("query_id", "doc_id", "rank", "strategy")


@query("enriched_search")
def enriched(spark, sf):
    """Vector hits with neighbouring chunks folded in."""
    hits = enriched_search(both_queries(spark, sf), _corpus(spark, sf), "vector")
    return hits.select("query_id", "doc_id", "rank", "context_enriched", "context_chunks_count", F.md5("text").alias("text"))


@query(
    "multi_query_fusion",
    f"""WITH {VECTOR_CTE}, {CHUNK_CTE}, rq AS (SELECT query_id, list_reverse(embedding) AS embedding FROM bq), {knn_cte('k0', 'bq', 'vc', 10)}, {knn_cte('k1', 'rq', 'vc', 10)},
      hits AS (SELECT query_id, 0 AS variant_no, doc_id, rank FROM k0 UNION ALL SELECT query_id, 1, doc_id, rank FROM k1),
      once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY variant_no, rank) AS r FROM hits) WHERE r = 1)
      SELECT query_id, doc_id, variant_no, row_number() OVER (PARTITION BY query_id ORDER BY variant_no, rank) AS rank FROM once""",
)
def fused_variants(spark, sf):
    """Each benchmark text and a second variant of it, first variant wins."""
    asked = both_queries(spark, sf)
    first = asked.withColumn("variant_no", F.lit(0))
    second = asked.withColumn("variant_no", F.lit(1)).withColumn("embedding", F.reverse("embedding"))
    hits = multi_query_fusion(first.unionByName(second), _corpus(spark, sf), "vector", window=None)
    return hits.select("query_id", "doc_id", "variant_no", "rank")


@query(
    "semantic_search_tool",
    f"""WITH {VECTOR_CTE}, {CHUNK_CTE}, {knn_cte('k', 'vq', 'vc', 5)}
      SELECT query_id, rank, substring(text, 1, 500) AS content, source, article_number AS article, page, round(1.0 / (1.0 + distance), 4) AS score
      FROM k JOIN vc USING (doc_id)""",
)
def semantic_tool(spark, sf):
    """Previews and scores."""
    return semantic_search_tool(vector_queries(spark, sf).drop("label"), Corpus(vector_chunks(spark, sf)))


@query(
    "hybrid_search_tool",
    f"""WITH {BM25_CTE}, {bm25_ranked_cte('b', 24)}, {VECTOR_CTE}, {CHUNK_CTE}, {knn_cte('v', 'bq', 'vc', 24)}, {_RRF.format(k=8)}
      SELECT query_id, rank, substring(text, 1, 500) AS content, source, article_number AS article, page, score AS rrf_score
      FROM hybrid LEFT JOIN vc USING (doc_id)""",
)
def hybrid_tool(spark, sf):
    """X9."""
    return hybrid_search_tool(both_queries(spark, sf), _corpus(spark, sf))


@query("article_lookup_tool")
def lookup_tool(spark, sf):
    """Articles by number, embedded by the default text embedding."""
    requests = table(spark, sf, "customer").repartition(spark.sparkContext.defaultParallelism).select(
        F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 12).cast("string").alias("article_number"), F.lit("").alias("source"))
    asked = requests.withColumn("embedding", hashed_embedding(F.concat(F.lit("artículo "), "article_number")))
    return article_lookup_tool(asked, Corpus(vector_chunks(spark, sf))).withColumn("content", F.md5("content"))


