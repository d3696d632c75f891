import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.functions.tokens import STOPWORDS, tokenize
from acervo.operators import lexical
from acervo.operators.evaluate import evaluate_retrieval
from acervo.operators.fusion import first_occurrence, hybrid_search, rrf_fuse
from acervo.operators.hierarchy import hierarchical_search
from acervo.operators.lookup import article_lookup
from acervo.operators.models import candidate_budget, rerank
from acervo.operators.parents import link_parents, parents_of_hits
from acervo.operators.ranking import rank_in_list
from acervo.operators.routing import centroids, semantic_route
from acervo.operators import cells, impact
from acervo.operators.vector import knn, knn_scored

TEXTS = [
    "El sistema de gestión de la seguridad y salud en el trabajo",
    "Obligaciones del empleador: gestión, seguridad y capacitación del trabajador",
    "Artículo 2.2.4.6.1. Objeto y campo de aplicación",
    "La gestión gestión gestión del riesgo",
    "gestión",
    "gestión",
    "",
]


def python_tokens(text):
    return [w for w in re.findall(r"\b[a-záéíóúüñA-ZÁÉÍÓÚÜÑ0-9\.]+\b", text.lower()) if len(w) > 1 and w not in STOPWORDS]


def python_bm25(queries, texts, k):
    docs = [Counter(python_tokens(t)) for t in texts]
    n, sizes = len(docs), [sum(d.values()) for d in docs]
    avg = sum(sizes) / n
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    found = set()
    for q, text in enumerate(queries):
        scores = []
        for i, d in enumerate(docs):
            s = sum(idf.get(t, 0) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * sizes[i] / avg)) for t in python_tokens(text))
            if s > 0:
                scores.append((-round(s, 9), i))
        found |= {(q, i, round(-s, 4), r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return found


def frame(spark, texts, id_name):
    return spark.createDataFrame(list(enumerate(texts)), f"{id_name} bigint, text string")


def test_tokens_match_python(spark):
    rows = frame(spark, TEXTS + ["¿Qué dice el ARTÍCULO 5?", "a. b. 1.2. x"], "id").select("text", tokenize("text").alias("t")).collect()
    assert all(r["t"] == python_tokens(r["text"]) for r in rows)


QUERIES = ["gestión de la seguridad", "gestión gestión riesgo", "artículo 2.2.4.6.1", "el de la"]


def test_bm25_matches_brute_force(spark):
    index = lexical.build_index(frame(spark, TEXTS, "doc_id"))
    hits = lexical.bm25_search(frame(spark, QUERIES, "query_id"), index, 4).collect()
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in hits} == python_bm25(QUERIES, TEXTS, 4)


def test_impact_search_matches_brute_force(spark):
    index = impact.build_impacts(frame(spark, TEXTS, "doc_id"))
    hits = impact.impact_search(frame(spark, QUERIES, "query_id"), index, 4).collect()
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in hits} == python_bm25(QUERIES, TEXTS, 4)
    assert impact.impact_search(frame(spark, ["el de la", ""], "query_id"), index, 4).count() == 0
    empty = impact.build_impacts(frame(spark, TEXTS, "doc_id").limit(0))
    assert impact.impact_search(frame(spark, QUERIES, "query_id"), empty, 4).count() == 0


@pytest.mark.parametrize(("seed", "k"), [(1, 3), (2, 10)])
def test_impact_search_skips_blocks_and_loses_nothing(spark, monkeypatch, seed, k, tmp_path):
    monkeypatch.setattr(impact, "BLOCK", 6)
    monkeypatch.setattr(impact, "LEAD", 15)
    rng = np.random.default_rng(seed)
    words = [f"palabra{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, rng.integers(0, 40), p=share / share.sum())) for _ in range(150)] + ["palabra1 palabra1 palabra50"] * 12
    queries = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(25)]
    docs = frame(spark, texts, "doc_id").withColumn("grp", (F.col("doc_id") % 3).cast("string"))
    index = impact.build_impacts(docs, keep=("grp",), path=str(tmp_path / "index"))
    found = impact.impact_search(frame(spark, queries, "query_id"), index, k).collect()
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in found} == python_bm25(queries, texts, k)
    asked = frame(spark, queries, "query_id").withColumn("f", F.create_map(F.lit("grp"), F.when(F.col("query_id") % 2 == 0, "1").otherwise("")))
    plain = lexical.bm25_search(asked, lexical.build_index(docs, keep=("grp",)), k, filters="f", filter_columns=("grp",))
    same = impact.impact_search(asked, index, k, filters="f", filter_columns=("grp",))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, plain.collect()))


def test_query_without_tokens_has_no_hits(spark):
    index = lexical.build_index(frame(spark, TEXTS, "doc_id"))
    assert lexical.bm25_search(frame(spark, ["el de la", ""], "query_id"), index, 4).count() == 0


def test_index_is_stored_reused_and_invalidated(spark, tmp_path):
    path, docs = str(tmp_path / "index"), frame(spark, TEXTS, "doc_id")
    queries = frame(spark, QUERIES, "query_id")
    direct = lexical.bm25_search(queries, lexical.build_index(docs), 5).collect()
    assert sorted(lexical.bm25_search(queries, lexical.load_or_build(docs, path), 5).collect()) == sorted(direct)
    assert lexical.index_exists(spark, path)
    other = frame(spark, ["nada"], "doc_id")
    assert lexical.load_or_build(other, path).corpus.first()["n_docs"] == len(TEXTS)
    lexical.invalidate_index(spark, path)
    assert not lexical.index_exists(spark, path)
    assert lexical.load_or_build(other, path).corpus.first()["n_docs"] == 1


def test_filter_applies_before_ranking(spark):
    docs = frame(spark, TEXTS, "doc_id").withColumn("source", F.when(F.col("doc_id") > 2, "b").otherwise("a"))
    index = lexical.build_index(docs, keep=("source",))
    hits = lexical.bm25_search(frame(spark, ["gestión"], "query_id"), index, 2, where=lexical.stringly_filter({"source": "a"}))
    assert sorted(r["doc_id"] for r in hits.collect()) == [0, 1]


def vectors(spark, n, dim=8, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dim)).astype(np.float32)
    if copies:
        rows[-copies:] = rows[0]
    data = [(i, [float(x) for x in v], f"g{i % 3}") for i, v in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id bigint, embedding array<float>, grp string"), rows


def brute(queries, rows, k, allowed=None):
    found = set()
    for q, v in enumerate(queries):
        d = np.round(((rows.astype(float) - v.astype(float)) ** 2).sum(axis=1), 9)
        order = sorted((dist, i) for i, dist in enumerate(d) if allowed is None or allowed(q, i))
        found |= {(q, i, r) for r, (_, i) in enumerate(order[:k], 1)}
    return found


def ranked(df):
    return {(r["query_id"], r["doc_id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("block", [16_384, 7])
def test_knn_matches_brute_force_in_one_or_many_blocks(spark, block):
    docs, rows = vectors(spark, 300, copies=100)  # a third are copies of one vector
    asked = docs.filter("doc_id < 40").select(F.col("doc_id").alias("query_id"), "embedding")
    assert ranked(knn(asked, docs.repartition(5), 6, block=block)) == brute(rows[:40], rows, 6)


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_cells_exact_equals_knn_with_parts_and_filters(spark, monkeypatch, metric):
    monkeypatch.setattr(cells, "PART", 40)  # a cell with a third of all vectors in many parts
    monkeypatch.setattr(cells, "QUERY_PART", 15)
    docs, _ = vectors(spark, 300, copies=100)
    docs = docs.union(spark.createDataFrame([(500, [0.0] * docs.first()["embedding"].__len__(), "g1"), (501, None, "g2")], docs.schema))
    asked = docs.select(F.col("doc_id").alias("query_id"), "embedding", F.create_map(
        F.lit("grp"), F.when(F.col("doc_id") % 2 == 0, F.col("grp")).otherwise("")).alias("f"))
    index = cells.build_cells(docs, 12, keep=("grp",), metric=metric)
    assert index.vectors.count() == 301
    options = {"filters": "f", "filter_columns": ("grp",)}
    found = cells.knn_cells(asked, index, 6, 2, exact=True, **options)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, knn(asked, docs, 6, metric=metric, **options).collect()))


def test_cells_stored_and_recall_at_the_width_of_a_sample(spark, tmp_path):
    docs, _ = vectors(spark, 600)
    asked = docs.select(F.col("doc_id").alias("query_id"), "embedding")
    cells.build_cells(docs, path=str(tmp_path / "index"))
    index = cells.load_cells(spark, str(tmp_path / "index"))
    recalls = cells.width_recall(index, 10)
    width = cells.wide_enough(recalls)
    assert 1 <= width < index.cells.count()
    assert recalls.agg(F.max("recall")).first()[0] == 1.0
    hits = {r[:2] for r in map(tuple, cells.knn_cells(asked, index, 10, width).collect())}
    true = {r[:2] for r in map(tuple, knn(asked, docs, 10).collect())}
    assert len(hits & true) >= 0.9 * len(true)


def test_cells_of_an_empty_table(spark):
    docs, _ = vectors(spark, 9)
    asked = docs.select(F.col("doc_id").alias("query_id"), "embedding")
    index = cells.build_cells(docs.limit(0))
    assert cells.knn_cells(asked, index, 3, 2).count() == 0
    assert cells.knn_cells(asked, index, 3, 2, exact=True).count() == 0
    assert cells.wide_enough(cells.width_recall(index, 3)) == 1
    assert cells.knn_cells(asked.limit(0), cells.build_cells(docs), 3, 2).count() == 0
    with pytest.raises(ValueError):
        cells.build_cells(docs, cells.MOST_CELLS + 1)


def test_knn_without_queries_or_vectors(spark):
    docs, _ = vectors(spark, 9)
    asked = docs.select(F.col("doc_id").alias("query_id"), "embedding", F.create_map(F.lit("grp"), F.col("grp")).alias("f"))
    assert knn(asked.limit(0), docs, 3).count() == 0
    assert knn(asked, docs.limit(0), 3).count() == 0
    assert knn(asked.limit(0), docs, 3, filters="f", filter_columns=("grp",)).count() == 0
    assert knn(asked, docs.withColumn("grp", F.lit(None).cast("string")), 3, filters="f", filter_columns=("grp",)).count() == 0


def test_knn_filters_before_ranking(spark):
    docs, rows = vectors(spark, 90)
    asked = docs.select(F.col("doc_id").alias("query_id"), "embedding", F.create_map(
        F.lit("grp"), F.when(F.col("doc_id") % 2 == 0, F.col("grp")).otherwise("")).alias("f"))
    hits = knn(asked, docs, 4, filters="f", filter_columns=("grp",))
    assert ranked(hits) == brute(rows, rows, 4, lambda q, i: q % 2 == 1 or q % 3 == i % 3)


def test_knn_cosine_and_scores(spark):
    docs, rows = vectors(spark, 50)
    asked = docs.select(F.col("doc_id").alias("query_id"), "embedding")
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    expected = {(q, int(i)) for q in range(50) for i in np.argsort(1 - unit @ unit[q])[:3]}
    assert {(r[0], r[1]) for r in knn(asked, docs, 3, metric="cosine").select("query_id", "doc_id").collect()} == expected
    assert knn_scored(asked, docs, 1).filter("score < 1").count() == 0


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, doc_id string, rank int")


def test_fusion_laws(spark):
    a = lists(spark, [(1, "x", 1), (1, "y", 2), (1, "z", 3)])
    b = lists(spark, [(1, "y", 1), (1, "w", 2)])
    fused = {r["doc_id"]: (r["rank"], r["score"]) for r in rrf_fuse([a, b], 10).collect()}
    assert fused["y"][0] == 1 and fused["y"][1] == round(1 / 62 + 1 / 61, 6)
    assert fused["x"] == (2, round(1 / 61, 6))
    assert len(fused) == 4
    mirrored = {r["doc_id"]: r["score"] for r in rrf_fuse([b, a], 10).collect()}
    assert mirrored == {d: s for d, (_, s) in fused.items()}
    assert rrf_fuse([a, b], 2).count() == 2


def test_first_occurrence_keeps_list_order(spark):
    a, b = lists(spark, [(1, "x", 1), (1, "y", 2)]), lists(spark, [(1, "y", 1), (1, "z", 2)])
    assert [r["doc_id"] for r in first_occurrence([a, b]).orderBy("rank").collect()] == ["x", "y", "z"]


def test_hybrid_with_one_side_missing(spark):
    docs, _ = vectors(spark, 20)
    asked = docs.filter("doc_id < 3").select(F.col("doc_id").alias("query_id"), "embedding", F.lit("gestión").alias("text"))
    assert hybrid_search(asked, 5, vectors=docs).count() == 15
    assert hybrid_search(asked, 5, index=lexical.build_index(frame(spark, TEXTS, "doc_id"))).count() == 15


def test_hierarchical_without_summaries_is_plain(spark):
    docs, rows = vectors(spark, 30)
    details = docs.withColumn("article_number", F.lit("")).withColumn("page", F.lit(""))
    asked = docs.filter("doc_id < 5").select(F.col("doc_id").alias("query_id"), "embedding")
    assert ranked(hierarchical_search(asked, None, details)) == brute(rows[:5], rows, 8)


def test_link_parents_first_in_list_wins(spark):
    children = spark.createDataFrame(
        [("a", None, "s", "1", "9"), ("b", None, "s", "", "7"), ("c", "given", "s", "1", ""), ("d", None, "t", "1", "")],
        "doc_id string, parent_id string, source string, article_number string, section_number string")
    parents = spark.createDataFrame(
        [("p0", 0, "s", "5", "9"), ("p1", 1, "s", "1", "8"), ("p2", 2, "s", "1", "7")],
        "parent_id string, position int, source string, article_number string, section_number string")
    linked = {r["doc_id"]: r["parent_id"] for r in link_parents(children, parents).collect()}
    assert linked == {"a": "p0", "b": "p2", "c": "given", "d": None}


def test_parents_once_and_unknown_skipped(spark):
    hits = spark.createDataFrame([(1, "c1", 1, 0.9), (1, "c2", 2, 0.8), (1, "c3", 3, 0.7), (1, "c4", 4, 0.6)],
                                 "query_id bigint, doc_id string, rank int, score double")
    children = spark.createDataFrame([("c1", "p1", "s", 0), ("c2", "p1", "s", 1), ("c3", "gone", "s", 2), ("c4", "p2", "s", 3)],
                                     "doc_id string, parent_id string, source string, chunk_index int")
    parents = spark.createDataFrame([("p1", "uno"), ("p2", "dos")], "parent_id string, text string")
    rows = parents_of_hits(hits, children, parents, 5).orderBy("rank").collect()
    assert [(r["parent_id"], r["matched_child_chunk"], r["relevance_score"]) for r in rows] == [("p1", 0, 0.9), ("p2", 3, 0.6)]


def test_article_lookup_tiers(spark):
    chunks = spark.createDataFrame(
        [(1, [0.0, 1.0], "15.", "a.pdf", "uno", "3"), (2, [1.0, 0.0], "16", "a.pdf", "dos", "4")],
        "doc_id bigint, embedding array<float>, article_number string, source string, text string, page string")
    asked = spark.createDataFrame(
        [(1, "15", "", [1.0, 0.0]), (2, "99", "a.pdf", [1.0, 0.0]), (3, "15", "b.pdf", [1.0, 0.0])],
        "query_id bigint, article_number string, source string, embedding array<float>")
    rows = {r["query_id"]: (r["found"], r["content"]) for r in article_lookup(asked, chunks).collect()}
    assert rows == {1: (True, "uno"), 2: (True, "dos"), 3: (False, "")}


def test_routing_ties_go_to_the_first(spark):
    examples = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [0.0, 3.0])], "category string, embedding array<double>")
    centers = centroids(examples)
    assert {r["category"]: r["centroid"] for r in centers.collect()} == {"b": [1.0, 0.0], "a": [0.0, 2.0]}
    asked = spark.createDataFrame([([1.0, 1.0],), ([1.0, 0.1],)], "embedding array<double>")
    assert [r["category"] for r in semantic_route(asked, centers).collect()] == ["a", "b"]
    none = semantic_route(asked, centers.limit(0)).first()
    assert (none["category"], none["confidence"]) == ("general_query", 0.0)


def test_rerank_and_budget(spark):
    hits = spark.createDataFrame([(1, i, i, float(i)) for i in range(1, 8)] + [(2, i, i, float(i)) for i in range(1, 4)],
                                 "query_id bigint, doc_id bigint, rank int, s double")
    best = rerank(hits, F.col("s"), 2).filter("query_id = 1").orderBy("rank").collect()
    assert [(r["doc_id"], r["rerank_score"]) for r in best] == [(7, 7.0), (6, 6.0)]
    assert [r["doc_id"] for r in rerank(hits, None, 2).filter("query_id = 1").collect()] == [1, 2]
    kept = candidate_budget(hits, F.col("s"))
    assert {(r["query_id"], r["doc_id"]) for r in kept.collect()} == {(1, d) for d in (7, 6, 5, 4, 3)} | {(2, d) for d in (1, 2, 3)}


def test_evaluation(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    hits = lists(spark, [(1, "a", 1), (1, "b", 2), (2, "c", 1)])
    labels = spark.createDataFrame([(1, "b"), (2, "z")], "query_id bigint, doc_id string")
    row = evaluate_retrieval(asked, hits, labels).first()
    assert row.asDict() == {"total_queries": 3, "hit_rate": 0.3333, "mrr": 0.1667, "mean_docs_returned": 1.0}


def test_many_queries_plan_gives_the_same_hits(spark):
    index = lexical.build_index(frame(spark, TEXTS, "doc_id"))
    terms = lexical.query_terms(frame(spark, QUERIES, "query_id"))
    plans = [{"many": False}, {"many": True}, {"small": False}]
    few, many, large = (
        sorted(map(tuple, lexical.bm25_scores(terms, index, **p).select("query_id", "doc_id", F.round("_score", 9)).collect())) for p in plans)
    assert few == many == large and few


def test_rank_in_buckets_equals_plain_rank(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 31).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id")]
    plain = rank_in_list(df, ["k"], order).select("id", "rank")
    assert rank_in_list(df, ["k"], order, bucket=-F.floor(F.col("v") / 5)).select("id", "rank").exceptAll(plain).count() == 0
