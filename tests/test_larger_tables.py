"""Tables as folders of files, and jobs whose steps keep their bounds as tables grow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from acervo.functions import replies, splitter
from acervo.operators import cells, fusion, hierarchy, impact, lexical, lookup, vector
from acervo.operators.vector import knn
from acervo.plans import search as plans
from acervo.streaming import jobs


@pytest.fixture
def folders(spark, tmp_path):
    """Writes a table as a folder of two files; the sf folder."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_ingest_stream_reads_a_folder_of_files(spark, folders):
    """F1."""
    sf = folders("documents", [(i, f"s{i % 2}", f"Text of document {i // 2}. " * 30) for i in range(8)], "doc_id long, source string, text string")
    got = queries()["ingest_stream"](spark, sf).collect()
    assert sum(r["ids"] for r in got) > 0 and all(r["ids"] == r["chunks"] for r in got)


def test_context_compaction_reads_a_folder_of_files(spark, folders):
    """F3."""
    sf = folders("conversations", [(c, t, "user", "x" * 600) for c in range(3) for t in range(6)], "conv_id long, turn long, role string, text string")
    got = {(r["session_id"], r["seq"], r["removed"]) for r in queries()["context_compaction"](spark, sf).collect()}
    assert got == {(c, seq, removed) for c in range(3) for seq, removed in ((4, "0"), (5, "1"))}


def test_context_compaction_takes_all_files_of_a_table_at_once(spark, folders, monkeypatch):
    """messages that lie in more files than a micro-batch takes are still met in the order of their turns."""
    monkeypatch.setitem(jobs.file_stream.__kwdefaults__, "per_trigger", 1)
    sf = folders("conversations", [(1, t, "user", "x" * 100 * (t + 1)) for t in range(12)], "conv_id long, turn long, role string, text string")
    got = {(r["seq"], r["estimated_tokens"], r["removed"]) for r in queries()["context_compaction"](spark, sf).collect()}
    assert got == {(5, 525, "0,1")} | {(t, 625 + 125 * (t - 6), str(t - 4)) for t in range(6, 12)}


def test_equal_lookups_are_asked_once(spark, monkeypatch):
    """the search is asked each article, source and vector once, and every request has its answer."""
    chunks = spark.createDataFrame([(i, [float(i), 1.0], str(i % 3), "s", f"t{i}", "1") for i in range(9)], "doc_id long, embedding array<double>, article_number string, source string, text string, page string")
    requests = spark.createDataFrame(
        [(i, ["1.", "2", None][i % 3], "", [7.0, 1.0]) for i in range(300)] + [(900, "1", "", None), (901, "1", "none", [7.0, 1.0])],
        "query_id long, article_number string, source string, embedding array<double>")
    asked = []
    monkeypatch.setattr(lookup, "knn", lambda queries, *rest, **options: asked.append(queries.count()) or knn(queries, *rest, **options))
    got = {r["query_id"]: (r["found"], r["content"]) for r in lookup.article_lookup(requests, chunks).collect()}
    assert asked == [2 * 4]
    assert got == {i: (True, ["t7", "t8", "t7"][i % 3]) for i in range(300)} | {900: (False, ""), 901: (False, "")}


def _points(spark, n, copies=1):
    return spark.createDataFrame([(i, [float(i // copies % 17), float(i // copies % 5)]) for i in range(n)], "doc_id long, embedding array<double>")


def test_vectors_are_read_once_for_all_blocks_of_queries(spark):
    """F9, F11."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    points = _points(spark, 60, copies=3)
    vectors = points.mapInPandas(counted, points.schema)
    asked = points.withColumnRenamed("doc_id", "query_id")
    got = knn(asked, vectors, 4, block=10).select("query_id", "doc_id", "rank").collect()
    assert read.value == 60
    assert sorted(map(tuple, got)) == sorted(map(tuple, knn(asked, points, 4).select("query_id", "doc_id", "rank").collect()))


def test_equal_vectors_are_compared_once():
    """a query meets k members of a group of copies, with the smallest ids."""
    rows, ids = np.ones((5000, 3)), np.arange(5000)[::-1]
    [(q, found, distances)] = vector._hits(np.zeros((1, 3)), np.array([0]), rows, ids, np.array([np.inf]), 5, "l2sq")
    assert sorted(found) == [0, 1, 2, 3, 4] and set(distances) == {3.0} and set(q) == {0}


def test_single_precision_loses_no_neighbour():
    """Limits are met exactly, also by vectors that nearly tie."""
    random = np.random.default_rng(5)
    rows = 100 + random.normal(size=(3000, 8)) * 1e-3
    queries = 100 + random.normal(size=(20, 8)) * 1e-3
    exact = np.round(((queries[:, None] - rows[None]) ** 2).sum(axis=2), vector.PLACES)
    limit = np.sort(exact, axis=1)[:, 9]
    pairs = {(q, r) for hits in vector._hits(queries, np.arange(20), rows, np.arange(3000), limit, 10, "l2sq") for q, r in zip(*hits[:2])}
    assert {(q, r) for q, r in zip(*np.nonzero(exact <= limit[:, None]))} <= pairs


def test_queries_go_to_their_cells_some_at_a_time(spark, monkeypatch):
    """a query that looks into every cell does not make one batch with a copy of its vector for each."""
    points = _points(spark, 85)
    index = cells.build_cells(points, 40)
    caught = []
    monkeypatch.setattr(cells, "PAIR_CELLS", 64, raising=False)
    monkeypatch.setattr(type(points), "mapInArrow", lambda frame, function, schema: caught.append((frame, function)))
    cells.cell_ranks(points.withColumnRenamed("doc_id", "query_id"), index)
    (frame, function), n = caught[-1], index.cells.count()
    sizes = [batch.num_rows for batch in function(iter(frame.toArrow().combine_chunks().to_batches()))]
    assert sum(sizes) == 85 * n and max(sizes) <= 64


def test_hierarchical_search_asks_pages_only_without_articles(spark, monkeypatch):
    """leads of one query with the same article ask once, and the page only where the article has no chunks."""
    details = spark.createDataFrame([(i, [float(i), 0.0], "1", "7") for i in range(20)], "doc_id long, embedding array<double>, article_number string, page string")
    summaries = spark.createDataFrame(
        [(100 + i, [float(i), 0.0], a, "7") for i, a in enumerate(["1", "1", "", "none"])], "doc_id long, embedding array<double>, article_number string, page string")
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<double>")
    asked = []
    monkeypatch.setattr(hierarchy, "knn", lambda q, *rest, **options: asked.append(q.count()) or knn(q, *rest, **options))
    got = hierarchy.hierarchical_search(queries, summaries, details).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(8))
    assert asked == [1, 1, 2, 1]


def test_scores_are_summed_in_tasks_of_bounded_size(spark, monkeypatch):
    """The tasks follow the pairs of queries and documents, not the bytes of the postings."""
    monkeypatch.setattr(lexical, "PAIRS", 100, raising=False)
    docs = spark.createDataFrame([(i, f"common word{i}") for i in range(50)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"common word{i}") for i in range(70)], "query_id long, text string")
    index = lexical.build_index(docs)
    scores = lexical.bm25_scores(lexical.query_terms(queries), index, many=70)
    assert scores.rdd.getNumPartitions() == 70 * 50 // 100
    blocks = impact.build_impacts(docs)
    asked = lexical.query_terms(queries).join(blocks.terms, "term").withColumn("weight", lexical.F.lit(1.0))
    assert impact._sums(asked, blocks, lexical.F.lit(True), []).rdd.getNumPartitions() == -(-(70 * 50 + 50) // 100)


def test_strategies_share_one_keyword_search(spark, monkeypatch):
    """the keywords are searched once for all strategies, which find what each finds on its own."""
    docs = [(i, [float(i % 17), 1.0], f"s{i % 3}", i, f"common word{i % 9}" + " rare" * (i % 4), "1" if i < 6 else "", str(i % 5)) for i in range(60)]
    chunks = spark.createDataFrame(docs, "doc_id long, embedding array<double>, source string, chunk_index int, text string, article_number string, page string")
    summaries = spark.createDataFrame([(900, [0.0, 1.0], "1", "")], "doc_id long, embedding array<double>, article_number string, page string")
    asked = [(i, f"common word{i}" + " rare" * i + (" more" * 20 if i % 2 else ""), [float(i), 2.0]) for i in range(6)]
    queries = spark.createDataFrame(asked, "query_id long, text string, embedding array<double>")
    corpus, names = plans.Corpus(chunks, lexical.build_index(chunks), summaries), ["vector", "bm25", "hybrid", "full", "auto"]
    listed = lambda hits: sorted(map(tuple, hits.select("query_id", "doc_id", "rank").collect()))
    expected = [listed(plans.search(queries, corpus, name, k=4)) for name in names]
    searched, found = [], []

    def counted(queries, index, k, **options):
        searched.append(k)
        return lexical.bm25_search(queries, index, k, **options)

    monkeypatch.setattr(plans, "bm25_search", counted)
    monkeypatch.setattr(fusion, "bm25_search", counted)
    plans.evaluate_strategies(queries, corpus, lambda hits: found.append(listed(hits)) or hits, names, k=4).collect()
    assert found == expected and searched == [4 * fusion.FETCH]


def test_a_reply_is_parsed_once(spark, folders):
    """the JSON of a reply is named at one place of the plan, so not once more for every chunk id or filter."""
    sf = folders("documents", [(i, "some letters") for i in range(10)], "doc_id long, text string")
    rows = queries()["parse_batch_json"](spark, sf)
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json(") == 1
    expected = {(i, 0, q) for i in range(10) for q in ("some letters", "b")} | {(i, 1, "c") for i in range(10)}
    assert {tuple(r) for r in rows.collect()} == {r for r in expected if r[0] % 5 != 4}


def test_the_last_entry_of_a_chunk_id_wins(value):
    """also among many ids, without comparing each with all."""
    entries = ",".join(f'{{"chunk_id": {i % 700}, "questions": ["{i}"]}}' for i in range(2000))
    found = value(replies.parse_batch_json("t"), t=f'{{"results": [{entries}]}}')
    assert found == {i: [str(i + 1400 if i < 600 else i + 700)] for i in range(700)}


def test_texts_are_split_some_at_a_time(spark, monkeypatch):
    """a batch of long texts is not put into Python whole, and every row keeps its chunks."""
    monkeypatch.setattr(splitter, "PART_BYTES", 2000, raising=False)
    texts = [None, "", *[f"word{i} " * (i % 90) for i in range(400)], "ñ" * 1500, None]
    separators, kinds = splitter.SEPARATORS["policy"], ["policy", None] * 202
    expected = [splitter.split_text(t, separators, 300, 60) for t in texts]
    pieces = [None if t is None else [t, "short"] for t in texts]
    for make, columns, rows in [
        (splitter.recursive_split(separators, 300, 60), pa.array(texts), expected),
        (splitter.recursive_split_by_type({"documentation": separators, "policy": separators}, 300, 60), (pa.array(texts), pa.array(kinds)), expected),
        (splitter.split_long_pieces(separators, 300, 60), pa.array(pieces), [
            [] if t is None else ([t] if len(t) <= 300 else found) + ["short"] for t, found in zip(texts, expected)]),
    ]:
        parts = list(make.func(iter([columns])))
        assert [row for part in parts for row in part.to_pylist()] == rows
        assert len(parts) > 20 and max(part.nbytes for part in parts) < 12_000


def test_leads_ask_for_no_more_chunks_than_they_give(spark, monkeypatch):
    """F5 of round 4: the chunks of an article or page are searched for a lead's share of the list, not for the whole list."""
    rows = [(i, [float(i), 0.0], str(i % 2), "7") for i in range(40)]
    details = spark.createDataFrame(rows, "doc_id long, embedding array<double>, article_number string, page string")
    queries = details.where("doc_id < 9").select(F.col("doc_id").alias("query_id"), "embedding")
    ks = []
    monkeypatch.setattr(hierarchy, "knn", lambda q, v, k, **options: ks.append(k) or knn(q, v, k, **options))
    assert hierarchy.hierarchical_search(queries, details, details).count() == 9 * 8
    assert ks == [8, 4, 2, 2]


def test_alike_queries_are_compared_once(spark):
    """F5 of round 4: queries with one vector and the same conditions are one row of a block, and each has its hits, ties included."""
    points = _points(spark, 60, copies=3).withColumn("grp", (F.col("doc_id") % 2).cast("string"))
    asked = points.select(F.col("doc_id").alias("query_id"), "embedding", F.create_map(F.lit("grp"), F.when(F.col("doc_id") % 4 > 1, F.col("grp"))).alias("f"))
    table = asked.select("query_id", "embedding", F.map_entries("f")).toArrow()
    block = vector._load_block(table)
    assert len(block.matrix) < 60 and block.sizes.sum() == 60 and sorted(block.ids.to_pylist()) == list(range(60))
    wanted = {}
    for q in points.collect():
        fits = [d for d in points.collect() if q["doc_id"] % 4 < 2 or d["grp"] == q["grp"]]
        wanted[q["doc_id"]] = [d["doc_id"] for d in sorted(fits, key=lambda d: (sum((a - b) ** 2 for a, b in zip(q["embedding"], d["embedding"])), d["doc_id"]))[:5]]
    for size in (None, 9):
        got = knn(asked, points, 5, filters="f", filter_columns=("grp",), block=size).orderBy("query_id", "rank").collect()
        assert {q: [r["doc_id"] for r in got if r["query_id"] == q] for q in range(60)} == wanted


def test_lookup_searches_one_tier_of_a_question(spark, monkeypatch):
    """F6 of round 4: a source alone is searched only where it has no chunk of the article; nulls and empty conditions as before."""
    chunks = spark.createDataFrame(
        [(i, [float(i), 1.0] if i else None, a, s, f"t{i}", "1") for i, (a, s) in enumerate([("9", "s"), ("1", "s"), ("2", "s"), (None, "r"), ("3", None), ("", "r")])],
        "doc_id long, embedding array<double>, article_number string, source string, text string, page string")
    asked = [("1", "s", 1), ("1.", "", 1), ("1", "r", 3), ("9", "s", 1), ("9", "", 1), (None, "r", 3), ("", "", 1), ("3", "", 4), ("3", "s", 1), ("2", "none", None)]
    requests = spark.createDataFrame([(i, a, s, [0.5, 1.0]) for i, (a, s, _) in enumerate(asked)], "query_id long, article_number string, source string, embedding array<double>")
    searched = []
    monkeypatch.setattr(lookup, "knn", lambda q, *rest, **options: searched.append(q.where("embedding is not null").count()) or knn(q, *rest, **options))
    got = {r["query_id"]: r["content"] for r in lookup.article_lookup(requests, chunks).collect()}
    assert got == {i: f"t{d}" if d is not None else "" for i, (_, _, d) in enumerate(asked)}
    assert searched == [10]  # one tier of each; before both, 20


def _cloud(spark, n, copies=0):
    random = np.random.default_rng(3)
    rows = random.normal(size=(n, 6))
    rows[:copies] = rows[0]
    return spark.createDataFrame([(i, row.tolist(), f"g{i % 3}") for i, row in enumerate(rows)], "doc_id long, embedding array<double>, grp string"), rows


def test_queries_of_cells_are_written_once(spark, monkeypatch):
    """F3 of round 4: a query is not written for each cell it looks into, and alike queries keep all their hits."""
    monkeypatch.setattr(cells, "QUERY_PART", 40)
    points, _ = _cloud(spark, 120, copies=30)
    written = []
    monkeypatch.setattr(cells, "query_blocks", lambda df, *rest: written.append(df.count()) or vector.query_blocks(df, *rest), raising=False)
    asked = points.withColumnRenamed("doc_id", "query_id")
    got = cells.knn_cells(asked, cells.build_cells(points, 20), 5, 3, exact=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn(asked, points, 5).collect()))
    assert written == [120]


def test_stored_cells_with_conditions_need_no_rows_per_cell(spark, tmp_path, monkeypatch):
    """F4 of round 4: exact search of a stored index under conditions, without a row for each query and cell."""
    monkeypatch.setattr(cells, "cell_ranks", None)
    points, _ = _cloud(spark, 90, copies=20)
    asked = points.select(F.col("doc_id").alias("query_id"), "embedding", F.create_map(F.lit("grp"), F.col("grp")).alias("f"))
    options = {"filters": "f", "filter_columns": ("grp",)}
    index = cells.build_cells(points, 9, keep=("grp",), path=str(tmp_path / "index"))
    got = cells.knn_cells(asked, index, 4, 2, exact=True, **options)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn(asked, points, 4, **options).collect()))


def test_width_search_meets_the_nearest_cells_only(spark, monkeypatch):
    """F2 of round 4: without ``exact`` a query meets all vectors of its ``width`` nearest cells and no others, and is no row per cell."""
    points, rows = _cloud(spark, 150)
    index = cells.build_cells(points, 12)
    asked = points.withColumnRenamed("doc_id", "query_id")
    looks = {(r["query_id"], r["cell"]) for r in cells.cell_ranks(asked, index, 4).collect()}
    own = {r["doc_id"]: r["cell"] for r in index.vectors.collect()}
    monkeypatch.setattr(cells, "cell_ranks", None)
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in cells.knn_cells(asked, index, 7, 4).collect()}
    wanted = {}
    for q in range(150):
        near = sorted((round(float(((rows[q] - rows[d]) ** 2).sum()), 9), d) for d in range(150) if (q, own[d]) in looks)
        wanted |= {(q, n): d for n, (_, d) in enumerate(near[:7], 1)}
    assert got == wanted
