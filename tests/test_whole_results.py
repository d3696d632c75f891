"""Nothing is lost: documents that share a source, long sheets and documents, zero vectors, repeated changes."""

import random
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from acervo.functions import classify
from acervo.operators import pages, sessions, sheets
from acervo.operators.hierarchy import hierarchical_search
from acervo.operators.lexical import build_index
from acervo.operators.models import _call
from acervo.operators.vector import knn
from acervo.plans.ingest import ingest
from acervo.plans.search import Corpus, hybrid_search_tool, search, semantic_search_tool


def test_documents_of_one_source_keep_their_chunks(spark):
    docs = spark.createDataFrame([(i, "same.md", f"Text of document {i}. " * (20 + i)) for i in range(12)], "doc_id long, source string, text string")
    snapshot, results = ingest(docs)
    again, _ = ingest(docs, snapshot)
    total = results.agg(F.sum("chunk_count")).first()[0]
    assert snapshot.count() == snapshot.select("id").distinct().count() == total == again.count()


def test_long_sheets_and_documents(spark):
    rows = spark.range(1, 10_501).select(F.lit("a").alias("sheet"), F.col("id").alias("row_no"), F.concat(F.lit("v"), "id").alias("c"))
    assert sheets.read_sheet(rows, ["c"]).count() == 10_500
    assert sheets.read_sheet(rows, ["c"], max_rows=100).count() == 100
    groups = sheets.row_groups(rows.filter("row_no % 3 = 0"), 20)
    ends = groups.filter("row_no = 10500").first()
    assert (ends["position"], ends["block"], ends["row_start"], ends["row_end"]) == (3500, 174, 3481, 3500)
    assert groups.filter("position <> row_no / 3").count() == 0
    book = spark.range(1, 901).select(F.lit(1).alias("doc_id"), F.col("id").alias("page_no"), F.lit("page").alias("text"))
    assert pages.stitch_pages(book).first()["pages_processed"] == 900
    assert pages.stitch_pages(book, max_pages=400).first()["pages_processed"] == 400


def test_cosine_with_zero_vectors(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.8, 0.6]), (4, [0.7, 0.714])], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["distance"], 1)) for r in knn(queries, vectors, 2, metric="cosine").collect()}
    assert got == {(1, 1): (3, 0.2), (1, 2): (4, 0.3), (2, 1): (1, 1.0), (2, 2): (2, 1.0)}


def test_type_of_real_archives(spark):
    kinds = {}
    for shift in range(4):
        made = BytesIO()
        with zipfile.ZipFile(made, "w") as z:
            z.writestr("pad", b"\x07" * shift + b"\x77\x6f\x72\x64")
            z.writestr("word/document.xml", "<w/>")
        kinds[shift] = spark.createDataFrame([(bytearray(made.getvalue()),)], "c binary").select(classify.detect_mime("c")["mime"].alias("m")).first()["m"]
    assert set(kinds.values()) == {classify.DOCX}


def test_profiles_keep_their_columns(spark):
    old = spark.createDataFrame([("1", "u", "a", "p", False), ("2", "v", "b", "q", False)], "id string, user_identifier string, preferred_profile string, custom_system_prompt string, is_active boolean")
    change = spark.createDataFrame([("u", "x", 1), ("u", "y", 2), ("w", "z", 1)], "user_identifier string, preferred_profile string, seq int")
    got = {r["user_identifier"]: tuple(r) for r in sessions.upsert_profiles(old, change).collect()}
    assert got == {"u": ("1", "u", "y", "p", True), "v": ("2", "v", "b", "q", False), "w": (None, "w", "z", None, True)}


def test_several_titles_give_one_session(spark):
    one = spark.createDataFrame([(1, "old", None, None)], "session_id long, title string, deleted_at timestamp, updated_at timestamp")
    titles = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "session_id long, new_title string, seq int")
    got = sessions.update_title(one, titles, F.current_timestamp()).collect()
    assert [r["title"] for r in got] == ["a"]


def test_hierarchical_search_is_full(spark):
    details = spark.createDataFrame([(i, [float(i), 0.0], "1" if i < 3 else "", "") for i in range(30)], "doc_id long, embedding array<double>, article_number string, page string")
    summaries = spark.createDataFrame([(900, [0.0, 0.0], "1", "")], "doc_id long, embedding array<double>, article_number string, page string")
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<double>")
    for k in (3, 8, 12):
        got = hierarchical_search(queries, summaries, details, k_chunks=k).orderBy("rank").collect()
        assert [r["doc_id"] for r in got] == list(range(k))


def test_tools_refuse_a_wrong_k():
    for tool in (semantic_search_tool, hybrid_search_tool):
        with pytest.raises(ValueError, match="top_k"):
            tool(None, Corpus(None), top_k=0)


@pytest.mark.parametrize("strategy", ["vector", "bm25", "hybrid", "hierarchical", "full"])
def test_every_strategy_takes_filters_of_single_queries(spark, strategy):
    rows = [(i, [float(i), 1.0], f"s{i % 3}", i, "word common" if i % 2 else "word rare", "1" if i < 6 else "", "") for i in range(24)]
    rows += [(i, [1000.0 + i, 1.0], "zz", i, "other text", "", "") for i in range(100, 160)]
    chunks = spark.createDataFrame(rows, "doc_id long, embedding array<double>, source string, chunk_index int, text string, article_number string, page string")
    summaries = spark.createDataFrame([(900, [0.0, 1.0], "1", "")], "doc_id long, embedding array<double>, article_number string, page string")
    corpus = Corpus(chunks, build_index(chunks, keep=("source",)), summaries)
    queries = spark.createDataFrame([(1, "word", [0.0, 1.0], {"source": "s1"}), (2, "word", [0.0, 1.0], {"source": ""}), (3, "word", [0.0, 1.0], {"source": "none"})],
                                    "query_id long, text string, embedding array<double>, filters map<string,string>")
    got = search(queries, corpus, strategy, k=6, filters="filters", filter_columns=("source",)).collect()
    hits = {q: {r["doc_id"] for r in got if r["query_id"] == q} for q in (1, 2, 3)}
    assert len(hits[1]) == 6 and all(d % 3 == 1 for d in hits[1])
    assert len(hits[2]) == 6 and {d % 3 for d in hits[2]} == {0, 1, 2}
    assert not hits[3]


def test_failing_prompts_keep_their_reason():
    calls = []

    def fn(prompts):
        calls.append(len(prompts))
        if "bad" in prompts:
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]

    prompts = [f"p{i}" for i in range(63)] + ["bad"]
    got = _call(fn, prompts)
    assert got[:63] == [(f"P{i}", None) for i in range(63)] and got[63] == (None, "RuntimeError: no answer")
    assert len(calls) == 13
    assert _call(lambda p: [], ["x"]) == [(None, "0 replies to 1 prompts")]


def test_histories_are_ordered(spark):
    logs = spark.createDataFrame([("a", 1, 5), ("a", 9, 6), ("b", 3, 1), ("a", 9, 7)], "session_id string, created_at int, id int")
    assert [r["id"] for r in sessions.history(logs, "query_logs").collect()] == [7, 6, 5, 1]


def test_sync_replaces_a_session(spark):
    schema = "session_id string, key string, value string, seq int"
    memory = spark.createDataFrame([("s", "k", "old", 1), ("s", "x", "gone", 2), ("t", "k", "stays", 1)], schema)
    got = sessions.sync_memory(memory, spark.createDataFrame([("s", "k", "new", 3), ("s", "k", "newer", 4)], schema))
    assert sorted(tuple(r) for r in got.collect()) == [("s", "k", "newer", 4), ("t", "k", "stays", 1)]


@pytest.mark.parametrize("slot", [5, 64])
def test_positions_of_sparse_and_uneven_row_numbers(spark, slot):
    rng = random.Random(slot)
    numbers = {"dense": range(200), "sparse": [i * 10**12 for i in range(150)], "uneven": [*range(120), 10**15, *range(10**9, 10**9 + 60)], "one": [7], None: [3, 1]}
    rows = [(sheet, n) for sheet, own in numbers.items() for n in own]
    rng.shuffle(rows)
    got = sheets.positions(spark.createDataFrame([*rows, ("dense", None)], "sheet string, row_no long"), slot).collect()
    for sheet, own in numbers.items():
        order = sorted(own) if sheet != "dense" else [None, *own]
        assert {(r["row_no"], r["position"], r["sheet_rows"]) for r in got if r["sheet"] == sheet} == {(n, i, len(order)) for i, n in enumerate(order, 1)}
