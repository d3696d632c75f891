import datetime as dt

import pytest
from pyspark.sql import functions as F

from acervo.operators import logs, models, sessions as se
from acervo.operators.evaluate import rag_scores
from acervo.operators.filters import last_n_days, metadata_map_filter, paginate, validate_queries
from acervo.operators.vector import knn
from acervo.plans import answer, ingest
from acervo.plans.search import Corpus, multi_query_fusion, search
from acervo.sources import files, tables
from acervo.streaming import jobs

DAY = dt.datetime(2024, 1, 31)


def test_upsert_is_idempotent_and_last_arrival_wins(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, text string")
    new = spark.createDataFrame([("b", "2", 1), ("b", "3", 2), ("c", "1", 1)], "id string, text string, n int")
    once = tables.upsert(old, new, arrival=F.col("n")).select("id", "text")
    twice = tables.upsert(once, new, arrival=F.col("n")).select("id", "text")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", "1"), ("b", "3"), ("c", "1")]
    assert tables.upsert(old, old, dedup=False).count() == 4


def test_replace_table_reads_its_own_path(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    tables.replace_table(spark.read.parquet(path).filter("id < 3"), path)
    assert spark.read.parquet(path).count() == 3


def test_every_relational_table_round_trips(spark, tmp_path):
    for name in tables.SCHEMAS:
        rows = spark.createDataFrame([("x", DAY)], "id string, created_at timestamp")
        tables.append_table(rows, str(tmp_path), name)
        back = tables.read_table(spark, str(tmp_path), name)
        assert back.count() == 1 and back.first()["id"] == "x"


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "INDEX.md").write_text("índice")
    (tmp_path / "a" / "guia_api.md").write_text("x" * 600 + "tarde")
    (tmp_path / "a" / "otro.md").write_text("Habla de la API")
    (tmp_path / "vacio.txt").write_text(" \n")
    (tmp_path / "x.bin").write_bytes(b"\x00\x01")
    root = str(tmp_path)
    assert sorted(r[0] for r in files.search_text_files(spark, root, "Api").collect()) == ["a/guia_api.md", "a/otro.md"]
    assert files.search_text_files(spark, root, "tarde").count() == 0
    assert sorted(r[0] for r in files.list_text_files(spark, root).collect()) == ["a/guia_api.md", "a/otro.md"]
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in files.read_files(spark, root).collect()}
    assert rows["otro.md"]["success"] and rows["otro.md"]["text"] == "Habla de la API"
    assert not rows["vacio.txt"]["success"] and not rows["x.bin"]["success"] and len(rows) == 5
    expected = spark.createDataFrame([(f"file:{root}/a/otro.md",), (f"file:{root}/falta.md",)], "path string")
    checked = {r["path"].rsplit("/", 1)[-1]: r["success"] for r in files.read_files(spark, root, expected=expected).collect()}
    assert checked["otro.md"] and checked["falta.md"] is False and len(checked) == 6
    with pytest.raises(Exception):
        files.read_files(spark, root, stop_on_first_error=True).collect()


def log_rows(spark):
    rows = [(1, "hola", 0.9, 10.0, 1, False, DAY), (2, "Hola ", 0.5, 20.0, 2, True, DAY - dt.timedelta(days=1)),
            (3, "x", None, 5.0, 1, False, DAY), (4, "x", 0.8, 5.0, 1, False, DAY - dt.timedelta(days=40))]
    df = spark.createDataFrame(rows, "log_id int, query_text string, reflection_score double, total_time_ms double, iteration_count int, was_reformulated boolean, created_at timestamp")
    from acervo.functions.metadata import query_hash
    return df.withColumn("query_hash", query_hash("query_text")).withColumn("retrieval_strategy", F.lit("hybrid"))


def test_quality_metrics(spark):
    now = F.lit(DAY)
    row = logs.quality_metrics(log_rows(spark), now).first()
    assert (row["total_queries"], row["avg_reflection_score"], row["avg_iterations"], row["reformulated_pct"], row["low_score_pct"]) == (2, 0.7, 1.5, 50.0, 50.0)
    empty = logs.quality_metrics(log_rows(spark).limit(0), now).first()
    assert (empty["total_queries"], empty["avg_reflection_score"], empty["low_score_pct"]) == (0, 0.0, 0.0)
    assert last_n_days(log_rows(spark), 30, now).count() == 3


def test_similar_query(spark):
    asked = spark.createDataFrame([(" HOLA",), ("x",), ("nuevo",)], "query_text string")
    found = {r["query_text"]: r["log_id"] for r in logs.find_similar_query(asked, log_rows(spark)).collect()}
    assert found == {" HOLA": 1, "x": 4, "nuevo": None}


def test_paginate_and_validate(spark):
    page = paginate(spark.range(45), [F.col("id")], 20, 20).collect()
    assert [r["id"] for r in page] == list(range(20, 40)) and page[0]["has_more"] and page[0]["total"] == 45
    assert not paginate(spark.range(40), [F.col("id")], 20, 20).first()["has_more"]
    asked = spark.createDataFrame([("  hola ", 2), ("  ", 2), ("ab", 2), ("x" * 4001, 2), ("hola", 5)], "text string, max_iterations int")
    good, bad = validate_queries(asked)
    assert [r["text"] for r in good.collect()] == ["hola"]
    assert sorted(r["reason"] for r in bad.collect()) == ["blank", "max_iterations out of range", "too long", "too short"]


def test_map_filter(spark):
    rows = spark.createDataFrame([({"a": "1"}, {"a": "1", "b": ""}), ({"a": "1"}, {"a": "2"}), ({}, {"a": "1"}), ({}, {})], "m map<string,string>, f map<string,string>")
    assert [r[0] for r in rows.select(metadata_map_filter(F.col("m"), F.col("f"))).collect()] == [True, False, False, True]


def messages(spark, n, size=100):
    return spark.createDataFrame([(s, i, "human", "x" * size) for s in (1, 2) for i in range(n if s == 1 else 3)],
                                 "session_id bigint, seq bigint, role string, content string")


def test_context_window(spark):
    rows = se.keep_last_n(messages(spark, 20), 8, 400)
    assert sorted(r["seq"] for r in rows.filter("to_summarise").collect()) == list(range(12))
    assert se.keep_last_n(messages(spark, 8), 8, 10).filter("to_summarise").count() == 0
    assert se.keep_last_n(messages(spark, 20), 8, 500).filter("to_summarise").count() == 0
    text = se.format_messages(messages(spark, 2, 801)).filter("session_id = 1").first()["text"]
    assert text.split("\n")[0] == "HUMAN: " + "x" * 800 + "... [truncado]"
    pieces = se.format_messages(messages(spark, 20), 8).filter("session_id = 1").orderBy("piece").collect()
    assert sum(len(p["text"].split("\n")) for p in pieces) == 20 and len(pieces) == 3


def test_memory_clear_and_isolation(spark):
    rows = [("s", "save", "k", "1", 1), ("s", "save", "k", "2", 2), ("t", "save", "k", "9", 1), ("s", "clear", None, None, 3), ("s", "save", "j", "3", 4)]
    memory = se.session_memory(spark.createDataFrame(rows, "session_id string, op string, key string, value string, seq bigint"))
    assert {(r["session_id"], r["key"], r["value"]) for r in memory.collect()} == {("t", "k", "9"), ("s", "j", "3")}


def test_stream_memory_equals_batch_over_several_batches(spark, tmp_path):
    schema = "session_id string, op string, key string, value string, seq bigint"
    rows = [(f"s{i % 3}", "clear" if i % 7 == 6 else "save", None if i % 7 == 6 else f"k{i % 4}", None if i % 7 == 6 else str(i), i) for i in range(60)]
    source = str(tmp_path / "ops")
    for part in range(4):
        spark.createDataFrame(rows[part * 15:(part + 1) * 15], schema).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.file_stream(spark, schema, source, per_trigger=1)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    jobs.write_stream(jobs.session_memory_stream(stream), out, checkpoint).awaitTermination()
    streamed = jobs.memory_from_changes(spark.read.schema(jobs.MEMORY_OUTPUT).parquet(out))
    batch = se.session_memory(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_ingest_stream_drops_copies_and_merges(spark, tmp_path):
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "coll"), str(tmp_path / "cp")
    schema = "doc_id bigint, source string, text string, arrived_at timestamp"
    for rows in ([(1, "a", "Texto uno", DAY), (2, "b", "Texto dos", DAY)], [(3, "c", "Texto uno", DAY), (1, "a", "Texto nuevo", DAY)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # a second run finds nothing new
        jobs.ingest_stream(jobs.file_stream(spark, schema, source, per_trigger=1), out, checkpoint).awaitTermination()
    found = {r["id"]: r["text"] for r in jobs.ingested_chunks(spark, out).collect()}
    assert found == {"a::1::0": "Texto nuevo", "b::2::0": "Texto dos"}


def test_ingest_reports_each_document(spark):
    docs = spark.createDataFrame([(1, "a", "Un texto corto"), (2, "b", "  ")], "doc_id bigint, source string, text string")
    snapshot, results = ingest.ingest(docs)
    again, _ = ingest.ingest(docs, snapshot)
    assert snapshot.count() == again.count() == 1
    rows = {r["doc_id"]: r for r in results.collect()}
    assert rows[1]["success"] and not rows[2]["success"] and len(rows[2]["errors"]) == 1


def test_ingest_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Guía\nTexto de la guía")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    snapshot, results = ingest.ingest_files(spark, str(tmp_path))
    ids = [r["id"] for r in snapshot.collect()]  # source, document (its path), index
    assert len(ids) == 1 and ids[0].startswith("a.md::") and ids[0].endswith("a.md::0")
    rows = {r["path"].rsplit("/", 1)[-1]: (r["success"], len(r["errors"])) for r in results.collect()}
    assert rows == {"a.md": (True, 0), "b.pdf": (False, 1), "c.bin": (False, 1)}


def test_questions_belong_to_their_chunk(spark):
    chunks = spark.createDataFrame([(1, i, f"c{i}", f"1::{i}") for i in range(7)], "doc_id bigint, chunk_index bigint, text string, id string")

    def model(prompts):
        return ['{"results": [{"chunk_id": 1, "questions": ["q1", " ", "q2"]}, {"chunk_id": 99, "questions": ["no"]}]}' for _ in prompts]

    rows = ingest.explode_questions(chunks, model).collect()
    assert sorted((r["parent_chunk_index"], r["text"]) for r in rows) == [(1, "q1"), (1, "q2"), (6, "q1"), (6, "q2")]
    _, counts = ingest.augment_and_index(chunks, chunks.limit(0), model)
    assert counts.first().asDict() == {"original_chunks": 7, "questions_added": 4, "total_indexed": 11}


def test_model_map_falls_back_per_row(spark):
    def model(prompts):
        if any(p == "bad" for p in prompts):
            raise ValueError
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([("a",), ("bad",), ("b",)], "p string").coalesce(1)
    assert [r[0] for r in rows.select(models.model_map("p", model, F.lit("?"))).collect()] == ["A", "?", "B"]


def test_summaries(value):
    long = "\n".join(["línea " * 20] * 5)
    assert value(models.summarise("t"), t="corto") == "corto"
    assert value(models.summarise("t"), t=long) == "\n".join(long.split("\n")[:3])
    assert value(models.summarise("t", lambda ps: ["R"] * len(ps)), t=long) == "R"


def vector_table(spark, n=30):
    rows = [(i, [float(i), 1.0], "s", i, f"texto {i}", str(i % 3), "") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, embedding array<float>, source string, chunk_index bigint, text string, article_number string, page string")


def test_loop_stops_after_two_retries(spark):
    docs = vector_table(spark)
    asked = docs.filter("doc_id < 6").select(F.col("doc_id").alias("query_id"), "text", "embedding")
    rounds = []

    def run(queries):
        rounds.append(queries.count())
        return knn(queries, docs, 2)

    def grade(queries, hits):
        return queries.select("query_id", F.when(F.col("query_id") < 2 + F.col("retries"), 0.9).otherwise(0.4).alias("score"))

    rows, hits = answer.corrective_loop(asked, run, grade, lambda q: q)
    assert rounds == [6, 4, 3]
    assert {r["query_id"]: r["retries"] for r in rows.collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 2}
    assert hits.count() == 12


def test_search_strategies_and_variants(spark):
    docs = vector_table(spark)
    asked = docs.filter("doc_id < 3").select(F.col("doc_id").alias("query_id"), "text", "embedding")
    found = search(asked, Corpus(docs), "vector", k=4, reranking=True, score=F.length("text").cast("double"))
    assert found.groupBy("query_id").count().filter("count != 5 AND count != 4").count() == 0
    variants = asked.withColumn("variant_no", F.lit(0)).unionByName(asked.withColumn("variant_no", F.lit(1)))
    fused = multi_query_fusion(variants, Corpus(docs), "vector", window=1, k=3)
    assert fused.filter("variant_no = 1").count() == 0 and fused.count() == 9
    with pytest.raises(ValueError):
        search(asked, Corpus(docs), "other")


def test_answers_end_to_end(spark):
    queries = spark.createDataFrame([(1, "q", 0.9, 0, 2), (2, "q", 0.6, 0, 2), (3, "q", 0.2, 2, 2), (4, "q", 0.9, 0, 2)],
                                    "query_id bigint, text string, score double, iteration int, max_iterations int")
    documents = spark.createDataFrame([(i, 1, "s.pdf", "5", "", 0, "1", "texto") for i in (1, 2, 3)],
                                      "query_id bigint, rank int, source string, article_number string, section_number string, chunk_index int, page string, text string")

    def model(prompts):
        return ["En conclusión, sí" if "Pasajes" in p else "Artículo 7 dice" for p in prompts]

    rows = {r["query_id"]: r for r in answer.answer_batch(queries, documents, model).collect()}
    assert [rows[i]["mode"] for i in (1, 2, 3, 4)] == ["direct", "rethinking", "rethinking_low_confidence", "no_docs"]
    assert rows[1]["verdict"]["is_valid"] and rows[1]["sources"][0]["value"] == "7"
    assert rows[2]["reflection"]["route"] == "retrieval" and rows[2]["sources"][0]["value"] == "s.pdf"
    assert rows[3]["reflection"]["final_answer"].endswith("puede estar incompleta.") and "score: 0.20" in rows[3]["draft"]
    assert rows[4]["sources"] == []


def test_answers_are_retried_until_valid(spark, tmp_path):
    log = str(tmp_path / "prompts")
    queries = spark.createDataFrame([(1, "q1", 0.9), (2, "q2", 0.9), (3, "q3", 0.6), (4, "q4", 0.9)], "query_id bigint, text string, score double")
    body = spark.createDataFrame([(i, r, "s.pdf", "5", "", 0, "1", f"texto {r}") for i in (1, 2, 3) for r in (1, 2, 3)],
                                 "query_id bigint, rank int, source string, article_number string, section_number string, chunk_index int, page string, text string")

    def model(prompts):
        with open(log, "a") as f:
            f.writelines(p.replace("\n", " ") + "\n" for p in prompts)
        return ["Artículo 7 dice" if "q1" in p or "mejor mejor" in p and "q2" in p else "En conclusión, sí" for p in prompts]

    searched = []

    def search(rows):
        searched.append(sorted(r["query_id"] for r in rows.collect()))
        return body.join(rows.select("query_id"), "query_id", "left_semi")

    better = lambda rows: rows.withColumn("text", F.concat("text", F.lit(" mejor")))
    got = {r["query_id"]: r for r in answer.answer_until_valid(queries, search, model, better, k=2).collect()}
    assert searched == [[1, 2, 3, 4], [2, 3], [2, 3]] or searched == [[1, 2, 3, 4], [2, 3, 4], [2, 3, 4]]
    assert {i: got[i]["iteration_count"] for i in (1, 2, 3)} == {1: 1, 2: 3, 3: 3}
    assert got[2]["answer"] == "Artículo 7 dice" and got[3]["answer"].endswith("puede estar incompleta.")
    prompts = open(log).read().splitlines()
    assert len(prompts) == len(set(prompts))  # each reaches the model once
    assert not any("texto 3" in p for p in prompts) and got[1]["n_docs"] == 2


def test_rag_scores(spark):
    rows = spark.createDataFrame([("qué es esto aquí", "esto es aquí", ["esto no es", "nada más"]), ("x", "", [])], "question string, answer string, contexts array<string>")
    first, second = rag_scores(rows).collect()
    assert (first["faithfulness"], first["answer_relevancy"], first["context_precision"]) == (0.667, 1.0, 0.5)
    assert (second["faithfulness"], second["context_precision"]) == (0.0, 0.0)


def test_running_counters_cross_slots(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base + dt.timedelta(minutes=20 * i), i, 1, i % 2) for i in range(12)]
    changes = spark.createDataFrame(rows, "session_id bigint, created_at timestamp, change_id bigint, messages bigint, documents bigint")
    found = se.session_counters(changes).orderBy("change_id").collect()
    assert [r["total_messages"] for r in found] == list(range(1, 13))
    assert [r["total_documents"] for r in found] == [sum(j % 2 for j in range(i + 1)) for i in range(12)]


def test_compaction_events(spark, tmp_path):
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "session_id bigint, seq bigint, role string, content string"
    for part in range(2):
        rows = [(s, i, "human", "x" * 40) for s in (1, 2) for i in range(part * 6, part * 6 + (6 if s == 1 else 1))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    events = jobs.compaction_stream(jobs.file_stream(spark, schema, source, per_trigger=1), keep=3, threshold=50)
    jobs.write_stream(events, out, checkpoint).awaitTermination()
    rows = spark.read.schema(jobs.COMPACTION_OUTPUT).parquet(out).orderBy("seq").collect()
    # 10 tokens a message: the sixth passes 50 and leaves 3; three more make 60 again, and so on
    assert [(r["session_id"], r["seq"], r["removed"]) for r in rows] == [("1", 5, [0, 1, 2]), ("1", 8, [3, 4, 5]), ("1", 11, [6, 7, 8])]


def test_memory_updates_over_five_batches_equal_the_batch_result(spark, tmp_path):
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "session_id string, op string, key string, value string, seq bigint"
    rows = [(f"s{i % 3}", "clear" if i % 17 == 5 else "save", None if i % 17 == 5 else f"k{i % 4}", None if i % 11 == 0 else f"v{i}", i) for i in range(100)]
    rows[20:60] = reversed(rows[20:60])  # late operations
    for part in range(5):
        spark.createDataFrame(rows[part::5] if part % 2 else rows[part::5][::-1], schema).coalesce(1).write.mode("append").parquet(source)
    changes = jobs.session_memory_updates(jobs.file_stream(spark, schema, source, per_trigger=1))
    jobs.write_updates(changes, out, checkpoint).awaitTermination()
    assert spark.read.parquet(f"{out}/*").select("batch_id").distinct().count() == 5
    streamed = jobs.memory_from_changes(spark.read.schema(jobs.MEMORY_OUTPUT).parquet(f"{out}/*"))
    batch = se.session_memory(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.select(streamed.columns).collect()))


def test_plugged_models(spark):
    import numpy as np

    rows = spark.createDataFrame([("ab", "abc"), ("x", "y")], "a string, b string")
    vec = models.embed(lambda texts: np.array([[len(t), 1.0] for t in texts]))
    pair = models.score_pair(lambda qs, ts: [len(q) / len(t) for q, t in zip(qs, ts)])
    assert [tuple(r) for r in rows.select(vec("a"), F.round(pair("a", "b"), 3)).collect()] == [([2.0, 1.0], 0.667), ([1.0, 1.0], 1.0)]
    size = rows.select(models.hashed_embedding("b", 16).alias("e")).first()["e"]
    assert len(size) == 16 and abs(sum(x * x for x in size) - 1.0) < 1e-6


def test_keys_and_deletes_over_the_relational_tables(spark, tmp_path):
    root = str(tmp_path / "tables")
    given = {
        "sessions": [("1",), ("2",), ("2",)], "messages": [("m1", "1"), ("m2", "2"), ("m3", None)], "documents": [("d1", "1"), ("d2", "9")],
        "chunks": [("c1", "d1"), ("c2", "d2"), ("c3", "none")], "query_logs": [("q1", "1", "m1"), ("q2", "2", "m1"), ("q3", None, "m9")],
        "reflection_logs": [], "user_profiles": [], "session_memory": [("s1", "1", "k"), ("s2", "1", "k"), ("s3", "2", None), ("s4", "2", None)],
    }
    columns = {"messages": "id, session_id", "documents": "id, session_id", "chunks": "id, document_id", "query_logs": "id, session_id, message_id", "session_memory": "id, session_id, key"}
    for name, rows in given.items():
        ddl = ", ".join(f"{c} string" for c in columns.get(name, "id").split(", "))
        tables.append_table(spark.createDataFrame(rows, ddl).withColumn("created_at", F.lit(DAY)), root, name)
    found = {(r["table_name"], r["constraint"]): r["violations"] for r in tables.key_violations(spark, root).collect() if r["violations"]}
    assert found == {("sessions", "unique id"): 1, ("documents", "session_id in sessions"): 1, ("chunks", "document_id in documents"): 1,
                     ("query_logs", "message_id in messages"): 1, ("session_memory", "unique session_id, key"): 1}
    after = tables.delete_rows(spark, root, "sessions", spark.createDataFrame([("1",), ("77",)], "id string"))
    ids = {name: sorted(r["id"] for r in rows.collect()) for name, rows in after.items()}
    assert ids == {"sessions": ["2", "2"], "messages": ["m2", "m3"], "documents": ["d1", "d2"], "query_logs": ["q1", "q2", "q3"], "reflection_logs": [], "session_memory": ["s3", "s4"]}
    logs_after = {r["id"]: (r["session_id"], r["message_id"]) for r in after["query_logs"].collect()}
    assert logs_after == {"q1": (None, None), "q2": ("2", None), "q3": (None, "m9")}
