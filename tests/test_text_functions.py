import pytest
from pyspark.sql import functions as F

from acervo.functions import answers, questions, replies
from acervo.functions.overlap import concat_dedup_overlap
from acervo.functions.splitter import SEPARATORS, split_text
from acervo.operators import chunking, pages, sheets
from acervo.operators.neighbours import neighbour_frame, neighbour_window


def python_fold(chunks, limit=220):
    text = chunks[0]
    for c in chunks[1:]:
        for n in range(min(limit, len(text), len(c)), 20, -1):
            if text[-n:] == c[:n]:
                text += c[n:]
                break
        else:
            text += "\n\n" + c
    return text


@pytest.mark.parametrize("chunks", [
    ["uno"],
    ["abc " * 20 + "x" * 30, "x" * 30 + " fin"],
    ["a" * 50, "a" * 40, "b"],
    ["corto", "corto y más"],
    ["0123456789abcdefghijKLMNO" + "zz" + "0123456789abcdefghijK", "0123456789abcdefghijKLMNO resto"],
    ["p" * 300, "p" * 300 + "q"],
])
def test_overlap_fold(spark, chunks):
    row = spark.createDataFrame([(chunks,)], "c array<string>").select(concat_dedup_overlap(F.col("c"))).first()
    assert row[0] == python_fold(chunks)


def test_split_covers_the_text_and_respects_the_size():
    text = "\n\n".join(" ".join(f"palabra{i}_{j}" for j in range(40)) for i in range(12))
    chunks = split_text(text, SEPARATORS["documentation"], 300, 60)
    assert all(len(c) <= 300 for c in chunks)
    assert all(any(w in c for c in chunks) for w in text.split())
    assert split_text("", SEPARATORS["policy"]) == []


def test_split_without_separator_cuts_characters():
    assert split_text("x" * 25, [" ", ""], 10, 2) == ["x" * 10, "x" * 10, "x" * 9]


def test_segments_start_at_headings(value):
    text = "Intro\n# Uno\ntexto\nCAPÍTULO II\nmás\nSección 3 x\nparte final"
    assert value(chunking.segment_by_headers("t"), t=text) == ["Intro", "\n# Uno\ntexto", "\nCAPÍTULO II\nmás", "\nSección 3 x", "\nparte final"]


def test_hierarchical_chunks(spark):
    body = "Texto del capítulo sobre seguridad. " * 6
    docs = spark.createDataFrame([(1, "d.pdf", f"CAPÍTULO I\n{body}\nCAPÍTULO II\n{body * 8}\n# corto")], "doc_id bigint, source string, text string")
    rows = chunking.hierarchical_chunk(docs).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and len(rows) > 2
    assert rows[0]["text"].startswith("[Fuente: d.pdf | Cap. I]\nCAPÍTULO I")
    assert all(r["meta"]["chunk_size"] == len(r["text"]) for r in rows)
    assert not any("# corto" == r["text"] for r in rows)


def test_adaptive_uses_given_type(spark):
    docs = spark.createDataFrame([("Cláusula primera. terms and conditions",)], "text string")
    detected = chunking.adaptive_chunk(docs).first()
    assert (detected["document_type"], detected["chunking_confidence"]) == ("contract", 1.0)
    assert chunking.adaptive_chunk(docs, document_type="policy").first()["document_type"] == "policy"


def test_markdown_sections(spark):
    text = "# A\n" + "a " * 30 + "\n## B\n" + "b " * 30 + "\n#### not a cut\n" + "c " * 10
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = [r["text"] for r in chunking.markdown_header_split(docs).orderBy("chunk_index").collect()]
    assert len(found) == 2 and found[0].startswith("# A") and "#### not a cut" in found[1]


@pytest.mark.parametrize("block", [1024, 3])
def test_neighbours_across_blocks(spark, block):
    rows = [("s", i, f"t{i}") for i in range(20)] + [("u", 0, "solo")]
    chunks = spark.createDataFrame(rows, "source string, chunk_index bigint, text string")
    framed = {(r["source"], r["chunk_index"]): r["neighbours"] for r in neighbour_frame(chunks, 2, block).collect()}
    assert framed[("s", 0)] == ["t0", "t1", "t2"] and framed[("s", 10)] == [f"t{i}" for i in range(8, 13)]
    assert len(framed) == 21 and framed[("u", 0)] == ["solo"]


def test_neighbour_window_flags(spark):
    chunks = spark.createDataFrame([("s", i, f"t{i}") for i in range(5)] + [("u", 0, "solo")], "source string, chunk_index bigint, text string")
    hits = chunks.filter("chunk_index = 0").unionByName(chunks.filter("chunk_index = 0"))
    rows = {r["source"]: r for r in neighbour_window(hits, chunks, 1).collect()}
    assert rows["s"]["text"] == "t0\n\nt1" and rows["s"]["context_enriched"] and rows["s"]["context_chunks_count"] == 2
    assert rows["u"]["text"] == "solo" and not rows["u"]["context_enriched"]


@pytest.mark.parametrize("query,kind", [
    ("¿Qué dice el artículo 5?", "simple"),
    ("diferencia artículo 5", "compound"),
    ("articulos 2.1 3.4", "compound"),
    ("palabra " * 31, "complex"),
    ("palabra " * 16, "simple"),
    ("yo " * 21, "compound"),
])
def test_complexity(value, query, kind):
    assert value(questions.assess_complexity("q"), q=query) == kind


@pytest.mark.parametrize("query,strategy", [("artículo 2.2.4 " + "x " * 30, "hybrid"), ("corta", "hybrid"), ("w " * 20, "full"), ("w " * 19, "hybrid")])
def test_strategy(value, query, strategy):
    assert value(questions.select_strategy("q"), q=query) == strategy


def test_variants_and_articles(value):
    assert value(questions.variant_set("a", "b", "c"), a="q", b="q", c="r") == ["q", "r"]
    assert value(questions.distinct_articles("q"), q="art. 15, 2.2.4 y 15 y 7") == ["15", "2.2.4"]


@pytest.mark.parametrize("score,n,mode", [(0.81, 2, "direct"), (0.8, 2, "rethinking"), (0.5, 2, "rethinking"), (0.49, 2, "rethinking_low_confidence"), (0.9, 0, "no_docs")])
def test_generation_mode(value, score, n, mode):
    assert value(answers.generation_mode("s", "n"), s=score, n=n) == mode


@pytest.mark.parametrize("quality,retries,route", [("correct", 0, ("generation", 0)), ("ambiguous", 0, ("retrieval", 1)), ("incorrect", 2, ("generation", 2))])
def test_grade_route(value, quality, retries, route):
    assert tuple(value(answers.grade_route("q", "r"), q=quality, r=retries)) == route


def test_validation(value):
    check = answers.validate_answer("a", "c")
    assert value(check, a="  ", c="x")["violations"] == ["Respuesta vacía"]
    assert value(check, a="Todo bien", c="x")["is_valid"]
    assert value(check, a="1. a\n9. b", c="1. a\n6. b")["confidence"] == 0.4
    assert value(check, a="1. a\n8. b", c="1. a\n6. b")["is_valid"]
    assert value(check, a="9. b", c="sin lista")["is_valid"]
    assert not value(check, a="No encontré información relevante pero además esto y aquello", c="")["is_valid"]
    assert value(check, a="No encontré información relevante.", c="")["is_valid"]
    assert value(check, a="En conclusión, sí", c="")["violations"][0].startswith("Conclusiones genéricas")


def test_sources(value):
    docs = F.array(*[F.struct(F.lit(s).alias("source"), F.lit("").alias("article_number"), F.lit("1").alias("page")) for s in ("a", "a", "b", "c")])
    named = value(answers.extract_sources("t", docs), t="Según el Artículo 5 y la sección 3.2, artículo 5.\nCapítulo Uno\n")
    assert [(s["type"], s["value"]) for s in named] == [("article", "5"), ("article", "5."), ("section", "3.2"), ("chapter", "Uno")]
    assert [s["value"] for s in value(answers.extract_sources("t", docs), t="nada")] == ["a", "b"]


def test_replies(value):
    assert value(replies.parse_batch_json("t"), t='x {"results":[{"chunk_id":0,"questions":["a"," "]}]} y') == {0: ["a"]}
    assert value(replies.parse_batch_json("t"), t="{bad") == {}
    assert value(replies.parse_fenced_json("t"), t='```json\n{"strategy":"full"}\n```')["strategy"] == "full"
    assert value(replies.parse_fenced_json("t"), t="nope")["strategy"] is None
    assert value(replies.parse_list_lines("t", F.lit("q")), t="1. primera cosa\n- segunda cosa\ncorta") == ["primera cosa", "segunda cosa"]
    assert value(replies.parse_list_lines("t", F.lit("q")), t="1. una sola línea") == ["q"]
    assert value(replies.parse_key_points("t", 2), t="- uno\nx\n• dos\n* tres") == ["uno", "dos"]
    duty = value(replies.parse_obligations("t"), t="- Obligacion: hacer: algo\ntexto")
    assert len(duty) == 1 and duty[0]["obligacion"] == "hacer: algo" and duty[0]["sancion"] == "no especificada"
    assert value(replies.parse_obligations("t"), t="libre")[0]["obligacion"] == "libre"


def test_ocr_lines(spark):
    box = lambda x, y: [[float(x), float(y)], [x + 10.0, float(y)], [x + 10.0, y + 10.0], [float(x), y + 10.0]]
    rows = [(1, 1, 1000.0, box(50, 100), "mundo", 0.9), (1, 1, 1000.0, box(5, 104), "hola", 0.9), (1, 1, 1000.0, box(5, 130), "fin", 0.5),
            (1, 1, 1000.0, box(5, 300), "ruido", 0.3), (1, 1, 1000.0, box(5, 400), "  ", 0.9)]
    boxes = spark.createDataFrame(rows, "doc_id int, page_no int, page_height double, bbox array<array<double>>, text string, conf double")
    assert pages.ocr_line_groups(boxes).first()["text"] == "hola mundo\nfin"


def test_pages_and_quality(spark):
    rows = [(1, 2, "dos", False), (1, 1, "uno", False), (1, 3, " \n", False), (1, 401, "fuera", False), (2, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, text string, has_fonts boolean")
    assert pages.stitch_pages(df).first()["pages_processed"] == 3
    stitched = pages.stitch_pages(df, max_pages=400).first()
    assert stitched["text"] == "[Página 1]\nuno\n\n[Página 2]\ndos" and stitched["pages_processed"] == 2
    quality = {r["doc_id"]: r for r in pages.text_quality(df).collect()}
    assert quality[2]["total_pages"] == 0 and quality[2]["avg_chars_per_page"] == 0.0 and quality[2]["is_scanned"]
    native = spark.createDataFrame([(3, 1, "x" * 200, True)], df.schema)
    row = pages.text_quality(native).first()
    assert row["is_native"] and row["confidence"] == 1.0 and row["quality_label"] == "native_high_confidence"


def test_sheets(spark):
    rows = [("Normativa", i, str(i) if i != 3 else None, "nan" if i == 2 else "SMLV") for i in range(1, 46)] + [("Vacía", 1, None, None)]
    df = spark.createDataFrame(rows, "sheet string, row_no int, `Artículo` string, `Sanción` string")
    columns = ["Artículo", "Sanción"]
    read = sheets.read_sheet(df, columns)
    assert read.select("sheet").distinct().count() == 1
    chunks = sheets.sheet_to_chunks(read, columns, F.lit("l.xlsx"), sheet_index=F.lit(2)).orderBy("chunk_index").collect()
    assert [c["chunk_index"] for c in chunks] == [2000, 2001, 2002]
    assert chunks[0]["text"].startswith("[Hoja: Normativa | Filas: 1–20 | Fuente: l.xlsx]\nArtículo: 1 | Sanción: SMLV\nArtículo: 2\nSanción: SMLV")
    assert chunks[2]["row_end"] == 45
    table = sheets.sheet_to_chunks(read, columns, F.lit("l.xlsx"), markdown=True).orderBy("chunk_index").first()["text"]
    assert "| Artículo | Sanción |\n| --- | --- |\n| 1 | SMLV |" in table
    assert sheets.read_sheet(df, columns, max_rows=5).count() == 5


def test_word_tables_and_blocks(spark):
    cells = spark.createDataFrame([([["a", "b"], ["1\n2", "3"]],), ([["solo", "x"]],), ([],)], "c array<array<string>>")
    assert [r[0] for r in cells.select(sheets.word_table(F.col("c"))).collect()] == ["| a | b |\n| --- | --- |\n| 1 2 | 3 |", "solo | x", ""]
    blocks = spark.createDataFrame([(1, 0, "Heading 1", "T"), (1, 1, "List Bullet", "i"), (1, 2, None, " "), (1, 3, "Normal", "p")],
                                   "doc_id int, block_no int, style string, text string")
    assert pages.docx_blocks_to_text(blocks).first()["text"] == "\n\nT\n\n  - i\np"
