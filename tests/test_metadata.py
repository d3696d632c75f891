import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from acervo.functions import classify, metadata
from acervo.functions.text import WHITESPACE, trim_ws, word_count


def test_fields_of_a_legal_text(value, legal_text):
    meta = value(metadata.extract_metadata("t", source=F.lit("d.pdf"), chunk_index=F.lit(4)), t=legal_text)
    assert meta["page"] == "3"
    assert meta["article_number"] == "2.2.4.6.1."
    assert meta["chapter"] == "II – OBLIGACIONES"
    assert meta["section"] == "4"
    assert meta["paragraph"] == "2"
    assert (meta["document_type"], meta["document_number"], meta["document_year"]) == ("decreto", "1072", "2015")
    assert meta["article_title"].startswith("Objeto y campo")
    assert meta["chunk_size"] == len(legal_text)


@pytest.mark.parametrize("text,number,key", [
    ("Artículo 15° Objeto", "15", "15"),
    ("ARTÍCULO ÚNICO. x", "ÚNICO", "ÚNICO"),
    ("artículo 2.2.4.", "2.2.4.", "2.2.4"),
    ("sin nada", "", ""),
])
def test_article_number(value, text, number, key):
    assert value(metadata.extract_article_number("t"), t=text) == number
    assert value(metadata.article_key(metadata.extract_article_number("t")), t=text) == key


def test_paragraph_without_number(value):
    assert value(metadata.extract_paragraph("t"), t="Parágrafo. Nada") == "1"
    assert value(metadata.extract_paragraph("t"), t="nada") == ""


def test_header(value, legal_text):
    meta = metadata.extract_metadata("t", source=F.lit("d.pdf"))
    assert value(metadata.contextual_header(meta), t=legal_text) == "[Fuente: d.pdf | Art. 2.2.4.6.1. | Página: 3 | Decreto 2015]\n"
    assert value(metadata.contextual_header(metadata.extract_metadata("t")), t="nada") == ""


def test_ids(value):
    assert value(metadata.chunk_id(F.lit("a b/c.pdf"), F.lit(3), "t"), t="x") == "a_b_c.pdf::3"
    assert value(metadata.chunk_id(F.lit(""), F.lit(3), "t"), t="x") == hashlib.md5(b"x").hexdigest()
    assert value(metadata.chunk_id(F.lit("a.pdf"), F.lit(3), "t", F.lit(9)), t="x") == "a.pdf::9::3"
    long = [value(metadata.chunk_id(F.lit("s" * 600 + end), F.lit(3), "t"), t="x") for end in "ab"]
    assert len(set(long)) == 2 and all(len(i) == 512 for i in long)
    text = "ñandú " * 60
    none = F.lit(None).cast("string")
    made = value(metadata.parent_id(none, none, F.lit(""), F.lit(1), "t"), t=text)
    assert made == str(uuid.uuid5(uuid.NAMESPACE_URL, text))
    made = value(metadata.parent_id(none, none, F.lit(""), F.lit(1), "t", prefix=200), t=text)
    assert made == str(uuid.uuid5(uuid.NAMESPACE_URL, text[:200]))
    assert value(metadata.parent_id(none, none, F.lit("s"), F.lit(1), "t"), t=text) == "s::chunk_1"
    assert value(metadata.parent_id(F.lit("p"), none, F.lit("s"), F.lit(1), "t"), t=text) == "p"


def test_query_hash_ignores_case_and_outer_space(value):
    assert value(metadata.query_hash("t"), t="  Hola Ñ ") == hashlib.md5("hola ñ".encode()).hexdigest()


def test_reformulated(value):
    assert value(metadata.was_reformulated("q", "a"), q="x", a=" x ") is False
    assert value(metadata.was_reformulated("q", "a"), q="x", a="y") is True
    assert value(metadata.was_reformulated("q", "a"), q="x", a=None) is False


def test_trim_and_words_follow_python(value):
    text = WHITESPACE + "uno dos  tres" + WHITESPACE
    assert value(trim_ws("t"), t=text) == text.strip()
    assert value(word_count("t"), t=text) == len(text.split())


@pytest.mark.parametrize("text,kind,confidence", [
    ("The endpoint takes a request body. Response 200. API key.", "api_docs", 1.0),
    ("Cláusula primera: terms and conditions. The parties agree.", "contract", 1.0),
    ("def run returns", "documentation", 1.0),
    ("hello", "standard", 0.0),
    ("endpoint microservice", "api_docs", 0.5),
])
def test_document_type(value, text, kind, confidence):
    found = value(classify.detect_document_type("t"), t=text)
    assert (found["doc_type"], found["confidence"]) == (kind, confidence)


def test_at_most_three_matches_per_pattern_count(value):
    found = value(classify.detect_document_type("t"), t="endpoint " * 9 + "microservice")
    assert found["confidence"] == 0.75 and found["indicators"] == ["endpoint"] * 3


def test_type_of_the_whole_text(value):
    text = "x" * 3000 + " endpoint " * 9 + "microservice"
    assert value(classify.detect_document_type("t"), t=text)["doc_type"] == "standard"
    found = value(classify.detect_document_type("t", sample_chars=None, matches=None), t=text)
    assert found["confidence"] == 0.9 and found["indicators"] == ["endpoint"] * 9


def test_search_of_the_whole_text(spark):
    from acervo.sources import files

    rows = spark.createDataFrame([("a/n.md", "x" * 600 + " Late")], "path string, text string")
    assert files.search_texts(rows, "late").count() == 0 and files.search_texts(rows, "late", sample_chars=None).count() == 1


@pytest.mark.parametrize("content,mime,supported", [
    (b"%PDF-1.7 x", "application/pdf", True),
    (b"PK\x03\x04....word/document.xml", classify.DOCX, True),
    (b"PK\x03\x04....xl/workbook.xml", classify.XLSX, True),
    (b"PK\x03\x04....other", "application/zip", False),
    (b"\xff\xd8\xff\xe0", "image/jpeg", True),
    (b"\x89PNG\r\n\x1a\n", "image/png", True),
    (b"II*\x00", "image/tiff", True),
    (b"RIFF\x00\x00\x00\x00WEBP", "image/webp", True),
    (b"BM..", "image/bmp", True),
    (b"hello", "application/octet-stream", False),
])
def test_mime(spark, content, mime, supported):
    found = spark.createDataFrame([(bytearray(content),)], "c binary").select(classify.detect_mime("c").alias("m")).first()["m"]
    assert (found["mime"], found["is_supported"]) == (mime, supported)


def test_loader_rules_go_by_priority(spark):
    mime = classify.mime_info(F.col("m"))
    quality = F.struct(F.col("n").alias("is_native"), F.col("p").alias("total_pages"))
    when = classify.loader_conditions(mime, quality)
    rules = [classify.LoaderRule("any", when["any_pdf"], 1), classify.LoaderRule("long", when["complex_pdf"], 9)]
    rows = spark.createDataFrame(
        [("application/pdf; x", True, 60), ("application/pdf", True, 50), ("image/png", None, None)], "m string, n boolean, p int")
    assert [r[0] for r in rows.select(classify.route_loader(rules)).collect()] == ["long", "any", None]
