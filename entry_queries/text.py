"""Cleaning, metadata, typing, tokens, chunking, replies, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.functions import answers, classify, cleaning, metadata, questions, replies
from acervo.functions.overlap import concat_dedup_overlap
from acervo.functions.splitter import HIERARCHICAL, recursive_split
from acervo.functions.text import preview
from acervo.functions.tokens import normalizer, tokenize
from acervo.operators import chunking
from acervo.operators.evaluate import build_context, grading_prompt, rag_means, rag_scores
from acervo.operators.models import hashed_embedding, model_map, score_pair, summary_rows
from acervo.plans.ingest import batch_prompts, explode_questions, prepare_chunks
from entry_queries.inputs import (
    LEGAL_CTE, LINES_CTE, P, documents, legal_chunks, line_chunks, noisy, noisy_documents, sql_noisy, sql_tokens, table,
    text_queries,
)
from entry_queries.registry import query

W = r"[\p{L}\p{N}_]"  # \w for Unicode text in RE2
WS_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# RE2 forms of the cleaning rules: (pattern, replacement); None where RE2 has no equal.
RULE_SQL = {
    cleaning.LINE_ENDINGS: (r"\r\n?", r"\n"),
    cleaning.BLANK_LINES: (r"\n{3,}", r"\n\n"),
    cleaning.TRAILING_SPACE: (r"(?m)[ \t]+$", ""),
    cleaning.BROKEN_WORDS: (rf"({W})-\n({W})", r"\1\2"),
    cleaning.SPACES: (r" {2,}", " "),
    cleaning.CONTROL_CHARS: (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
    cleaning.PAGE_NUMBERS: (r"(?m)^\s*[-–—]?\s*\d+\s*[-–—]?\s*$", ""),
    cleaning.CODE_BLOCKS: (r"\n```[a-z]*\n", r"\n```"),
    cleaning.HEADING_SPACING: (r"\n(#{1,6})\s+", r"\n\1 "),
    cleaning.OCR_SYMBOLS: (r"[|¡£¢§¦¨©ª«¬­®¯°±²³´µ¶·¸¹º»¼½¾¿]", ""),
    cleaning.LOWERCASE_LINES: (r"\n\s*([a-z])", r" \1"),
    cleaning.CLAUSE_SPACING: (rf"(?i)(CL[AÁ]USULA|PAR[AÁ]GRAFO|ANEXO)\s*({W}+)", r"\1 \2"),
}


def sql_rule(rule: cleaning.Rule, text: str) -> str:
    if rule is cleaning.OCR_L:  # no look-around in RE2: neighbours are put back, and a second pass takes "l l"
        for _ in range(2):
            text = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}_])l($|[^\\p{{L}}\\p{{N}}_])', '\\11\\2', 'g')"
        return text
    if rule is cleaning.REPEATED_LETTERS:  # no back-reference in RE2: one replacement per letter
        for letter in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
            text = f"regexp_replace({text}, '{letter}{{5,}}', '{letter}', 'g')"
        return text
    pattern, put = RULE_SQL[rule]
    put = "chr(10) || " * put.count(r"\n") + "'" + put.replace(r"\n", "") + "'"
    return f"regexp_replace({text}, '{pattern}', {put}, 'g')"


def _rule_query(rule: cleaning.Rule) -> None:
    sql = None
    if rule in RULE_SQL or rule in (cleaning.REPEATED_LETTERS, cleaning.OCR_L):
        done = sql_rule(rule, "t")
        sql = f"WITH n AS (SELECT doc_id, {sql_noisy()} AS t FROM documents) SELECT doc_id, md5({done}) AS cleaned, length({done}) AS size FROM n"

    @query(f"clean_{rule.name}", sql)
    def run(spark, sf, rule=rule):
        done = noisy_documents(spark, sf).withColumn("text", cleaning.apply_rule("text", rule))
        return done.select("doc_id", F.md5("text").alias("cleaned"), F.length("text").cast("long").alias("size"))


for _rule in [*cleaning.UNIVERSAL, *{r.name: r for rules in cleaning.PROFILES.values() for r in rules}.values()]:
    _rule_query(_rule)


def _technical_sql() -> str:
    text = "t"
    for rule in [*cleaning.UNIVERSAL, *cleaning.PROFILES["technical"]]:
        text = sql_rule(rule, text)
    return f"WITH n AS (SELECT doc_id, {sql_noisy()} AS t FROM documents), c AS (SELECT doc_id, trim({text}, {WS_TRIM}) AS c FROM n) SELECT doc_id, md5(c) AS cleaned, length(c) AS size FROM c"


@query("clean_technical", _technical_sql())
def clean_technical(spark, sf):
    """C16 with one profile."""
    done = noisy_documents(spark, sf).withColumn("text", cleaning.clean("text", "technical"))
    return done.select("doc_id", F.md5("text").alias("cleaned"), F.length("text").cast("long").alias("size"))


_PROFILE_OF_LANG = {"en": "technical", "es": "contract", "fr": "ocr_output", "de": "default"}


@query("clean_by_profile")
def clean_by_profile(spark, sf):
    """C16 with a profile per row."""
    names = F.create_map(*[F.lit(x) for pair in _PROFILE_OF_LANG.items() for x in pair])
    docs = noisy_documents(spark, sf).withColumn("profile", F.try_element_at(names, "lang"))
    done = docs.withColumn("text", cleaning.clean("text", F.col("profile")))
    return done.select("doc_id", "profile", F.md5("text").alias("cleaned"), F.length("text").cast("long").alias("size"))


@query(
    "clean_custom_rule",
    "SELECT doc_id, md5(regexp_replace(text, '[0-9]{4,}', '#', 'g')) AS cleaned FROM documents",
)
def clean_custom(spark, sf):
    """A rule of the user's own; a disabled one does nothing."""
    rules = [cleaning.Rule("long_numbers", r"[0-9]{4,}", "#"), cleaning.Rule("off", "a", "b", enabled=False)]
    return documents(spark, sf).select("doc_id", F.md5(cleaning.apply_rules("text", rules)).alias("cleaned"))


# ── Metadata ──────────────────────────────────────────────────────────────────

_KEY = ["order_id", "chunk_index", "part_id"]
_ART = r"'ART[ÍI]CULO\s+([\d\.]+(?:\s*°)?|ÚNICO|PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO)'"
_FIELDS_SQL = {
    "page": r"regexp_extract(text, '\[Página\s*(\d+)\]', 1, 'i')",
    "article_number": rf"trim(rtrim(trim(regexp_extract(text, {_ART}, 1, 'i')), '°'))",
    "article_title": r"substring(regexp_replace(trim(regexp_extract(text, 'ARTÍCULO\s+[\d\.]+[°\s]+[\.–\-]?\s*([^\n\.]{5,80})', 1, 'i')), '^[\.–\-\s]+', ''), 1, 100)",
    "chapter": r"trim(regexp_extract(text, 'CAPÍTULO\s+([IVXivx\d]+(?:\s*[–\-]\s*[A-ZÁÉÍÓÚ][^\n]{0,60})?)', 1, 'i'))",
    "section": r"trim(regexp_extract(text, 'SECCIÓN\s+([\d]+(?:\s*[–\-]\s*[A-ZÁÉÍÓÚ][^\n]{0,60})?)', 1, 'i'))",
    "paragraph": r"CASE WHEN regexp_matches(text, 'PARÁGRAFO\s*(\d*)', 'i') THEN coalesce(nullif(regexp_extract(text, 'PARÁGRAFO\s*(\d*)', 1, 'i'), ''), '1') ELSE '' END",
}


def _kind_sql(part: int) -> str:
    cases = ""
    for kind, pattern in metadata.DOCUMENT_KINDS.items():
        value = f"'{kind}'" if part == 0 else f"regexp_extract(text, '{pattern}', {part}, 'i')"
        cases += f" WHEN regexp_matches(text, '{pattern}', 'i') THEN {value}"
    return f"CASE{cases} ELSE '' END"


_FIELDS_SQL |= {"document_type": _kind_sql(0), "document_number": _kind_sql(1), "document_year": _kind_sql(2)}


def _fields_sql(*names: str) -> str:
    return f"WITH {LEGAL_CTE} SELECT order_id, chunk_index, part_id, {', '.join(f'{_FIELDS_SQL[n]} AS {n}' for n in names)} FROM legal"


@query("extract_page", _fields_sql("page"))
def page(spark, sf):
    """P1."""
    return legal_chunks(spark, sf).select(*_KEY, metadata.extract_page("text").alias("page"))


@query("extract_article_number", _fields_sql("article_number"))
def article_number(spark, sf):
    """P2."""
    return legal_chunks(spark, sf).select(*_KEY, metadata.extract_article_number("text").alias("article_number"))


@query("extract_article_title", _fields_sql("article_title"))
def article_title(spark, sf):
    """P3."""
    return legal_chunks(spark, sf).select(*_KEY, metadata.extract_article_title("text").alias("article_title"))


@query("extract_chapter_section_paragraph", _fields_sql("chapter", "section", "paragraph"))
def chapter_section_paragraph(spark, sf):
    """P4."""
    return legal_chunks(spark, sf).select(
        *_KEY, metadata.extract_chapter("text").alias("chapter"), metadata.extract_section("text").alias("section"),
        metadata.extract_paragraph("text").alias("paragraph"))


@query("extract_document_info", _fields_sql("document_type", "document_number", "document_year"))
def document_info(spark, sf):
    """P5."""
    rows = legal_chunks(spark, sf).withColumn("info", metadata.extract_document_info("text"))
    return rows.select(*_KEY, "info.*")


def _meta_rows(spark, sf):
    rows = legal_chunks(spark, sf)
    meta = metadata.extract_metadata("text", source=F.col("source"), loader=F.lit("pdf"), chunk_index=F.col("chunk_index"))
    return rows.withColumn("meta", meta)


_META_CTE = LEGAL_CTE + ", meta AS (SELECT *, " + ", ".join(f"{sql} AS {n}" for n, sql in _FIELDS_SQL.items()) + " FROM legal)"


@query(
    "extract_metadata",
    f"""WITH {_META_CTE} SELECT order_id, chunk_index, part_id, concat_ws('|', source, '', 'pdf', chunk_index, length(text), page, article_number,
        article_title, chapter, section, paragraph, document_type, document_number, document_year) AS fields FROM meta""",
)
def all_metadata(spark, sf):
    """Every field, as strings in the order of the struct."""
    strings = metadata.metadata_as_strings(F.col("meta"))
    values = F.concat_ws("|", *[F.element_at(strings, n) for n in metadata.METADATA_FIELDS])
    return _meta_rows(spark, sf).select(*_KEY, values.alias("fields"))


@query(
    "contextual_header",
    f"""WITH {_META_CTE} SELECT order_id, chunk_index, part_id, '[' || concat_ws(' | ', 'Fuente: ' || source,
        CASE WHEN article_number <> '' THEN 'Art. ' || article_number WHEN chapter <> '' THEN 'Cap. ' || chapter END,
        CASE WHEN page <> '' THEN 'Página: ' || page END,
        CASE WHEN document_type <> '' AND document_year <> '' THEN upper(document_type[1]) || document_type[2:] || ' ' || document_year END) || ']' || chr(10) AS header
      FROM meta""",
)
def header(spark, sf):
    """P7."""
    return _meta_rows(spark, sf).select(*_KEY, metadata.contextual_header(F.col("meta")).alias("header"))


_SRC = "CASE WHEN doc_id % 4 > 0 THEN source || ' a/b' ELSE '' END"


def _identified(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 4 > 0, F.concat("source", F.lit(" a/b"))).otherwise("").alias("source"), "text")


@query(
    "chunk_id",
    f"""WITH d AS (SELECT doc_id, {_SRC} AS source, text FROM documents)
      SELECT doc_id, substring(translate(CASE WHEN source <> '' THEN source || '::' || doc_id ELSE md5(text) END, ' /\\', '___'), 1, 512) AS chunk_id,
             CASE WHEN source <> '' THEN source || '::' || doc_id ELSE md5(text) END AS result_id FROM d""",
)
def chunk_ids(spark, sf):
    """P14."""
    return _identified(spark, sf).select(
        "doc_id", metadata.chunk_id("source", "doc_id", "text").alias("chunk_id"),
        metadata.result_id("source", "doc_id", "text").alias("result_id"))


@query(
    "parent_id",
    f"""WITH d AS (SELECT doc_id, {_SRC} AS source, CASE WHEN doc_id % 5 = 0 THEN doc_id END AS given, text,
          sha1(unhex('{metadata.URL_NAMESPACE_HEX}') || encode(text)) AS h FROM documents)
      SELECT doc_id, CASE WHEN given IS NOT NULL THEN given::VARCHAR WHEN source <> '' THEN source || '::chunk_' || doc_id ELSE
        substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' ||
        translate(substring(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substring(h, 18, 3) || '-' || substring(h, 21, 12) END AS parent_id FROM d""",
)
def parent_ids(spark, sf):
    """P15."""
    rows = _identified(spark, sf).withColumn("given", F.when(F.col("doc_id") % 5 == 0, F.col("doc_id")))
    return rows.select("doc_id", metadata.parent_id("given", F.lit(None).cast("string"), "source", "doc_id", "text").alias("parent_id"))


# ── Typing ────────────────────────────────────────────────────────────────────

# Words planted so that types occur: (language, text put in front).
_TYPE_WORDS = {
    "en": "Function main returns parameters: x. Policy one. ",
    "es": "Cláusula primera, cláusula segunda: terms and conditions. endpoint ",
    "fr": "Component a; component b; layer c; microservice. Header: api key. ",
}


def _typed_text():
    put = F.create_map(*[F.lit(x) for pair in _TYPE_WORDS.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(put, "lang"), F.lit("")), F.col("text"))


_TYPED_SQL = "(CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPE_WORDS.items()) + " ELSE '' END || text)"


def _type_sql() -> str:
    scores = ", ".join(
        "(" + " + ".join(f"len(regexp_extract_all(s, '{p}'))" for p in patterns) + f") AS {name}"
        for name, patterns in classify.TYPE_PATTERNS.items()
    )
    names = list(classify.TYPE_PATTERNS)
    best = f"greatest({', '.join(names)})"
    cases = " ".join(f"WHEN {n} = {best} THEN '{n}'" for n in names)
    return (
        f"WITH s AS (SELECT doc_id, lower({_TYPED_SQL}) AS s FROM documents), c AS (SELECT doc_id, {scores} FROM s) "
        f"SELECT doc_id, CASE WHEN {best} = 0 THEN 'standard' {cases} END AS doc_type, "
        f"CASE WHEN {best} = 0 THEN 0.0 ELSE round({best} / ({' + '.join(names)}), 4) END AS confidence FROM c"
    )


@query("detect_document_type", _type_sql())
def document_type(spark, sf):
    """P8 over whole texts, all matches counted."""
    rows = documents(spark, sf).select("doc_id", classify.detect_document_type(_typed_text(), None, None).alias("t"))
    return rows.select("doc_id", "t.doc_type", "t.confidence")


def _files(spark, sf):
    """Documents as files: name from the source, type and quality from the number."""
    mimes = F.array(*[F.lit(m) for m in [*classify.MIME_LABELS, "text/plain; charset=utf-8"]])
    stems = F.array(*[F.lit(s) for s in ["README", "api_v2", "informe", "sla-2024", "policy", "tech_spec", "terms"]])
    docs = documents(spark, sf)
    return docs.select(
        "doc_id",
        F.concat(F.lit("/in/"), "source", F.lit("/"), F.get(stems, F.col("doc_id").cast("int") % 7), F.lit(".v1.PDF")).alias("path"),
        classify.mime_info(F.get(mimes, F.col("doc_id").cast("int") % 11)).alias("mime"),
        F.when(F.col("doc_id") % 6 > 0, F.struct(
            (F.col("doc_id") % 2 == 0).alias("is_native"),
            F.round(0.5 + (F.col("doc_id") % 10) / 20, 3).alias("confidence"),
            (F.col("doc_id") % 120).alias("total_pages"),
        )).alias("quality"),
        _typed_text().alias("sample"),
    )


_MIMES_SQL = "[" + ", ".join(f"'{m}'" for m in [*classify.MIME_LABELS, "text/plain"]) + "]"
_FILES_CTE = f"""
files AS (SELECT doc_id, {_MIMES_SQL}[doc_id % 11 + 1] AS mime,
  ['readme', 'api_v2', 'informe', 'sla-2024', 'policy', 'tech_spec', 'terms'][doc_id % 7 + 1] || '.v1' AS stem,
  CASE WHEN doc_id % 6 > 0 THEN doc_id % 2 = 0 END AS is_native,
  CASE WHEN doc_id % 6 > 0 THEN round(0.5 + (doc_id % 10) / 20, 3) END AS confidence,
  CASE WHEN doc_id % 6 > 0 THEN doc_id % 120 END AS total_pages, lower({_TYPED_SQL}) AS sample, source FROM documents)
"""


def _any_sql(column: str, keys: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{k}')" for k in keys) + ")"


def _infer_sql(with_sample: bool) -> str:
    cases = "".join(f" WHEN {_any_sql('stem', keys)} THEN '{n}'" for n, keys in classify.NAME_KEYWORDS.items())
    if with_sample:
        cases += "".join(f" WHEN {_any_sql('sample', keys)} THEN '{n}'" for n, keys in classify.CONTENT_KEYWORDS.items())
    return f"CASE{cases} ELSE 'standard' END"


@query("infer_type", f"WITH {_FILES_CTE} SELECT doc_id, {_infer_sql(False)} AS by_name, {_infer_sql(True)} AS by_sample FROM files")
def inferred_type(spark, sf):
    """P11."""
    return _files(spark, sf).select(
        "doc_id", classify.infer_type("path").alias("by_name"), classify.infer_type("path", F.col("sample")).alias("by_sample"))


_TECH_SQL = f"({_any_sql('stem', classify.TECHNICAL_NAME)} OR {_any_sql('sample', classify.TECHNICAL_CONTENT)})"


@query(
    "looks_like",
    f"""WITH {_FILES_CTE} SELECT doc_id, {_TECH_SQL} AS technical,
        {_any_sql('stem', classify.CONTRACT_NAME)} OR {_any_sql('sample', classify.CONTRACT_CONTENT)} AS contract FROM files""",
)
def looks_like(spark, sf):
    """P12."""
    return _files(spark, sf).select(
        "doc_id", classify.looks_like_technical("path", F.col("sample")).alias("technical"),
        classify.looks_like_contract("path", F.col("sample")).alias("contract"))


_WORD_SQL = f"mime IN ('{classify.WORD_TYPES[0]}', '{classify.WORD_TYPES[1]}')"
_EXCEL_SQL = f"mime IN ('{classify.EXCEL_TYPES[0]}', '{classify.EXCEL_TYPES[1]}')"


@query(
    "classify_ingestion",
    f"""WITH {_FILES_CTE}, k AS (SELECT *, CASE WHEN {_WORD_SQL} THEN 'word' WHEN {_EXCEL_SQL} THEN 'excel' WHEN starts_with(mime, 'image/') THEN 'image'
          WHEN mime <> 'application/pdf' THEN 'other' WHEN is_native IS NULL THEN 'pdf?' WHEN NOT is_native AND confidence >= 0.8 THEN 'scan'
          WHEN is_native AND confidence >= 0.8 THEN 'native' ELSE 'unsure' END AS kind FROM files)
      SELECT doc_id,
        CASE kind WHEN 'word' THEN 'word' WHEN 'excel' THEN 'excel' WHEN 'image' THEN 'ocr' WHEN 'scan' THEN 'ocr'
          WHEN 'native' THEN CASE WHEN total_pages > 50 THEN 'docling' ELSE 'pymupdf' END ELSE 'pymupdf' END AS loader_type,
        CASE kind WHEN 'word' THEN CASE WHEN {_TECH_SQL} THEN 'technical' ELSE 'default' END WHEN 'image' THEN 'ocr_output' WHEN 'scan' THEN 'ocr_output' ELSE 'default' END AS cleaner_profile,
        kind IN ('image', 'scan') AS requires_ocr,
        CASE kind WHEN 'word' THEN CASE WHEN {_TECH_SQL} THEN 'technical_doc' ELSE 'standard' END WHEN 'excel' THEN 'excel' WHEN 'image' THEN 'imagen'
          WHEN 'other' THEN 'desconocido' WHEN 'pdf?' THEN {_infer_sql(True)} ELSE {_infer_sql(False)} END AS document_type,
        CASE kind WHEN 'word' THEN 0.95 WHEN 'excel' THEN 0.97 WHEN 'image' THEN 0.95 WHEN 'other' THEN 0.0 WHEN 'pdf?' THEN 0.45 WHEN 'unsure' THEN 0.55 ELSE confidence END AS confidence,
        CASE WHEN kind = 'other' THEN 'application/octet-stream' ELSE mime END AS mime_type FROM k""",
)
def plans(spark, sf):
    """P10."""
    rows = _files(spark, sf).withColumn("plan", classify.classify_ingestion("path", F.col("mime"), F.col("quality"), F.col("sample")))
    names = ["loader_type", "cleaner_profile", "requires_ocr", "document_type", "confidence", "mime_type"]
    return rows.select("doc_id", *[f"plan.{n}" for n in names])


@query(
    "route_loader",
    f"""WITH {_FILES_CTE} SELECT doc_id, CASE WHEN mime = 'application/pdf' AND coalesce(is_native, false) AND total_pages > 50 THEN 'docling'
        WHEN mime = 'application/pdf' AND coalesce(is_native, false) THEN 'pymupdf' WHEN mime = 'application/pdf' THEN 'ocr'
        WHEN {_WORD_SQL} THEN 'word' WHEN {_EXCEL_SQL} THEN 'excel' WHEN starts_with(mime, 'image/') THEN 'ocr' END AS loader FROM files""",
)
def loaders(spark, sf):
    """Rules out of order, sorted by priority."""
    when = classify.loader_conditions(F.col("mime"), F.col("quality"))
    rules = [
        classify.LoaderRule("pymupdf", when["native_pdf"], 20),
        classify.LoaderRule("docling", when["complex_pdf"], 30),
        classify.LoaderRule("ocr", when["scanned_pdf"], 20),
        classify.LoaderRule("word", when["word_document"]),
        classify.LoaderRule("excel", when["excel_spreadsheet"]),
        classify.LoaderRule("ocr", when["image_file"], 5),
    ]
    return _files(spark, sf).select("doc_id", classify.route_loader(rules).alias("loader"))


# ── Tokens, questions ─────────────────────────────────────────────────────────

@query(
    "tokenize",
    f"WITH t AS (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents) SELECT doc_id, len(toks) AS n, md5(array_to_string(toks, ' ')) AS tokens FROM t",
)
def tokens(spark, sf):
    """P13."""
    rows = documents(spark, sf).select("doc_id", tokenize("text", P).alias("toks"))
    return rows.select("doc_id", F.size("toks").cast("long").alias("n"), F.md5(F.array_join("toks", " ")).alias("tokens"))


@query(
    "lemmatizer",
    f"WITH t AS (SELECT doc_id, list_transform({sql_tokens('text')}, lambda t: CASE WHEN length(t) > 4 AND ends_with(t, 's') THEN t[:-2] ELSE t END) AS toks FROM documents) SELECT doc_id, md5(array_to_string(toks, ' ')) AS tokens FROM t",
)
def lemmas(spark, sf):
    """U7 with a plural stripper as the user's function."""
    strip = normalizer(lambda words: [w[:-1] if len(w) > 4 and w.endswith("s") else w for w in words])
    rows = documents(spark, sf).select("doc_id", strip(tokenize("text", P)).alias("toks"))
    return rows.select("doc_id", F.md5(F.array_join("toks", " ")).alias("tokens"))


_NWORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(
    "assess_complexity",
    f"""WITH m AS (SELECT conv_id, turn, lower(text) AS l, {_NWORDS} AS n, len(regexp_extract_all(text, '{questions.ARTICLE_MENTION}', 0, 'i')) AS a FROM conversations)
      SELECT conv_id, turn, CASE WHEN n <= 15 AND a <= 1 AND NOT {_any_sql('l', questions.COMPARISON)} THEN 'simple'
        WHEN {_any_sql('l', questions.COMPARISON)} OR a >= 2 OR ({_any_sql('l', questions.COMPOUND)} AND n > 20) THEN 'compound'
        WHEN n > 30 THEN 'complex' ELSE 'simple' END AS complexity FROM m""",
)
def complexity(spark, sf):
    """P25."""
    return table(spark, sf, "conversations").select("conv_id", "turn", questions.assess_complexity("text").alias("complexity"))


@query(
    "distinct_articles",
    f"""WITH m AS (SELECT order_id, chunk_index, part_id, list_filter(regexp_extract_all(text, '{questions.ARTICLE_MENTION}', 1, 'i'), lambda m: contains(m, '.') OR length(m) >= 2) AS a
          FROM legal), u AS (SELECT order_id, chunk_index, part_id, list_filter(a, lambda x, i: list_position(a, x) = i)[:5] AS a FROM m)
      SELECT order_id, chunk_index, part_id, array_to_string(a, ',') AS articles FROM u""".replace("WITH m AS", f"WITH {LEGAL_CTE}, m AS", 1),
)
def articles(spark, sf):
    """U-4."""
    rows = legal_chunks(spark, sf)
    return rows.select(*_KEY, F.array_join(questions.distinct_articles("text"), ",").alias("articles"))


@query(
    "select_strategy",
    rf"SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '\d+\.\d+') AND {_NWORDS} >= 20 THEN 'full' ELSE 'hybrid' END AS strategy FROM conversations",
)
def strategy(spark, sf):
    """P27."""
    return table(spark, sf, "conversations").select("conv_id", "turn", questions.select_strategy("text").alias("strategy"))


@query(
    "variant_set",
    """SELECT conv_id, turn, md5(concat_ws('|', text, CASE WHEN r <> text THEN r END, CASE WHEN b <> text AND b IS DISTINCT FROM r THEN b END)) AS variants FROM (
        SELECT conv_id, turn, text, CASE WHEN turn % 3 > 0 THEN lower(text) END AS r, CASE turn % 2 WHEN 0 THEN text ELSE lower(text) END AS b FROM conversations)""",
)
def variants(spark, sf):
    """U-3."""
    c = table(spark, sf, "conversations").withColumn("r", F.when(F.col("turn") % 3 > 0, F.lower("text"))).withColumn(
        "b", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lower("text")))
    return c.select("conv_id", "turn", F.md5(F.array_join(questions.variant_set("text", "r", "b"), "|")).alias("variants"))


@query(
    "validate_queries",
    """WITH q AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN text WHEN turn % 3 = 0 THEN '  ' ELSE ' ' || substring(text, 1, turn) END AS text, turn AS it, turn * 5 AS k FROM conversations)
      SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'blank' WHEN length(trim(text)) < 3 THEN 'too short' WHEN length(trim(text)) > 4000 THEN 'too long'
        WHEN it NOT BETWEEN 1 AND 4 THEN 'max_iterations out of range' END AS reason, greatest(1, least(k, 20)) AS semantic_k, greatest(1, least(k, 15)) AS hybrid_k FROM q""",
)
def validated(spark, sf):
    """F8."""
    c = table(spark, sf, "conversations")
    text = F.when(F.col("turn") == 0, F.col("text")).when(F.col("turn") % 3 == 0, "  ").otherwise(
        F.concat(F.lit(" "), F.substring("text", F.lit(1), F.col("turn").cast("int"))))
    rows = c.select("conv_id", "turn", text.alias("text"), (F.col("turn") * 5).alias("k"))
    return rows.select(
        "conv_id", "turn", questions.reject_reason("text", "turn").alias("reason"),
        questions.clamp("k", questions.SEMANTIC_TOP_K).alias("semantic_k"), questions.clamp("k", questions.HYBRID_TOP_K).alias("hybrid_k"))


@query("truncate_preview", "SELECT doc_id, substring(text, 1, 500) AS preview, md5(substring(text, 1, 2000)) AS bulk FROM documents")
def previews(spark, sf):
    """F9."""
    return documents(spark, sf).select("doc_id", preview("text", 500).alias("preview"), F.md5(preview("text", 2000)).alias("bulk"))


@query(
    "min_chunk_length",
    f"WITH {LINES_CTE} SELECT source, chunk_index FROM lines WHERE length(trim(text)) >= 100",
)
def long_lines(spark, sf):
    """F5."""
    return chunking.min_chunk_length(line_chunks(spark, sf), 100).select("source", "chunk_index")


@query("assign_chunk_index", f"WITH {LINES_CTE} SELECT source, chunk_index, md5(text) AS text FROM lines")
def numbered(spark, sf):
    """W4."""
    docs = documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), F.split("text", "\n").alias("chunks"))
    rows = chunking.number_chunks(docs)
    return rows.select("source", F.col("chunk_index").cast("long"), F.md5("text").alias("text"))


# ── Chunking ──────────────────────────────────────────────────────────────────

def _sized(rows, *extra):
    return rows.select("doc_id", *extra, F.col("chunk_index").cast("long"), F.length("text").cast("long").alias("size"), F.md5("text").alias("text"))


@query("recursive_split")
def split(spark, sf):
    """T1."""
    docs = documents(spark, sf).withColumn("chunks", recursive_split(HIERARCHICAL)("text"))
    return _sized(chunking.number_chunks(docs))


@query("adaptive_chunk")
def adaptive(spark, sf):
    """T2."""
    docs = documents(spark, sf).select("doc_id", "source", _typed_text().alias("text"))
    return _sized(chunking.adaptive_chunk(docs), "document_type", "chunking_confidence")



def _headed(spark, sf):
    """Documents with chapter and Markdown headings planted at full stops and commas."""
    text = F.replace(F.replace(F.replace("text", F.lit(". "), F.lit(".\nCapítulo ")), F.lit(", "), F.lit(",\n## ")), F.lit(" en "), F.lit("\nparte en "))
    return documents(spark, sf).select("doc_id", "source", text.alias("text"))


_HEADED_SQL = "replace(replace(replace(text, '. ', '.' || chr(10) || 'Capítulo '), ', ', ',' || chr(10) || '## '), ' en ', chr(10) || 'parte en ')"


@query(
    "segment_by_headers",
    rf"""WITH h AS (SELECT doc_id, {_HEADED_SQL} AS t FROM documents),
      words AS (SELECT doc_id, regexp_replace(t, '(\n(?:CAPÍTULO|SECCIÓN|PARTE)\b)', chr(1) || '\1', 'gi') AS t FROM h),
      cut AS (SELECT doc_id, string_split(regexp_replace(t, '(\n#+\x01?\s[\p{{L}}\p{{N}}_])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM words)
      SELECT doc_id, len(p) AS segments, md5(array_to_string(p, '|')) AS text FROM (SELECT doc_id, list_filter(parts, lambda s: trim(s, {WS_TRIM}) <> '') AS p FROM cut)""",
)
def segments(spark, sf):
    """T3."""
    rows = _headed(spark, sf).withColumn("p", chunking.segment_by_headers("text"))
    return rows.select("doc_id", F.size("p").cast("long").alias("segments"), F.md5(F.array_join("p", "|")).alias("text"))


@query("hierarchical_chunk")
def hierarchical(spark, sf):
    """T4, F5, P6, P7."""
    return _sized(chunking.hierarchical_chunk(_headed(spark, sf)), F.col("meta.chapter").alias("chapter"))


@query("markdown_header_split")
def markdown(spark, sf):
    """T5."""
    return _sized(chunking.markdown_header_split(_headed(spark, sf)))


@query("chunk_with_profile")
def profiled(spark, sf):
    """T7."""
    docs = _headed(spark, sf).withColumn("text", noisy())
    return _sized(chunking.chunk_with_profile(docs, "technical"))


@query("build_parent_child")
def parent_child_tables(spark, sf):
    """Parents with their number of children."""
    parents, children = chunking.parents_and_children(_headed(spark, sf))
    counts = children.groupBy("parent_id").agg(F.count("*").alias("children"))
    return parents.join(counts, "parent_id", "left").select("parent_id", "source", "position", F.coalesce("children", F.lit(0)).alias("children"))


@query("concat_dedup_overlap")
def overlap(spark, sf):
    """P20: chunks of each document folded back into one text."""
    docs = documents(spark, sf).withColumn("chunks", recursive_split(HIERARCHICAL)("text"))
    return docs.select("doc_id", F.md5(concat_dedup_overlap(F.col("chunks"))).alias("text"), F.size("chunks").cast("long").alias("chunks"))


# ── Replies of a model ────────────────────────────────────────────────────────

_Q = "regexp_replace(text, '[^a-zA-Z ]', '', 'g')"


def _letters():
    return F.regexp_replace("text", "[^a-zA-Z ]", "")


@query(
    "parse_batch_json",
    f"""WITH q AS (SELECT doc_id, {_Q} AS t FROM documents WHERE doc_id % 5 <> 4)
      SELECT doc_id, chunk_id::INTEGER AS chunk_id, question FROM (
        SELECT doc_id, 0 AS chunk_id, unnest([trim(t), 'b']) AS question FROM q UNION ALL SELECT doc_id, 1, 'c' FROM q) WHERE question <> ''""",
)
def batch_json(spark, sf):
    """Replies with text around the JSON, blank questions, and every fifth broken."""
    good = F.concat(
        F.lit('Claro: {"results": [{"chunk_id": 0, "questions": ["'), _letters(),
        F.lit(' ", "  ", "b"]}, {"chunk_id": 1, "questions": ["c"]}]} fin'))
    reply = F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit('{"results": [ '), _letters())).otherwise(good)
    # the outer form: a plain explode adds a filter on the map and parses the reply again
    rows = documents(spark, sf).select("doc_id", F.explode_outer(replies.parse_batch_json(reply)).alias("chunk_id", "questions"))
    return rows.filter(F.col("chunk_id").isNotNull()).select("doc_id", "chunk_id", F.explode("questions").alias("question"))


@query(
    "parse_fenced_json",
    f"""SELECT doc_id, CASE WHEN doc_id % 5 <> 4 THEN {_Q} || '|b' END AS sub_queries, CASE WHEN doc_id % 5 <> 4 THEN 'full' END AS strategy FROM documents""",
)
def fenced_json(spark, sf):
    """P34."""
    good = F.concat(F.lit('```json\n{"sub_queries": ["'), _letters(), F.lit('", "b"], "strategy": "full"}\n```'))
    reply = F.when(F.col("doc_id") % 5 == 4, "```json {no```").otherwise(good)
    rows = documents(spark, sf).select("doc_id", replies.parse_fenced_json(reply).alias("p"))
    joined = F.when(F.col("p.sub_queries").isNotNull(), F.array_join("p.sub_queries", "|"))
    return rows.select("doc_id", joined.alias("sub_queries"), "p.strategy")


_BULLETED = "CASE doc_id % 3 WHEN 0 THEN '- ' WHEN 1 THEN '12. ' ELSE '• ' END"


def _bulleted():
    mark = F.when(F.col("doc_id") % 3 == 0, "- ").when(F.col("doc_id") % 3 == 1, "12. ").otherwise("• ")
    return F.concat(mark, F.replace("text", F.lit("\n"), F.concat(F.lit("\n "), mark)))


_BULLETED_SQL = f"{_BULLETED} || replace(text, chr(10), chr(10) || ' ' || {_BULLETED})"


@query(
    "parse_list_lines",
    f"""WITH r AS (SELECT doc_id, {_BULLETED_SQL} AS reply FROM documents),
      l AS (SELECT doc_id, list_filter(list_transform(string_split(trim(reply, {WS_TRIM}), chr(10)), lambda s: trim(s)), lambda s: length(s) > 5) AS l FROM r),
      i AS (SELECT doc_id, list_filter(list_transform(l, lambda s: trim(ltrim(s, '0123456789.-*• '))), lambda s: s <> '')[:4] AS i FROM l)
      SELECT doc_id, CASE WHEN len(i) <= 1 THEN 'q' ELSE md5(array_to_string(i, '|')) END AS items FROM i""",
)
def list_lines(spark, sf):
    """P35."""
    items = replies.parse_list_lines(_bulleted(), F.lit("q"))
    rows = documents(spark, sf).select("doc_id", items.alias("i"))
    return rows.select("doc_id", F.when(F.size("i") <= 1, F.array_join("i", "|")).otherwise(F.md5(F.array_join("i", "|"))).alias("items"))


@query(
    "parse_key_points",
    f"""WITH r AS (SELECT doc_id, {_BULLETED_SQL} AS reply FROM documents),
      l AS (SELECT doc_id, list_filter(list_transform(string_split(reply, chr(10)), lambda s: trim(s)), lambda s: s[1] IN ('-', '•', '*')) AS l FROM r)
      SELECT doc_id, len(l[:5]) AS n, md5(array_to_string(list_transform(l[:5], lambda s: ltrim(s, '-•* ')), '|')) AS points FROM l""",
)
def key_points(spark, sf):
    """P36."""
    rows = documents(spark, sf).select("doc_id", replies.parse_key_points(_bulleted()).alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("points"))


@query(
    "parse_obligations",
    """WITH t AS (SELECT order_id, chunk_index, part_id, text, string_split(text, chr(10)) AS l FROM legal)
      SELECT order_id, chunk_index, part_id, nivel_criticidad::INTEGER AS nivel_criticidad, sujeto_obligado, md5(obligacion) AS obligacion, plazo, sancion FROM (
        SELECT order_id, chunk_index, part_id, 3 AS nivel_criticidad, l[5] AS sujeto_obligado, '' AS obligacion, '' AS plazo, 'no especificada' AS sancion FROM t WHERE chunk_index % 2 = 0
        UNION ALL SELECT order_id, chunk_index, part_id, 3, '', '', chunk_index || ': días', 'no especificada' FROM t WHERE chunk_index % 2 = 0
        UNION ALL SELECT order_id, chunk_index, part_id, 0, '', text, '', 'no especificada' FROM t WHERE chunk_index % 2 = 1)""".replace(
        "l[5]", "l[2]").replace("WITH t AS", f"WITH {LEGAL_CTE}, t AS", 1),
)
def obligations(spark, sf):
    """A bulleted reply for even chunks, free text for odd ones."""
    second = F.element_at(F.split("text", "\n"), 2)
    reply = F.when(
        F.col("chunk_index") % 2 == 0,
        F.concat(F.lit("Lista\n- Sujeto obligado: "), second, F.lit("\n* Plazo: "), F.col("chunk_index").cast("string"), F.lit(": días\n- nada")),
    ).otherwise(F.col("text"))
    rows = legal_chunks(spark, sf).select(*_KEY, F.explode(replies.parse_obligations(reply)).alias("o"))
    return rows.select(*_KEY, "o.nivel_criticidad", "o.sujeto_obligado", F.md5("o.obligacion").alias("obligacion"), "o.plazo", "o.sancion")


# ── Prompts ───────────────────────────────────────────────────────────────────

_HITS_CTE = "hits AS (SELECT l_orderkey AS query_id, source, article_number, chunk_index, text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rank FROM (SELECT *, 'S' || l_suppkey AS source, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey::VARCHAR ELSE '' END AS article_number, l_linenumber AS chunk_index, l_returnflag || chr(10) || l_linestatus || ' ' || l_partkey AS text FROM lineitem))"


def _order_hits(spark, sf):
    """Lines of each order as its ranked documents."""
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("query_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).otherwise("").alias("article_number"),
        F.lit("").alias("section_number"),
        F.lit("").alias("page"),
        F.col("l_linenumber").alias("chunk_index"),
        F.concat("l_returnflag", F.lit("\n"), "l_linestatus", F.lit(" "), F.col("l_partkey").cast("string")).alias("text"),
        F.row_number().over(order).alias("rank"),
    )


@query(
    "build_context",
    f"""WITH {_HITS_CTE} SELECT query_id, md5(string_agg('[Documento ' || rank || ' — Fuente: ' || source || CASE WHEN article_number <> '' THEN ' | Artículo: ' || article_number ELSE '' END
        || ' | Chunk: ' || chunk_index || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context FROM hits GROUP BY query_id""",
)
def contexts(spark, sf):
    """A16."""
    return build_context(_order_hits(spark, sf)).withColumn("context", F.md5("context"))


@query(
    "grading_prompt",
    f"""WITH {_HITS_CTE} SELECT query_id, md5(string_agg('[Doc ' || rank || '] (source: ' || source || ', chunk: ' || chunk_index || ')' || chr(10) || substring(text, 1, 500),
        chr(10) || '---' || chr(10) ORDER BY rank)) AS prompt FROM hits WHERE rank <= 5 GROUP BY query_id""",
)
def grading(spark, sf):
    """P39."""
    return grading_prompt(_order_hits(spark, sf)).withColumn("prompt", F.md5("prompt"))


@query(
    "batch_prompt",
    f"""WITH {LINES_CTE} SELECT source, batch_no::INTEGER AS batch_no, count(*) AS members, md5('Genera exactamente 3 preguntas para cada uno de los siguientes ' || count(*) || ' fragmentos.' || chr(10) ||
        string_agg(chr(10) || '[CHUNK ' || chunk_index % 5 || ']' || chr(10) || replace(substring(text, 1, 1500), chr(10), ' '), chr(10) ORDER BY chunk_index)) AS prompt
      FROM (SELECT *, chunk_index // 5 AS batch_no FROM lines) GROUP BY source, batch_no""",
)
def batches(spark, sf):
    """P38."""
    rows = batch_prompts(line_chunks(spark, sf), key="source")
    return rows.select("source", "batch_no", F.size("members").cast("long").alias("members"), F.md5("prompt").alias("prompt"))


# ── Answers ───────────────────────────────────────────────────────────────────

@query(
    "grade_route",
    """SELECT event_id, quality, CASE WHEN quality = 'correct' OR r >= 2 THEN 'generation' ELSE 'retrieval' END AS route,
        (CASE WHEN quality = 'correct' OR r >= 2 THEN r ELSE r + 1 END)::INTEGER AS retries,
        CASE WHEN n = 0 THEN 'no_docs' WHEN s > 0.8 THEN 'direct' WHEN s >= 0.5 THEN 'rethinking' ELSE 'rethinking_low_confidence' END AS mode FROM (
        SELECT *, CASE WHEN s > 0.7 THEN 'correct' WHEN s >= 0.3 THEN 'ambiguous' ELSE 'incorrect' END AS quality FROM (
          SELECT event_id, event_id % 4 AS r, event_id % 7 AS n, least(value / 100, 1.0) AS s FROM events))""",
)
def graded(spark, sf):
    """P28, P29."""
    ev = table(spark, sf, "events").select(
        "event_id", (F.col("event_id") % 4).alias("r"), (F.col("event_id") % 7).alias("n"), F.least(F.col("value") / 100, F.lit(1.0)).alias("s"))
    rows = ev.withColumn("quality", answers.grade_quality("s"))
    routed = rows.withColumn("g", answers.grade_route("quality", "r"))
    return routed.select("event_id", "quality", "g.route", "g.retries", answers.generation_mode("s", "n").alias("mode"))


_ANSWER_MARKS = {0: "En conclusión, es fundamental para todos. ", 1: "1. Uno\n9. Nueve\n", 2: "No encontré información relevante en los textos. ", 3: ""}


def _answers(spark, sf):
    c = table(spark, sf, "conversations")
    mark = F.create_map(*[F.lit(x) for pair in _ANSWER_MARKS.items() for x in pair])
    text = F.when(F.col("turn") == 7, "  ").otherwise(F.concat(F.element_at(mark, F.col("turn").cast("int") % 4), "text"))
    context = F.when(F.col("conv_id") % 2 == 0, F.lit("1. a\n 6. b")).otherwise(F.lit("2. a\n 8. b"))
    return c.select("conv_id", "turn", text.alias("answer"), context.alias("context"))


_ANSWERS_CTE = """
a AS (SELECT conv_id, turn, CASE WHEN turn = 7 THEN '  ' ELSE CASE turn % 4 WHEN 0 THEN 'En conclusión, es fundamental para todos. '
        WHEN 1 THEN '1. Uno' || chr(10) || '9. Nueve' || chr(10) WHEN 2 THEN 'No encontré información relevante en los textos. ' ELSE '' END || text END AS answer,
      CASE WHEN conv_id % 2 = 0 THEN 6 ELSE 8 END AS top FROM conversations),
v AS (SELECT conv_id, turn, answer, trim(answer) = '' AS empty, list_filter([
    CASE WHEN len(regexp_extract_all(answer, '__G__', 0, 'i')) > 0 THEN 'Conclusiones genéricas detectadas: [' ||
      array_to_string(list_transform(regexp_extract_all(answer, '__G__', 0, 'i')[:3], lambda g: '''' || g || ''''), ', ') || ']' END,
    CASE WHEN list_max(list_transform(regexp_extract_all(answer, '(?m)^\\s*(\\d+)\\.\\s+\\S', 1), lambda n: n::BIGINT)) > top + 2 THEN
      'Numerales inventados: respuesta tiene hasta ' || list_max(list_transform(regexp_extract_all(answer, '(?m)^\\s*(\\d+)\\.\\s+\\S', 1), lambda n: n::BIGINT)) || ', contexto solo hasta ' || top END,
    CASE WHEN contains(lower(answer), 'no encontré información relevante') AND length(trim(answer, __WS__)) > 53 THEN 'Respuesta mixta: declara no encontrar pero agrega información' END],
    lambda x: x IS NOT NULL) AS viol FROM a),
verdicts AS (SELECT conv_id, turn, answer, NOT empty AND len(viol) = 0 AS is_valid, CASE WHEN empty THEN ['Respuesta vacía'] ELSE viol END AS violations,
    (CASE WHEN empty THEN 1.0 WHEN len(viol) = 0 THEN 0.9 ELSE 0.4 END)::DOUBLE AS confidence FROM v)
""".replace("__G__", "|".join(answers.GENERIC_PHRASES)).replace("__WS__", WS_TRIM).replace("\\\\", "\\")


@query("validate_answer", f"WITH {_ANSWERS_CTE} SELECT conv_id, turn, is_valid, array_to_string(violations, '; ') AS violations, confidence FROM verdicts")
def validated_answers(spark, sf):
    """P30."""
    rows = _answers(spark, sf).withColumn("v", answers.validate_answer("answer", "context"))
    return rows.select("conv_id", "turn", "v.is_valid", F.array_join("v.violations", "; ").alias("violations"), "v.confidence")


@query(
    "reflect",
    f"""WITH {_ANSWERS_CTE}, r AS (SELECT *, turn % 4 AS it, NOT is_valid AND turn % 4 < 2 AS again FROM verdicts)
      SELECT conv_id, turn, CASE WHEN again THEN 'retrieval' ELSE 'END' END AS route,
        md5(CASE WHEN is_valid THEN answer WHEN NOT again THEN answer || chr(10) || chr(10) || '⚠️ Nota: Esta respuesta puede estar incompleta.' END) AS final_answer,
        is_valid AS is_grounded, again AND len(violations) > 0 AS has_hallucination,
        CASE WHEN is_valid THEN 'Respuesta válida' WHEN again THEN violations[1] ELSE 'Iteraciones agotadas' END AS feedback, it + 1 AS iteration_count FROM r""",
)
def reflections(spark, sf):
    """P31."""
    rows = _answers(spark, sf).withColumn("v", answers.validate_answer("answer", "context")).withColumn("it", F.col("turn") % 4)
    r = rows.withColumn("r", answers.reflect(F.col("v"), "answer", "it", F.lit(2)))
    return r.select("conv_id", "turn", "r.route", F.md5("r.final_answer").alias("final_answer"), "r.is_grounded", "r.has_hallucination", "r.feedback", "r.iteration_count")


@query(
    "extract_sources",
    f"""WITH {LEGAL_CTE}, m AS (SELECT order_id, chunk_index, part_id, source,
          list_transform(regexp_extract_all(text, '[Aa]rt[íi]culo\\s+([\\d.]+[\\p{{L}}\\p{{N}}_]*)', 1), lambda x: 'article:' || x) ||
          list_transform(regexp_extract_all(text, '[Ss]ecci[óo]n\\s+([\\d.]+[\\p{{L}}\\p{{N}}_]*)', 1), lambda x: 'section:' || x) ||
          list_transform(regexp_extract_all(text, '[Cc]ap[íi]tulo\\s+([\\p{{L}}\\p{{N}}_\\s]+?)(?:\\n|$)', 1), lambda x: 'chapter:' || trim(x)) AS s FROM legal)
      SELECT order_id, chunk_index, part_id, CASE WHEN len(s) > 0 THEN array_to_string(s, ',') ELSE 'source:' || source END AS sources FROM m""",
)
def cited(spark, sf):
    """Cited articles, else the source of the document itself."""
    docs = F.array(F.struct("source", F.lit("").alias("article_number"), F.lit("").alias("page")))
    rows = legal_chunks(spark, sf).select(*_KEY, answers.extract_sources("text", docs).alias("s"))
    return rows.select(*_KEY, F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["type"], s["value"])), ",").alias("sources"))


_PAIRS_CTE = r"""
turns AS (SELECT conv_id, turn, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
s AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda w: w <> '')) AS q,
        list_distinct(list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda w: w <> '')) AS a FROM turns WHERE answer IS NOT NULL),
scored AS (SELECT conv_id, turn, 
    round(len(list_intersect(a, q)) / greatest(len(a), 1), 3) AS faithfulness,
    round(len(list_intersect(list_filter(q, lambda w: length(w) > 3), list_filter(a, lambda w: length(w) > 3))) / greatest(len(list_filter(q, lambda w: length(w) > 3)), 1), 3) AS answer_relevancy,
    round((CASE WHEN len(list_intersect(list_filter(q, lambda w: length(w) > 3), list_filter(q, lambda w: length(w) > 3))) > 0 THEN 1 ELSE 0 END
         + CASE WHEN len(list_intersect(list_filter(q, lambda w: length(w) > 3), list_filter(a, lambda w: length(w) > 3))) > 0 THEN 1 ELSE 0 END) / 2, 3) AS context_precision FROM (
      SELECT conv_id, turn, list_distinct(q) AS q, a FROM s))
"""


def _pairs(spark, sf):
    """Each message with the next as its answer; contexts are the question and the answer."""
    c = table(spark, sf, "conversations")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("question")).join(following, ["conv_id", "turn"])
    return pairs.withColumn("contexts", F.array("question", "answer"))


@query(
    "rag_scores",
    "WITH " + _PAIRS_CTE.replace("round(len(list_intersect(a, q)) / greatest(len(a), 1), 3)", "round(len(a) / greatest(len(a), 1), 3)") +
    " SELECT conv_id, turn, faithfulness, answer_relevancy, context_precision FROM scored",
)
def overlap_scores(spark, sf):
    """A15."""
    return rag_scores(_pairs(spark, sf)).select("conv_id", "turn", "faithfulness", "answer_relevancy", "context_precision")


@query(
    "rag_means",
    "WITH " + _PAIRS_CTE + """ SELECT count(*) AS dataset_size, round(avg(faithfulness), 3) AS faithfulness,
        round(avg(answer_relevancy), 3) AS answer_relevancy, round(avg(context_precision), 3) AS context_precision FROM scored""",
)
def mean_scores(spark, sf):
    """Means, with the question as the only context for faithfulness."""
    pairs = _pairs(spark, sf)
    faith = rag_scores(pairs.withColumn("contexts", F.array("question"))).select("conv_id", "turn", "faithfulness")
    rest = rag_scores(pairs).select("conv_id", "turn", "answer_relevancy", "context_precision")
    return rag_means(faith.join(rest, ["conv_id", "turn"]))


# ── Model functions ───────────────────────────────────────────────────────────

def stub_reply(prompts: list[str]) -> list[str]:
    """A rule in place of a chat model: fails on prompts with a digit, else returns the first line."""
    if any(ch.isdigit() for p in prompts for ch in p):
        raise ValueError("refused")
    return [p.split("\n")[0] for p in prompts]


@query(
    "model_map",
    r"SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[0-9]') THEN 'sin respuesta' ELSE string_split(text, chr(10))[1] END) AS reply FROM documents",
)
def mapped(spark, sf):
    """Rows that fail get the fallback, the others of their batch their reply."""
    reply = model_map("text", stub_reply, F.lit("sin respuesta"))
    return documents(spark, sf).select("doc_id", F.md5(reply).alias("reply"))


@query("embed_default")
def embedded(spark, sf):
    """Default embedding of every document, as a checksum."""
    rows = documents(spark, sf).select("doc_id", hashed_embedding("text").alias("e"))
    return rows.select("doc_id", F.size("e").alias("size"), F.round(F.aggregate("e", F.lit(0.0).cast("double"), lambda a, x: a + x * x), 4).alias("norm"))


@query(
    "score_pair",
    "SELECT doc_id, item_id, abs(length(d.text) - length(b.text))::DOUBLE AS score FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id",
)
def scored_pairs(spark, sf):
    """U3 with a user's function: every document against one benchmark text."""
    pair = score_pair(lambda qs, ts: [float(abs(len(t) - len(q))) for q, t in zip(qs, ts)])
    bench = text_queries(spark, sf)
    docs = documents(spark, sf).withColumn("query_id", F.pmod("doc_id", bench.agg(F.count("*")).scalar()))
    pairs = docs.select("doc_id", "query_id", F.col("text").alias("body")).join(bench, "query_id")
    return pairs.select("doc_id", F.col("query_id").alias("item_id"), pair("text", "body").alias("score"))


@query(
    "summarise",
    """SELECT doc_id, true AS is_summary, length(text) AS original_content_length,
        md5(CASE WHEN length(text) < 200 THEN text ELSE array_to_string(string_split(text, chr(10))[1:3], chr(10)) END) AS summary FROM documents""",
)
def summaries(spark, sf):
    """U6 without a model: short texts whole, else the first three lines."""
    rows = summary_rows(documents(spark, sf))
    return rows.select("doc_id", "is_summary", F.col("original_content_length").cast("long"), F.md5("text").alias("summary"))


def question_model(prompts: list[str]) -> list[str]:
    """Two questions per chunk of the prompt, in the expected JSON."""
    replies_ = []
    for prompt in prompts:
        n = prompt.count("\n[CHUNK ")
        body = ", ".join(f'{{"chunk_id": {i}, "questions": ["¿Qué dice {i}?", " ", "¿Y {i}?"]}}' for i in range(n))
        replies_.append(f'Claro {{"results": [{body}]}}')
    return replies_


@query(
    "explode_questions",
    f"""WITH {LINES_CTE} SELECT source, chunk_index AS parent_chunk_index, unnest(['¿Qué dice ' || chunk_index % 5 || '?', '¿Y ' || chunk_index % 5 || '?']) AS text FROM lines""",
)
def exploded_questions(spark, sf):
    """T9."""
    rows = explode_questions(line_chunks(spark, sf), question_model, key="source")
    return rows.select("source", "parent_chunk_index", "text")


@query("prepare_chunks")
def prepared(spark, sf):
    """X1, first half: clean → adaptive chunks → metadata → id."""
    chunks = prepare_chunks(documents(spark, sf).select("doc_id", "source", "text"))
    return _sized(chunks, "document_type", "id")


