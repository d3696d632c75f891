"""Document and file typing by rules."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import col, contains_any

# Text patterns per document type, in order of precedence.
TYPE_PATTERNS: dict[str, list[str]] = {
    "documentation": [r"function\s+\w", r"class\s+\w", r"def\s+\w", r"returns", r"parameters?\s*:"],
    "api_docs": [r"endpoint", r"request\s+body", r"response\s+200", r"api\s+key", r"header:"],
    "architecture": [r"component\s+\w", r"microservice", r"layer\s+\w", r"architecture\s+pattern"],
    "contract": [r"cl[aá]usula\s+\w", r"the\s+parties\s+agree", r"terms\s+and\s+conditions"],
    "policy": [r"policy\s+\w", r"procedure\s+\w", r"responsibl\w+\s+shall", r"scope\s+of"],
}
SAMPLE_CHARS = 2000
MATCHES_PER_PATTERN = 3

# Keywords in a file name, then in a text sample, per type.
NAME_KEYWORDS: dict[str, list[str]] = {
    "documentation": ["readme", "tutorial", "guide", "getting_started"],
    "api_docs": ["api", "openapi", "swagger", "endpoints"],
    "architecture": ["architecture", "design", "adr", "tech_spec"],
    "contract": ["contract", "sla", "agreement"],
    "policy": ["policy", "compliance", "security_policy"],
}
CONTENT_KEYWORDS: dict[str, list[str]] = {
    "api_docs": ["api endpoint", "request body", "response 200"],
    "documentation": ["function", "parameter", "returns", "throws"],
    "architecture": ["architecture", "microservice", "component"],
    "contract": ["clause", "party agrees", "terms and conditions"],
}
TECHNICAL_NAME = ["readme", "guide", "tutorial", "api", "docs", "spec", "architecture"]
TECHNICAL_CONTENT = ["function", "class", "api", "endpoint", "parameter", "returns", "throws", "implementation"]
CONTRACT_NAME = ["contract", "agreement", "terms", "conditions", "sla"]
CONTRACT_CONTENT = ["clause", "party agrees", "terms and conditions"]

# Supported types, their labels, and leading bytes (hex).
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
MIME_LABELS: dict[str, str] = {
    "application/pdf": "PDF",
    DOCX: "Word (.docx)",
    "application/msword": "Word (.doc, legacy)",
    XLSX: "Excel (.xlsx)",
    "application/vnd.ms-excel": "Excel (.xls, legacy)",
    "image/jpeg": "Imagen JPEG",
    "image/png": "Imagen PNG",
    "image/tiff": "Imagen TIFF",
    "image/webp": "Imagen WebP",
    "image/bmp": "Imagen BMP",
}
UPLOAD_SUFFIXES = [".pdf", ".docx", ".xlsx", ".xls", ".jpg", ".jpeg", ".png", ".tiff", ".webp"]
WORD_TYPES = [DOCX, "application/msword"]
EXCEL_TYPES = [XLSX, "application/vnd.ms-excel"]


def _type_hits(text: Column, patterns: list[str], matches: int | None) -> Column:
    """Matched strings, at most ``matches`` per pattern, stripped."""
    found = [F.regexp_extract_all(text, F.lit(f"(?imU){p}"), F.lit(0)) for p in patterns]
    if matches is not None:
        found = [F.slice(f, 1, matches) for f in found]
    return F.transform(F.concat(*found), F.trim)


def _scored(hits: Column, name: str, precedence: int) -> Column:
    """struct(score, precedence, doc_type, indicators); transform over a one-element array binds the hits once."""
    return F.transform(
        F.array(hits),
        lambda h: F.struct(F.size(h).alias("score"), F.lit(precedence).alias("precedence"), F.lit(name).alias("doc_type"), h.alias("indicators")),
    )[0]


def detect_document_type(text: Column | str, sample_chars: int | None = SAMPLE_CHARS, matches: int | None = MATCHES_PER_PATTERN) -> Column:
    """struct(doc_type, confidence, indicators) from the first ``sample_chars`` characters and ``matches`` per pattern; None: all."""
    sample = F.lower(col(text) if sample_chars is None else F.substring(col(text), 1, sample_chars))
    scored = F.array(*[_scored(_type_hits(sample, patterns, matches), name, -i) for i, (name, patterns) in enumerate(TYPE_PATTERNS.items())])
    # transform over a one-element array binds the scored list once
    result = F.transform(
        F.array(scored),
        lambda s: F.struct(
            F.array_max(F.transform(s, lambda t: F.struct(t["score"], t["precedence"], t["doc_type"], t["indicators"]))).alias("best"),
            F.aggregate(s, F.lit(0), lambda acc, t: acc + t["score"]).alias("total"),
        ),
    )
    return F.element_at(
        F.transform(
            result,
            lambda r: F.when(
                r["total"] > 0,
                F.struct(
                    r["best"]["doc_type"].alias("doc_type"),
                    F.round(r["best"]["score"] / r["total"], 4).alias("confidence"),
                    r["best"]["indicators"].alias("indicators"),
                ),
            ).otherwise(
                F.struct(
                    F.lit("standard").alias("doc_type"),
                    F.lit(0.0).alias("confidence"),
                    F.array().cast("array<string>").alias("indicators"),
                )
            ),
        ),
        1,
    )


def _keyword_type(c: Column, keywords: dict[str, list[str]]) -> Column:
    found = None
    for name, keys in keywords.items():
        hit = contains_any(c, keys)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def file_stem(path: Column | str) -> Column:
    """File name without directory and last suffix."""
    name = F.substring_index(col(path), "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def file_suffix(path: Column | str) -> Column:
    """Lower-cased last suffix with its dot; "" without one."""
    return F.lower(F.regexp_extract(F.substring_index(col(path), "/", -1), r"^.+(\.[^.]+)$", 1))


def infer_type(path: Column | str, sample: Column | None = None) -> Column:
    """Type by keywords of the file name, then of the sample; else "standard"."""
    by_name = _keyword_type(F.lower(file_stem(path)), NAME_KEYWORDS)
    if sample is None:
        return F.coalesce(by_name, F.lit("standard"))
    by_content = _keyword_type(F.lower(F.coalesce(sample, F.lit(""))), CONTENT_KEYWORDS)
    return F.coalesce(by_name, by_content, F.lit("standard"))


def looks_like_technical(path: Column | str, sample: Column) -> Column:
    return contains_any(F.lower(file_stem(path)), TECHNICAL_NAME) | contains_any(
        F.lower(F.coalesce(sample, F.lit(""))), TECHNICAL_CONTENT
    )


def looks_like_contract(path: Column | str, sample: Column) -> Column:
    return contains_any(F.lower(file_stem(path)), CONTRACT_NAME) | contains_any(
        F.lower(F.coalesce(sample, F.lit(""))), CONTRACT_CONTENT
    )


def mime_info(mime: Column) -> Column:
    """struct(mime, label, is_supported, is_pdf, is_word, is_excel, is_image); parameters cut."""
    mime = F.trim(F.substring_index(mime, ";", 1))
    labels = F.create_map(*[F.lit(x) for pair in MIME_LABELS.items() for x in pair])
    return F.struct(
        mime.alias("mime"),
        F.coalesce(F.try_element_at(labels, mime), F.concat(F.lit("Desconocido ("), mime, F.lit(")"))).alias("label"),
        mime.isin(list(MIME_LABELS)).alias("is_supported"),
        (mime == "application/pdf").alias("is_pdf"),
        mime.isin(WORD_TYPES).alias("is_word"),
        mime.isin(EXCEL_TYPES).alias("is_excel"),
        mime.startswith("image/").alias("is_image"),
    )


def detect_mime(content: Column | str) -> Column:
    """Type struct from the bytes themselves, never from the name."""
    head = F.hex(F.substring(col(content), 1, 12))
    has = lambda text: F.contains(col(content), F.lit(text.encode()))
    has_wide = lambda text: F.contains(col(content), F.lit(text.encode("utf-16-le")))
    mime = (
        F.when(head.startswith("25504446"), "application/pdf")
        .when(head.startswith("504B0304") & has("word/"), DOCX)
        .when(head.startswith("504B0304") & has("xl/"), XLSX)
        .when(head.startswith("504B0304"), "application/zip")
        .when(head.startswith("D0CF11E0A1B11AE1") & has_wide("WordDocument"), "application/msword")
        .when(head.startswith("D0CF11E0A1B11AE1") & (has_wide("Workbook") | has_wide("Book")), "application/vnd.ms-excel")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("424D"), "image/bmp")
        .when(F.length(col(content)) == 0, "application/x-empty")
        .otherwise("application/octet-stream")
    )
    return F.transform(F.array(mime), mime_info)[0]


class LoaderRule(NamedTuple):
    """A loader and the condition under which it applies; higher priority wins."""

    loader: str
    condition: Column
    priority: int = 10


def loader_conditions(mime: Column, quality: Column) -> dict[str, Column]:
    """Ready-made conditions over a ``mime_info`` struct and a quality struct (may be null)."""
    native = mime["is_pdf"] & F.coalesce(quality["is_native"], F.lit(False))
    return {
        "native_pdf": native,
        "scanned_pdf": mime["is_pdf"] & ~F.coalesce(quality["is_native"], F.lit(False)),
        "any_pdf": mime["is_pdf"],
        "word_document": mime["is_word"],
        "excel_spreadsheet": mime["is_excel"],
        "image_file": mime["is_image"],
        "complex_pdf": native & (quality["total_pages"] > 50),
    }


def route_loader(rules: list[LoaderRule]) -> Column:
    """Loader of the first rule that applies, by descending priority; null when none does."""
    ordered = sorted(rules, key=lambda r: -r.priority)
    return reduce(
        lambda chain, r: chain.when(r.condition, r.loader),
        ordered[1:],
        F.when(ordered[0].condition, ordered[0].loader),
    )


def _plan(loader, cleaner, ocr, doc_type, path, mime, confidence, reasoning) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(loader).alias("loader_type"),
        as_col(cleaner).alias("cleaner_profile"),
        F.lit(ocr).alias("requires_ocr"),
        as_col(doc_type).alias("document_type"),
        col(path).alias("source_path"),
        as_col(mime).alias("mime_type"),
        F.round(as_col(confidence).cast("double"), 3).alias("confidence"),
        as_col(reasoning).alias("reasoning"),
    )


def classify_ingestion(path: Column | str, mime: Column, quality: Column, sample: Column) -> Column:
    """Ingestion plan struct by MIME type and text quality; the fallback plan when nothing is known.

    ``quality`` is a struct(is_native, confidence, total_pages) or null.
    """
    technical = looks_like_technical(path, sample)
    by_name = infer_type(path)
    sure = quality["confidence"] >= 0.80
    native = quality["is_native"]
    conf2 = F.format_string("%.2f", quality["confidence"])
    m = mime["mime"]
    return (
        F.when(
            mime["is_word"],
            _plan("word", F.when(technical, "technical").otherwise("default"), False,
                  F.when(technical, "technical_doc").otherwise("standard"), path, m, 0.95,
                  "Archivo Word detectado por MIME type"),
        )
        .when(
            mime["is_excel"],
            _plan("excel", "default", False, "excel", path, m, 0.97, "Archivo Excel detectado por MIME type"),
        )
        .when(
            mime["is_image"],
            _plan("ocr", "ocr_output", True, "imagen", path, m, 0.95, "Imagen directa — requiere OCR"),
        )
        .when(
            mime["is_pdf"] & native.isNull(),
            _plan("pymupdf", "default", False, infer_type(path, sample), path, m, 0.45,
                  "Calidad PDF indeterminada — PyMuPDF como fallback seguro"),
        )
        .when(
            mime["is_pdf"] & ~native & sure,
            _plan("ocr", "ocr_output", True, by_name, path, m, quality["confidence"],
                  F.concat(F.lit("PDF escaneado (confidence="), conf2, F.lit(")"))),
        )
        .when(
            mime["is_pdf"] & native & sure,
            _plan(F.when(quality["total_pages"] > 50, "docling").otherwise("pymupdf"), "default", False,
                  by_name, path, m, quality["confidence"],
                  F.concat(F.lit("PDF nativo (confidence="), conf2, F.lit(", pages="),
                           quality["total_pages"].cast("string"), F.lit(")"))),
        )
        .when(
            mime["is_pdf"],
            _plan("pymupdf", "default", False, by_name, path, m, 0.55,
                  "Calidad ambigua — confianza baja, puede necesitar revisión"),
        )
        .otherwise(
            _plan("pymupdf", "default", False, "desconocido", path, "application/octet-stream", 0.0,
                  "Fallback: MIME type no reconocido"),
        )
    )


def needs_model(plan: Column, threshold: float = 0.70) -> Column:
    """Plans below the threshold are the ones worth a model call."""
    return plan["confidence"] < threshold
