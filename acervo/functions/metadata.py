"""Structure found in a chunk of legal or technical text, and row identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import col, trim_ws

# What counts as a page mark, article, chapter, and so on.
PAGE = r"\[Página\s*(\d+)\]"
ARTICLE = r"ARTÍCULO\s+([\d\.]+(?:\s*°)?|ÚNICO|PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO)"
ARTICLE_TITLE = r"ARTÍCULO\s+[\d\.]+[°\s]+[\.–\-]?\s*([^\n\.]{5,80})"
CHAPTER = r"CAPÍTULO\s+([IVXivx\d]+(?:\s*[–\-]\s*[A-ZÁÉÍÓÚ][^\n]{0,60})?)"
SECTION = r"SECCIÓN\s+([\d]+(?:\s*[–\-]\s*[A-ZÁÉÍÓÚ][^\n]{0,60})?)"
PARAGRAPH = r"PARÁGRAFO\s*(\d*)"
DOCUMENT_KINDS = {
    "decreto": r"DECRETO\s+(?:NÚMERO\s+)?(\d+)\s+(?:DEL?\s+)?(?:DE\s+)?(\d{4})",
    "resolución": r"RESOLUCIÓN\s+(?:NÚMERO\s+)?(\d+)\s+(?:DEL?\s+)?(?:DE\s+)?(\d{4})",
    "ley": r"LEY\s+(\d+)\s+(?:DEL?\s+)?(?:DE\s+)?(\d{4})",
    "circular": r"CIRCULAR\s+(?:EXTERNA\s+)?(\d+)\s+(?:DEL?\s+)?(?:DE\s+)?(\d{4})",
}
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"  # RFC 4122 URL namespace

METADATA_FIELDS = [
    "source", "path", "loader", "chunk_index", "chunk_size", "page", "article_number",
    "article_title", "chapter", "section", "paragraph", "document_type",
    "document_number", "document_year",
]


def _first(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(col(text), f"(?iuU){pattern}", group)


def extract_page(text: Column | str) -> Column:
    return _first(text, PAGE)


def extract_article_number(text: Column | str) -> Column:
    """Number or ordinal; the degree sign goes, a trailing dot stays."""
    return trim_ws(F.rtrim(trim_ws(_first(text, ARTICLE)), F.lit("°")))


def article_key(number: Column | str) -> Column:
    """Article number with outer dots trimmed, for exact lookup."""
    return F.trim(col(number), F.lit("."))


def extract_article_title(text: Column | str) -> Column:
    title = F.regexp_replace(trim_ws(_first(text, ARTICLE_TITLE)), r"(?U)^[\.–\-\s]+", "")
    return F.substring(title, 1, 100)


def extract_chapter(text: Column | str) -> Column:
    return trim_ws(_first(text, CHAPTER))


def extract_section(text: Column | str) -> Column:
    return trim_ws(_first(text, SECTION))


def extract_paragraph(text: Column | str) -> Column:
    """Paragraph number; "1" when the word stands without one."""
    number = _first(text, PARAGRAPH)
    present = col(text).rlike(f"(?iuU){PARAGRAPH}")
    return F.when(present, F.when(number == "", "1").otherwise(number)).otherwise("")


def extract_document_info(text: Column | str) -> Column:
    """struct(document_type, document_number, document_year) of the first kind found."""
    found = None
    for kind, pattern in DOCUMENT_KINDS.items():
        row = F.struct(
            F.lit(kind).alias("document_type"),
            _first(text, pattern, 1).alias("document_number"),
            _first(text, pattern, 2).alias("document_year"),
        )
        present = col(text).rlike(f"(?iuU){pattern}")
        found = F.when(present, row) if found is None else found.when(present, row)
    empty = F.struct(*[F.lit("").alias(n) for n in ("document_type", "document_number", "document_year")])
    return found.otherwise(empty)


def extract_metadata(
    text: Column | str,
    *,
    source: Column | None = None,
    path: Column | None = None,
    loader: Column | None = None,
    chunk_index: Column | None = None,
) -> Column:
    """All fields of a chunk as one typed struct (``METADATA_FIELDS``)."""
    info = extract_document_info(text)
    text_or = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    return F.struct(
        text_or(source).alias("source"),
        text_or(path).alias("path"),
        text_or(loader).alias("loader"),
        (chunk_index if chunk_index is not None else F.lit(0)).cast("int").alias("chunk_index"),
        F.length(col(text)).alias("chunk_size"),
        extract_page(text).alias("page"),
        extract_article_number(text).alias("article_number"),
        extract_article_title(text).alias("article_title"),
        extract_chapter(text).alias("chapter"),
        extract_section(text).alias("section"),
        extract_paragraph(text).alias("paragraph"),
        info["document_type"].alias("document_type"),
        info["document_number"].alias("document_number"),
        info["document_year"].alias("document_year"),
    )


def metadata_as_strings(meta: Column) -> Column:
    """map<string,string> view of the struct: every value as text, null as ""."""
    entries = []
    for name in METADATA_FIELDS:
        entries += [F.lit(name), F.coalesce(meta[name].cast("string"), F.lit(""))]
    return F.create_map(*entries)


def contextual_header(meta: Column) -> Column:
    """``[Fuente: … | Art. … | Página: … | Decreto 2015]\\n``; "" when nothing is known."""
    place = F.when(meta["article_number"] != "", F.concat(F.lit("Art. "), meta["article_number"])).when(
        meta["chapter"] != "", F.concat(F.lit("Cap. "), meta["chapter"])
    )
    law = F.when(
        (meta["document_type"] != "") & (meta["document_year"] != ""),
        F.concat(F.initcap(meta["document_type"]), F.lit(" "), meta["document_year"]),
    )
    parts = F.concat_ws(
        " | ",
        F.when(meta["source"] != "", F.concat(F.lit("Fuente: "), meta["source"])),
        place,
        F.when(meta["page"] != "", F.concat(F.lit("Página: "), meta["page"])),
        law,
    )
    return F.when(parts == "", "").otherwise(F.concat(F.lit("["), parts, F.lit("]\n")))


def _source_key(source: Column | str, chunk_index: Column | str, mark: str) -> Column:
    """``source<mark>index`` or null when either is missing."""
    index = col(chunk_index).cast("string")
    return F.when((col(source) != "") & (index != ""), F.concat(col(source), F.lit(mark), index))


def chunk_id(source: Column | str, chunk_index: Column | str, text: Column | str, document: Column | str | None = None) -> Column:
    """Store id: ``source::index`` else MD5 of the text, made safe.

    Where several documents share a source, ``document`` keeps their chunks apart:
    ``source::document::index``.  An id of more than 512 characters keeps its first 479 and
    the MD5 of the whole, so long ids stay distinct.
    """
    key = source if document is None else F.concat_ws("::", F.when(col(source) != "", col(source)), col(document).cast("string"))
    raw = F.translate(F.coalesce(_source_key(key, chunk_index, "::"), F.md5(col(text))), " /\\", "___")
    return F.when(F.length(raw) > 512, F.concat(F.substring(raw, 1, 479), F.lit("_"), F.md5(raw))).otherwise(raw)


def result_id(source: Column | str, chunk_index: Column | str, text: Column | str) -> Column:
    """Id used when merging result lists: as above but unescaped, and of the whole text."""
    return F.coalesce(_source_key(source, chunk_index, "::"), F.md5(col(text)))


def uuid5_url(name: Column | str) -> Column:
    """UUID version 5 in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(col(name), "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def parent_id(
    doc_id: Column | str, alt_id: Column | str, source: Column | str, chunk_index: Column | str, text: Column | str,
    prefix: int | None = None,
) -> Column:
    """Given id, else ``source::chunk_n``, else UUIDv5 of the text, or of its first ``prefix`` characters."""
    given = [F.when(col(c).cast("string") != "", col(c).cast("string")) for c in (doc_id, alt_id)]
    return F.coalesce(
        *given, _source_key(source, chunk_index, "::chunk_"), uuid5_url(col(text) if prefix is None else F.substring(col(text), 1, prefix))
    )


def query_hash(text: Column | str) -> Column:
    return F.md5(trim_ws(F.lower(col(text))))


def was_reformulated(query: Column | str, active: Column | str) -> Column:
    return col(active).isNotNull() & (trim_ws(active) != trim_ws(query))
