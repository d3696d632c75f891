"""Texts to chunks: one row in, many out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.classify import detect_document_type
from acervo.functions.cleaning import clean
from acervo.functions.metadata import contextual_header, extract_metadata
from acervo.functions.splitter import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    HIERARCHICAL,
    MARKDOWN,
    SEPARATORS,
    recursive_split,
    recursive_split_by_type,
    split_long_pieces,
)
from acervo.functions.text import blank, col, trim_ws

# Where a segment starts, and the shortest chunk kept.
SEGMENT_START = r"(?iuU)(?=\n(?:#+\s|CAPÍTULO|SECCIÓN|PARTE)\b)"
HEADER_LINE = r"(?mdU)(?=^#{1,3}\s)"
MIN_CHUNK, MIN_MARKDOWN_CHUNK = 100, 50


def min_chunk_length(df: DataFrame, n: int = MIN_CHUNK, text: str = "text") -> DataFrame:
    """Drop chunks whose stripped text is shorter than ``n``."""
    return df.filter(F.length(trim_ws(text)) >= n)


def number_chunks(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """Explode an array of chunk texts to (…, chunk_index, text); 0-based per row."""
    # the outer form: a plain explode adds a filter on the array and runs the splitter twice
    rows = df.select("*", F.posexplode_outer(chunks).alias("chunk_index", "_chunk")).filter(F.col("_chunk").isNotNull())
    return rows.drop(chunks, "text").withColumnRenamed("_chunk", "text")


def adaptive_chunk(
    docs: DataFrame,
    *,
    document_type: str | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: dict[str, list[str]] = SEPARATORS,
) -> DataFrame:
    """Chunks by the separators of the document's type.

    The type is the argument, else the row's ``document_type``, else detected;
    adds document_type, chunking_confidence and chunk_index.
    """
    if document_type is not None:
        typed = docs.withColumn("document_type", F.lit(document_type)).withColumn("chunking_confidence", F.lit(1.0))
    elif "document_type" in docs.columns:
        typed = docs.withColumn("chunking_confidence", F.lit(1.0))
    else:
        detected = docs.withColumn("_type", detect_document_type("text"))
        typed = detected.select(
            *docs.columns, F.col("_type.doc_type").alias("document_type"),
            F.col("_type.confidence").alias("chunking_confidence"),
        )
    split = recursive_split_by_type(separators, size, overlap)
    return number_chunks(typed.withColumn("chunks", split("text", "document_type")))


def segment_by_headers(text: Column | str) -> Column:
    """Segments that start at a heading; blank ones dropped."""
    return F.filter(F.split(col(text), SEGMENT_START), lambda part: ~blank(part))


def _chunks_of_pieces(docs: DataFrame, pieces: Column, separators: list[str], size: int, overlap: int, shortest: int) -> DataFrame:
    """Split the long pieces, drop short chunks, and number what is left per document.

    The pieces of a document stay in its row as one array until the final
    explode, so no shuffle is needed to keep or number them in order.
    """
    split = split_long_pieces(separators, size, overlap)
    kept = F.filter("chunks", lambda c: F.length(trim_ws(c)) >= shortest)
    return number_chunks(docs.withColumn("chunks", split(pieces)).withColumn("chunks", kept))


def hierarchical_chunk(
    docs: DataFrame,
    *,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    shortest: int = MIN_CHUNK,
    add_header: bool = True,
    loader: Column | None = None,
    path: Column | None = None,
) -> DataFrame:
    """Heading segments, whole when short and split when long, with metadata and a context header.

    ``docs`` has (source, text, …); adds chunk_index, meta (struct) and the final text.
    """
    segments = F.filter(F.transform(segment_by_headers("text"), trim_ws), lambda s: s != "")
    chunks = _chunks_of_pieces(docs, segments, HIERARCHICAL, size, overlap, shortest)
    meta = extract_metadata("text", source=F.col("source"), path=path, loader=loader, chunk_index=F.col("chunk_index"))
    with_meta = chunks.withColumn("meta", meta)
    body = trim_ws("text")
    final = F.concat(contextual_header(F.col("meta")), body) if add_header else body
    titled = with_meta.withColumn("text", final)
    return titled.withColumn("meta", F.col("meta").withField("chunk_size", F.length("text")))


def markdown_header_split(docs: DataFrame, *, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                          shortest: int = MIN_MARKDOWN_CHUNK) -> DataFrame:
    """Sections that open with #, ## or ###, headings kept; long ones split."""
    sections = F.filter(F.transform(F.split("text", HEADER_LINE), trim_ws), lambda s: s != "")
    return _chunks_of_pieces(docs, sections, MARKDOWN, size, overlap, shortest)


def chunk_with_profile(docs: DataFrame, profile: Column | str = "default", **options) -> DataFrame:
    """Clean by profile, then chunk by headings."""
    return hierarchical_chunk(docs.withColumn("text", clean("text", profile)), **options)


def parents_and_children(docs: DataFrame, *, size: int = 400, overlap: int = 0) -> tuple[DataFrame, DataFrame]:
    """Heading segments as parents, their splits as children linked by ``parent_id``.

    ``docs`` has (doc_id, source, text).  Parents: (parent_id, source, position,
    text); children: (doc_id, parent_id, source, chunk_index, text).
    """
    parents = docs.select(
        "doc_id", "source", F.posexplode(segment_by_headers("text")).alias("position", "text")
    ).select(F.concat_ws("::parent_", F.col("doc_id").cast("string"), "position").alias("parent_id"), "source", "position", "text")
    split = recursive_split(HIERARCHICAL, size, overlap)
    children = number_chunks(parents.withColumn("chunks", split("text")))
    return parents, children.select(
        F.concat_ws("::chunk_", "parent_id", "chunk_index").alias("doc_id"), "parent_id", "source", "chunk_index", "text"
    )
