"""Page-wise documents: stitching, text quality, OCR boxes, word-processor blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import blank, trim_ws

# Fixed values.
TEXT_THRESHOLD, OCR_CONFIDENCE, LINE_TOLERANCE = 50, 0.4, 0.015
HEADING_STYLES = ["heading 1", "heading 2", "heading 3", "título 1", "título 2", "título 3", "estilo1", "estilo2"]
LIST_STYLES = ["list paragraph", "list bullet", "list number", "párrafo de lista", "viñeta de lista"]
BLOCKS_PER_PIECE = 2000


def stitch_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(doc_id, page_no, text) → (doc_id, text, pages_processed).

    All pages (those up to ``max_pages`` where that is given), blank ones skipped, each
    under ``[Página n]``.  A document is put together as one value.
    """
    kept = pages.filter(~blank("text") if max_pages is None else (F.col("page_no") <= max_pages) & ~blank("text"))
    marked = kept.select(
        "doc_id", F.struct("page_no", F.format_string("[Página %d]\n%s", "page_no", "text").alias("text")).alias("_page")
    )
    gathered = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list("_page")).alias("_pages"))
    return gathered.select(
        "doc_id",
        F.array_join(F.transform("_pages", lambda p: p["text"]), "\n\n").alias("text"),
        F.size("_pages").alias("pages_processed"),
    )


def quality_label(is_native: Column, confidence: Column) -> Column:
    return F.concat(
        F.when(is_native, "native").otherwise("scanned"), F.when(confidence >= 0.8, "_high_confidence").otherwise("_low_confidence")
    )


def text_quality(pages: DataFrame, threshold: int = TEXT_THRESHOLD) -> DataFrame:
    """Per document of (doc_id, page_no, text, has_fonts): native or scanned, with confidence.

    A page number of null stands for a document without pages.
    """
    chars = F.length(trim_ws(F.coalesce("text", F.lit(""))))
    present = F.col("page_no").isNotNull()
    totals = pages.groupBy("doc_id").agg(
        F.count("page_no").alias("total_pages"),
        F.sum(F.when(present, chars)).alias("_chars"),
        F.count_if(present & (chars >= threshold)).alias("pages_with_text"),
        F.coalesce(F.bool_or("has_fonts"), F.lit(False)).alias("has_embedded_fonts"),
    )
    some = F.col("total_pages") > 0
    avg = F.when(some, F.col("_chars") / F.col("total_pages")).otherwise(0.0)
    ratio = F.when(some, F.col("pages_with_text") / F.col("total_pages")).otherwise(0.0)
    native = F.col("_avg") >= threshold
    distance = F.least(F.col("_avg") / (threshold * 3), F.lit(1.0))
    nearness = 1.0 - F.least(F.col("_avg") / threshold, F.lit(1.0))
    base = F.when(native, 0.5 + 0.3 * distance + 0.2 * F.col("_ratio")).otherwise(
        0.5 + 0.3 * nearness + 0.2 * (1.0 - F.col("_ratio"))
    )
    fonts = F.col("has_embedded_fonts")
    confidence = (
        F.when(fonts & native, F.least(base + 0.15, F.lit(1.0)))
        .when(~fonts & ~native, F.least(base + 0.1, F.lit(1.0)))
        .otherwise(base)
    )
    scored = totals.withColumn("_avg", avg).withColumn("_ratio", ratio).withColumn("confidence", F.round(confidence, 3))
    return scored.select(
        "doc_id",
        native.alias("is_native"),
        (~native).alias("is_scanned"),
        F.round("_avg", 2).alias("avg_chars_per_page"),
        "total_pages",
        "pages_with_text",
        (F.col("total_pages") - F.col("pages_with_text")).alias("pages_without_text"),
        "has_embedded_fonts",
        "confidence",
        quality_label(native, F.col("confidence")).alias("quality_label"),
    )


def classify_batch(documents: DataFrame, quality: DataFrame) -> DataFrame:
    """(doc_id, class): native or scanned; documents without a quality row count as scanned."""
    known = quality.select("doc_id", F.when(F.col("is_native"), "native").otherwise("scanned").alias("class"))
    return documents.select("doc_id").join(known, "doc_id", "left").withColumn("class", F.coalesce("class", F.lit("scanned")))


def pages_processed(chunks: DataFrame, key: str = "source", page: str = "page") -> DataFrame:
    """Distinct non-null pages (or sheets) per document."""
    return chunks.groupBy(key).agg(F.count_distinct(page).alias("pages_processed"))


def ocr_confidence_filter(boxes: DataFrame, threshold: float = OCR_CONFIDENCE) -> DataFrame:
    return boxes.filter((F.col("conf") >= threshold) & ~blank("text"))


def ocr_line_groups(boxes: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """(doc_id, page_no, page_height, bbox, text, conf) → (doc_id, page_no, text).

    Boxes in order of their centre's height; a box further than the tolerance
    from the first box of its line opens a new line; lines read left to right.
    """
    centre = lambda axis: F.aggregate(
        F.transform("bbox", lambda p: F.get(p, F.lit(axis))), F.lit(0.0).cast("double"), lambda a, v: a + v
    ) / F.size("bbox")
    items = ocr_confidence_filter(boxes).select(
        "doc_id", "page_no", F.struct(centre(1).alias("y"), centre(0).alias("x"), F.col("text").alias("t")).alias("_box"),
        (F.col("page_height") * tolerance).alias("_tolerance"),
    )
    by_height = F.array_sort(
        F.collect_list("_box"),
        lambda a, b: F.when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).otherwise(0),
    )
    page = items.groupBy("doc_id", "page_no").agg(by_height.alias("_boxes"), F.max("_tolerance").alias("_tolerance"))
    line_type = "array<struct<y:double,boxes:array<struct<x:double,t:string>>>>"

    def place(lines: Column, box: Column) -> Column:
        last = F.element_at(lines, -1)
        item = F.array(F.struct(box["x"].alias("x"), box["t"].alias("t")))
        same = (F.size(lines) > 0) & (F.abs(box["y"] - last["y"]) <= F.col("_tolerance"))
        grown = F.struct(last["y"].alias("y"), F.concat(last["boxes"], item).alias("boxes"))
        fresh = F.struct(box["y"].alias("y"), item.alias("boxes"))
        before = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.when(same, F.concat(before, F.array(grown))).otherwise(F.concat(lines, F.array(fresh)))

    lines = F.aggregate("_boxes", F.array().cast(line_type), place)
    by_x = lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0)
    line_text = lambda line: F.array_join(F.transform(F.array_sort(line["boxes"], by_x), lambda b: b["t"]), " ")
    return page.select("doc_id", "page_no", F.array_join(F.transform(lines, line_text), "\n").alias("text"))


def block_text(style: Column, text: Column) -> Column:
    """Text of one word-processor block; null when blank."""
    body, name = trim_ws(text), F.lower(F.coalesce(style, F.lit("")))
    return F.when(body != "", F.when(name.isin(HEADING_STYLES), F.concat(F.lit("\n\n"), body, F.lit("\n")))
                  .when(name.isin(LIST_STYLES), F.concat(F.lit("  - "), body)).otherwise(body))


def docx_blocks_to_text(blocks: DataFrame, per_piece: int = BLOCKS_PER_PIECE) -> DataFrame:
    """(doc_id, block_no, style, text) → (doc_id, piece, text).

    An ordinary document is one piece; a longer one comes in pieces of
    ``per_piece`` blocks, which joined by newlines are the whole text.
    """
    kept = blocks.withColumn("_line", block_text(F.col("style"), F.col("text"))).filter(F.col("_line").isNotNull())
    piece = F.floor(F.col("block_no") / per_piece).cast("int").alias("piece")
    gathered = kept.groupBy("doc_id", piece).agg(F.array_sort(F.collect_list(F.struct("block_no", "_line"))).alias("_rows"))
    return gathered.select("doc_id", "piece", F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n").alias("text"))
