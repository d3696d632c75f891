"""Spreadsheet rows to text chunks.

Sheets are tables of string cells: (sheet, row_no, cells…).  A sheet may be of any
length: positions are counted in steps of its row numbers and put together from the sums
of the steps before, so no window holds a whole long sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.metadata import extract_metadata
from acervo.functions.text import blank, trim_ws

ROWS_PER_CHUNK, SHEET_STRIDE, HEADER_COLUMNS = 20, 1000, 10  # fixed values
SLOT = 65_536  # rows that are counted together


def _slots(rows: DataFrame, keys: list[str], name: str, slot: int) -> DataFrame:
    """Adds ``name``: equal steps of row numbers, so wide that one of them holds about ``slot`` rows of its key if these are spread evenly."""
    span = rows.groupBy(*keys).agg(F.min("row_no").cast("long").alias("_low"), F.max("row_no").cast("long").alias("_high"), F.count("*").alias("_rows"))
    step = F.greatest(F.ceil((F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_rows") / slot)), F.lit(1))
    steps = span.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_low", step.alias("_step"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    at = F.floor((F.col("row_no").cast("long") - F.col("_low")) / F.col("_step"))
    return rows.join(steps, same, "left").withColumn(name, F.coalesce(at, F.lit(-1))).drop("_low", "_step", *[f"_of_{k}" for k in keys])


def positions(rows: DataFrame, slot: int = SLOT) -> DataFrame:
    """Adds ``position`` (1-based per sheet, by row_no) and ``sheet_rows``.

    The steps follow each sheet's own numbers, however sparse; a step that gathers many rows
    of an unevenly numbered sheet is cut once more by its own numbers.
    """
    placed = _slots(_slots(rows, ["sheet"], "_slot", slot), ["sheet", "_slot"], "_cut", slot)
    counts = placed.groupBy("sheet", "_slot", "_cut").agg(F.count("*").alias("_n"))
    sheet = Window.partitionBy("sheet")
    before = F.sum("_n").over(sheet.orderBy("_slot", "_cut").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        F.col("sheet").alias("_sheet"), F.col("_slot").alias("_s"), F.col("_cut").alias("_c"),
        F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(sheet).alias("sheet_rows"))
    inside = F.row_number().over(Window.partitionBy("sheet", "_slot", "_cut").orderBy("row_no"))
    joined = placed.withColumn("_inside", inside).join(
        offsets, F.col("sheet").eqNullSafe(F.col("_sheet")) & (F.col("_slot") == F.col("_s")) & (F.col("_cut") == F.col("_c")))
    return joined.withColumn("position", (F.col("_before") + F.col("_inside")).cast("int")).drop("_slot", "_cut", "_sheet", "_s", "_c", "_before", "_inside")


def read_sheet(rows: DataFrame, columns: list[str], *, sheet: str = "sheet", row_no: str = "row_no",
               max_rows: int | None = None, sheets: list[str] | None = None) -> DataFrame:
    """Rows of each sheet (its first ``max_rows`` where that is given) as strings: nulls "", all-empty rows dropped."""
    chosen = rows.filter(F.col(sheet).isin(sheets)) if sheets else rows
    strings = chosen.select(
        F.col(sheet).alias("sheet"),
        F.col(row_no).alias("row_no"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns],
    )
    if max_rows is not None:
        strings = positions(strings).filter(F.col("position") <= max_rows).drop("position", "sheet_rows")
    return strings.filter(F.concat(*columns) != "")


def rows_to_paragraph(columns: list[str]) -> Column:
    """``name: value | …`` of one row; blank, nan and none values skipped; "" when nothing is left."""
    def part(name: str) -> Column:
        value = trim_ws(F.col(name))
        return F.when(~F.lower(value).isin("", "nan", "none"), F.concat(F.lit(f"{name}: "), value))

    return F.concat_ws(" | ", *[part(c) for c in columns])


def markdown_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_header(columns: list[str]) -> str:
    return "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |"


def word_table(cells: Column) -> Column:
    """array<array<string>> → Markdown table; newlines in cells become spaces; one row stays a bare line."""
    clean = F.transform(cells, lambda row: F.transform(row, lambda c: F.replace(trim_ws(c), F.lit("\n"), F.lit(" "))))
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
    rule = F.transform(F.element_at(clean, 1), lambda c: F.lit("---"))
    table = F.concat_ws(
        "\n",
        line(F.element_at(clean, 1)),
        line(rule),
        F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(1))), line),
    )
    return (
        F.when(F.coalesce(F.size(cells), F.lit(0)) < 1, "")
        .when(F.size(cells) == 1, F.array_join(F.try_element_at(clean, F.lit(1)), " | "))
        .otherwise(table)
    )


def row_groups(sheet_rows: DataFrame, n: int = ROWS_PER_CHUNK) -> DataFrame:
    """Adds position (1-based, per sheet), block, row_start and row_end of blocks of ``n`` rows."""
    block = F.floor((F.col("position") - 1) / n).cast("int")
    return positions(sheet_rows).withColumn("block", block).withColumn("row_start", block * n + 1).withColumn(
        "row_end", F.least(block * n + n, F.col("sheet_rows").cast("int"))
    ).drop("sheet_rows")


def sheet_chunk_header(source: Column) -> Column:
    return F.format_string("[Hoja: %s | Filas: %d–%d | Fuente: %s]\n", "sheet", "row_start", "row_end", source)


def sheet_to_chunks(
    sheet_rows: DataFrame,
    columns: list[str],
    source: Column,
    *,
    sheet_index: Column | None = None,
    n: int = ROWS_PER_CHUNK,
    markdown: bool = False,
) -> DataFrame:
    """Blocks of ``n`` rows as chunks with header and metadata.

    chunk_index = sheet_index · 1000 + block.  Blocks hold at most ``n`` rows, so
    gathering one in a task is bounded.
    """
    line = markdown_row([trim_ws(F.col(c)) for c in columns]) if markdown else rows_to_paragraph(columns)
    index = sheet_index if sheet_index is not None else F.lit(0)
    lines = row_groups(sheet_rows, n).select(
        "sheet", "block", "row_start", "row_end", source.alias("source"), index.alias("sheet_index"), "position", line.alias("line")
    )
    grouped = lines.groupBy("sheet", "block", "row_start", "row_end", "source", "sheet_index").agg(
        F.array_sort(F.collect_list(F.struct("position", "line"))).alias("_rows")
    )
    texts = F.filter(F.transform("_rows", lambda r: r["line"]), lambda s: s != "")
    content = F.array_join(texts, "\n")
    content = F.concat(F.lit(markdown_header(columns) + "\n"), content) if markdown else content
    full = grouped.withColumn("_content", content).filter(~blank("_content")).select(
        "sheet",
        (F.col("sheet_index") * SHEET_STRIDE + F.col("block")).cast("int").alias("chunk_index"),
        "row_start",
        "row_end",
        "source",
        F.lit(", ".join(columns[:HEADER_COLUMNS])).alias("columns"),
        F.concat(sheet_chunk_header(F.col("source")), F.col("_content")).alias("text"),
    )
    meta = extract_metadata("text", source=F.col("source"), loader=F.lit("excel"), chunk_index=F.col("chunk_index"))
    return full.withColumn("meta", meta)
