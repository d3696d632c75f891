"""Files as rows: reading, typing, fingerprints, keyword search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.classify import UPLOAD_SUFFIXES, detect_mime, file_stem, file_suffix
from acervo.functions.text import blank

SEARCH_CHARS = 500  # fixed value


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime, content) of every file below ``path``."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )


def read_files(
    spark: SparkSession, path: str, pattern: str = "*", *, expected: DataFrame | None = None, stop_on_first_error: bool = False
) -> DataFrame:
    """One result row per file: (path, mime, text, loader, errors, success).

    Text files come with their text.  A blank, undecodable or unsupported file
    becomes an error row; ``stop_on_first_error`` fails the job instead.
    ``expected`` is a table of paths that should be there (as Spark spells them,
    ``file:/…``): a missing one also becomes an error row.  Spark does not list
    files of zero bytes, so those show up only as missing.
    """
    files = read_binary(spark, path, pattern).withColumn("mime", detect_mime("content"))
    plain = F.col("path").rlike(r"(?i)\.(md|txt|csv|json|html?)$")
    content = F.col("content").cast("string")
    text = F.when(plain & F.is_valid_utf8(content), content)
    loader = (
        F.when(plain, "text").when(F.col("mime.is_pdf"), "pdf").when(F.col("mime.is_word"), "word")
        .when(F.col("mime.is_excel"), "excel").when(F.col("mime.is_image"), "ocr")
    )
    rows = files.select("path", "mime", text.alias("text"), loader.alias("loader"), plain.alias("_plain"), F.lit(True).alias("_there"))
    if expected is not None:
        rows = expected.select("path").distinct().join(rows, "path", "full")
    problem = (
        F.when(F.col("_there").isNull(), F.concat(F.lit("Archivo no encontrado o vacío: "), "path"))
        .when(F.col("_plain") & F.col("text").isNull(), F.concat(F.lit("Texto no decodificable: "), "path"))
        .when(F.col("_plain") & blank("text"), F.concat(F.lit("Documento vacío o no legible: "), "path"))
        .when(F.col("loader").isNull(), F.concat(F.lit("Formato no soportado: "), F.col("mime.label"), F.lit(" "), F.col("path")))
    )
    if stop_on_first_error:
        problem = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(problem)
    judged = rows.withColumn("_problem", problem)
    return judged.select(
        "path", "mime", "text", "loader",
        F.filter(F.array("_problem"), lambda e: e.isNotNull()).alias("errors"),
        F.col("_problem").isNull().alias("success"),
    )


def detect_many(files: DataFrame, *, skip_unsupported: bool = True) -> DataFrame:
    """Type struct per file (path, content); unsupported ones are dropped, or fail the job."""
    typed = files.select("path", detect_mime("content").alias("mime"))
    if skip_unsupported:
        return typed.filter("mime.is_supported")
    refused = F.raise_error(F.concat(F.lit("Formato no soportado: "), F.col("mime.label"), F.lit(" "), F.col("path")))
    return typed.withColumn("mime", F.when(F.col("mime.is_supported"), F.col("mime")).otherwise(refused.cast(typed.schema["mime"].dataType)))


def upload_gate(files: DataFrame, name: str = "filename") -> DataFrame:
    """Files whose lower-cased suffix is accepted."""
    return files.filter(file_suffix(name).isin(UPLOAD_SUFFIXES))


def file_fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds file_hash: SHA-256 of the bytes, 64 hex digits."""
    return files.withColumn("file_hash", F.sha2(F.col(content), 256))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """First file of each (session_id, file_hash) that is not known yet."""
    keys = ["session_id", "file_hash"]
    once = files.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in files.columns if c not in keys]), "path").alias("_file"))
    return once.select(*keys, "_file.*").join(known.select(*keys), keys, "left_anti")


def search_texts(texts: DataFrame, query: str, sample_chars: int | None = SEARCH_CHARS) -> DataFrame:
    """Rows (path, text) with the query in the file stem, else in the first ``sample_chars`` characters (None: all); any case."""
    wanted = query.lower()
    in_name = F.lower(file_stem("path")).contains(wanted)
    read = F.col("text") if sample_chars is None else F.substring("text", 1, sample_chars)
    return texts.filter(in_name | F.lower(read).contains(wanted)).select("path")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to ``root``, text) of every .md file below it."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.md", "wholetext": "true"}
    rows = spark.read.options(**options).text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    full = F.col("_metadata.file_path")
    return rows.select(F.regexp_replace(full, "^.*?" + root.rstrip("/") + "/", "").alias("path"), F.col("value").alias("text"))


def search_text_files(spark: SparkSession, root: str, query: str, sample_chars: int | None = SEARCH_CHARS) -> DataFrame:
    return search_texts(read_markdown(spark, root), query, sample_chars)


def list_text_files(spark: SparkSession, root: str) -> DataFrame:
    """All .md paths but INDEX.md."""
    return read_markdown(spark, root).select("path").filter(F.substring_index("path", "/", -1) != "INDEX.md")
