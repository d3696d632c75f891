"""WARC derivatives: from responses, linked metadata and plain-text conversion records.

Each response yields a ``metadata`` record (application/warc-fields: title, outlinks, the
source's HTTP headers and digest) and a ``conversion`` record (text/plain), both referring
to the response by its identifier.  All of it is column functions over one scan; nothing
is shuffled.  ``write_warc`` lays records out as gzip-compressed WARC files, ``read_warc``
reads such files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements that end a line, and character references.
BLOCKS = "p|div|br|li|ul|ol|tr|td|th|table|h1|h2|h3|h4|h5|h6|article|section|header|footer|nav|title|blockquote|pre|hr"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&euro;": "€"}
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"
HIDDEN = "(?is)<!--.*?(?:-->|\\z)|<script\\b.*?(?:</script\\s*>|\\z)|<style\\b.*?(?:</style\\s*>|\\z)"
HREF = "(?i)href\\s*=\\s*(\"[^\"\\r\\n]*\"|'[^'\\r\\n]*'|[^\\s\"'<>]+)"
TITLE = "(?i)<title[^<>]*>([^<]*)"


def sha1_digest(text: Column) -> Column:
    """``sha1:`` and the digest in base 32, as WARC tools write it."""
    hexed = F.sha1(text.cast("binary"))
    part = lambda k: F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0")
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*map(part, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32))


def urn(*parts: Column) -> Column:
    """A record identifier that depends on the parts alone."""
    h = F.md5(F.concat_ws(" ", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def character(code: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")


def unescaped(text: Column) -> Column:
    """Character references replaced; numeric ones piece by piece."""
    def piece(x: Column, i: Column) -> Column:
        decimal, hexadecimal = F.regexp_extract(x, "^([0-9]{1,7});", 1), F.regexp_extract(x, "^[xX]([0-9a-fA-F]{1,6});", 1)
        rest = F.regexp_replace(x, "^[^;]*;", "")
        return (F.when(i == 0, x).when(decimal != "", F.concat(character(decimal.cast("long")), rest))
                .when(hexadecimal != "", F.concat(character(F.conv(hexadecimal, 16, 10).cast("long")), rest)).otherwise(F.concat(F.lit("&#"), x)))

    text = F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(F.split(text, "&#"), piece), "")).otherwise(text)
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def plain_text(html: Column) -> Column:
    """Visible text, one line per block; scripts, styles and comments go, unclosed ones with all that follows.

    A tag ends at the next ``<`` at the latest and no pattern repeats a group, so that the
    time is linear and the stack flat, whatever the page.
    """
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(text, f"(?i)</?(?:{BLOCKS})(?:[\\s/][^<>]*)?>", "\n")
    text = unescaped(F.regexp_replace(text, "<[^<>]*>", ""))
    text = F.regexp_replace(text, "[ \\t\\f\\r]+", " ")
    return F.regexp_replace(F.regexp_replace(text, "[ \\n]*\\n[ \\n]*", "\n"), "^[ \\n]+|[ \\n]+$", "")


def one_line(value: Column) -> Column:
    """A value for a header or field line: line breaks are percent-encoded, so it cannot begin another line."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def outlinks(html: Column) -> Column:
    """The targets of ``href`` in double, single or no quotes."""
    found = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.transform(found, lambda x: one_line(unescaped(F.regexp_replace(x, "^[\"']|[\"']$", ""))))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled ``pages`` (page_id, url, html): (page_id, record_id, target_uri, date, http_headers, payload)."""
    payload = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length("payload").cast("string"))
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha1(F.col("payload").cast("binary"))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), "payload")


def derived(source: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response.

    ``source``: page_id, record_id, target_uri, date, http_headers, payload; other columns
    are ignored.  Returns (page_id, warc_type, record_id, refers_to, target_uri,
    content_length, block_digest, source_digest, header, block).  A null payload is an empty
    one and still gives both records; a null target leaves its header line out; line breaks
    in values are percent-encoded; very long payloads take time in proportion; repeated rows
    give equal records; an empty table gives an empty result.
    """
    rows = source.select("page_id", "record_id", "target_uri", "date", F.coalesce("http_headers", F.lit("")).alias("http_headers"), F.coalesce("payload", F.lit("")).alias("payload"))
    title = F.trim(F.regexp_replace(unescaped(F.regexp_extract("payload", TITLE, 1)), "[\\s]+", " "))
    links = F.transform(outlinks(F.col("payload")), lambda x: F.concat(F.lit("outlink: "), x))
    kept = F.transform(F.filter(F.split("http_headers", "\r\n|\r|\n"), lambda x: x != ""), lambda x: F.concat(F.lit("source-header: "), x))
    rows = rows.select("*", sha1_digest(F.col("payload")).alias("source_digest"))
    fields = F.concat(F.array(F.concat(F.lit("source-payload-digest: "), F.col("source_digest")), F.concat(F.lit("source-payload-length: "), F.octet_length("payload").cast("string")),
                              F.concat(F.lit("title: "), title)), kept, links)
    made = F.array(F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.concat(F.array_join(fields, EOL), F.lit(EOL)).alias("block")),
                   F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")))
    rows = rows.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "source_digest", F.inline(made))
    rows = rows.select("*", urn("warc_type", "refers_to").alias("record_id"), F.octet_length("block").cast("long").alias("content_length"), sha1_digest(F.col("block")).alias("block_digest"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), one_line(value))
    header = F.concat_ws(EOL, F.lit("WARC/1.1"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
                         line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")),
                         line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")))
    return rows.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_length", "block_digest", "source_digest", header.alias("header"), "block")


def write_warc(records: DataFrame, path: str) -> None:
    """Records as gzip-compressed WARC files, one per task; a record ends in two empty lines, which is the line separator here."""
    lines = records.select(F.concat("header", F.lit(EOL * 2), "block").alias("value"))
    lines.write.option("lineSep", EOL * 2).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of ``.warc`` and ``.warc.gz`` files: (file, nth, warc_type, record_id, refers_to, target_uri, date, headers, block).

    ``headers`` is a map by lower-cased name, of a repeated one the last; ``block`` is
    binary.  A file, of at most 2 GB, is one task, unpacked piece by piece; a record cut off at
    its end is returned as far as it goes.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for nth, (head, block) in enumerate(unpacked(content)):
                    rows.append((name, nth, *(head.get(k) for k in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date")), head, block))
                    size += len(block)
                    if size > 16_000_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns)

    columns = ["file", "nth", "warc_type", "record_id", "refers_to", "target_uri", "date", "headers", "block"]
    files = spark.read.format("binaryFile").load(path).where("path like '%.warc' or path like '%.gz'").select("path", "content")
    return files.mapInPandas(run, "file string, nth long, warc_type string, record_id string, refers_to string, target_uri string, date string, headers map<string,string>, block binary")


def unpacked(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a file; each may be a gzip member of its own."""
    held = bytearray()
    pieces = gunzipped(content) if content[:2] == b"\x1f\x8b" else iter([content])
    for piece in chain(pieces, [None]):
        held += piece or b""
        while (end := held.find(b"\r\n\r\n")) >= 0:
            lines = bytes(held[:end]).decode("utf-8", "replace").strip("\r\n").split("\r\n")
            head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            length = int(head["content-length"]) if head.get("content-length", "").isdigit() else 0
            if piece is not None and len(held) < end + 8 + length:
                break
            yield head, bytes(held[end + 4:end + 4 + length])
            del held[:end + 8 + length]


def gunzipped(content: bytes, step: int = 1_000_000) -> Iterator[bytes]:
    """The unpacked pieces of one or many gzip members."""
    left = memoryview(content)
    while len(left):
        member = zlib.decompressobj(31)
        while len(left) and not member.eof:
            yield member.decompress(left[:step])
            used = min(step, len(left)) - len(member.unused_data)
            left = left[used:]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files as ``derived`` takes them; payloads are read as UTF-8."""
    records = read_warc(spark, path).where("warc_type = 'response'")
    at = F.position(F.lit(EOL * 2).cast("binary"), F.col("block"))
    head = F.when(at > 0, F.substring("block", F.lit(1), at - 1)).otherwise(F.col("block"))
    body = F.when(at > 0, F.substring("block", at + 4, F.octet_length("block"))).otherwise(F.lit(b""))
    text = lambda data: F.decode(data, "UTF-8")
    return records.select(F.xxhash64("record_id").alias("page_id"), "record_id", "target_uri", "date", text(head).alias("http_headers"), text(body).alias("payload"))
