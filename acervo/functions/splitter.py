"""Recursive text splitting as an Arrow function over a text and a separator column.

The loop's depth depends on the data, so it has no Catalyst form; it is the one
text function here that runs in Python, batch by batch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

CHUNK_SIZE = 1100
CHUNK_OVERLAP = 220
PART_BYTES = 4_000_000  # texts that are Python strings at a time
CHUNKS = pa.list_(pa.string())

# Separators per document type, most meaningful first.
SEPARATORS: dict[str, list[str]] = {
    "documentation": ["\n## ", "\n### ", "\n#### ", "\n1.", "\n2.", "\n---", "\n\n", "\n", " ", ""],
    "api_docs": ["\n## ", "\n### ", "\nEndpoint", "\nResponse", "\nRequest", "\n\n", "\n", " ", ""],
    "architecture": ["\n## ", "\n### ", "\n1.", "\n2.", "\nComponent", "\nLayer", "\n\n", "\n", " ", ""],
    "contract": ["\n\nCLÁUSULA", "\n\nCláusula", "\n\nPARÁGRAFO", "\n\nOTROSÍ", "\n\nANEXO", "\n\n", "\n", " ", ""],
    "policy": ["\n\nPOLÍTICA", "\n\nPROCEDIMIENTO", "\n\nRESPONSABLE", "\n\nALCANCE", "\n\n", "\n", " ", ""],
}
HIERARCHICAL = ["\n# ", "\n## ", "\n### ", "\nCAPÍTULO ", "\nSECCIÓN ", "\n\n\n", "\n\n", "\n", " ", ""]
MARKDOWN = ["\n\n", "\n", ". ", " "]


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before each separator; every piece but the first starts with it."""
    if separator == "":
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *(separator + r for r in rest)] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join pieces up to ``size``; carry whole pieces back up to ``overlap``."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            yield "".join(window)
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window)


def _split(text: str, separators: list[str], size: int, overlap: int) -> Iterator[str]:
    position = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    later = separators[position + 1:]
    small: list[str] = []
    for piece in _pieces(text, separators[position]):
        if len(piece) < size:
            small.append(piece)
            continue
        yield from _pack(small, size, overlap)
        small = []
        if later:
            yield from _split(piece, later, size, overlap)
        else:
            yield piece
    yield from _pack(small, size, overlap)


def split_text(text: str | None, separators: list[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    if not text:
        return []
    stripped = (chunk.strip() for chunk in _split(text, separators, size, overlap))
    return [chunk for chunk in stripped if chunk]


def _part_starts(sizes: np.ndarray, budget: int) -> list[int]:
    """Where parts of at most about ``budget`` begin: rows with ``sizes`` are put together in order."""
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // budget
    return [0, *(np.flatnonzero(np.diff(before)) + 1).tolist()] if len(sizes) else []


def _bytes(column: pa.Array) -> np.ndarray:
    """Bytes of the text, or of all texts, of each row."""
    if not pa.types.is_list(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(_bytes(column.flatten()))])
    return np.diff(ends[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])])


def _in_parts(chunks: Callable[..., list[str]], *columns: pa.Array) -> Iterator[pa.Array]:
    """``chunks`` of every row.  Only some texts at a time leave Arrow for Python, so a worker's memory does not follow the batch."""
    starts = _part_starts(_bytes(columns[0]), PART_BYTES)
    for start, end in zip(starts, [*starts[1:], len(columns[0])]):
        rows = zip(*(c.slice(start, end - start).to_pylist() for c in columns))
        yield pa.array([chunks(*row) for row in rows], CHUNKS)


def recursive_split(separators: list[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Arrow function text → array<string> for one separator list."""

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from _in_parts(lambda t: split_text(t, separators, size, overlap), texts)

    return split


def recursive_split_by_type(
    table: dict[str, list[str]] = SEPARATORS, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
):
    """Arrow function (text, type) → array<string>; unknown types split like documentation."""
    default = table["documentation"]

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, kinds in batches:
            yield from _in_parts(lambda t, k: split_text(t, table.get(k, default), size, overlap), texts, kinds)

    return split


def split_long_pieces(separators: list[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Arrow function array<string> → array<string>: pieces above ``size`` are split, others kept."""

    def chunks(pieces: list[str] | None) -> list[str]:
        found: list[str] = []
        for piece in pieces if pieces is not None else []:
            found += [piece] if len(piece) <= size else split_text(piece, separators, size, overlap)
        return found

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield from _in_parts(chunks, rows)

    return split
