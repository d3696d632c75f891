"""Exact nearest neighbours.

The vectors stay where they are: each task streams its Arrow batches past a
block of queries with one matrix product per tile and keeps k hits per query,
so the only shuffle moves k rows per query and task.  A block is at most
``QUERY_BLOCK`` queries (more where vectors are short: ``BLOCK_CELLS`` components), and
the driver never holds more than one block: a larger query table is written to the shared
folder in blocks and the vectors are scanned once per block, which gives the same rows.
These scans read a copy of the ids, vectors and filter columns alone, not the tables they
come from.  Queries alike in vector and filters lie in one block and are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.vectors import similarity
from acervo.operators.ranking import small_hits, top_k
from acervo.session import scratch_path, written

QUERY_BLOCK = 16_384  # queries sent to the tasks at a time; 100 MB at 1536 dimensions
BLOCK_CELLS = 4_000_000  # components of the queries of a block, where these are more than QUERY_BLOCK
TILE_CELLS = 4_000_000  # cells of one distance tile
ROW_TILE = 8_192  # vectors of one distance tile
CACHED = 512  # queries and vectors of a tile in single precision; 1 MB stays in a core's cache
FIRST_ROWS, GROWTH = 256, 4  # vectors a task compares before it knows limits, and how much longer each further step is
PLACES = 9  # distances are rounded, so equal vectors tie and the id decides


class QueryBlock(NamedTuple):
    """Different queries of one block, as each task sees them."""

    ids: pa.Array  # of all queries, alike ones side by side
    matrix: np.ndarray
    groups: dict[tuple[str, ...], dict[tuple[str, ...], np.ndarray]]  # filter names → values → query rows
    starts: np.ndarray  # of each query row's ids, and their number
    sizes: np.ndarray


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _pair_distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    exact = 1.0 - np.einsum("ij,ij->i", a, b) if metric == "cosine" else ((a - b) ** 2).sum(axis=1)
    return np.round(np.maximum(exact, 0.0), PLACES)


def _merge(best: dict[str, np.ndarray], rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Keep the k nearest per query row; ties go to the smaller id."""
    rows = np.concatenate([best["row"], rows])
    ids = np.concatenate([best["id"], ids]) if len(best["id"]) else ids
    dist = np.concatenate([best["dist"], dist])
    # one sort by row and rounded distance leaves little more than k of a row to the sort by all three
    key = (rows.astype(np.uint64) << np.uint64(32)) | (dist + 0.0).astype(np.float32).view(np.uint32)
    order = np.argsort(key)
    key = key[order]
    starts = np.r_[0, np.flatnonzero(key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)) + 1] if len(key) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(key)])
    last = key[starts + np.minimum(sizes, k) - 1]
    order = order[key <= np.repeat(last, sizes)]
    rows, ids, dist = rows[order], ids[order], dist[order]
    order = np.lexsort((ids, dist, rows))
    rows, ids, dist = rows[order], ids[order], dist[order]
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.zeros(0, int)
    position = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = position < k
    return {"row": rows[keep], "id": ids[keep], "dist": dist[keep]}


def _limits(best: dict[str, np.ndarray], n: int, k: int) -> np.ndarray:
    """Distance beyond which a row cannot enter a query's k best."""
    limit = np.full(n, np.inf)
    count = np.bincount(best["row"], minlength=n)
    worst = np.full(n, -np.inf)
    np.maximum.at(worst, best["row"], best["dist"])
    full = count >= k
    limit[full] = worst[full]
    return limit


def _pools(columns: dict[str, np.ndarray], names: tuple[str, ...], n: int) -> dict[tuple[str, ...], np.ndarray]:
    """Row numbers of a batch by the values of its filter columns."""
    if not names:
        return {(): np.arange(n)}
    keys = pd.MultiIndex.from_arrays([columns[name] for name in names])
    codes, values = keys.factorize()
    order = np.argsort(codes, kind="stable")
    cuts = np.cumsum(np.bincount(codes[codes >= 0], minlength=len(values)))
    skipped = int((codes < 0).sum())
    starts = np.r_[0, cuts[:-1]] + skipped if len(values) else cuts
    return {tuple(v): order[start:stop + skipped] for v, start, stop in zip(values, starts, cuts)}


def _exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Exact distances of the pairs (q, r), some at a time."""
    step = max(1, CACHED * CACHED // max(1, rows.shape[1]))
    parts = [_pair_distance(queries[q[at:at + step]], rows[r[at:at + step]], metric) for at in range(0, len(q), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


class _Rows(NamedTuple):
    """Vectors to compare with, prepared once for all tiles of queries."""

    exact: np.ndarray
    square: np.ndarray
    single: np.ndarray | None  # None where single precision does not reach
    error: float


def _prepared(rows: np.ndarray) -> _Rows:
    square = (rows**2).sum(axis=1)
    error = 1.0 - (2 * rows.shape[1] + 16) * float(np.finfo(np.float32).eps)  # twice the worst error of the sums
    small = np.nan_to_num(square, nan=0).max(initial=0) < 1e30
    return _Rows(rows, square, np.c_[rows, square * error].astype(np.float32) if small else None, error)


def _within(wide: np.ndarray, rows: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(q, r) of all pairs whose product is at most ``most[q]``, by tiles that stay in a core's cache."""
    products, low = np.empty(CACHED * CACHED, np.float32), np.zeros(CACHED * CACHED + 8, bool)
    found_q, found_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for right in range(0, len(rows), CACHED):
        against = rows[right:right + CACHED].T
        n = against.shape[1]
        for left in range(0, len(wide), CACHED):
            own = wide[left:left + CACHED]
            cells = len(own) * n
            tile = np.matmul(own, against, out=products[:cells].reshape(len(own), n))
            np.less_equal(tile, most[left:left + CACHED, None], out=low[:cells].reshape(len(own), n))
            low[cells:cells + 8] = False
            eights = np.flatnonzero(low[:-(-cells // 8) * 8].view(np.uint64))  # few are not zero
            if len(eights):
                at = (eights[:, None] * 8 + np.arange(8)).ravel()
                q, r = np.divmod(at[low[at]], n)
                found_q.append(q + left)
                found_r.append(r + right)
    return np.concatenate(found_q), np.concatenate(found_r)


def _near(queries: np.ndarray, rows: _Rows, limit: np.ndarray, k: int, metric: str):
    """(query number, row number, exact distance) of every pair that may rank among the k best.

    Queries with a limit are compared in single precision, with a slack above its error; the pairs left are
    measured exactly.
    """
    query_sq, row_sq = (queries**2).sum(axis=1), rows.square
    scale = 2.0 if metric == "cosine" else 1.0
    known = np.isfinite(limit)
    if known.any() and rows.single is not None and np.nan_to_num(query_sq, nan=0).max() < 1e30:
        some = np.flatnonzero(known)
        wide = np.c_[-2.0 * queries[some], np.ones(len(some))].astype(np.float32)
        most = scale * limit[some] - query_sq[some] * rows.error
        q, r = _within(wide, rows.single, np.nextafter((most + 1e-8 + 1e-6 * np.abs(most)).astype(np.float32), np.float32(np.inf)))
        q = some[q]
    else:
        q, r, known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(queries), bool)
    rest = np.flatnonzero(~known)
    if len(rest):
        rough = (query_sq[rest, None] + row_sq[None, :] - 2.0 * (queries[rest] @ rows.exact.T)) / scale
        if metric == "cosine":  # a zero vector is at distance 1 of everything
            rough = np.where((query_sq[rest, None] > 0) & (row_sq[None, :] > 0), rough, 1.0)
        most = limit[rest]
        if len(row_sq) > k:
            most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1])
        slack = 1e-9 * (1.0 + query_sq[rest] + np.nan_to_num(row_sq, nan=0).max())
        q2, r2 = np.nonzero(rough <= (most + slack)[:, None])
        q, r = np.concatenate([q, rest[q2]]), np.concatenate([r, r2])
    return q, r, _exact(queries, rows.exact, q, r, metric)


def _copies(rows: np.ndarray, ids: np.ndarray, k: int):
    """(first row of every different vector, starts, sizes, rows in order): of equal rows the k with the smallest ids; None without many copies."""
    keys = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel() if rows.size else np.zeros(0)
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    if 4 * len(first) > 3 * len(rows):
        return None
    order = np.lexsort((ids, group))
    sizes = np.bincount(group)
    starts = np.cumsum(sizes) - sizes
    order = order[np.arange(len(order)) - np.repeat(starts, sizes) < k]
    sizes = np.minimum(sizes, k)
    return first, np.cumsum(sizes) - sizes, sizes, order


def _hits(targets: np.ndarray, members: np.ndarray, rows: np.ndarray, ids: np.ndarray, limit: np.ndarray, k: int, metric: str):
    """(query rows, ids, distances), tile by tile, of the pairs of ``members`` and ``rows`` that may rank among the k best.

    Equal vectors are compared once, and beyond the k smallest ids they cannot rank.
    """
    copies = _copies(rows, ids, k)
    different = rows if copies is None else rows[copies[0]]
    for low in range(0, len(different), ROW_TILE):
        against = _prepared(different[low:low + ROW_TILE])
        step = max(1, TILE_CELLS // len(against.square))
        for at in range(0, len(members), step):
            tile = members[at:at + step]
            q, r, dist = _near(targets[tile], against, limit[tile], k, metric)
            r = r + low
            if copies is not None:
                _, starts, sizes, order = copies
                n = sizes[r]
                q, dist = np.repeat(q, n), np.repeat(dist, n)
                r = order[np.repeat(starts[r], n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]
            yield tile[q], ids[r], dist


def _gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``TILE_CELLS`` components of vectors, so that lists are merged less often; the first alone."""
    held, cells = [], TILE_CELLS
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            cells += len(batch.column(column).flatten())
        if held and cells >= TILE_CELLS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, cells = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _steps(batch: pa.RecordBatch, seen: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` that grow with the rows ``seen`` before, so that limits are tight before most rows are compared."""
    at = 0
    while at < batch.num_rows:
        n = max(FIRST_ROWS, (GROWTH - 1) * (seen + at))
        yield batch.slice(at, n)
        at += n


def _scan(block, k: int, metric: str, schema: pa.Schema, filter_columns: list[str]):
    """The task body: Arrow batches of (id, vector, filter columns…) → k hits per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: QueryBlock = block.value
        targets = _unit(asked.matrix) if metric == "cosine" else asked.matrix
        best, seen = {"row": np.zeros(0, np.int64), "id": np.zeros(0, object), "dist": np.zeros(0)}, 0
        for whole in _gathered(batches, 1):
            for batch in _steps(whole, seen):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                vectors = _matrix(batch.column(1))
                vectors = _unit(vectors) if metric == "cosine" else vectors
                columns = {n: batch.column(2 + i).to_numpy(zero_copy_only=False) for i, n in enumerate(filter_columns)}
                limit = _limits(best, len(targets), k)
                found: list[tuple[np.ndarray, ...]] = []
                held = 0
                for names, wanted in asked.groups.items():
                    pools = _pools(columns, names, len(ids))
                    for values in wanted.keys() & pools.keys():
                        members, pool = wanted[values], pools[values]
                        for hits in _hits(targets, members, vectors[pool], ids[pool], limit, k, metric):
                            found.append(hits)
                            held += len(hits[0])
                            if held > TILE_CELLS // 4:
                                best = _merge(best, *(np.concatenate(part) for part in zip(*found)), k)
                                found, held = [], 0
                if found:
                    best = _merge(best, *(np.concatenate(part) for part in zip(*found)), k)
            seen += whole.num_rows
        # every query row is as many queries as are alike
        for at in range(0, len(best["row"]), ROW_TILE * 8):
            part = {name: column[at:at + ROW_TILE * 8] for name, column in best.items()}
            n = asked.sizes[part["row"]]
            for queries, hits in _expanded(asked.starts[part["row"]], n):
                yield pa.RecordBatch.from_arrays(
                    [asked.ids.take(pa.array(queries)), pa.array(part["id"][hits].tolist(), schema.field(1).type), pa.array(part["dist"][hits])], schema=schema)

    return run


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, row) of every place ``starts[row] … + sizes[row]``, some at a time."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, ROW_TILE * 8):
        nth = np.arange(at, min(total, at + ROW_TILE * 8))
        row = np.searchsorted(ends, nth, side="right")
        yield starts[row] + nth - (ends[row] - sizes[row]), row


def _load_block(queries: pa.Table) -> QueryBlock:
    matrix = _matrix(queries.column(1).combine_chunks())
    filters = queries.column(2).to_pylist() if queries.num_columns > 2 else [None] * len(matrix)
    known: dict[tuple, int] = {}
    kind = np.zeros(len(matrix), np.int64)
    for row, wanted in enumerate(filters):
        pairs = sorted((entry["key"], entry["value"]) for entry in (wanted or []) if entry["value"])
        kind[row] = known.setdefault((tuple(p[0] for p in pairs), tuple(p[1] for p in pairs)), len(known))
    # queries alike in vector and filters are one row
    keyed = np.c_[matrix, kind] if len(matrix) else np.zeros((0, 1))
    _, first, alike = np.unique(keyed.view(np.dtype((np.void, keyed.shape[1] * keyed.itemsize))).ravel(), return_index=True, return_inverse=True)
    sizes = np.bincount(alike, minlength=len(first))
    ids = queries.column(0).combine_chunks().take(pa.array(np.argsort(alike, kind="stable")))
    groups: dict[tuple, dict[tuple, np.ndarray]] = {}
    for (names, values), number in known.items():
        groups.setdefault(names, {})[values] = np.flatnonzero(kind[first] == number)
    return QueryBlock(ids, matrix[first], groups, np.cumsum(sizes) - sizes, sizes)


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    filters: str | None = None,
    filter_columns: tuple[str, ...] = (),
    metric: str = "l2sq",
    block: int | None = None,
) -> DataFrame:
    """(query_id, doc_id, distance, rank): the ``k`` nearest rows of every query.

    ``filters`` names a map<string,string> column of the queries: equality
    conditions on ``filter_columns`` of the vectors, applied before ranking;
    entries with an empty value are ignored.  ``metric`` is ``l2sq`` or ``cosine``
    (1 − cosine).  Ties go to the smaller id.  ``block`` bounds the queries of a scan.
    """
    spark = queries.sparkSession
    wanted = [F.col(query_id), F.col(query_vector)] + ([F.map_entries(filters)] if filters else [])
    asked = queries.filter(F.col(query_vector).isNotNull()).select(*wanted)
    scanned = vectors.filter(F.col(vector).isNotNull()).select(
        F.col(doc_id), F.col(vector), *[F.col(c).cast("string") for c in filter_columns]
    )
    id_types = [asked.schema[0].dataType, scanned.schema[0].dataType]
    schema = f"{query_id} {id_types[0].simpleString()}, {doc_id} {id_types[1].simpleString()}, distance double"
    arrow = pa.schema([(query_id, _arrow_type(id_types[0])), (doc_id, _arrow_type(id_types[1])), ("distance", pa.float64())])

    def search(part: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast(_load_block(part))
        hits = scanned.mapInArrow(_scan(shared, k, metric, arrow, list(filter_columns)), schema)
        return top_k(hits, [query_id], [F.col("distance"), F.col(doc_id)], k)

    few = block or QUERY_BLOCK
    first = asked.limit(few + 1).toArrow()
    if first.num_rows <= few:
        return small_hits(search(first), first.num_rows, k)

    # Too many queries for one block: written in parts of bounded size, one scan each.
    found = scratch_path(spark, "knn-hits")
    # Of vectors alike in value and filter columns only the k smallest ids can rank; they are written once, copies side by side.
    alike = [scanned.columns[1], *filter_columns]
    # The hash comes first because Spark sorts by a number far faster than by an array.
    hashed = scanned.withColumn("_hash", F.xxhash64(*alike))
    scanned = written(top_k(hashed, ["_hash", *alike], [F.col(doc_id)], k, "_copy").drop("_hash", "_copy"), "knn-vectors")
    for part in query_blocks(asked, block or block_rows(first), asked.columns[1:]):
        search(part.toArrow()).write.mode("append").parquet(found)
    return spark.read.parquet(found)


def block_rows(queries: pa.Table) -> int:
    """Queries of a block, by the length of the vectors of some (id, vector, …)."""
    return max(QUERY_BLOCK, BLOCK_CELLS * queries.num_rows // max(1, len(queries.column(1).combine_chunks().flatten())))


def query_blocks(asked: DataFrame, block: int, alike: list[str]) -> Iterator[DataFrame]:
    """``asked`` (id, vector, …) in parts of about ``block`` rows at most; rows alike in the columns ``alike`` lie together."""
    parts = scratch_path(asked.sparkSession, "knn-queries")
    cuts = math.ceil(1.1 * asked.count() / block)
    asked.withColumn("_block", F.pmod(F.xxhash64(*alike), F.lit(cuts))).write.partitionBy("_block").parquet(parts)
    stored = asked.sparkSession.read.parquet(parts)
    # rows alike may be many: their block is cut once more by the id
    for number, rows in sorted(map(tuple, stored.groupBy("_block").count().collect())):  # at most `cuts` rows
        pieces = math.ceil(rows / (1.25 * block))
        own = stored.filter(F.col("_block") == number).drop("_block")
        for piece in range(pieces):
            yield own.filter(F.pmod(F.xxhash64(asked.columns[0]), F.lit(pieces)) == piece)


def _arrow_type(dtype) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dtype)


def knn_scored(queries: DataFrame, vectors: DataFrame, k: int, **options) -> DataFrame:
    """``knn`` with score = round(1 / (1 + distance), 4)."""
    return knn(queries, vectors, k, **options).withColumn("score", similarity("distance"))
