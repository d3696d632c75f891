"""A table that takes changes: rows bucketed by their owner, deltas, tombstones, merges of the touched buckets.

A store is a folder: ``base/bucket=…`` holds the rows, dealt into buckets by a hash of
their owner (a document, a session); ``deltas/batch=…`` holds changes that have not been
merged.  Adding a batch writes only the batch; reading lets the newest change of a key win;
``compact_store`` rewrites the buckets that pending batches touch, by dynamic partition
overwrite, and leaves the files of all others alone.

A change is a row, a tombstone (``deleted``), or, with ``whole_owner``, one of the rows
that take the place of everything its owner had, so that the tail of a document that
became shorter goes.  Deleted keys stay as tombstones in their bucket until ``vacuum_store``.
A batch that is written or merged again after a failure gives the same rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.session import remove, written

#: Rows of a file of a bucket; a bucket with more is written by several tasks.
FILE_ROWS = 1_000_000
#: Columns that the store adds.
BATCH, DELETED, WHOLE = "_batch", "_deleted", "_whole"


class Layout(NamedTuple):
    key: list[str]
    owner: list[str]
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.owner), F.lit(self.buckets)).cast("int")


def _write(rows: DataFrame, layout: Layout, path: str) -> None:
    """Write rows with a ``bucket`` column to their buckets; only buckets that occur are replaced."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("_files"))  # one row per bucket
    dealt = rows.join(F.broadcast(sizes), "bucket").withColumn("_file", F.pmod(F.xxhash64(*layout.key, F.lit("file")), F.col("_files")))
    dealt.repartition("bucket", "_file").drop("_files", "_file").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def create_store(rows: DataFrame, path: str, *, key: list[str], owner: list[str] | None = None, buckets: int = 64) -> None:
    """A store with ``rows``, one per ``key``; ``owner`` (by default the key) decides the bucket."""
    layout = Layout(key, owner or key, buckets)
    if missing := [c for c in {*layout.key, *layout.owner} if c not in rows.columns]:
        raise ValueError(f"no column {missing[0]!r}")
    spark = rows.sparkSession
    spark.createDataFrame([(layout.key, layout.owner, buckets)], "key array<string>, owner array<string>, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    spark.createDataFrame([], f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}").write.mode("overwrite").parquet(f"{path}/schema")
    remove(spark, f"{path}/deltas")
    first = rows.select("*", F.lit(-1).cast("long").alias(BATCH), F.lit(False).alias(DELETED), layout.bucket().alias("bucket"))
    remove(spark, f"{path}/base")
    _write(first, layout, f"{path}/base")


def layout_of(spark: SparkSession, path: str) -> Layout:
    row = spark.read.parquet(f"{path}/layout").first()
    return Layout(list(row["key"]), list(row["owner"]), row["buckets"])


def _columns(spark: SparkSession, path: str) -> str:
    """The columns of a store as DDL; read from it, so that an empty store has them too."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/schema").schema)


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the base, rows of the pending batches), tombstones included."""
    columns = _columns(spark, path)
    at = lambda name, more: (spark.read.schema(f"{columns}, {more}").option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
                             if _there(spark, f"{path}/{name}") else spark.createDataFrame([], f"{columns}, {more}"))
    base = at("base", f"{BATCH} long, {DELETED} boolean, bucket int")
    return base, at("deltas", f"{DELETED} boolean, {WHOLE} boolean, batch long, bucket int").withColumnRenamed("batch", BATCH)


def _resolved(base: DataFrame, pending: DataFrame, layout: Layout) -> DataFrame:
    """The newest row or tombstone of every key, after batches that replaced whole owners."""
    named = lambda df, names: df.select(*[F.col(n).alias(f"_on_{n}") for n in names], *[c for c in df.columns if c.startswith("_since")])
    on = lambda names: F.expr(" and ".join(f"`{n}` <=> `_on_{n}`" for n in names))
    taken = named(pending.where(WHOLE).groupBy(*layout.owner).agg(F.max(BATCH).alias("_since")), layout.owner)
    # changes before the last batch that replaced their owner are void
    fresh = pending.join(taken, on(layout.owner), "left").where(F.coalesce(F.col(BATCH) >= F.col("_since"), F.lit(True)))
    body = [c for c in base.columns if c not in layout.key]
    order = F.struct(BATCH, F.xxhash64(*[c for c in body if "map<" not in base.schema[c].dataType.simpleString()]))
    newest = fresh.dropna(subset=layout.key).groupBy(*layout.key).agg(F.max_by(F.struct(*body), order).alias("_row")).select(*layout.key, "_row.*").select(base.columns)
    kept = base.join(named(newest, layout.key), on(layout.key), "left_anti")
    # rows of replaced owners become tombstones: their bucket is never left without a row
    dead = (F.col(DELETED) | F.col("_since").isNotNull()).alias(DELETED)
    return kept.join(taken, on(layout.owner), "left").select(*[dead if c == DELETED else c for c in base.columns]).unionByName(newest)


def add_changes(changes: DataFrame, path: str, batch_id: int, *, deleted: str | None = None, whole_owner: bool = False) -> None:
    """Add a batch of changes: full rows, and tombstones where the boolean column ``deleted`` is true.

    With ``whole_owner`` the rows take the place of everything their owners had; a row with a null in
    its key only empties its owner.  Of several rows of a key in one batch one wins, the
    same at every run.  Writing a batch number again replaces that batch.
    """
    spark = changes.sparkSession
    layout = layout_of(spark, path)
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    schema = spark.read.parquet(f"{path}/schema").schema
    rows = changes.select(*[(F.col(f.name) if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], gone.alias(DELETED), F.lit(whole_owner).alias(WHOLE))
    rows.withColumn("bucket", layout.bucket()).repartition("bucket", F.pmod(F.xxhash64(*layout.key), F.lit(4))).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/deltas/batch={batch_id}")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of a store, pending batches included."""
    base, pending = _parts(spark, path)
    return _resolved(base, pending, layout_of(spark, path)).where(~F.col(DELETED)).drop(BATCH, DELETED, "bucket")


def compact_store(spark: SparkSession, path: str) -> list[int]:
    """Merge the pending batches into the buckets they touch; the numbers of these buckets."""
    layout = layout_of(spark, path)
    base, pending = _parts(spark, path)
    touched = sorted(r[0] for r in pending.select("bucket").distinct().collect())  # at most `buckets` numbers
    if touched:
        merged = written(_resolved(base.where(F.col("bucket").isin(touched)), pending, layout), "store-merged")
        _write(merged, layout, f"{path}/base")
    remove(spark, f"{path}/deltas")
    return touched


def merge_store(changes: DataFrame, path: str, *, deleted: str | None = None, whole_owner: bool = False) -> list[int]:
    """Merge changes at once; columns that ``changes`` lacks keep the values their keys have.  The touched buckets."""
    spark = changes.sparkSession
    layout = layout_of(spark, path)
    base, pending = _parts(spark, path)
    lacking = [c for c in base.columns if c not in (BATCH, DELETED, "bucket", *changes.columns)]
    if lacking and not whole_owner:
        # a key's owner may be among the lacking columns, so all current rows of these keys are asked
        old = read_store(spark, path).select(*layout.key, *lacking)
        changes = changes.join(old, layout.key, "left")
    last = pending.agg(F.max(BATCH)).first()[0]
    newest = base.agg(F.max(BATCH)).first()[0]
    add_changes(changes, path, 1 + max(-1 if last is None else last, -1 if newest is None else newest), deleted=deleted, whole_owner=whole_owner)
    return compact_store(spark, path)


def vacuum_store(spark: SparkSession, path: str) -> None:
    """Drop the tombstones of buckets that also hold rows."""
    layout = layout_of(spark, path)
    base, _ = _parts(spark, path)
    mixed = base.groupBy("bucket").agg(F.max(DELETED).alias("dead"), F.min(DELETED).alias("all_dead")).where("dead and not all_dead")
    buckets = [r["bucket"] for r in mixed.select("bucket").collect()]  # at most `buckets` numbers
    if buckets:
        _write(written(base.where(F.col("bucket").isin(buckets) & ~F.col(DELETED)), "store-vacuumed"), layout, f"{path}/base")
