"""Mixing sources to target weights.

Every document gets a random key, a hash of its id.  Rows are laid out by
(source, key range), prefix sums of sizes run inside a range, and the sums of the
ranges before it are added; so a source with a third of all rows is spread over
``KEY_RANGES`` groups and no source meets in one task.  A source is taken whole as
often as its budget allows and the last epoch is cut, in key order, at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm.common import text_or_empty, word_count
from acervo.session import written

#: The random key is an MD5 in hex; its first three digits name one of 4096 equal ranges.
RANGE_DIGITS = 3


def random_key(seed: str, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: (source, missing, source_size, target).

    ``sizes`` has (source, missing, source_size).  Sources take the weights in turn, by
    code point, null last.  The words of all sources are shared by weight; a source stops
    at ``most`` times its own size and what it leaves is shared again by weight.  The
    sharing has a closed form: sorted by cap per unit of weight, the capped sources come
    first and the rest share what remains.  One row per source passes through one task.
    """
    by_name = Window.orderBy("missing", "source")
    rising = Window.orderBy("room", "nth")
    every = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", share.cast("double"))
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.first(F.when(F.col("room") > F.col("level"), F.col("level")), ignorenulls=True).over(every))
        .select("source", "missing", "source_size",
                F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix-1") -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    ``docs``: doc_id, source, text; other columns are ignored.  Returns (doc_id, size,
    source_size, target, taken), one row per input row.  Null text has size 0; null is a
    source of its own; a null doc_id has a key like any other; repeated rows count each
    time; an empty table gives an empty result.  Ties of keys go by doc_id, then size.
    """
    rows = written(
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("missing"),
                    word_count(text_or_empty()).alias("size"), random_key(seed, F.col("doc_id")).alias("key")),
        "mix-sizes",
    ).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = rows.groupBy("source", "missing", "range").agg(F.sum("size").alias("in_range"))
    targets = source_targets(ranges.groupBy("source", "missing").agg(F.sum("in_range").alias("source_size")), weights, most)
    earlier = Window.partitionBy("source", "missing").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "missing", "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("offset"))
    plan = offsets.join(targets, ["source", "missing"])
    within = Window.partitionBy("source", "missing", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    budget = F.floor(F.col("target") + 0.5)
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - F.col("rounds") * F.col("source_size")
    start = F.col("offset") + F.col("upto") - F.col("size")
    return (
        rows.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(plan, ["source", "missing", "range"])
        .withColumn("rounds", rounds)
        .select("doc_id", "size", "source_size", "target",
                (F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - start))).cast("long").alias("taken"))
    )


def mixed_rows(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with ``epoch`` and ``words`` to use of that copy.

    ``plan`` is what ``mix`` gives for ``docs``.  Rows that share an id, or have none, meet the plan's rows one by
    one: by id, size and their number among equal ones.
    """
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    alike = Window.partitionBy("doc_id", "size")
    numbered = plan.select(F.col("doc_id"), "size", "taken").withColumn("_nth", F.row_number().over(alike.orderBy("taken")))
    cut = numbered.where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("_nth").alias("_of"), "taken", F.explode(copies).alias("epoch"))
    words = F.least(F.col("_size"), F.col("taken") - (F.col("epoch") - 1) * F.col("_size")).alias("words")
    given = docs.select(F.struct("*").alias("_row"), "doc_id", word_count(text_or_empty()).alias("size"), F.xxhash64("source", "text").alias("_tie"))
    given = given.withColumn("_nth", F.row_number().over(alike.orderBy("_tie")))
    met = given.join(cut, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")) & (F.col("_nth") == F.col("_of")))
    return met.select("_row.*", "epoch", words)
