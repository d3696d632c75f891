"""Row filters and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.questions import reject_reason
from acervo.functions.text import trim_ws


def metadata_filter(filters: dict[str, str]) -> Column:
    """Conjunction of equalities; entries with an empty value are ignored."""
    conditions = [F.col(name) == value for name, value in filters.items() if value]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def metadata_map_filter(meta: Column, filters: Column) -> Column:
    """The same per row, on map<string,string> columns."""
    wanted = F.filter(F.map_entries(filters), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.forall(wanted, lambda e: F.coalesce(F.try_element_at(meta, e["key"]) == e["value"], F.lit(False)))


def not_deleted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def active_only(df: DataFrame) -> DataFrame:
    return not_deleted(df).filter(F.col("is_active"))


def last_n_days(df: DataFrame, days: int, now: Column, ts: str = "created_at") -> DataFrame:
    """Rows from ``days`` days before ``now`` on."""
    return df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def validate_queries(queries: DataFrame, text: str = "text", max_iterations: str = "max_iterations") -> tuple[DataFrame, DataFrame]:
    """(accepted with the text stripped, refused with ``reason``)."""
    judged = queries.withColumn("reason", reject_reason(text, max_iterations))
    accepted = judged.filter(F.col("reason").isNull()).drop("reason").withColumn(text, trim_ws(text))
    return accepted, judged.filter(F.col("reason").isNotNull())


def exclude_augmented(chunks: DataFrame) -> DataFrame:
    return chunks.filter(~F.coalesce("is_augmented_question", F.lit(False)))


def only_questions(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.coalesce("is_augmented_question", F.lit(False)))


def union_augmented(originals: DataFrame, questions: DataFrame) -> DataFrame:
    return originals.unionByName(questions, allowMissingColumns=True)


def paginate(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page in a total order, with total and has_more."""
    limit, offset = max(1, min(limit, 100)), max(0, offset)
    total = df.agg(F.count("*")).scalar()
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("total", total).withColumn("has_more", F.lit(offset + limit) < F.col("total"))
