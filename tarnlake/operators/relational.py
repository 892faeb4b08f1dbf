"""Relational operators on DataFrames; Catalyst picks how they run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose condition is true; NULL is not."""
    return df.where(condition)


def project(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    return df.select(*columns)


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join; NULL keys never match. A side is broadcast only where its size is known to be small."""
    return left.join(right, F.col(left_key) == F.col(right_key), "inner")


def aggregate(df: DataFrame, keys: Sequence[Column], values: Sequence[Column]) -> DataFrame:
    """Groups, NULL being a group of its own; without keys exactly one row."""
    if not keys:
        return df.agg(*values)
    return df.groupBy(*keys).agg(*values) if values else df.select(*keys).distinct()


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_by_first(df: DataFrame, shown: Sequence[str], keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """One row per distinct ``shown``: the one that comes first by ``keys`` (name, descending), which are kept.

    Keys of one direction are an aggregation with partial results; mixed ones
    a window over each group, of which only the first row of every task is shuffled.
    """
    if len({down for _, down in keys}) == 1:
        pick = F.max if keys[0][1] else F.min
        first = pick(F.struct(*(F.col(k) for k, _ in keys))).alias("_first")
        grouped = df.groupBy(*shown).agg(first)
        return grouped.select(*shown, *(F.col(f"_first.{k}").alias(k) for k, _ in keys))
    rank = F.row_number().over(Window.partitionBy(*shown).orderBy(*(ordering(k, down) for k, down in keys)))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def ordering(name: str, descending: bool) -> Column:
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_first()


def sort_rows(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*(ordering(k, down) for k, down in keys))


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
