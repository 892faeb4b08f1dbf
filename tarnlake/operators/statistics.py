"""Statistics of tables and columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places that rows are dealt to, and stored bytes for each. Up to 200 are written without being held in memory.
PLACES, PLACE_BYTES = 192, 1 << 18


@dataclass(frozen=True)
class ColumnStatistics:
    least: object
    most: object
    distinct: int
    nulls: int
    width: float


def table_statistics(df: DataFrame, exact: bool = True) -> tuple[int, dict[str, ColumnStatistics]]:
    """Rows, and per column its extremes, distinct values, NULLs and mean width in bytes.

    ``exact`` counts distinct values exactly, which expands rows once per
    column; otherwise a sketch of fixed size does, in one pass.
    """
    r = _summary(df, exact).first()
    return r["n"], {f.name: ColumnStatistics(r[f"lo{i}"], r[f"hi{i}"], r[f"d{i}"], r["n"] - r[f"c{i}"], r[f"w{i}"] or 0.0) for i, f in enumerate(df.schema.fields)}


def statistics_frame(df: DataFrame, exact: bool = True) -> DataFrame:
    """``table_statistics`` as a DataFrame, computed lazily."""
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"), F.col("n").alias("row_count"), F.col(f"lo{i}").cast("string").alias("min_value"), F.col(f"hi{i}").cast("string").alias("max_value"),
            F.col(f"d{i}").alias("ndv"), (F.col("n") - F.col(f"c{i}")).alias("null_count"), F.coalesce(F.col(f"w{i}"), F.lit(0.0)).alias("avg_width"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return _summary(df, exact).select(F.inline(F.array(*rows)))


def _summary(df: DataFrame, exact: bool) -> DataFrame:
    """One row: ``n`` rows, and by each column's number ``lo``, ``hi``, ``d`` distinct, ``c`` not NULL, ``w`` wide.

    Exact counts have an aggregation of their own, as beside extremes of
    strings all expanded rows would be sorted. Rows are dealt to tasks by
    their hash first: a small file may hold many rows, and one task reads it.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    if exact:
        df = df.repartition(max(1, min(PLACES, storage_bytes(df) // PLACE_BYTES)), *columns)
    parts = [F.count(F.lit(1)).alias("n")]
    for i, (c, f) in enumerate(zip(columns, df.schema.fields, strict=True)):
        wide = F.avg(F.octet_length(c)) if isinstance(f.dataType, T.StringType) else F.lit(8.0)
        parts += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.count(c).alias(f"c{i}"), wide.alias(f"w{i}")]
    count = F.count_distinct if exact else F.approx_count_distinct
    distinct = [count(c).alias(f"d{i}") for i, c in enumerate(columns)]
    return df.agg(*parts).crossJoin(df.agg(*distinct)) if exact else df.agg(*parts, *distinct)


def storage_bytes(df: DataFrame) -> int:
    """Size of a table as the optimizer estimates it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
