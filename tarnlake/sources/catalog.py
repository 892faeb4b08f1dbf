"""Tables by name: a JSON catalog of CSV files, or a folder of Parquet tables."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.errors import SourceError
from tarnlake.plans.ast import DOUBLE, INT, STRING

SPARK_KINDS = {INT: T.LongType(), DOUBLE: T.DoubleType(), STRING: T.StringType()}


def dialect_kind(kind: T.DataType) -> str | None:
    """The dialect's kind for a column of a foreign table; None if it has none."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return INT
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DOUBLE
    return STRING if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)) else None


def dialect_column(name: str, kind: T.DataType) -> Column:
    """Whole numbers are 64-bit, other numbers double, dates ISO strings, and timestamps too, with their time of day."""
    column = F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd").alias(name)
    return column.cast(SPARK_KINDS[dialect_kind(kind)]).alias(name)


#: End the name of a date or time as it is stored, beside the string that the dialect sees, which is that of its day
#: or all of it: comparisons with what is stored reach the scan.
STORED_DAY, STORED_ALL = "#day", "#all"


class Catalog:
    """Schemas and frames of tables; frames are built once."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._frames: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame, days: Iterable[str] = ()) -> None:
        """Register any DataFrame; columns of other kinds than the dialect's are left out. Timestamps in ``days`` are read as dates."""
        kept = [f for f in df.schema.fields if dialect_kind(f.dataType)]
        days = {f.name for f in kept if f.name in set(days) or isinstance(f.dataType, T.DateType)}
        dates = [F.col(f"`{f.name}`").alias(f.name + (STORED_DAY if f.name in days else STORED_ALL)) for f in kept if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
        self._frames[name] = df.select(*(dialect_column(f.name, T.DateType() if f.name in days else f.dataType) for f in kept), *dates)

    def stored(self, name: str) -> DataFrame:
        """The table, and its dates as they are stored."""
        return self._frames[name]

    def table(self, name: str) -> DataFrame:
        return self._frames[name].select(*(F.col(f"`{n}`") for n, _ in self.schema(name)))

    def schema(self, name: str) -> list[tuple[str, str]] | None:
        if name not in self._frames:
            return None
        return [(f.name, dialect_kind(f.dataType)) for f in self._frames[name].schema.fields if not f.name.endswith((STORED_DAY, STORED_ALL))]

    def names(self) -> list[str]:
        return sorted(self._frames)

    @classmethod
    def of_parquet(cls, spark: SparkSession, folder: str, names: list[str], days: Iterable[str] = ()) -> Catalog:
        found = cls(spark)
        for name in names:
            found.add(name, spark.read.parquet(f"{folder}/{name}.parquet"), days)
        return found

    @classmethod
    def of_json(cls, spark: SparkSession, path: str) -> Catalog:
        """``{"tables": [{"name", "file", "columns": [{"name", "type"}]}]}``; files are relative to the catalog."""
        try:
            tables = json.loads(Path(path).read_text(encoding="utf-8"))["tables"]
        except OSError as e:
            raise SourceError(f"cannot open the catalog {path}: {e.strerror}") from e
        found = cls(spark)
        for t in tables:
            for c in t["columns"]:
                if c["type"] not in SPARK_KINDS:
                    raise SourceError(f"unknown type {c['type']} of column {c['name']} in table {t['name']}")
            file = t["file"] if Path(t["file"]).is_absolute() else str(Path(path).resolve().parent / t["file"])
            found._frames[t["name"]] = read_csv(spark, file, [(c["name"], c["type"]) for c in t["columns"]])
        return found


def read_csv(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """A CSV file with a header that is skipped unread and without quoting.

    Rows of another width, and fields that are not numbers where numbers are
    declared, raise when they are read. Empty strings stay empty.
    """
    if not path.startswith(("viewfs:", "hdfs:", "s3a:", "file:")) and not Path(path).exists():
        raise SourceError(f"cannot open {path}")
    schema = T.StructType([T.StructField(n, SPARK_KINDS[k], True) for n, k in columns])
    rows = spark.read.schema(schema).options(header=True, quote="", escape="", mode="FAILFAST", enforceSchema=True, inferSchema=False, columnNameOfCorruptRecord="").csv(path)
    whole = []
    for n, k in columns:
        c = F.col(f"`{n}`")
        missing = F.lit("") if k == STRING else F.raise_error(F.lit(f"column {n}: an empty field is not a number")).cast(SPARK_KINDS[k])
        whole.append(F.coalesce(c, missing).alias(n))
    return rows.select(*whole)
