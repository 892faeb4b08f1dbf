"""SQL text in, DataFrame out."""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tarnlake.errors import DialectError
from tarnlake.operators.statistics import table_statistics
from tarnlake.plans.analyzer import Bound, analyze
from tarnlake.plans.estimate import Estimator, Statistics
from tarnlake.plans.explain import explain, explain_analyze
from tarnlake.plans.lowering import lower
from tarnlake.plans.parser import parse
from tarnlake.sources.catalog import Catalog

STORAGE, EXECUTION = ("row", "columnar"), ("volcano", "vectorized")
#: Results that the cache holds at most.
CACHED = 32


@dataclass(frozen=True)
class Options:
    """How a query runs; never what it returns."""

    storage: str = "row"
    execution: str = "volcano"
    optimize: bool = True

    def __post_init__(self) -> None:
        if self.storage not in STORAGE or self.execution not in EXECUTION:
            raise DialectError(f"storage is one of {STORAGE}, execution one of {EXECUTION}")
        if self.execution == "vectorized" and self.storage != "columnar":
            raise DialectError("vectorized execution needs columnar storage")


class Engine:
    """A catalog with a result cache. ``columnar`` storage keeps tables in Spark's columnar cache."""

    def __init__(self, catalog: Catalog, options: Options | None = None) -> None:
        self.catalog, self.options = catalog, options or Options()
        self._results: OrderedDict[tuple[str, Options], DataFrame] = OrderedDict()
        self._columnar: dict[str, DataFrame] = {}
        self._statistics: dict[str, Statistics] = {}
        self.hits = 0

    def table(self, name: str) -> DataFrame:
        """The table, and its dates as they are stored."""
        df = self.catalog.stored(name)
        if self.options.storage == "row":
            return df
        if name not in self._columnar:
            self._columnar[name] = df.cache()
        return self._columnar[name]

    def bind(self, sql: str) -> Bound:
        return analyze(parse(sql), self.catalog.schema)

    def sql(self, sql: str) -> DataFrame:
        """The query's result, lazily."""
        return lower(self.bind(sql), self.table)

    def cached(self, sql: str) -> DataFrame:
        """The query's result, kept by Spark and reused for the same text and options; the oldest give way."""
        key = (sql, self.options)
        if key in self._results:
            self.hits += 1
            self._results.move_to_end(key)
            return self._results[key]
        found = self._results[key] = self.sql(sql).cache()
        if len(self._results) > CACHED:
            self._results.popitem(last=False)[1].unpersist()
        return found

    def statistics(self, name: str) -> Statistics:
        """Statistics of a table, computed once, with sketches of distinct values."""
        if name not in self._statistics:
            self._statistics[name] = table_statistics(self.catalog.table(name), exact=False)
        return self._statistics[name]

    def explain(self, sql: str, estimates: bool = False) -> str:
        """Plans as text. ``estimates`` adds rows, for which tables without statistics are scanned once."""
        bound = self.bind(sql)
        guess = Estimator(bound, [self.statistics(r.table) for r in bound.relations]).run() if estimates else None
        return explain(bound, lower(bound, self.table), guess)

    def explain_analyze(self, sql: str) -> tuple[int, str]:
        began = time.perf_counter()
        statement = parse(sql)
        parsed = time.perf_counter()
        df = lower(analyze(statement, self.catalog.schema), self.table)
        planned = time.perf_counter()
        return explain_analyze(df, (parsed - began) * 1000, (planned - parsed) * 1000)
