"""Command line: run dialect queries over a JSON catalog."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from pathlib import Path

from pyspark.errors import PySparkException

from tarnlake.engine import EXECUTION, STORAGE, Engine, Options
from tarnlake.errors import DialectError, SourceError
from tarnlake.operators.statistics import storage_bytes
from tarnlake.session import session
from tarnlake.sources.catalog import Catalog

#: Catalyst rules that --no-optimize turns off.
PUSHDOWN = "org.apache.spark.sql.catalyst.optimizer.PushDownPredicates,org.apache.spark.sql.catalyst.optimizer.PushPredicateThroughJoin"


def render(value: object) -> str:
    return "NULL" if value is None else f"{value:.15g}" if isinstance(value, float) else str(value)


#: Rows that a printed table's widths are taken from.
SIZED = 1000


def table_lines(names: list[str], rows: Iterable[Iterable[object]]) -> Iterator[str]:
    """The lines of an aligned text table, as rows come: results of any size are printed without being held."""
    cells = ([render(v) for v in r] for r in rows)
    head = list(islice(cells, SIZED))
    wide = [max(len(r[i]) for r in [names, *head]) for i in range(len(names))]
    line = lambda r: " | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip()
    yield line(names)
    yield "-+-".join("-" * w for w in wide)
    n = 0
    for n, r in enumerate(chain(head, cells), 1):
        yield line(r)
    yield f"({n} rows)"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnlake", description=__doc__)
    p.add_argument("--catalog", required=True)
    p.add_argument("--query", action="append", default=[])
    p.add_argument("--queries", metavar="FILE", help="a file of queries with a semicolon behind each; all are run and counted")
    p.add_argument("--storage", choices=STORAGE, default="row")
    p.add_argument("--execution", choices=EXECUTION, default="volcano")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--explain-analyze", action="store_true")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--no-optimize", action="store_true")
    p.add_argument("--storage-stats", action="store_true")
    return p


def run(engine: Engine, sql: str, args: argparse.Namespace) -> None:
    if args.explain:
        print(engine.explain(sql, estimates=True))
    elif args.explain_analyze:
        print(engine.explain_analyze(sql)[1])
    else:
        df = engine.sql(sql) if args.no_cache else engine.cached(sql)
        for line in table_lines(df.columns, df.toLocalIterator()):
            print(line)


def run_file(engine: Engine, path: str, args: argparse.Namespace) -> int:
    """Run the queries of a file, whatever becomes of the others; 1 if any failed."""
    try:
        found = [q.strip() for q in Path(path).read_text(encoding="utf-8").split(";") if q.strip()]
    except OSError as e:
        raise SourceError(f"cannot open {path}: {e.strerror}") from e
    failed = 0
    for i, sql in enumerate(found, 1):
        print(f"[{i}/{len(found)}] {sql}")
        try:
            run(engine, sql, args)
        except (DialectError, PySparkException) as e:
            failed += 1
            print(f"error: {e}")
    print(f"{len(found) - failed} ok, {failed} failed")
    return int(failed > 0)


def main(argv: list[str] | None = None, spark=None) -> int:
    args, unknown = parser().parse_known_args(argv)
    for flag in unknown:
        print(f"warning: unknown argument {flag}", file=sys.stderr)
    if not args.query and not args.queries and not args.storage_stats:
        print("error: --query or --queries is needed", file=sys.stderr)
        return 1
    try:
        options = Options(args.storage, args.execution, not args.no_optimize)
        spark = spark or session()
        if args.no_optimize:
            spark.conf.set("spark.sql.optimizer.excludedRules", PUSHDOWN)
        engine = Engine(Catalog.of_json(spark, args.catalog), options)
        if args.storage_stats:
            for name in engine.catalog.names():
                print(f"{name}: {storage_bytes(engine.table(name)) / 1e6:.2f} MB")
            return 0
        for sql in args.query:
            run(engine, sql, args)
        return run_file(engine, args.queries, args) if args.queries else 0
    except DialectError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if args.no_optimize and spark is not None:
            spark.conf.unset("spark.sql.optimizer.excludedRules")


if __name__ == "__main__":
    sys.exit(main())
