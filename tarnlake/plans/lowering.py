"""A checked statement to a DataFrame, in the dialect's order of operators.

Scan, join, filter, aggregate, having, sort, project, distinct, limit: sort keys
are evaluated below the projection, and the sort itself is put last before the
limit, so that Spark plans a top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import dialect
from tarnlake.operators import relational
from tarnlake.plans import dates
from tarnlake.plans.analyzer import Bound, kind_of
from tarnlake.plans.ast import ARITHMETIC, COMPARISONS, DOUBLE, INT, STRING, Aggregate, Binary, Case, DateLiteral, Expr, In, IsNull, Like, Literal, Negate, Ref, Substring, walk
from tarnlake.sources.catalog import STORED_ALL, STORED_DAY


def _column(slot: int, ordinal: int) -> str:
    return f"c{slot}_{ordinal}"


_FLIPPED = {"=": "=", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
#: What an operator costs a row, next to one for reading a column; SUBSTRING and arithmetic may raise.
_WORK = {Like: 20, Substring: 10, Case: 5, In: 3}
_MAY_RAISE = (Substring, Negate)


def conjuncts(e: Expr) -> list[Expr]:
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, Binary) and e.op == "AND" else [e]


def _work(e: Expr) -> int:
    return sum(_WORK.get(type(x), 1) + (x.kind == STRING if isinstance(x, Ref) else 0) for x in walk(e))


def by_work(parts: list[Expr]) -> list[Expr]:
    """The cheap conditions first. What may raise keeps its place behind those that stand before it."""
    out: list[Expr] = []
    calm: list[Expr] = []
    for e in parts:
        if any(isinstance(x, _MAY_RAISE) or isinstance(x, Binary) and x.op in ARITHMETIC for x in walk(e)):
            out += [*sorted(calm, key=_work), e]
            calm = []
        else:
            calm.append(e)
    return out + sorted(calm, key=_work)


class Lowering:
    def __init__(self, bound: Bound) -> None:
        self.bound = bound
        self.refs = {(slot, name): _column(slot, i) for slot, schema in enumerate(bound.schemas) for i, (name, _) in enumerate(schema)}
        self.known: dict[Expr, str] = {}
        self.stored: dict[str, tuple[str, str, str]] = {}  # of a date's column: the stored one, what the dialect sees of it, its type

    def side(self, slot: int, df: DataFrame) -> DataFrame:
        names = [n for n, _ in self.bound.schemas[slot]]
        columns = [F.col(f"`{n}`").alias(_column(slot, i)) for i, n in enumerate(names)]
        for i, n in enumerate(names):
            for end in (STORED_DAY, STORED_ALL):
                if n + end in df.columns:
                    self.stored[_column(slot, i)] = f"d{slot}_{i}", end, df.schema[n + end].dataType.simpleString()
                    columns.append(F.col(f"`{n}{end}`").alias(f"d{slot}_{i}"))
        return df.select(*columns)

    def frame(self, table: Callable[[str], DataFrame]) -> DataFrame:
        b = self.bound
        sides = [self.side(slot, table(r.table)) for slot, r in enumerate(b.relations)]
        df = sides[0]
        if b.join:
            df = relational.equi_join(*sides, *(self.refs[r.slot, r.name] for r in b.join))
        if b.where:
            df = relational.filter_rows(df, self.condition(b.where))
        if b.grouped:
            df = self.aggregated(df)
            if b.having:
                df = relational.filter_rows(df, self.condition(b.having))
        shown = [f"o{i}" for i in range(len(b.items))]
        columns = [self.value(i.expr).alias(n) for i, n in zip(b.items, shown, strict=True)]
        own = {i.expr: n for i, n in reversed(list(zip(b.items, shown, strict=True)))}
        keys = [(own.get(o.expr, f"s{k}"), o.descending) for k, o in enumerate(b.order_by)]
        hidden = [self.value(o.expr).alias(n) for o, (n, _) in zip(b.order_by, keys, strict=True) if n.startswith("s")]
        df = relational.project(df, [*columns, *hidden])
        if b.distinct:
            df = relational.distinct_by_first(df, shown, keys) if hidden else relational.distinct(df)
        if keys:
            df = relational.sort_rows(df, list(dict(keys).items()) if len(dict(keys)) == len(keys) else keys)
        if b.limit is not None:
            df = relational.limit_rows(df, b.limit)
        return df.select(*shown).toDF(*b.names)

    def aggregated(self, df: DataFrame) -> DataFrame:
        keys = list(dict.fromkeys(self.bound.keys))
        values = self.bound.aggregates()
        made = [self.value(e).alias(f"k{i}") for i, e in enumerate(keys)], [self.aggregate(a).alias(f"a{i}") for i, a in enumerate(values)]
        self.known = {e: f"k{i}" for i, e in enumerate(keys)} | {a: f"a{i}" for i, a in enumerate(values)}
        return relational.aggregate(df, *made)

    def aggregate(self, a: Aggregate) -> Column:
        if a.arg is None:
            return F.count(F.lit(1))
        x = self.value(a.arg)
        return {"COUNT": F.count, "SUM": dialect.total, "AVG": dialect.mean, "MIN": F.min, "MAX": F.max}[a.function](x)

    def is_condition(self, e: Expr) -> bool:
        return e not in self.known and (isinstance(e, (IsNull, Like, In)) or isinstance(e, Binary) and e.op in (*COMPARISONS, "AND", "OR"))

    def condition(self, e: Expr) -> Column:
        if not self.is_condition(e):
            return dialect.as_condition(self.value(e))
        match e:
            case Binary("AND"):
                return reduce(Column.__and__, map(self.condition, by_work(conjuncts(e))))
            case Binary("OR", x, y):
                return self.condition(x) | self.condition(y)
            case Binary(op, x, y):
                for way in ((op, x, y), (_FLIPPED[op], y, x)):
                    if (found := self.compared_date(*way)) is not None:
                        return found
                a, b = self.value(x), self.value(y)
                return {"=": a.__eq__, "!=": a.__ne__, "<": a.__lt__, ">": a.__gt__, "<=": a.__le__, ">=": a.__ge__}[op](b)
            case IsNull(x, negated):
                return self.value(x).isNotNull() if negated else self.value(x).isNull()
            case Like(x, pattern, negated):
                found = dialect.like(self.value(x), pattern)
            case In(x, values, negated):
                found = dialect.is_in(self.value(x), kind_of(x), [(v.value, v.kind) for v in values])
        return ~found if negated else found

    def compared_date(self, op: str, x: Expr, y: Expr) -> Column | None:
        """A stored date compared with a day, which row groups and partitions are skipped by; None for anything else."""
        text = y.text if isinstance(y, DateLiteral) else y.value if isinstance(y, Literal) and y.kind == STRING else None
        if not isinstance(x, Ref) or x in self.known or text is None or self.refs[x.slot, x.name] not in self.stored or not dates.parse(text) or text >= "9999-12-31":
            return None
        name, seen, kind = self.stored[self.refs[x.slot, x.name]]
        column, day, after = F.col(name), F.lit(text).cast(kind), F.lit(dates.add(text, 1, "day")).cast(kind)
        if seen == STORED_ALL:  # the string of a time is greater than that of its day, so none equals a day
            return {">": column >= day, ">=": column >= day, "<": column < day, "<=": column < day}.get(op)
        return {"=": (column >= day) & (column < after), "!=": (column < day) | (column >= after), "<": column < day, ">": column >= after, "<=": column < after, ">=": column >= day}[op]

    def value(self, e: Expr) -> Column:
        if e in self.known:
            return F.col(self.known[e])
        if self.is_condition(e):
            return dialect.as_int(self.condition(e))
        match e:
            case Ref(slot, name, _, _):
                return F.col(self.refs[slot, name])
            case Literal(value, kind):
                return dialect.literal(value, kind)
            case DateLiteral(text):
                return dialect.literal(text, STRING)
            case Negate(x):
                return -self.value(x)
            case Binary(op, x, y):
                return self.arithmetic(op, x, y, kind_of(e))
            case Case(branches, otherwise):
                return self.case(branches, otherwise, kind_of(e))
            case Substring(x, start, length):
                fixed = isinstance(start, Literal) and (length is None or isinstance(length, Literal))
                return dialect.substring(self.value(x), self.value(start), self.value(length) if length else None, fixed)
        raise AssertionError(e)

    def arithmetic(self, op: str, x: Expr, y: Expr, kind: str) -> Column:
        a, b = self.value(x), self.value(y)
        if op == "/":
            return dialect.divide(a, b, kind == INT)
        if kind == DOUBLE:
            a, b = a.cast("double"), b.cast("double")
        return a + b if op == "+" else a - b if op == "-" else a * b

    def case(self, branches, otherwise: Expr | None, kind: str) -> Column:
        cast = (lambda c: c.cast("double")) if kind == DOUBLE else (lambda c: c)
        (first, then), *rest = branches
        out = F.when(self.condition(first), cast(self.value(then)))
        for c, v in rest:
            out = out.when(self.condition(c), cast(self.value(v)))
        return out.otherwise(cast(self.value(otherwise))) if otherwise else out


def lower(bound: Bound, table: Callable[[str], DataFrame]) -> DataFrame:
    return Lowering(bound).frame(table)
