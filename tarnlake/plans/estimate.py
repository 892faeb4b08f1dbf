"""Row estimates of a statement's operators from column statistics; for reports, as Catalyst plans by its own."""

from __future__ import annotations

from dataclasses import dataclass

from tarnlake.operators.statistics import ColumnStatistics
from tarnlake.plans.analyzer import Bound
from tarnlake.plans.ast import STRING, Binary, DateLiteral, Expr, In, IsNull, Literal, Ref, walk

#: What is assumed where nothing is known.
UNKNOWN_SHARE, UNKNOWN_ROWS = 0.5, 1000
_FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}

Statistics = tuple[int, dict[str, ColumnStatistics]]


@dataclass(frozen=True)
class Estimates:
    scans: tuple[float, ...]
    join: float | None
    filter: float | None
    aggregate: float | None
    having: float | None
    result: float


class Estimator:
    """``tables`` holds the statistics of the FROM and the JOIN side; None where there are none."""

    def __init__(self, bound: Bound, tables: list[Statistics | None]) -> None:
        self.bound, self.tables = bound, tables

    def column(self, e: Expr) -> ColumnStatistics | None:
        if isinstance(e, Ref) and (t := self.tables[e.slot]):
            return t[1].get(e.name)
        return None

    def share(self, e: Expr) -> float:
        """The part of rows for which a condition is thought to hold."""
        match e:
            case Binary("AND", x, y):
                return self.share(x) * self.share(y)
            case Binary("OR", x, y):
                a, b = self.share(x), self.share(y)
                return a + b - a * b
            case Binary(op, Ref() as c, Literal() | DateLiteral() as v):
                return self.compared(op, c, _value(v))
            case Binary(op, Literal() | DateLiteral() as v, Ref() as c):
                return self.compared(_FLIPPED.get(op, op), c, _value(v))
            case In(Ref() as c, values, negated) if s := self.column(c):
                inside = sum(self.compared("=", c, v) for v in {v.value for v in values})
                return max(1 / max(1, s.distinct), 1 - inside) if negated else min(1.0, inside)
            case IsNull(Ref() as c, negated) if s := self.column(c):
                nulls = s.nulls / max(1, self.tables[c.slot][0])
                return 1 - nulls if negated else nulls
        return UNKNOWN_SHARE

    def compared(self, op: str, c: Ref, v) -> float:
        s = self.column(c)
        if not s or s.least is None:
            return UNKNOWN_SHARE
        one = 1 / max(1, s.distinct)
        inside = s.least <= v <= s.most
        if op in ("=", "!="):
            equal = one if inside else 0.0
            return equal if op == "=" else 1 - equal
        if c.kind == STRING:
            return UNKNOWN_SHARE if inside else float((v > s.most) == (op in ("<", "<=")))
        width = float(s.most) - float(s.least)
        below = min(1.0, max(0.0, (float(v) - float(s.least)) / width)) if width else float(v > s.least)
        part = below if op in ("<", "<=") else 1 - below
        return max(part, one) if op in ("<=", ">=") and inside else part

    def groups(self, keys: tuple[Expr, ...], rows: float) -> float:
        """At most as many groups as combinations of the keys' columns, and as rows."""
        many = 1.0
        for k in keys:
            for c in {x for x in walk(k) if isinstance(x, Ref)}:
                s = self.column(c)
                many *= max(1, s.distinct) if s else rows
        return min(many, rows)

    def run(self) -> Estimates:
        b = self.bound
        scans = tuple(float(t[0]) if t else float(UNKNOWN_ROWS) for t in self.tables)
        rows, join, where, aggregate, having = scans[0], None, None, None, None
        if b.join:
            kinds = [s.distinct for s in map(self.column, b.join) if s]
            rows = join = max(1.0, scans[0] * scans[1] / max(kinds)) if kinds and max(kinds) else max(scans)
        if b.where:
            rows = where = max(1.0, rows * self.share(b.where))
        if b.grouped:
            rows = aggregate = self.groups(b.keys, rows) if b.keys else 1.0
            if b.having:
                rows = having = max(1.0, rows * UNKNOWN_SHARE)
        return Estimates(scans, join, where, aggregate, having, min(rows, b.limit) if b.limit is not None else rows)


def _value(v: Literal | DateLiteral):
    return v.text if isinstance(v, DateLiteral) else v.value


def q_error(estimate: float, actual: float) -> float:
    """By how many times an estimate is off; empty results count as one row."""
    a, b = max(1.0, estimate), max(1.0, actual)
    return max(a / b, b / a)
