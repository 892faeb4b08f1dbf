"""Bind names, fold constants, check types and validate: all before any DataFrame is built."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from tarnlake.errors import BindError, DialectError, TypeMismatch, ValidationError
from tarnlake.plans import dates
from tarnlake.plans.ast import (
    ARITHMETIC, COMPARISONS, DOUBLE, INT, STRING, Aggregate, Binary, Case, DateLiteral, Expr, In, Interval, IsNull, Item, Like, Literal, Name,
    Negate, Order, Ref, Relation, Select, Substring, aggregates, rebuild, show, walk,
)

Schema = list[tuple[str, str]]
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Bound:
    """A checked statement. ``keys`` is empty and ``grouped`` true for a global aggregate."""

    relations: tuple[Relation, ...]
    schemas: tuple[tuple[tuple[str, str], ...], ...]
    items: tuple[Item, ...]
    join: tuple[Ref, Ref] | None
    where: Expr | None
    grouped: bool
    keys: tuple[Expr, ...]
    having: Expr | None
    order_by: tuple[Order, ...]
    limit: int | None
    distinct: bool

    @property
    def names(self) -> list[str]:
        return [x.alias or show(x.expr) for x in self.items]

    def aggregates(self) -> list[Aggregate]:
        """Each distinct one, hidden ones in HAVING and ORDER BY included."""
        found = [a for x in (*(i.expr for i in self.items), self.having, *(o.expr for o in self.order_by)) for a in aggregates(x)]
        return list(dict.fromkeys(found))

    def refs(self) -> set[Ref]:
        parts = [*(i.expr for i in self.items), self.where, *self.keys, self.having, *(o.expr for o in self.order_by), *(self.join or ())]
        return {x for e in parts if e for x in walk(e) if isinstance(x, Ref)}


def analyze(s: Select, schema_of: Callable[[str], Schema | None]) -> Bound:
    scope = _Scope(s, schema_of)
    items = tuple(Item(fold(scope.bind(i.expr, "SELECT")), i.alias or (show(scope.bind(i.expr, "SELECT")) if isinstance(i.expr, Name) else None)) for i in s.items)
    if s.where and aggregates(s.where):
        raise ValidationError("aggregates are not allowed in WHERE; use HAVING")
    where = fold(scope.bind(s.where, "WHERE")) if s.where else None
    by_alias = {i.alias: b.expr for i, b in zip(s.items, items, strict=True) if i.alias}
    keys = tuple(_key(e, scope, by_alias) for e in s.group_by)
    having = fold(scope.bind(s.having, "HAVING")) if s.having else None
    order_by = tuple(Order(_order_key(o.expr, scope, by_alias), o.descending) for o in s.order_by)
    join = scope.join_keys(s.on) if s.joined else None
    if having is not None and not keys:
        raise ValidationError("HAVING needs GROUP BY")
    grouped = bool(keys) or any(aggregates(i.expr) for i in items)
    if not grouped and any(aggregates(o.expr) for o in order_by):
        raise ValidationError("ORDER BY uses an aggregate but the query does not aggregate")
    if s.star:
        if grouped:
            raise ValidationError("SELECT * cannot be combined with GROUP BY or aggregates")
        items = tuple(Item(Ref(slot, n, k), n) for slot, schema in enumerate(scope.schemas) for n, k in schema)
    for e in (*(i.expr for i in items), where, *keys, having, *(o.expr for o in order_by)):
        if e:
            for a in aggregates(e):
                if a.arg and aggregates(a.arg):
                    raise ValidationError(f"aggregates cannot be nested: {show(a)}")
            kind_of(e)
    for clause, e in (("WHERE", where), ("HAVING", having)):
        if e and kind_of(e) == STRING:
            raise TypeMismatch(f"{clause} needs a condition, not a STRING: {show(e)}")
    if grouped:
        for e in (*(i.expr for i in items), *([having] if having else []), *(o.expr for o in order_by)):
            _check_grouped(e, keys)
    return Bound(tuple(scope.relations), tuple(tuple(x) for x in scope.schemas), items, join, where, grouped, keys, having, order_by, s.limit, s.distinct)


class _Scope:
    def __init__(self, s: Select, schema_of) -> None:
        self.relations = [s.source, *([s.joined] if s.joined else [])]
        self.schemas: list[Schema] = []
        for r in self.relations:
            schema = schema_of(r.table)
            if schema is None:
                raise ValidationError(f"unknown table {r.table}")
            self.schemas.append(schema)
        if s.joined and s.source.qualifier == s.joined.qualifier:
            if not s.source.alias and not s.joined.alias:
                raise BindError(f"joining {s.source.table} to itself needs aliases")
            raise BindError(f"duplicate alias {s.joined.qualifier}")

    def find(self, n: Name) -> list[Ref]:
        return [Ref(slot, n.name, k, show(n)) for slot, schema in enumerate(self.schemas) for name, k in schema if name == n.name and n.qualifier in (None, self.relations[slot].qualifier)]

    def resolve(self, n: Name, clause: str) -> Ref:
        if n.qualifier and all(n.qualifier != r.qualifier for r in self.relations):
            raise BindError(f"unknown table or alias {n.qualifier} in {show(n)}")
        found = self.find(n)
        if len(found) > 1:
            raise BindError(f"column {n.name} is ambiguous")
        if not found:
            raise BindError(f"{clause} column not found: {show(n)}")
        return found[0]

    def bind(self, e: Expr, clause: str) -> Expr:
        return self.resolve(e, clause) if isinstance(e, Name) else rebuild(e, lambda x: self.bind(x, clause))

    def join_keys(self, on: Expr) -> tuple[Ref, Ref]:
        if not isinstance(on, Binary):
            raise ValidationError("JOIN needs a condition of the form a.x = b.y")
        if on.op in ("AND", "OR"):
            raise ValidationError("JOIN takes a single equality; AND and OR are not supported in ON")
        if on.op != "=":
            raise ValidationError(f"JOIN takes an equality, not {on.op}")
        if not isinstance(on.left, Name) or not isinstance(on.right, Name):
            raise ValidationError("both sides of the JOIN equality must be columns")
        left, right = self.resolve(on.left, "ON"), self.resolve(on.right, "ON")
        if left.slot == right.slot:
            raise ValidationError("the JOIN equality must compare columns of both tables")
        if (left.kind == STRING) != (right.kind == STRING):
            raise TypeMismatch(f"cannot join {left.kind} {show(left)} with {right.kind} {show(right)}")
        return (left, right) if left.slot == 0 else (right, left)


def _is_ordinal(e: Expr) -> bool:
    return isinstance(e, Literal) and e.kind == INT


def _key(e: Expr, scope: _Scope, by_alias: dict[str, Expr]) -> Expr:
    if _is_ordinal(e):
        raise ValidationError("GROUP BY ordinals are not supported")
    if isinstance(e, Name) and not e.qualifier and not scope.find(e) and e.name in by_alias:
        bound = by_alias[e.name]
    else:
        bound = fold(scope.bind(e, "GROUP BY"))
    if aggregates(bound):
        raise ValidationError("aggregates are not allowed in GROUP BY")
    return bound


def _order_key(e: Expr, scope: _Scope, by_alias: dict[str, Expr]) -> Expr:
    if _is_ordinal(e):
        raise ValidationError("ORDER BY ordinals are not supported")
    if isinstance(e, Name) and not e.qualifier and e.name in by_alias:
        return by_alias[e.name]
    return fold(scope.bind(e, "ORDER BY"))


def _untyped(e: Expr) -> Expr:
    """``e`` with numbers alike whatever their kind, to spot near misses."""
    if isinstance(e, Literal) and e.kind != STRING:
        return replace(e, value=float(e.value), kind=DOUBLE)
    return rebuild(e, _untyped)


def _check_grouped(e: Expr, keys: tuple[Expr, ...]) -> None:
    if e in keys or isinstance(e, Aggregate):
        return
    near = [k for k in keys if _untyped(k) == _untyped(e)]
    if near:
        raise ValidationError(f"{show(e)} differs from the GROUP BY key {show(near[0])} in the type of a literal")
    if isinstance(e, Ref):
        raise ValidationError(f"column {show(e)} must appear in GROUP BY or in an aggregate")
    rebuild(e, lambda x: (_check_grouped(x, keys), x)[1])


def fold(e: Expr) -> Expr:
    """Arithmetic on literals and on dates, where it has a value; errors and NULLs are left to run time."""
    e = rebuild(e, fold)
    match e:
        case Negate(Literal(v, kind)) if kind != STRING and v != _LEAST:
            return Literal(-v, kind)
        case Binary("+" | "-" as op, DateLiteral(text), Interval(n, unit)):
            return DateLiteral(dates.add(text, n if op == "+" else -n, unit))
        case Binary("+", Interval(n, unit), DateLiteral(text)):
            return DateLiteral(dates.add(text, n, unit))
        case Binary(op, Literal(a, x), Literal(b, y)) if op in ARITHMETIC and STRING not in (x, y):
            return _fold_numbers(e, op, a, b, INT if x == y == INT else DOUBLE)
    return e


def _fold_numbers(e: Expr, op: str, a, b, kind: str) -> Expr:
    if op == "/" and b == 0:
        return e
    if kind == INT:
        value = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return Literal(value, INT) if _LEAST <= value <= _MOST else e
    a, b = float(a), float(b)
    value = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b
    return Literal(value, DOUBLE) if math.isfinite(value) else e


def kind_of(e: Expr) -> str:
    """INT, DOUBLE or STRING; raises where operands do not go together."""
    match e:
        case Ref(_, _, kind, _) | Literal(_, kind):
            return kind
        case DateLiteral():
            return STRING
        case Interval():
            raise TypeMismatch("INTERVAL can only be added to or subtracted from a DATE literal")
        case Negate(x):
            if kind_of(x) == STRING:
                raise TypeMismatch(f"unary - needs a number: {show(e)}")
            return kind_of(x)
        case Binary(op, x, y):
            return _kind_of_binary(e, op, kind_of(x), kind_of(y))
        case IsNull(x, _):
            kind_of(x)
            return INT
        case Like(x, _, _):
            if kind_of(x) != STRING:
                raise TypeMismatch(f"LIKE needs a STRING: {show(x)}")
            return INT
        case In(x, values, _):
            if len({kind_of(v) == STRING for v in (x, *values)}) > 1:
                raise TypeMismatch(f"IN cannot mix STRING and numbers: {show(e)}")
            return INT
        case Case(branches, otherwise):
            for c, _ in branches:
                if kind_of(c) != INT:
                    raise TypeMismatch(f"CASE conditions must be INT: {show(c)}")
            kinds = {kind_of(v) for _, v in branches} | ({kind_of(otherwise)} if otherwise else set())
            if STRING in kinds and len(kinds) > 1:
                raise TypeMismatch("CASE branches cannot mix STRING and numbers")
            return DOUBLE if DOUBLE in kinds else kinds.pop()
        case Substring(x, start, length):
            return _kind_of_substring(x, start, length)
        case Aggregate(function, x):
            kind = kind_of(x) if x else INT
            if function in ("SUM", "AVG") and kind == STRING:
                raise TypeMismatch(f"{function} needs a number: {show(e)}")
            return INT if function == "COUNT" else kind if function in ("MIN", "MAX") else DOUBLE
    raise DialectError(f"unresolved {show(e)}")


def _kind_of_binary(e: Expr, op: str, x: str, y: str) -> str:
    if op in ARITHMETIC:
        if STRING in (x, y):
            raise TypeMismatch(f"arithmetic needs numbers: {show(e)}")
        return DOUBLE if DOUBLE in (x, y) else INT
    if op in COMPARISONS:
        if (x == STRING) != (y == STRING):
            raise TypeMismatch(f"cannot compare STRING with a number: {show(e)}")
    elif (x, y) != (INT, INT):
        raise TypeMismatch(f"{op} needs conditions: {show(e)}")
    return INT


def _kind_of_substring(x: Expr, start: Expr, length: Expr | None) -> str:
    if kind_of(x) != STRING:
        raise TypeMismatch(f"SUBSTRING needs a STRING: {show(x)}")
    for what, part, least in (("start", start, 1), ("length", length, 0)):
        if part is None:
            continue
        if kind_of(part) != INT:
            raise TypeMismatch(f"SUBSTRING {what} must be INT: {show(part)}")
        if isinstance(part, Literal) and part.value < least:
            raise TypeMismatch(f"SUBSTRING {what} must be at least {least}")
    return STRING
