"""The typed syntax tree. Nodes are values: equal ones are the same expression."""

from __future__ import annotations

from dataclasses import dataclass, field

INT, DOUBLE, STRING = "INT", "DOUBLE", "STRING"
COMPARISONS = ("=", "!=", "<", ">", "<=", ">=")
ARITHMETIC = ("+", "-", "*", "/")


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Name(Expr):
    """A column as written; the binder turns it into a Ref."""

    name: str
    qualifier: str | None = None


@dataclass(frozen=True)
class Ref(Expr):
    """A column of relation ``slot``; ``shown`` is how the query spells it."""

    slot: int
    name: str
    kind: str
    shown: str = field(compare=False, default="")


@dataclass(frozen=True)
class Literal(Expr):
    value: int | float | str
    kind: str


@dataclass(frozen=True)
class Interval(Expr):
    n: int
    unit: str


@dataclass(frozen=True)
class DateLiteral(Expr):
    """An ISO date; a string once intervals are folded."""

    text: str


@dataclass(frozen=True)
class Negate(Expr):
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool = False


@dataclass(frozen=True)
class Like(Expr):
    arg: Expr
    pattern: str
    negated: bool = False


@dataclass(frozen=True)
class In(Expr):
    arg: Expr
    values: tuple[Literal, ...]
    negated: bool = False


@dataclass(frozen=True)
class Case(Expr):
    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None = None


@dataclass(frozen=True)
class Substring(Expr):
    arg: Expr
    start: Expr
    length: Expr | None = None


@dataclass(frozen=True)
class Aggregate(Expr):
    """``arg`` is None for COUNT(*)."""

    function: str
    arg: Expr | None


@dataclass(frozen=True)
class Relation:
    table: str
    alias: str | None = None

    @property
    def qualifier(self) -> str:
        return self.alias or self.table


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]  # none for *
    source: Relation
    joined: Relation | None = None
    on: Expr | None = None
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    distinct: bool = False

    @property
    def star(self) -> bool:
        return not self.items


def children(e: Expr) -> tuple[Expr, ...]:
    match e:
        case Negate(x) | IsNull(x, _) | Like(x, _, _):
            return (x,)
        case Binary(_, x, y):
            return (x, y)
        case In(x, values, _):
            return (x, *values)
        case Case(branches, otherwise):
            return (*(x for pair in branches for x in pair), *([otherwise] if otherwise else []))
        case Substring(x, start, length):
            return (x, start, *([length] if length else []))
        case Aggregate(_, x):
            return (x,) if x else ()
    return ()


def rebuild(e: Expr, f) -> Expr:
    """``e`` with ``f`` applied to each child."""
    match e:
        case Negate(x):
            return Negate(f(x))
        case IsNull(x, negated):
            return IsNull(f(x), negated)
        case Like(x, pattern, negated):
            return Like(f(x), pattern, negated)
        case Binary(op, x, y):
            return Binary(op, f(x), f(y))
        case In(x, values, negated):
            return In(f(x), values, negated)
        case Case(branches, otherwise):
            return Case(tuple((f(c), f(v)) for c, v in branches), f(otherwise) if otherwise else None)
        case Substring(x, start, length):
            return Substring(f(x), f(start), f(length) if length else None)
        case Aggregate(name, x):
            return Aggregate(name, f(x) if x else None)
    return e


def walk(e: Expr):
    yield e
    for x in children(e):
        yield from walk(x)


def aggregates(e: Expr | None) -> list[Aggregate]:
    return [x for x in walk(e) if isinstance(x, Aggregate)] if e else []


def show(e: Expr) -> str:
    """The text that names an expression without alias."""
    match e:
        case Name(name, qualifier):
            return f"{qualifier}.{name}" if qualifier else name
        case Ref(_, name, _, shown):
            return shown or name
        case Literal(value, kind):
            return f"'{value}'" if kind == STRING else f"{value:.15g}" if kind == DOUBLE else str(value)
        case DateLiteral(text):
            return f"'{text}'"
        case Interval(n, unit):
            return f"INTERVAL '{n}' {unit}"
        case Negate(x):
            return f"(-{show(x)})"
        case Binary(op, x, y):
            return f"({show(x)} {op} {show(y)})"
        case IsNull(x, negated):
            return f"({show(x)} IS {'NOT ' * negated}NULL)"
        case Like(x, pattern, negated):
            return f"({show(x)} {'NOT ' * negated}LIKE '{pattern}')"
        case In(x, values, negated):
            return f"({show(x)} {'NOT ' * negated}IN ({', '.join(map(show, values))}))"
        case Case(branches, otherwise):
            parts = [f"WHEN {show(c)} THEN {show(v)}" for c, v in branches] + ([f"ELSE {show(otherwise)}"] if otherwise else [])
            return f"CASE {' '.join(parts)} END"
        case Substring(x, start, length):
            return f"SUBSTRING({', '.join(map(show, (x, start, *([length] if length else []))))})"
        case Aggregate(function, x):
            return f"{function}({show(x) if x else '*'})"
    raise AssertionError(e)
