"""Tokens to a syntax tree: one SELECT statement."""

from __future__ import annotations

import math

from tarnlake.errors import ParseError
from tarnlake.plans import dates
from tarnlake.plans.ast import COMPARISONS, DOUBLE, INT, STRING, Aggregate, Binary, Case, DateLiteral, Expr, In, Interval, IsNull, Item, Like, Literal, Name, Negate, Order, Relation, Select, Substring
from tarnlake.plans.lexer import Token, tokenize

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
#: Words that would pass for an alias and change what is meant.
NOT_ALIASES = frozenset("LEFT RIGHT FULL INNER OUTER CROSS NATURAL UNION INTERSECT EXCEPT USING OFFSET WITH ESCAPE SEMI ANTI".split())
_MOST = (1 << 63) - 1


def parse(sql: str) -> Select:
    return _Parser(tokenize(sql)).statement()


class _Parser:
    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at = tokens, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, message: str, token: Token | None = None) -> ParseError:
        t = token or self.now
        return ParseError(message, t.line, t.column)

    def accept(self, *kinds: str) -> Token | None:
        if self.now.kind in kinds:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def expect(self, kind: str, what: str | None = None) -> Token:
        if found := self.accept(kind):
            return found
        raise self.fail(f"expected {what or kind} but found {self.now.text!r}")

    def statement(self) -> Select:
        self.expect("SELECT")
        distinct = bool(self.accept("DISTINCT"))
        items = () if self.accept("*") else tuple(self.list_of(self.item))
        self.expect("FROM")
        source, joined, on = self.relation(), None, None
        if self.accept("JOIN"):
            joined = self.relation()
            self.expect("ON")
            on = self.expression()
            if self.now.kind == "JOIN":
                raise self.fail("only one JOIN is supported")
        where = self.expression() if self.accept("WHERE") else None
        group_by: tuple[Expr, ...] = ()
        if self.accept("GROUP"):
            self.expect("BY")
            group_by = tuple(self.list_of(self.expression))
        having = self.expression() if self.accept("HAVING") else None
        order_by: tuple[Order, ...] = ()
        if self.accept("ORDER"):
            self.expect("BY")
            order_by = tuple(self.list_of(self.order))
        limit = self.limit() if self.accept("LIMIT") else None
        self.accept(";")
        if self.now.kind != "end":
            raise self.fail(f"unexpected {self.now.text!r} after the end of the query")
        return Select(items, source, joined, on, where, group_by, having, order_by, limit, distinct)

    def list_of(self, one) -> list:
        found = [one()]
        while self.accept(","):
            found.append(one())
        return found

    def item(self) -> Item:
        e = self.expression()
        return Item(e, self.expect("name", "a name after AS").text if self.accept("AS") else None)

    def relation(self) -> Relation:
        table = self.expect("name", "a table name").text
        if self.accept("AS"):
            return Relation(table, self.expect("name", "a name after AS").text)
        if self.now.kind == "name":
            if self.now.text.upper() in NOT_ALIASES:
                raise self.fail(f"{self.now.text.upper()} is not supported here")
            return Relation(table, self.expect("name").text)
        return Relation(table)

    def order(self) -> Order:
        e = self.expression()
        way = self.accept("ASC", "DESC")
        return Order(e, way is not None and way.kind == "DESC")

    def limit(self) -> int:
        token = self.now
        if not self.accept("int"):
            raise self.fail("LIMIT needs an integer literal")
        if int(token.text) > 2**31 - 1:
            raise self.fail("LIMIT is out of range", token)
        return int(token.text)

    def expression(self) -> Expr:
        return self.chain("OR", lambda: self.chain("AND", self.comparison))

    def chain(self, word: str, one) -> Expr:
        left = one()
        while self.accept(word):
            left = Binary(word, left, one())
        return left

    def comparison(self) -> Expr:
        left = self.additive()
        if self.accept("IS"):
            negated = bool(self.accept("NOT"))
            self.expect("NULL", "NULL or NOT NULL after IS")
            return IsNull(left, negated)
        negated = bool(self.accept("NOT"))
        if self.accept("BETWEEN"):
            low = self.additive()
            self.expect("AND", "AND in BETWEEN")
            high = self.additive()
            if negated:
                return Binary("OR", Binary("<", left, low), Binary(">", left, high))
            return Binary("AND", Binary(">=", left, low), Binary("<=", left, high))
        if self.accept("LIKE"):
            return Like(left, self.expect("string", "a string literal after LIKE").text, negated)
        if self.accept("IN"):
            self.expect("(")
            values = tuple(self.list_of(self.constant))
            self.expect(")")
            return In(left, values, negated)
        if negated:
            raise self.fail("NOT is only supported in NOT BETWEEN, NOT LIKE, NOT IN and IS NOT NULL")
        if op := self.accept(*COMPARISONS):
            return Binary(op.kind, left, self.additive())
        return left

    def constant(self) -> Literal:
        if self.accept("-"):
            if self.now.kind not in ("int", "float"):
                raise self.fail("IN takes constants only")
            return self.number(negative=True)
        if self.now.kind in ("int", "float"):
            return self.number()
        if token := self.accept("string"):
            return Literal(token.text, STRING)
        raise self.fail("IN takes constants only")

    def number(self, negative: bool = False) -> Literal:
        token = self.now
        self.at += 1
        sign = -1 if negative else 1
        if token.kind == "int":
            value = int(token.text)
            if value > _MOST:
                raise self.fail("integer literal is out of range", token)
            return Literal(sign * value, INT)
        value = float(token.text)
        if math.isinf(value):
            raise self.fail("float literal is out of range", token)
        return Literal(sign * value, DOUBLE)

    def additive(self) -> Expr:
        left = self.multiplicative()
        while op := self.accept("+", "-"):
            left = Binary(op.kind, left, self.multiplicative())
        return left

    def multiplicative(self) -> Expr:
        left = self.unary()
        while op := self.accept("*", "/"):
            left = Binary(op.kind, left, self.unary())
        return left

    def unary(self) -> Expr:
        return Negate(self.unary()) if self.accept("-") else self.primary()

    def primary(self) -> Expr:
        token = self.now
        match token.kind:
            case "int" | "float":
                return self.number()
            case "string":
                self.at += 1
                return Literal(token.text, STRING)
            case "(":
                self.at += 1
                if self.now.kind == "SELECT":
                    raise self.fail("subqueries are not supported")
                e = self.expression()
                self.expect(")")
                return e
            case "CASE":
                return self.case()
            case "SUBSTRING":
                return self.substring()
            case "DATE":
                self.at += 1
                text = self.expect("string", "a quoted date after DATE")
                if dates.parse(text.text) is None:
                    raise self.fail(f"{text.text!r} is not a date of the form YYYY-MM-DD", text)
                return DateLiteral(text.text)
            case "INTERVAL":
                return self.interval()
            case "name":
                return self.name()
            case "NOT":
                raise self.fail("NOT is only supported in NOT BETWEEN, NOT LIKE, NOT IN and IS NOT NULL")
            case "NULL":
                raise self.fail("NULL is only supported in IS [NOT] NULL")
            case "+":
                raise self.fail("unary + is not supported")
            case kind if kind in AGGREGATES:
                return self.aggregate()
        raise self.fail(f"expected an expression but found {token.text!r}")

    def name(self) -> Expr:
        first = self.expect("name").text
        if self.now.kind == "(":
            raise self.fail(f"unknown function {first}")
        if self.accept("."):
            return Name(self.expect("name", "a column name").text, first)
        return Name(first)

    def aggregate(self) -> Expr:
        function = self.now.kind
        self.at += 1
        self.expect("(")
        if self.now.kind == "*":
            if function != "COUNT":
                raise self.fail(f"{function}(*) is not supported")
            self.at += 1
            arg = None
        else:
            arg = self.expression()
        self.expect(")")
        return Aggregate(function, arg)

    def case(self) -> Expr:
        self.expect("CASE")
        branches = []
        if self.now.kind != "WHEN":
            raise self.fail("expected WHEN after CASE")
        while self.accept("WHEN"):
            condition = self.expression()
            self.expect("THEN")
            branches.append((condition, self.expression()))
        otherwise = self.expression() if self.accept("ELSE") else None
        self.expect("END")
        return Case(tuple(branches), otherwise)

    def substring(self) -> Expr:
        self.expect("SUBSTRING")
        self.expect("(")
        arg, length = self.expression(), None
        if self.accept("FROM"):
            start = self.expression()
            length = self.expression() if self.accept("FOR") else None
        else:
            self.expect(",", "',' or FROM in SUBSTRING")
            start = self.expression()
            length = self.expression() if self.accept(",") else None
        self.expect(")")
        return Substring(arg, start, length)

    def interval(self) -> Expr:
        self.expect("INTERVAL")
        text = self.expect("string", "a quoted whole number after INTERVAL")
        if not text.text.removeprefix("-").isascii() or not text.text.removeprefix("-").isdigit():
            raise self.fail(f"INTERVAL needs a whole number, not {text.text!r}", text)
        unit = self.now
        word = unit.text.lower().removesuffix("s")
        if unit.kind != "name" or word not in dates.UNITS:
            raise self.fail("INTERVAL needs the unit day, month or year")
        self.at += 1
        return Interval(int(text.text), word)
