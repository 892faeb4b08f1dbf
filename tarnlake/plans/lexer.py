"""Text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tarnlake.errors import ParseError

#: The reserved words of the dialect.
RESERVED = frozenset(
    """SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT DISTINCT JOIN ON IS NOT
    AND OR AS ASC DESC NULL BETWEEN LIKE IN CASE WHEN THEN ELSE END SUBSTRING FOR DATE INTERVAL COUNT SUM AVG
    MIN MAX""".split()
)
_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<number>[0-9]+(?:\.[0-9]*)?)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|'(?P<string>[^']*)'|(?P<symbol><=|>=|!=|[=<>+\-*/(),.;])"
)


@dataclass(frozen=True)
class Token:
    """``kind`` is a reserved word, a symbol, or one of name, int, float, string, end."""

    kind: str
    text: str
    line: int
    column: int


def tokenize(sql: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(sql):
        column = at - start + 1
        found = _TOKEN.match(sql, at)
        if not found:
            if sql[at] == "'":
                raise ParseError("unterminated string literal", line, column)
            raise ParseError(f"unexpected character {sql[at]!r}", line, column)
        kind, text = found.lastgroup, found[found.lastgroup]
        if kind == "number":
            out.append(Token("float" if "." in text else "int", text, line, column))
        elif kind == "word":
            word = text.upper()
            out.append(Token(word if word in RESERVED else "name", text, line, column))
        elif kind == "string":
            out.append(Token("string", text, line, column))
        elif kind == "symbol":
            out.append(Token(text, text, line, column))
        if breaks := found[0].count("\n"):
            line += breaks
            start = at + found[0].rindex("\n") + 1
        at = found.end()
    return [*out, Token("end", "end of input", line, at - start + 1)]
