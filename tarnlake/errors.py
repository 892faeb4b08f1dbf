"""What the dialect refuses, and in which phase."""

from __future__ import annotations


class DialectError(ValueError):
    """A query that the dialect rejects."""


class ParseError(DialectError):
    """Bad text, with its place."""

    def __init__(self, message: str, line: int, column: int) -> None:
        super().__init__(f"{message} (line {line}, column {column})")
        self.line, self.column = line, column


class BindError(DialectError):
    """A name that does not resolve, or resolves twice."""


class ValidationError(DialectError):
    """A statement that makes no sense as a whole."""


class TypeMismatch(DialectError):
    """Operands of kinds that do not go together."""


class SourceError(DialectError):
    """A table that cannot be read as declared."""
