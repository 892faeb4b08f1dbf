"""Column helpers with the dialect's semantics; built-in functions only.

Values are bigint, double or string. Conditions are boolean columns; ``as_int``
makes a value of one and ``as_condition`` a condition of a number.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlake.plans.ast import DOUBLE, INT

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def literal(value: int | float | str, kind: str) -> Column:
    return F.lit(value).cast("bigint") if kind == INT else F.lit(float(value)) if kind == DOUBLE else F.lit(value)


def as_int(condition: Column) -> Column:
    return condition.cast("bigint")


def as_condition(number: Column) -> Column:
    return number != F.lit(0)


def divide(a: Column, b: Column, whole: bool) -> Column:
    """Truncating if ``whole``; NULL if divided by zero."""
    if whole:
        return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def like(x: Column, pattern: str) -> Column:
    """``%`` and ``_`` only, without regard to ASCII case and without an escape."""
    low = pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
    return F.translate(x, _UPPER, _LOWER).like(low)


def is_in(x: Column, kind: str, values: list[tuple[int | float | str, str]]) -> Column:
    """Integers are compared exactly with integers and as doubles with doubles."""
    if kind != INT:
        return x.isin([v if isinstance(v, str) else float(v) for v, _ in values])
    whole = [v for v, k in values if k == INT]
    parts = [float(v) for v, k in values if k == DOUBLE]
    found = [c for c, some in ((x.isin([F.lit(v).cast("bigint") for v in whole]), whole), (x.cast("double").isin(parts), parts)) if some]
    return found[0] if len(found) == 1 else found[0] | found[1]


def substring(x: Column, start: Column, length: Column | None, checked: bool) -> Column:
    """From ``start``, 1 being the first character; unless ``checked``, values out of range raise."""
    most = F.lit(2**31 - 1).cast("bigint")
    n = most if length is None else length
    # the end of a very long stretch stays a 32-bit number
    found = F.call_function("substring", x, F.least(start, most).cast("int"), F.least(n, most - F.least(start, most)).cast("int"))
    if checked:
        return found
    bad = (start < 1) | (n < 0)
    return F.when(bad, F.raise_error(F.lit("SUBSTRING start must be at least 1 and length at least 0")).cast("string")).otherwise(found)


def total(x: Column) -> Column:
    return F.sum(x.cast("double"))


def mean(x: Column) -> Column:
    return F.avg(x.cast("double"))


def order(x: Column, descending: bool) -> Column:
    """NULL is the least value."""
    return x.desc_nulls_last() if descending else x.asc_nulls_first()
