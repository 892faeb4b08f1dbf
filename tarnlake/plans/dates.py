"""Calendar arithmetic on ISO dates from year 0 to 9999, at plan time."""

from __future__ import annotations

import re

from tarnlake.errors import DialectError

_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})")
UNITS = ("day", "month", "year")


def days_in_month(year: int, month: int) -> int:
    if month == 2:
        return 29 if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else 28
    return 30 if month in (4, 6, 9, 11) else 31


def parse(text: str) -> tuple[int, int, int] | None:
    """Year, month and day, or None if there is no such day."""
    found = _ISO.fullmatch(text)
    if not found:
        return None
    year, month, day = map(int, found.groups())
    return (year, month, day) if 1 <= month <= 12 and 1 <= day <= days_in_month(year, month) else None


def _number(year: int, month: int, day: int) -> int:
    """Days since 0000-03-01 in the proleptic calendar, whose years then end with February."""
    y = year - (month <= 2)
    return 365 * y + y // 4 - y // 100 + y // 400 + (153 * ((month + 9) % 12) + 2) // 5 + day - 1


def _date(number: int) -> tuple[int, int, int]:
    low, high = -2, 10001
    while high - low > 1:  # the last year that begins (in March) no later
        middle = (low + high) // 2
        low, high = (middle, high) if _number(middle, 3, 1) <= number else (low, middle)
    rest, month, year = number - _number(low, 3, 1), 3, low
    while rest >= (n := days_in_month(year, month)):
        rest -= n
        month += 1
        if month == 13:
            month, year = 1, year + 1
    return year, month, rest + 1


def add(text: str, n: int, unit: str) -> str:
    """The date ``n`` days, months or years later; a day past the month's end is its last."""
    year, month, day = parse(text)
    if abs(n) > 10_000 * 366:
        raise DialectError(f"date out of range: {text} and {n} {unit}s leave the years 0000 to 9999")
    if unit == "day":
        year, month, day = _date(_number(year, month, day) + n)
    else:
        months = year * 12 + month - 1 + n * (12 if unit == "year" else 1)
        year, month = months // 12, months % 12 + 1
        day = min(day, days_in_month(year, month))
    if not 0 <= year <= 9999:
        raise DialectError(f"date out of range: {text} and {n} {unit}s leave the years 0000 to 9999")
    return f"{year:04d}-{month:02d}-{day:02d}"
