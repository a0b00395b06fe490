"""Arithmetic of segments, and the small parsers that go with query and key files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def approximate(i: Column, first: Column, intercept: Column, exponent: Column, significand: Column) -> Column:
    """The value of a fixed-point line at position i; the shift is arithmetic."""
    return F.call_function("shiftright", significand * (i.cast("long") - first), exponent.cast("int")) + intercept


def residual(y: Column, approximation: Column) -> Column:
    return y - approximation


def truncated_div(a: Column, b: Column) -> Column:
    """Whole-number division that rounds toward zero."""
    return F.call_function("div", a, b)


def sign_of(x: Column) -> Column:
    return F.when(x < 0, 1).otherwise(0)


def slope(dy: Column, dx: Column) -> Column:
    return dy.cast("double") / dx


def words(line: Column, separator: str = ",") -> Column:
    """The trimmed parts of a line."""
    return F.transform(F.split(line, f"\\Q{separator}\\E"), lambda x: F.trim(x))


def doubles(line: Column, separator: str = ",") -> Column:
    """The numbers among a line's parts; what is no number is left out."""
    return F.filter(F.transform(words(line, separator), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def text_of_big(x: Column) -> Column:
    """A number of up to 38 digits as text."""
    return x.cast("decimal(38,0)").cast("string")


def key_of_timestamp(at: Column, hours: int = 8) -> Column:
    """The name that a log of this moment gets, in a zone so many hours ahead."""
    return F.date_format(at + F.make_interval(hours=F.lit(hours)), "yyyyMMdd_HHmmss")
