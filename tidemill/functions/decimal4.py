"""Fixed-point numbers of four digits, held as whole numbers of ten-thousandths.

Multiplication, division and parsing cut toward zero where decimals would round, so the numbers are bigint columns and
not DECIMAL ones. Only from_double rounds, halves away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def from_int(c: Column) -> Column:
    return c.cast("bigint") * SCALE


def zero() -> Column:
    return F.lit(0).cast("bigint")


def one() -> Column:
    return F.lit(SCALE).cast("bigint")


def from_double(c: Column) -> Column:
    return F.round(c * SCALE).cast("bigint")


def from_raw(c: Column) -> Column:
    return c.cast("bigint")


def raw(c: Column) -> Column:
    return c


def parse(c: Column) -> Column:
    """The number that a text writes, digits beyond the fourth cut off; null for other texts."""
    whole = F.regexp_extract(c, r"^-?([0-9]+)", 1)
    digits = F.rpad(F.substring(F.regexp_extract(c, r"^-?[0-9]+\.([0-9]*)$", 1), 1, 4), 4, "0")
    value = whole.try_cast("bigint") * SCALE + digits.try_cast("bigint")
    signed = F.when(c.startswith("-"), -value).otherwise(value)
    return F.when(c.rlike(r"^-?[0-9]+(\.[0-9]*)?$"), signed)


def parse_strict(c: Column) -> Column:
    """As parse, but a text that is no number ends the query."""
    value = parse(c)
    return F.when(value.isNull() & c.isNotNull(), F.raise_error(F.concat(F.lit("not a decimal: "), c)).cast("bigint")).otherwise(value)


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return _div(a * b, F.lit(SCALE))


def divide(a: Column, b: Column) -> Column:
    """The quotient; division by zero is an error, as everywhere in ANSI mode."""
    return _div(a * SCALE, b)


def negate(a: Column) -> Column:
    return -a


def absolute(a: Column) -> Column:
    return F.abs(a)


def least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def greatest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def not_negative(a: Column) -> Column:
    return F.greatest(a, F.lit(0).cast("bigint"))


def scaled(a: Column, n: Column | int) -> Column:
    return a * n


def is_zero(a: Column) -> Column:
    return a == 0


def is_positive(a: Column) -> Column:
    return a > 0


def is_negative(a: Column) -> Column:
    return a < 0


def is_not_negative(a: Column) -> Column:
    return a >= 0


def to_double(a: Column) -> Column:
    return a / F.lit(float(SCALE))


def to_int(a: Column) -> Column:
    return _div(a, F.lit(SCALE))


def show(a: Column) -> Column:
    """The number as text, without trailing zeros and without a point for whole numbers."""
    size = F.abs(a)
    rest = F.rtrim(F.lpad((size % SCALE).cast("string"), 4, "0"), F.lit("0"))
    text = F.concat(_div(size, F.lit(SCALE)).cast("string"), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))
    return F.concat(F.when(a < 0, "-").otherwise(""), text)
