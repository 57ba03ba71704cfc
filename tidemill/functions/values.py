"""Two-valued predicates and forgiving arithmetic over columns, nested ones included.

SQL's three-valued logic is Spark's own; these functions are for callers who want every predicate to be true or false:
null, false, 0, "" and an empty array are false and everything else, 0.0 and structs included, is true; a null equals a
null; null sorts before every value and NaN before every number; impossible arithmetic is null instead of an error.
All stay inside Catalyst: no Python runs per row. Types are Spark types, as from df.schema; where two sides have
different types the comparison is decided by the types, as unequal values of unlike kinds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def kind(t: T.DataType) -> str:
    """null, bool, int, float, text, list or record."""
    for name, types in (("null", (T.NullType,)), ("bool", (T.BooleanType,)), ("int", _INTS), ("float", _FLOATS), ("text", (T.StringType,)), ("list", (T.ArrayType,)), ("record", (T.StructType,))):
        if isinstance(t, types):
            return name
    raise TypeError(f"no value kind for {t.simpleString()}")


_ORDER = ("null", "bool", "int", "float", "text", "list", "record")


def truthy(c: Column, t: T.DataType) -> Column:
    """Whether a value counts as true; never null."""
    test = {"null": F.lit(False), "bool": c, "int": c != 0, "float": c.isNotNull(), "text": c != "", "list": F.size(c) > 0, "record": c.isNotNull()}[kind(t)]
    return F.coalesce(test, F.lit(False))


def _rank(c: Column, t: T.DataType) -> Column:
    """0 for null, 1 for NaN, 2 for other values."""
    return F.when(c.isNull(), 0).when(F.isnan(c), 1).otherwise(2) if kind(t) == "float" else F.when(c.isNull(), 0).otherwise(2)


def equal(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Structural equality: two nulls are equal, unlike kinds and NaN never are."""
    if kind(ta) != kind(tb):
        return a.isNull() & b.isNull()
    same = a.eqNullSafe(b)
    return same & ~F.coalesce(F.isnan(a), F.lit(False)) if kind(ta) == "float" else same


def less(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Total order: null, then bool, int, float, text, list and record; NaN is the least float."""
    ra, rb = _rank(a, ta), _rank(b, tb)
    if kind(ta) != kind(tb):
        earlier = _ORDER.index(kind(ta)) < _ORDER.index(kind(tb))
        return F.when((ra > 0) & (rb > 0), F.lit(earlier)).otherwise((ra == 0) & (rb > 0))
    return (ra < rb) | ((ra == 2) & (rb == 2) & F.coalesce(a < b, F.lit(False)))


def less_or_equal(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    return ~less(b, tb, a, ta)


def one_of(a: Column, values: list) -> Column:
    """Membership in a list of literals; an empty list has no members."""
    return reduce(lambda x, y: x | y, (a.eqNullSafe(F.lit(v)) for v in values), F.lit(False))


def all_of(*tests: Column) -> Column:
    return reduce(lambda x, y: x & y, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(True))


def any_of(*tests: Column) -> Column:
    return reduce(lambda x, y: x | y, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(False))


def negated(test: Column) -> Column:
    return ~F.coalesce(test, F.lit(False))


def plus(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Sums of numbers, a whole number beside a float being a float; texts are joined."""
    kinds = {kind(ta), kind(tb)}
    if kinds == {"text"}:
        return F.concat(a, b)
    if kinds == {"int"}:
        return a.cast("bigint") + b.cast("bigint")
    return a.cast("double") + b.cast("double") if kinds <= {"int", "float"} else F.lit(None)


def _same_number(a, ta, b, tb, of: Callable[[Column, Column], Column]) -> Column:
    if kind(ta) != kind(tb) or kind(ta) not in ("int", "float"):
        return F.lit(None)
    wide = "bigint" if kind(ta) == "int" else "double"
    return of(a.cast(wide), b.cast(wide))


def minus(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    return _same_number(a, ta, b, tb, lambda x, y: x - y)


def times(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    return _same_number(a, ta, b, tb, lambda x, y: x * y)


def divided(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Division, whole numbers towards zero; by zero it is null."""
    if kind(ta) == "int":
        return _same_number(a, ta, b, tb, lambda x, y: F.call_function("div", x, F.nullif(y, F.lit(0).cast("bigint"))))
    return _same_number(a, ta, b, tb, lambda x, y: F.try_divide(x, y))


def minus_of(a: Column, t: T.DataType) -> Column:
    return -a if kind(t) in ("int", "float") else F.lit(None)


def size_of(c: Column, t: T.DataType) -> Column:
    """Items of a list (0 if it is missing), bytes of a text."""
    if kind(t) == "list":
        return F.coalesce(F.size(F.coalesce(c, F.array().cast(t))), F.lit(0))
    return F.octet_length(c) if kind(t) == "text" else F.lit(None)


def starts_with(a: Column, prefix: Column) -> Column:
    return F.startswith(a, prefix)


def ends_with(a: Column, suffix: Column) -> Column:
    return F.endswith(a, suffix)


def contains_text(a: Column, part: Column) -> Column:
    return F.contains(a, part)


def contains_item(items: Column, value: Column) -> Column:
    """Membership of a value in a list, null being a member like any other."""
    return F.coalesce(F.exists(items, lambda x: x.eqNullSafe(value)), F.lit(False))


def lower_ascii(a: Column) -> Column:
    return F.translate(a, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def upper_ascii(a: Column) -> Column:
    return F.translate(a, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def any_item(items: Column, test: Callable[[Column], Column]) -> Column:
    """Whether the test holds for an item; false for an empty or missing list, and a null test is false."""
    return F.coalesce(F.exists(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def every_item(items: Column, test: Callable[[Column], Column]) -> Column:
    """Whether the test holds for all items; true for an empty or missing list, and a null test is false."""
    return F.coalesce(F.forall(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True))


def each(items: Column, of: Callable[[Column], Column]) -> Column:
    """A path through all items."""
    return F.transform(items, of)


def each_flat(items: Column, of: Callable[[Column], Column]) -> Column:
    """A path through all items to lists, laid out as one list; missing inner lists count as empty."""
    return F.flatten(F.filter(F.transform(items, of), lambda x: x.isNotNull()))


def item_at(items: Column, i: int) -> Column:
    """The item at a place from 0, null beyond the end."""
    if i < 0:
        raise ValueError("places start at 0")
    return F.get(items, i)


def items_where(items: Column, test: Callable[[Column], Column]) -> Column:
    """Items for which the test is true itself."""
    return F.filter(items, lambda x: F.coalesce(test(x), F.lit(False)))


def single_or_list(matches: Column) -> Column:
    """(single, several): a path's one match, or else the list of its matches."""
    one = F.size(matches) == 1
    return F.struct(F.when(one, F.get(matches, 0)).alias("single"), F.when(~one, matches).alias("several"))
