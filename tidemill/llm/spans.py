"""Spans of regular expression matches, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = "array<struct<start: int, end: int, value: string>>"
#: Matches whose places are summed up one after the other; more of them go by sums of such parts.
PART = 256


def _with(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _placed(pairs: Column, first: Column) -> Column:
    """The spans of some (gap, value) pairs, the first gap of which starts at first."""

    def add(found, p):
        start = F.coalesce(F.get(found, F.size(found) - 1)["end"], first) + F.length(p["gap"])
        return F.concat(found, F.array(F.struct(start.alias("start"), (start + F.length(p["value"])).alias("end"), p["value"].alias("value"))))

    return F.aggregate(pairs, F.array().cast(_SPAN), add)


def _all_placed(pairs: Column) -> Column:
    """The spans of all (gap, value) pairs of a text, in parts, so that no long array grows match by match."""
    part = lambda k: F.slice(pairs, k * PART + 1, F.lit(PART))
    parts = F.sequence(F.lit(0), F.ceil(F.size(pairs) / PART).cast("int") - 1)
    size = lambda k: F.aggregate(part(k), F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["value"]))
    firsts = F.aggregate(parts, F.array(F.lit(0)), lambda found, k: F.concat(found, F.array(F.get(found, F.size(found) - 1) + size(k))))
    return _with(firsts, lambda at: F.flatten(F.transform(parts, lambda k: _placed(part(k), F.get(at, k)))))


def spans(text: Column, pattern: str, might: Column | None = None) -> Column:
    """array<struct<start, end, value>>: the leftmost non-overlapping matches, in code points, end exclusive.

    The text between matches and the matches alternate, so the running sum of their lengths is where each match stands.
    A pattern must not match the empty string. might: a cheap condition without which there is no match. A null text has
    none. A text with n matches costs n * PART and, to add up the parts, (n / PART) ** 2 steps.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(_SPAN)

    def pairs(found):
        return F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("value"))

    placed = _with(values, lambda found: F.when(F.size(found) > PART, _with(pairs(found), _all_placed)).when(F.size(found) > 0, _placed(pairs(found), F.lit(0))).otherwise(empty))
    return F.coalesce(placed if might is None else F.when(might, placed), empty)


def before(text: Column, start: Column, n: int) -> Column:
    """The n characters before start, or those there are."""
    return F.substring(text, F.greatest(start - n + 1, F.lit(1)), F.least(start, F.lit(n)))


def after(text: Column, end: Column, n: int) -> Column:
    return F.substring(text, end + 1, F.lit(n))
