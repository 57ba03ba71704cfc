"""Bounded numbers, ids, event envelopes, clocks and results as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounded:
    """Whole numbers from low to high, with a name for messages."""

    name: str
    low: int
    high: int

    def of(self, c: Column) -> Column:
        """The number, or null outside the bounds."""
        return F.when(c.between(self.low, self.high), c.cast("bigint"))

    def strict(self, c: Column) -> Column:
        """The number; one outside the bounds ends the query."""
        message = F.concat(F.lit(f"{self.name}.of_int_exn: "), c.cast("string"), F.lit(f" not in [{self.low}, {self.high}]"))
        return F.when(c.isNull() | c.between(self.low, self.high), c.cast("bigint")).otherwise(F.raise_error(message).cast("bigint"))

    def clamped(self, c: Column) -> Column:
        return F.when(c.isNotNull(), F.least(F.greatest(c.cast("bigint"), F.lit(self.low).cast("bigint")), F.lit(self.high).cast("bigint")))

    def zero(self) -> Column:
        """0 if it is within the bounds, else null."""
        return self.of(F.lit(0))

    def show(self, c: Column) -> Column:
        return F.concat(F.lit(f"{self.name}("), c.cast("string"), F.lit(")"))


def entity_id(c: Column) -> Column:
    return c.cast("bigint")


def show_entity_id(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def event(payload: Column, aggregate_id: Column, aggregate_version: Column, occurred_at: Column | None = None, event_id: Column | None = None) -> Column:
    """An event envelope; by default with a random id and the query's time."""
    return F.struct((F.uuid() if event_id is None else event_id).alias("event_id"), (F.current_timestamp() if occurred_at is None else occurred_at).alias("occurred_at"), aggregate_id.alias("aggregate_id"), aggregate_version.cast("bigint").alias("aggregate_version"), payload.alias("payload"))


def map_payload(envelope: Column, change: Callable[[Column], Column]) -> Column:
    return envelope.withField("payload", change(envelope["payload"]))


class FixedClock:
    """A clock that tests set; now() is a literal for plans."""

    def __init__(self, at: datetime):
        self.at = at

    def now(self) -> Column:
        return F.lit(self.at)

    def set(self, at: datetime) -> None:
        self.at = at

    def advance(self, by: timedelta) -> None:
        self.at += by


class SystemClock:
    def now(self) -> Column:
        return F.current_timestamp()


# Results: struct<ok, error>, one of which is null. An ok value itself must not be null.
def ok(value: Column) -> Column:
    return F.struct(value.alias("ok"), F.lit(None).cast("string").alias("error"))


def error(message: Column, like: Column) -> Column:
    """An error whose ok field has the type of like."""
    return F.struct(F.when(F.lit(False), like).alias("ok"), message.alias("error"))


def guard(test: Column, message: Column, value: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), ok(value)).otherwise(error(message, value))


def of_option(value: Column, message: Column) -> Column:
    return guard(value.isNotNull(), message, value)


def to_option(result: Column) -> Column:
    return result["ok"]


def to_error(result: Column) -> Column:
    return result["error"]


def map_ok(result: Column, of: Callable[[Column], Column]) -> Column:
    value = of(result["ok"])
    return F.when(result["error"].isNull(), ok(value)).otherwise(error(result["error"], value))


def flat_map(result: Column, of: Callable[[Column], Column]) -> Column:
    """The next result if this one is ok, else this one's error."""
    value = of(result["ok"])
    return F.when(result["error"].isNull(), value).otherwise(error(result["error"], value["ok"]))


def map_error(result: Column, of: Callable[[Column], Column]) -> Column:
    return F.when(result["error"].isNull(), result).otherwise(error(of(result["error"]), result["ok"]))


def or_else(result: Column, other: Column) -> Column:
    return F.when(result["error"].isNull(), result).otherwise(other)


def both(a: Column, b: Column) -> Column:
    """Both values, or the first error."""
    pair = F.struct(a["ok"].alias("left"), b["ok"].alias("right"))
    return F.when(a["error"].isNotNull(), error(a["error"], pair)).when(b["error"].isNotNull(), error(b["error"], pair)).otherwise(ok(pair))


def sequence(results: Column) -> Column:
    """A list of results as a result of the list: all values, or the first error."""
    values = F.transform(results, lambda r: r["ok"])
    errors = F.filter(F.transform(results, lambda r: r["error"]), lambda e: e.isNotNull())
    return F.when(F.size(errors) > 0, error(F.get(errors, 0), values)).otherwise(ok(values))
