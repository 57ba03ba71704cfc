import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemill.functions import decimal4 as d
from tidemill.functions import encryption as e
from tidemill.functions import json_keys as j
from tidemill.functions import partitions as p
from tidemill.functions import scalars as s


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).head())


def dec(x):
    return d.parse(F.lit(x))


def test_decimals(spark):
    assert one(spark, *[d.show(x) for x in (d.add(dec("1.5"), dec("2.3")), d.subtract(dec("5.0"), dec("2.3")), d.multiply(dec("2.5"), dec("4.0")), d.divide(dec("10"), dec("4")), d.negate(dec("5")), d.absolute(dec("-7")), d.not_negative(dec("-3")), d.scaled(dec("1.5"), 3), dec("-0.5"), d.one(), d.zero())]) == ("3.8", "2.7", "10", "2.5", "-5", "7", "0", "4.5", "-0.5", "1", "0")
    assert one(spark, dec("abc"), dec(".5"), dec("1.23456"), dec(""), d.from_double(F.lit(-0.00025)), d.multiply(dec("-0.0001"), dec("0.5")), d.to_int(dec("-1.9")), d.to_double(dec("1.25"))) == (None, None, 12345, None, -3, 0, -1, 1.25)
    with pytest.raises(PySparkException):
        one(spark, d.divide(dec("1"), dec("0")))
    with pytest.raises(PySparkException):
        one(spark, d.parse_strict(F.lit("x")))


def test_decimals_against_whole_numbers(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(-(10**6), 10**6), rng.choice([-1, 1]) * rng.randint(1, 10**5)) for _ in range(300)]
    cut = lambda a, b: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    t = spark.createDataFrame(pairs, "a bigint, b bigint")
    for r in t.select("a", "b", d.multiply(F.col("a"), F.col("b")).alias("m"), d.divide(F.col("a"), F.col("b")).alias("q"), d.parse(d.show(F.col("a"))).alias("again")).collect():
        assert (r["m"], r["q"], r["again"]) == (cut(r["a"] * r["b"], 10000), cut(r["a"] * 10000, r["b"]), r["a"])


def test_bounded(spark):
    score, positive = s.Bounded("Score", 0, 100), s.Bounded("Positive", 1, 10)
    assert one(spark, *[score.of(F.lit(x)) for x in (0, 50, 100, -1, 101)], *[score.clamped(F.lit(x)) for x in (-10, 200, 42)], positive.zero(), score.show(F.lit(42))) == (0, 50, 100, None, None, 0, 100, 42, None, "Score(42)")
    with pytest.raises(PySparkException, match=r"Score.of_int_exn: 101 not in \[0, 100\]"):
        one(spark, score.strict(F.lit(101)))


def test_events_and_clock(spark):
    clock = s.FixedClock(datetime(2024, 1, 1))
    clock.advance(timedelta(hours=1))
    (row,) = one(spark, s.map_payload(s.event(F.lit(2), F.lit("a"), F.lit(7), clock.now()), lambda x: x * 10))
    assert row["payload"] == 20 and row["occurred_at"] == datetime(2024, 1, 1, 1) and row["aggregate_version"] == 7 and len(row["event_id"]) == 36


def test_results(spark):
    good, bad = s.ok(F.lit(1)), s.error(F.lit("no"), F.lit(1))
    assert one(spark, s.map_ok(good, lambda x: x + 1), s.flat_map(bad, s.ok), s.or_else(bad, good), s.map_error(bad, lambda x: F.upper(x)), s.sequence(F.array(good, good)), s.sequence(F.array(good, bad)), s.both(good, bad), s.of_option(F.lit(None).cast("int"), F.lit("gone")), s.to_option(good)) == ((2, None), (None, "no"), (1, None), (None, "NO"), ([1, 1], None), (None, "no"), (None, "no"), (None, "gone"), 1)


def test_json(spark):
    meta = '{"event_id": "550e8400-e29b-41d4-a716-446655440001", "causal_dependencies": [{"tenant_id": "t"}, {"tenant_id": "t", "stream_type": "Order", "stream_id": {"id": 1}, "stream_position": 1}, "garbage"]}'
    deps, none, eid, number = one(spark, j.dependencies(F.lit(meta)), j.dependencies(F.lit(None).cast("string")), j.event_id(F.lit(meta)), j.event_id(F.lit('{"event_id": 5}')))
    assert [tuple(x) for x in deps] == [("t", "Order", '{"id":1}', 1)] and none == [] and eid.startswith("550e") and number is None
    assert one(spark, j.canonical(F.lit('{"b": 1, "a": 2}')), j.payload_or(F.lit("{"), "{}"), j.field(F.lit('{"a.b": 3}'), "a.b"), j.path(F.lit('{"a": {"b": 4}}'), "a", "b"), j.valid_uuid(F.lit("x"))) == ('{"a":2,"b":1}', "{}", "3", "4", False)


def test_partitions(spark):
    t = spark.range(500).select(F.col("id").cast("string").alias("key"))
    homes = [t.where(p.belongs_to(F.col("key"), w, 3)).count() for w in range(3)]
    assert sum(homes) == 500 and min(homes) > 100
    assert [p.effective_worker(1, 4, k, 2) for k in (0, 3)] == [(4, 8), (7, 8)]
    assert p.group_of_worker("g", 2, 3) == "g:2" and p.group_of_worker("g", 0, 1) == "g"


def test_encryption(spark):
    assert e.KeyOfKeys.of(b"x") is None and "x" * 5 not in repr(e.KeyOfKeys(b"x" * 32))
    kek, other = e.KeyOfKeys(b"k" * 32), e.KeyOfKeys(b"o" * 32)
    key, nonce = F.unhex(F.lit("11" * 32)), F.unhex(F.lit("00" * 12))
    blob, back, wrong, short = one(spark, e.wrapped(key, kek, nonce), e.unwrapped(e.wrapped(key, kek), kek), e.unwrapped(e.wrapped(key, kek), other), e.decrypted(F.lit(b"short"), key))
    assert bytes(blob[:12]) == b"\0" * 12 and len(blob) == 12 + 32 + 16 and bytes(back) == b"\x11" * 32 and wrong is None and short is None
    keys = spark.createDataFrame([(1,), (2,)], "key_id int").withColumn("wrapped", e.wrapped(key, kek))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "key_id int, payload string").withColumn("payload", e.encrypted(F.col("payload"), key))
    left, counts = e.shred_members(keys, spark.createDataFrame([(1,)], "key_id int"))
    assert counts == {"keys_destroyed": 1, "aggregates_affected": 1}
    assert {tuple(r) for r in e.readable(rows, left, kek).collect()} == {(1, None), (2, "b")}
    assert e.is_forgotten(rows, left).count() == 1
    assert {tuple(r) for r in e.readable(rows, e.rotated(keys, kek, other), other).collect()} == {(1, "a"), (2, "b")}
    none, counts = e.shred_community(keys)
    assert counts["aggregates_affected"] == 0 and e.readable(rows, none, kek).where("payload is not null").count() == 0
