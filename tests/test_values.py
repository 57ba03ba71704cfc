import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import values as v

COLUMNS = {"b": T.BooleanType(), "i": T.LongType(), "f": T.DoubleType(), "s": T.StringType(), "l": T.ArrayType(T.LongType()), "r": T.StructType([T.StructField("x", T.LongType())])}


def rows(n=120):
    rng = random.Random(1)
    maybe = lambda x: None if rng.random() < 0.25 else x
    return [(k, maybe(rng.random() < 0.5), maybe(rng.randint(-3, 3)), maybe(rng.choice([0.0, 1.5, -2.0, math.nan])), maybe(rng.choice(["", "a", "é", "Ab"])), maybe([rng.randint(0, 2) for _ in range(rng.randint(0, 3))]), maybe((rng.randint(0, 2),))) for k in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), T.StructType([T.StructField("k", T.LongType()), *[T.StructField(n, t) for n, t in COLUMNS.items()]])).cache()


def truth(x):
    """The reference semantics, in plain Python."""
    return not (x is None or x is False or (isinstance(x, int) and not isinstance(x, bool) and x == 0) or x == "" and isinstance(x, str) or isinstance(x, list) and not x)


def place(x):
    """A sort key: null first; NaN is the least float."""
    if x is None:
        return (0,)
    if isinstance(x, float) and math.isnan(x):
        return (1,)
    return (2, x)


def test_truthiness(table):
    got = table.select("k", *[v.truthy(F.col(n), t).alias(n) for n, t in COLUMNS.items()]).collect()
    for r, row in zip(sorted(got), rows(), strict=True):
        assert tuple(r)[1:] == tuple(truth(x) for x in row[1:])


def test_equality_and_order(spark, table):
    a, b = table.alias("a"), table.alias("b").where("k < 25")
    for n in "bifs":
        t = COLUMNS[n]
        x, y = F.col(f"a.{n}"), F.col(f"b.{n}")
        got = a.crossJoin(b).select(x.alias("x"), y.alias("y"), v.equal(x, t, y, t).alias("eq"), v.less(x, t, y, t).alias("lt"), v.less_or_equal(x, t, y, t).alias("le")).distinct().collect()
        for r in got:
            assert r["eq"] == (r["x"] == r["y"] if r["x"] is not None and r["y"] is not None else r["x"] is r["y"])
            assert r["lt"] == (place(r["x"]) < place(r["y"]))
            assert r["le"] == (place(r["x"]) <= place(r["y"]))


def test_unlike_kinds(table):
    i, f = (F.col("i"), T.LongType()), (F.col("f"), T.DoubleType())
    for r in table.select("i", "f", v.equal(*i, *f).alias("eq"), v.less(*i, *f).alias("lt"), v.less(*f, *i).alias("gt")).collect():
        assert r["eq"] == (r["i"] is None and r["f"] is None)
        assert r["lt"] == ((r["i"] is not None and r["f"] is not None) or (r["i"] is None and r["f"] is not None))
        assert r["gt"] == (r["f"] is None and r["i"] is not None)


def test_arithmetic(spark):
    t = spark.createDataFrame([(7, 2, 7.0, 2.0, "a", "b"), (-7, 2, -7.0, 0.0, "", "x"), (7, 0, 1.0, 1.0, None, "x")], "a bigint, b bigint, x double, y double, s string, t string")
    long, double, text = T.LongType(), T.DoubleType(), T.StringType()
    got = [tuple(r) for r in t.select(v.divided(F.col("a"), long, F.col("b"), long), v.divided(F.col("x"), double, F.col("y"), double), v.plus(F.col("a"), long, F.col("x"), double), v.plus(F.col("s"), text, F.col("t"), text), v.times(F.col("a"), long, F.col("x"), double), v.minus(F.col("a"), long, F.col("b"), long), v.minus_of(F.col("s"), text)).collect()]
    assert got == [(3, 3.5, 14.0, "ab", None, 5, None), (-3, None, -14.0, "x", None, -9, None), (None, 1.0, 8.0, None, None, 7, None)]


def test_collections(spark):
    t = spark.createDataFrame([([1, None, 3],), ([],), (None,)], "l array<bigint>")
    got = [tuple(r) for r in t.select(v.any_item(F.col("l"), lambda x: x > 5), v.every_item(F.col("l"), lambda x: x > 0), v.size_of(F.col("l"), T.ArrayType(T.LongType())), v.contains_item(F.col("l"), F.lit(3)), v.contains_item(F.col("l"), F.lit(None).cast("bigint")), v.item_at(F.col("l"), 5), v.items_where(F.col("l"), lambda x: x > 1)).collect()]
    assert got == [(False, False, 3, True, True, None, [3]), (False, True, 0, False, False, None, []), (False, True, 0, False, False, None, None)]
    with pytest.raises(ValueError):
        v.item_at(F.col("l"), -1)


def test_documented_device(spark):
    """A device with policies: nested quantifiers, paths through lists, single matches."""
    t = spark.createDataFrame([("android", True, [("vpn", True, 1), ("wifi", False, 2)])], "platform string, enrolled boolean, policies array<struct<name: string, enforced: boolean, priority: bigint>>")
    p = F.col("policies")
    row = t.select(
        v.any_item(p, lambda x: (x["name"] == "vpn") & x["enforced"]),
        v.every_item(p, lambda x: x["enforced"]),
        v.each(p, lambda x: x["priority"]),
        v.single_or_list(v.each(v.items_where(p, lambda x: x["enforced"]), lambda x: x["name"])),
        v.any_item(p, lambda x: v.any_item(p, lambda y: y["priority"] > x["priority"])),
        v.all_of(F.col("enrolled"), F.lit(None).cast("boolean")),
        v.any_of(F.col("enrolled"), F.lit(None).cast("boolean")),
        v.negated(F.lit(None).cast("boolean")),
        v.size_of(F.lit("é"), T.StringType()),
        v.lower_ascii(F.lit("ÉA")),
        v.one_of(F.col("platform"), []),
    ).head()
    assert tuple(row) == (True, False, [1, 2], ("vpn", None), True, False, True, True, 2, "Éa", False)
