"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).head())


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every node of the links (u, v: bigint), root being the smallest node that it reaches.

    Every step is a minimum per node and a join; the links of a node are never gathered. Each step's table is written to
    the shared folder, so that a lost executor costs a part of one step. Empty links give an empty table; links with a
    null end or from a node to itself are left out.
    """
    now = cut(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    last, rounds = None, 0
    while (state := _state(now)) != last:
        last = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links-large")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        old, now, rounds = now, cut(small, "links"), rounds + 1
        for x in (old, large):
            drop_cut(x)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("v"), "root")
    return roots.union(roots.select(F.col("root").alias("v"), "root").distinct())
