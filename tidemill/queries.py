"""The query catalogue: each query as a Spark function and as the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import decimal4, encryption, json_keys, partitions, scalars, values
from .operators import inbox, outbox, saga
from .plans.relations import Catalog, ManyToMany, OneToMany, Quantifier
from .sources import derived as d
from .sources.log_tables import unit_of_work
from .sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    names = ("nation", "customer", "supplier", "part", "orders", "lineitem")
    return Catalog(
        load(spark, sf_dir, list(names)),
        {
            "nation": {"customers": OneToMany("customer", (("n_nationkey", "c_nationkey"),))},
            "customer": {"orders": OneToMany("orders", (("c_custkey", "o_custkey"),))},
            "orders": {"lines": OneToMany("lineitem", (("o_orderkey", "l_orderkey"),))},
            "supplier": {"parts": ManyToMany("lineitem", (("s_suppkey", "l_suppkey"),), (("l_partkey", "p_partkey"),), "part")},
            "lineitem": {"peers": OneToMany("lineitem", (("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")))},
        },
    )


# Filters of one table.


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_acctbal <= 9000 AND NOT (c_mktsegment = 'BUILDING') AND c_nationkey <> 3")
def spec_filter_cmp(spark, sf_dir):
    test = (F.col("c_acctbal") > 1000) & (F.col("c_acctbal") <= 9000) & ~(F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") != 3)
    return catalog(spark, sf_dir).where("customer", test).rows.select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey < 2")
def spec_in_list(spark, sf_dir):
    test = values.one_of(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]) | (F.col("c_nationkey") < 2)
    return catalog(spark, sf_dir).where("customer", test).rows.select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_partkey, l_linenumber, CAST((l_orderkey + l_partkey) * l_linenumber AS BIGINT) AS mixed, CAST(-(l_orderkey // 7) AS BIGINT) AS sevenths FROM lineitem WHERE (l_orderkey + l_partkey) * l_linenumber > 5000 AND l_partkey - l_suppkey >= 0")
def spec_arith(spark, sf_dir):
    rows, long = _table(spark, sf_dir, "lineitem"), T.LongType()
    total = values.times(values.plus(F.col("l_orderkey"), long, F.col("l_partkey"), long), long, F.col("l_linenumber"), long)
    sevenths = values.minus_of(values.divided(F.col("l_orderkey"), long, F.lit(7), long), long)
    kept = rows.where((total > 5000) & (values.minus(F.col("l_partkey"), long, F.col("l_suppkey"), long) >= 0))
    return kept.select("l_orderkey", "l_partkey", "l_linenumber", total.alias("mixed"), sevenths.alias("sevenths"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
def spec_placeholder(spark, sf_dir):
    return spark.sql("SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderpriority = :priority AND o_totalprice > :least", args={"priority": "1-URGENT", "least": 100000}, orders=_table(spark, sf_dir, "orders"))


@query("SELECT p_partkey, lower(p_type) AS kind, upper(p_name) AS name, CAST(strlen(p_name) AS BIGINT) AS name_bytes FROM part WHERE (starts_with(p_name, 's') OR ends_with(p_name, 'ring')) AND contains(p_brand, '#2')")
def spec_strings(spark, sf_dir):
    test = (values.starts_with(F.col("p_name"), F.lit("s")) | values.ends_with(F.col("p_name"), F.lit("ring"))) & values.contains_text(F.col("p_brand"), F.lit("#2"))
    return _table(spark, sf_dir, "part").where(test).select("p_partkey", values.lower_ascii(F.col("p_type")).alias("kind"), values.upper_ascii(F.col("p_name")).alias("name"), values.size_of(F.col("p_name"), T.StringType()).cast("bigint").alias("name_bytes"))


# Related tables.


@query("SELECT n_nationkey, c_custkey AS custkey FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 5000")
def spec_path_left_join_o2m(spark, sf_dir):
    return catalog(spark, sf_dir).along("nation", "customers").where(F.col("customers_c_acctbal") > 5000).select("n_nationkey", F.col("customers_c_custkey").alias("custkey"))


@query("SELECT s_suppkey, p_partkey AS partkey FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey LEFT JOIN part ON l_partkey = p_partkey WHERE p_size = 11")
def spec_path_left_join_m2m(spark, sf_dir):
    return catalog(spark, sf_dir).along("supplier", "parts").where(F.col("parts_p_size") == 11).select("s_suppkey", F.col("parts_p_partkey").alias("partkey"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def spec_exists_o2m(spark, sf_dir):
    return catalog(spark, sf_dir).exists("customer", "orders", F.col("o_totalprice") > 100000).rows.select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND p_size = 7 AND p_partkey < 100)")
def spec_exists_m2m(spark, sf_dir):
    return catalog(spark, sf_dir).exists("supplier", "parts", (F.col("p_size") == 7) & (F.col("p_partkey") < 100)).rows.select("s_suppkey", "s_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity > 10))")
def spec_forall_o2m(spark, sf_dir):
    return catalog(spark, sf_dir).forall("orders", "lines", F.col("l_quantity") > 10).rows.select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND NOT (p_partkey % 700 <> 3))")
def spec_forall_m2m(spark, sf_dir):
    return catalog(spark, sf_dir).forall("supplier", "parts", F.col("p_partkey") % 700 != 3).rows.select("s_suppkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem a WHERE l_returnflag = 'A' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_quantity > 45)")
def spec_exists_composite(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.exists(c.where("lineitem", F.col("l_returnflag") == "A"), "peers", F.col("l_quantity") > 45).rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def spec_quantifier_nav(spark, sf_dir):
    return catalog(spark, sf_dir).exists("customer", "orders.lines", F.col("l_quantity") > 49).rows.select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48))")
def spec_nested_quantifier(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.exists("customer", "orders", lambda o: c.exists(c.where(o, F.col("o_orderstatus") == "F"), "lines", F.col("l_quantity") > 48)).rows.select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def spec_exists_or(spark, sf_dir):
    rich = catalog(spark, sf_dir).marked("customer", "orders", F.col("o_totalprice") > 400000, "rich").rows
    return rich.where((F.col("c_acctbal") < 0) | F.col("rich")).select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND NOT (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')))")
def spec_forall_nested(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.forall("nation", "customers", Quantifier("orders", F.col("o_orderstatus") == "O")).rows.select("n_nationkey")


# Nested values.

def _nested(spark, sf_dir) -> DataFrame:
    item = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(item).alias("items"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F' AND o_totalprice > 300000) AS found FROM orders GROUP BY o_custkey")
def value_exists_array(spark, sf_dir):
    return _nested(spark, sf_dir).select("o_custkey", values.any_item(F.col("items"), lambda x: (x["status"] == "F") & (x["price"] > 300000)).alias("found"))


@query("SELECT o_custkey, bool_and(o_totalprice > 50000) AS every FROM orders GROUP BY o_custkey")
def value_forall_array(spark, sf_dir):
    return _nested(spark, sf_dir).select("o_custkey", values.every_item(F.col("items"), lambda x: x["price"] > 50000).alias("every"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 3")
def value_size(spark, sf_dir):
    rows = _nested(spark, sf_dir)
    n = values.size_of(F.col("items"), rows.schema["items"].dataType).cast("bigint")
    return rows.select("o_custkey", n.alias("n")).where("n > 3")


@query("SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (WHERE o_orderstatus = 'P') AS priorities FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'P') > 0")
def value_filter_wildcard(spark, sf_dir):
    open_ = values.items_where(F.col("items"), lambda x: x["status"] == "P")
    found = values.each(open_, lambda x: x["priority"])
    return _nested(spark, sf_dir).where(F.size(open_) > 0).select("o_custkey", F.array_join(F.array_sort(found), ",").alias("priorities"))


@query("SELECT o_custkey, min(o_totalprice) AS least, list_contains(list(o_orderstatus), 'P') AS has_p FROM orders GROUP BY o_custkey")
def value_index_contains(spark, sf_dir):
    prices = F.array_sort(values.each(F.col("items"), lambda x: x["price"]))
    return _nested(spark, sf_dir).select("o_custkey", values.item_at(prices, 0).alias("least"), values.contains_item(values.each(F.col("items"), lambda x: x["status"]), F.lit("P")).alias("has_p"))


@query("SELECT event_id, (user_id % 5 <> 0) AS truthy, (CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END) IS NOT DISTINCT FROM (CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END) AS same, CASE WHEN event_id % 3 = 0 THEN event_id % 6 <> 0 ELSE FALSE END AS earlier FROM events")
def value_truth(spark, sf_dir):
    a, b, long = F.when(F.col("event_id") % 3 != 0, F.col("user_id")), F.when(F.col("event_id") % 6 != 0, F.col("user_id")), T.LongType()
    return _table(spark, sf_dir, "events").select("event_id", values.truthy(F.col("user_id") % 5, long).alias("truthy"), values.equal(a, long, b, long).alias("same"), values.less(a, long, b, long).alias("earlier"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 90")
def json_path_get(spark, sf_dir):
    k = json_keys.field(F.col("props"), "k")
    return _table(spark, sf_dir, "events").where(k.cast("int") > 90).select("event_id", k.alias("k"))


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS joined, CAST(NULL AS BIGINT) AS wrong_sum, CAST(NULL AS BIGINT) AS wrong_size, CAST(NULL AS BIGINT) AS wrong_sign FROM customer")
def value_texts(spark, sf_dir):
    rows, text, number = _table(spark, sf_dir, "customer"), T.StringType(), T.LongType()
    name, key = F.col("c_name"), F.col("c_custkey")
    joined = values.plus(values.plus(name, text, F.lit("/"), text), text, F.col("c_mktsegment"), text)
    wrong = {"wrong_sum": values.plus(name, text, key, number), "wrong_size": values.size_of(key, number), "wrong_sign": values.minus_of(name, text)}
    return rows.select("c_custkey", joined.alias("joined"), *[c.cast("bigint").alias(k) for k, c in wrong.items()])


@query("""SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(o_orderpriority) END AS single, CASE WHEN count(*) > 1 THEN string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) END AS several
FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey""")
def value_single_or_list(spark, sf_dir):
    found = values.each(values.items_where(F.col("items"), lambda x: x["status"] == "P"), lambda x: x["priority"])
    rows = _nested(spark, sf_dir).select("o_custkey", values.single_or_list(found).alias("m")).where("m.single is not null or size(m.several) > 0")
    return rows.select("o_custkey", "m.single", F.array_join(F.array_sort("m.several"), ",").alias("several"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN md5(CAST(event_id AS VARCHAR)) END AS named FROM events")
def json_event_id(spark, sf_dir):
    digest = F.md5(F.col("event_id").cast("string"))
    meta = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"event_id": "'), digest, F.lit('"}'))).when(F.col("event_id") % 3 == 1, '{"event_id": 5}').otherwise("{")
    return _table(spark, sf_dir, "events").select("event_id", json_keys.event_id(meta).alias("named"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{}' ELSE replace(props, ' ', '') END AS payload, '{}' AS metadata FROM events")
def json_malformed(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "{").otherwise(F.col("props")).alias("payload"), F.lit("x").alias("metadata"))
    return outbox.readable_rows(rows)


@query("SELECT event_type || '-' || CAST(user_id % 10 AS VARCHAR) AS part, CAST(('0x' || substr(md5(event_type || '-' || CAST(user_id % 10 AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) AS worker, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def partition_by_expression(spark, sf_dir):
    part = partitions.by_expression("concat(event_type, '-', user_id % 10)")
    return _table(spark, sf_dir, "events").groupBy(part.alias("part"), partitions.worker_of(part, 5).alias("worker")).agg(F.count("*").alias("n"))


# Numbers.

_RAW = "CAST(round(l_extendedprice * 10000) AS BIGINT)"
_RATE = "CAST(round(l_discount * 10000) AS BIGINT)"


def _amounts(spark, sf_dir) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", decimal4.from_double(F.col("l_extendedprice")).alias("price"), decimal4.from_double(F.col("l_discount")).alias("rate"), "l_quantity")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, ({_RAW} * ({_RATE} - 300)) // 10000 AS product FROM lineitem")
def decimal4_mul(spark, sf_dir):
    return _amounts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", decimal4.multiply(F.col("price"), decimal4.subtract(F.col("rate"), F.lit(300))).alias("product"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, (-({_RAW}) * 10000) // (CAST(l_quantity AS BIGINT) * 10000) AS quotient FROM lineitem")
def decimal4_div(spark, sf_dir):
    return _amounts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", decimal4.divide(decimal4.negate(F.col("price")), decimal4.from_int(F.col("l_quantity"))).alias("quotient"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v < 0 THEN '-' ELSE '' END || CAST(abs(v) // 10000 AS VARCHAR) || CASE WHEN abs(v) % 10000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(abs(v) % 10000 AS VARCHAR), 4, '0'), '0') END AS shown, v AS parsed
FROM (SELECT l_orderkey, l_linenumber, l_partkey, ({_RAW} * ({_RATE} - 300)) // 10000 AS v FROM lineitem)""")
def decimal4_show(spark, sf_dir):
    product = decimal4.multiply(F.col("price"), F.col("rate") - 300)
    return _amounts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", decimal4.show(product).alias("shown")).withColumn("parsed", decimal4.parse(F.col("shown")))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, p + r AS added, abs(r - p) AS size, least(p, 30000000) AS low, greatest(p, 30000000) AS high, greatest(r - 500, 0) AS cut, r * 3 AS tripled,
r = 0 AS zero, p > 0 AS positive, r - 500 < 0 AS negative, r >= 500 AS not_negative, p / 10000.0 AS as_double, p // 10000 AS as_int, p = r AS same, r < p AS earlier
FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_RAW} AS p, {_RATE} AS r FROM lineitem)""")
def decimal4_parts(spark, sf_dir):
    p, r, m = F.col("price"), F.col("rate"), decimal4.from_raw(F.lit(30000000))
    less = decimal4.subtract(r, F.lit(500))
    parts = {
        "added": decimal4.add(p, r),
        "size": decimal4.absolute(decimal4.subtract(r, p)),
        "low": decimal4.least(p, m),
        "high": decimal4.greatest(p, m),
        "cut": decimal4.not_negative(less),
        "tripled": decimal4.scaled(r, 3),
        "zero": decimal4.is_zero(r),
        "positive": decimal4.is_positive(p),
        "negative": decimal4.is_negative(less),
        "not_negative": decimal4.is_not_negative(less),
        "as_double": decimal4.to_double(p),
        "as_int": decimal4.to_int(p),
        "same": p == r,
        "earlier": r < p,
    }
    return _amounts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(k) for k, c in parts.items()])


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {_RAW} AS parsed FROM lineitem")
def decimal4_parse_strict(spark, sf_dir):
    return _amounts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", decimal4.parse_strict(decimal4.show(F.col("price"))).alias("parsed"))


@query("SELECT event_id, user_id AS id, CAST(user_id AS VARCHAR) AS shown, 'User(' || user_id || ')' AS named FROM events")
def entity_ids(spark, sf_dir):
    users = scalars.Bounded("User", 0, 10**9)
    return _table(spark, sf_dir, "events").select("event_id", scalars.entity_id(F.col("user_id")).alias("id"), scalars.show_entity_id(F.col("user_id")).alias("shown"), users.show(F.col("user_id")).alias("named"))


@query("SELECT event_id, ts < TIMESTAMP '2024-01-03 12:00:00' AS earlier FROM events")
def clock_fixed(spark, sf_dir):
    clock = scalars.FixedClock(datetime(2024, 1, 2))
    clock.advance(timedelta(hours=36))
    return _table(spark, sf_dir, "events").select("event_id", (F.col("ts") < clock.now()).alias("earlier"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal + 1 ELSE c_nationkey END AS recovered, CASE WHEN c_acctbal < 0 THEN 'customer is negative' END AS error,
CASE WHEN c_acctbal >= 0 AND c_nationkey > 2 THEN c_acctbal + 1 + c_nationkey END AS total, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_nationkey <= 2 THEN 'far' END AS first_error FROM customer""")
def result_combinators(spark, sf_dir):
    plain = scalars.guard(F.col("c_acctbal") >= 0, F.lit("negative"), F.col("c_acctbal"))
    more = scalars.map_ok(plain, lambda x: x + 1)
    near = scalars.of_option(F.when(F.col("c_nationkey") > 2, F.col("c_nationkey").cast("double")), F.lit("far"))
    pair = scalars.both(more, near)
    recovered = scalars.or_else(more, scalars.ok(F.col("c_nationkey").cast("double")))
    named = scalars.map_error(plain, lambda e: F.concat(F.lit("customer is "), e))
    total = scalars.map_ok(pair, lambda x: x["left"] + x["right"])
    return _table(spark, sf_dir, "customer").select("c_custkey", scalars.to_option(recovered).alias("recovered"), scalars.to_error(named).alias("error"), scalars.to_option(total).alias("total"), scalars.to_error(total).alias("first_error"))


@query("SELECT c_custkey, CAST(least(greatest(CAST(trunc(c_acctbal) AS BIGINT), 0), 5000) AS BIGINT) AS clamped, CASE WHEN CAST(trunc(c_acctbal) AS BIGINT) BETWEEN 0 AND 5000 THEN CAST(trunc(c_acctbal) AS BIGINT) END AS bounded FROM customer")
def bounded_clamp(spark, sf_dir):
    score, whole = scalars.Bounded("Score", 0, 5000), F.col("c_acctbal").cast("bigint")
    return _table(spark, sf_dir, "customer").select("c_custkey", score.clamped(whole).alias("clamped"), score.of(whole).alias("bounded"))


# The outbox.

_OUT = f"({d.duckdb(d.OUTBOX)}) m"
_AT = "(transaction_id > 300 OR (transaction_id = 300 AND position > 1440))"


@query(f"SELECT position, transaction_id, uri FROM {_OUT} WHERE {_AT} AND transaction_id < 1200")
def outbox_pending(spark, sf_dir):
    return outbox.pending(d.derived(spark, sf_dir, d.OUTBOX), (300, 1440), 1200).select("position", "transaction_id", "uri")


@query(f"SELECT position, transaction_id, uri FROM {_OUT} WHERE {_AT} AND (uri = 'kafka://click' OR starts_with(uri, 'kafka://click/'))")
def outbox_pending_uri_prefix(spark, sf_dir):
    return outbox.pending(d.derived(spark, sf_dir, d.OUTBOX), (300, 1440), uri="kafka://click").select("position", "transaction_id", "uri")


@query(f"SELECT position, transaction_id FROM {_OUT} WHERE transaction_id < 100")
def outbox_visibility(spark, sf_dir):
    return outbox.pending(d.derived(spark, sf_dir, d.OUTBOX), horizon=100).select("position", "transaction_id")


@query(f"SELECT position, transaction_id, uri FROM {_OUT} WHERE transaction_id > 98 ORDER BY transaction_id, position LIMIT 100")
def outbox_first_batch(spark, sf_dir):
    return outbox.batch(outbox.pending(d.derived(spark, sf_dir, d.OUTBOX), (98, 10**9))).select("position", "transaction_id", "uri")


@query(f"SELECT uri, CAST(('0x' || substr(md5(uri), 1, 8))::BIGINT % 3 AS INTEGER) AS worker, CAST(count(*) AS BIGINT) AS n FROM {_OUT} GROUP BY ALL")
def outbox_partition_assignment(spark, sf_dir):
    return d.derived(spark, sf_dir, d.OUTBOX).groupBy("uri", partitions.worker_of(F.col("uri"), 3).alias("worker")).agg(F.count("*").alias("n"))


@query("SELECT 'g' || CAST(user_id % 7 AS VARCHAR) AS consumer_group, 'kafka://' || event_type AS uri, arg_max(event_id * 31 % 1009, event_id) AS offset_acked FROM events GROUP BY ALL")
def outbox_positions_latest(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.concat(F.lit("g"), F.col("user_id") % 7).alias("consumer_group"), F.concat(F.lit("kafka://"), "event_type").alias("uri"), (F.col("event_id") * 31 % 1009).alias("offset_acked"), F.col("event_id").alias("commit_id"))
    return outbox.positions(log).select("consumer_group", "uri", "offset_acked")


@query(f"SELECT max(transaction_id) AS transaction_id, arg_max(position, transaction_id * 1000000 + position) AS position FROM (SELECT * FROM {_OUT} WHERE {_AT} ORDER BY transaction_id, position LIMIT 100)")
def outbox_ack_next(spark, sf_dir):
    rows = outbox.batch(outbox.pending(d.derived(spark, sf_dir, d.OUTBOX), (300, 1440)))
    return rows.agg(F.max(F.struct("transaction_id", "position")).alias("m")).select("m.transaction_id", "m.position")


@query(f"SELECT position, transaction_id FROM {_OUT} WHERE transaction_id < 120 OR (transaction_id = 120 AND position <= 180)")
def outbox_retention(spark, sf_dir):
    groups = spark.createDataFrame([("a", 180, "400"), ("b", 9000, "120")], "consumer_group string, offset_acked bigint, tx string")
    current = groups.withColumn("last_processed_transaction_id", F.col("tx").cast("decimal(20,0)"))
    return outbox.consumed_everywhere(d.derived(spark, sf_dir, d.OUTBOX), current).select("position", "transaction_id")


@query("SELECT event_id, concat('group:', CAST(user_id % 4 AS VARCHAR)) AS own_group, CAST(user_id % 4 AS BIGINT) AS worker FROM events")
def outbox_worker_groups(spark, sf_dir):
    pairs = [partitions.effective_worker(p, 2, k, 2) for p in range(2) for k in range(2)]
    names = spark.createDataFrame([(w, partitions.group_of_worker("group", w, n)) for w, n in pairs], "worker bigint, own_group string")
    events = _table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("worker"))
    return events.join(F.broadcast(names), "worker").select("event_id", "own_group", "worker")  # four rows


@query("SELECT md5(CAST(event_id % 9000 AS VARCHAR)) AS event_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def outbox_duplicate_events(spark, sf_dir):
    meta = F.concat(F.lit('{"event_id":"'), F.md5((F.col("event_id") % 9000).cast("string")), F.lit('"}'))
    return outbox.duplicate_events(_table(spark, sf_dir, "events").select(meta.alias("metadata")))


# The inbox.

_IN = f"({d.duckdb(d.INBOX)})"
_REDELIVERED = f"(SELECT * FROM {_IN} a UNION ALL SELECT event_id, tenant_id, stream_type, stream_id, stream_position, received_position + 1000003, payload FROM {_IN} b WHERE event_id % 10 = 0)"
_ACKED = "received_position % 3 = 0"


def _redelivered(spark, sf_dir) -> DataFrame:
    rows = d.derived(spark, sf_dir, d.INBOX)
    return rows.unionByName(rows.where("event_id % 10 = 0").withColumn("received_position", F.col("received_position") + 1000003))


def _acks(rows: DataFrame) -> DataFrame:
    return rows.where(_ACKED).select(*inbox.KEY, F.col("received_position").alias("processed_position"))


_ELIGIBLE = f"""SELECT m.* FROM {_IN} m LEFT JOIN (SELECT tenant_id, stream_type, stream_id, stream_position FROM {_IN} WHERE {_ACKED}) p
ON m.tenant_id = p.tenant_id AND m.stream_type = p.stream_type AND m.stream_id = p.stream_id AND m.stream_position - 1 = p.stream_position
WHERE NOT (m.{_ACKED}) AND (m.stream_position = 1 OR p.stream_position IS NOT NULL)"""
_COLUMNS = "tenant_id, stream_type, stream_id, stream_position, received_position"


@query(f"SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, stream_type, stream_id, stream_position ORDER BY received_position) AS rn FROM {_REDELIVERED}) WHERE rn = 1")
def inbox_dedup_pk(spark, sf_dir):
    return inbox.first_arrivals(_redelivered(spark, sf_dir)).select(*_COLUMNS.split(", "))


@query(f"SELECT CAST(event_id % 5000 AS VARCHAR) AS event_id, CAST(count(*) AS BIGINT) AS n_keys FROM {_IN} GROUP BY 1 HAVING count(*) > 1")
def inbox_event_id_conflicts(spark, sf_dir):
    return inbox.event_id_conflicts(_redelivered(spark, sf_dir).withColumnRenamed("event_id", "n"), (F.col("n") % 5000).cast("string"))


@query(f"SELECT {_COLUMNS} FROM ({_ELIGIBLE})")
def inbox_eligible(spark, sf_dir):
    rows = d.derived(spark, sf_dir, d.INBOX)
    return inbox.eligible(rows, inbox.predecessor_edges(rows), _acks(rows)).select(*_COLUMNS.split(", "))


@query(f"SELECT {_COLUMNS} FROM ({_ELIGIBLE}) ORDER BY received_position LIMIT 1")
def inbox_next(spark, sf_dir):
    rows = d.derived(spark, sf_dir, d.INBOX)
    return inbox.next_message(rows, inbox.predecessor_edges(rows), _acks(rows)).select(*_COLUMNS.split(", "))


@query(f"SELECT {_COLUMNS}, drain_key FROM (SELECT *, max(received_position) OVER w AS drain_key, row_number() OVER w AS n FROM {_IN} WINDOW w AS (PARTITION BY tenant_id, stream_type, stream_id ORDER BY stream_position ROWS UNBOUNDED PRECEDING)) WHERE stream_position = n")
def inbox_drain_order(spark, sf_dir):
    return inbox.drain_order(d.derived(spark, sf_dir, d.INBOX)).select(*_COLUMNS.split(", "), "drain_key")


@query(f"SELECT max(received_position) - (SELECT max(received_position) FROM {_IN} WHERE {_ACKED} AND received_position < 900000) AS lag FROM {_IN}")
def inbox_lag(spark, sf_dir):
    rows = d.derived(spark, sf_dir, d.INBOX)
    return inbox.lag(rows, _acks(rows).where("processed_position < 900000"))


@query(f"SELECT tenant_id, stream_type, stream_id, CAST(('0x' || substr(md5(tenant_id || ':' || stream_type || ':' || stream_id), 1, 8))::BIGINT % 4 AS INTEGER) AS worker, CAST(count(*) AS BIGINT) AS n FROM {_IN} GROUP BY ALL")
def inbox_partition_stream(spark, sf_dir):
    return d.derived(spark, sf_dir, d.INBOX).groupBy("tenant_id", "stream_type", "stream_id", partitions.worker_of(partitions.by_stream(), 4).alias("worker")).agg(F.count("*").alias("n"))


@query(f"SELECT {_COLUMNS} FROM {_IN} WHERE NOT ({_ACKED}) OR received_position > 500000")
def inbox_retention(spark, sf_dir):
    rows = d.derived(spark, sf_dir, d.INBOX)
    return inbox.retained(rows, _acks(rows), 500000).select(*_COLUMNS.split(", "))


@query("SELECT event_id, event_type AS stream_type, '{\"id\":' || user_id || '}' AS stream_id, event_id // 3 AS stream_position FROM events WHERE event_id % 4 <> 0")
def inbox_dependencies(spark, sf_dir):
    one = F.concat(F.lit('{"stream_position": '), F.expr("event_id div 3"), F.lit(', "stream_id": {"id": '), F.col("user_id"), F.lit('}, "tenant_id": "t", "stream_type": "'), F.col("event_type"), F.lit('"}'))
    meta = F.concat(F.lit('{"causal_dependencies": ["junk", {"tenant_id": "t"}'), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit(", "), one)).otherwise(""), F.lit("]}"))
    found = _table(spark, sf_dir, "events").select("event_id", F.explode(json_keys.dependencies(meta)).alias("d"))
    return found.select("event_id", "d.stream_type", "d.stream_id", "d.stream_position")


def _uuid(c):
    return F.regexp_replace(F.md5(c.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _log_folder(spark: SparkSession) -> str:
    """A new folder for log tables where all executors see it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/logs-{uuid.uuid4().hex}"


@query(f"SELECT uri, CAST(count(*) AS BIGINT) AS n FROM {_OUT} WHERE uri = 'kafka://click' OR starts_with(uri, 'kafka://click/') GROUP BY uri")
def outbox_dispatch(spark, sf_dir):
    """Messages published in two commits and handed to a group of two workers until none is left."""
    where = _log_folder(spark)
    box = outbox.Outbox(spark, where, batch_size=20_000).setup()
    rows = d.derived(spark, sf_dir, d.OUTBOX).select("position", "uri", "payload", F.concat(F.lit('{"event_id": "'), _uuid(F.col("position")), F.lit('"}')).alias("metadata"))
    for half in range(2):
        with unit_of_work(box.messages) as (n,):
            box.publish(n, rows.where(F.col("position") % 2 == half))
    for worker in range(2):
        box.drain(lambda batch: batch.select("uri").write.mode("append").parquet(f"{where}/taken"), group="g", uri="kafka://click", worker=worker, workers=2)
    return spark.read.schema("uri string").parquet(f"{where}/taken").groupBy("uri").agg(F.count("*").alias("n"))


@query(f"SELECT tenant_id, stream_type, stream_id, stream_position, row_number() OVER (ORDER BY event_id % 2, received_position) AS received_position FROM {_IN} m")
def inbox_publish(spark, sf_dir):
    """Messages stored once: the even ones, then all of them."""
    box = inbox.Inbox(spark, _log_folder(spark)).setup()
    rows = _deliveries(spark, sf_dir)
    for part in (rows.where("event_id % 2 = 0"), rows):
        box.publish(part)
    return box.read().select(*_COLUMNS.split(", "))


def _deliveries(spark, sf_dir) -> DataFrame:
    """Messages of which those at even positions of their streams depend on the one before."""
    needs = F.concat(F.lit(', "causal_dependencies": [{"tenant_id": "'), "tenant_id", F.lit('", "stream_type": "'), "stream_type", F.lit('", "stream_id": '), "stream_id", F.lit(', "stream_position": '), F.col("stream_position") - 1, F.lit("}]"))
    meta = F.concat(F.lit('{"event_id": "'), _uuid(F.col("event_id")), F.lit('"'), F.when(F.col("stream_position") % 2 == 0, needs).otherwise(""), F.lit("}"))
    return d.derived(spark, sf_dir, d.INBOX).withColumns({"uri": F.lit("kafka://in"), "metadata": meta, "arrival": F.col("received_position")})


@query(f"""SELECT m.tenant_id, m.stream_type, m.stream_id, m.stream_position, CASE WHEN m.stream_position % 2 = 0 THEN 1 ELSE 0 END AS wave FROM {_IN} m
WHERE m.stream_position % 2 = 1 OR EXISTS (SELECT 1 FROM {_IN} p WHERE p.tenant_id = m.tenant_id AND p.stream_type = m.stream_type AND p.stream_id = m.stream_id AND p.stream_position = m.stream_position - 1)""")
def inbox_dispatch(spark, sf_dir):
    """Waves of eligible messages, handed on and acknowledged until none is left."""
    where = _log_folder(spark)
    box = inbox.Inbox(spark, where).setup()
    box.publish(_deliveries(spark, sf_dir))
    waves = iter(range(1_000_000))
    box.drain_waves(lambda rows: rows.select(*inbox.KEY).withColumn("wave", F.lit(next(waves))).write.mode("append").parquet(f"{where}/taken"))
    return spark.read.schema("tenant_id string, stream_type string, stream_id string, stream_position bigint, wave int").parquet(f"{where}/taken")


# Events, workflows, keys.


@query("SELECT event_id, user_id AS aggregate_id, event_id AS aggregate_version, ts AS occurred_at, user_id * 10 AS payload FROM events")
def event_envelope(spark, sf_dir):
    made = scalars.event(F.col("user_id"), F.col("user_id"), F.col("event_id"), F.col("ts"), F.col("event_id").cast("string"))
    rows = _table(spark, sf_dir, "events").select("event_id", scalars.map_payload(made, lambda x: x * 10).alias("e"))
    return rows.select("event_id", "e.aggregate_id", "e.aggregate_version", "e.occurred_at", "e.payload")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_nationkey > 2 THEN c_acctbal * 2 END AS value, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_nationkey <= 2 THEN 'far' END AS error FROM customer")
def result_chain(spark, sf_dir):
    first = scalars.guard(F.col("c_acctbal") >= 0, F.lit("negative"), F.col("c_acctbal"))
    chain = scalars.flat_map(first, lambda x: scalars.guard(F.col("c_nationkey") > 2, F.lit("far"), x * 2))
    return _table(spark, sf_dir, "customer").select("c_custkey", chain.alias("r")).select("c_custkey", scalars.to_option(F.col("r")).alias("value"), scalars.to_error(F.col("r")).alias("error"))


@query("SELECT n_nationkey, CASE WHEN bool_and(c_acctbal >= -900) THEN count(*) END AS n, CASE WHEN NOT bool_and(c_acctbal >= -900) THEN 'customer ' || min(c_custkey) FILTER (WHERE c_acctbal < -900) END AS error FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def result_sequence(spark, sf_dir):
    checked = scalars.guard(F.col("c_acctbal") >= -900, F.concat(F.lit("customer "), F.col("c_custkey")), F.col("c_custkey"))
    error = scalars.to_error(checked)
    first = F.min_by(error, F.when(error.isNotNull(), F.col("c_custkey")))
    rows = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("all"), first.alias("error"))
    return rows.select("n_nationkey", F.when(F.col("error").isNull(), F.col("all")).alias("n"), "error")


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 2 END) AS BIGINT) AS state FROM events GROUP BY user_id")
def event_fold(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return saga.summed(events, "user_id", F.when(F.col("event_type") == "error", -1).otherwise(2).cast("bigint"))


_SAGA = f"({d.duckdb(d.SAGA)})"
_FAILS = f"(SELECT saga_id, count(*) AS n, min(step_no) FILTER (WHERE NOT ok) AS f, arg_min(activity, step_no) FILTER (WHERE NOT ok) AS a FROM {_SAGA} GROUP BY saga_id)"


@query(f"SELECT saga_id, CAST(n AS BIGINT) AS n_steps, f IS NULL AS completed, f AS failed_step, a AS failed_activity, CAST(coalesce(f - 1, n) AS BIGINT) AS n_done, CAST(coalesce(f - 1, 0) AS BIGINT) AS n_compensated FROM {_FAILS}")
def saga_outcome(spark, sf_dir):
    return saga.outcomes(d.derived(spark, sf_dir, d.SAGA))


@query(f"SELECT saga_id, f - step_no AS compensation_no, step_no, activity FROM {_SAGA} JOIN {_FAILS} USING (saga_id) WHERE step_no < f")
def saga_compensation_order(spark, sf_dir):
    return saga.compensations(d.derived(spark, sf_dir, d.SAGA))


@query(f"""SELECT saga_id, min(alt_no) FILTER (WHERE good) IS NOT NULL AS succeeded, min(alt_no) FILTER (WHERE good) AS winner,
CAST(count(*) FILTER (WHERE w IS NULL OR alt_no <= w) AS BIGINT) AS n_tried, CAST(coalesce(sum(undone) FILTER (WHERE w IS NULL OR alt_no <= w), 0) AS BIGINT) AS n_compensated FROM
(SELECT *, min(alt_no) FILTER (WHERE good) OVER (PARTITION BY saga_id) AS w FROM
(SELECT saga_id, alt_no, bool_and(ok) AS good, coalesce(min(alt_step) FILTER (WHERE NOT ok) - 1, 0) AS undone FROM ({d.duckdb(d.FALLBACK)}) GROUP BY saga_id, alt_no)) GROUP BY saga_id""")
def saga_fallback(spark, sf_dir):
    return saga.fallback(d.derived(spark, sf_dir, d.FALLBACK))


@query(f"""SELECT saga_id, bool_and(good) AS succeeded, CAST(count(*) AS BIGINT) AS n_branches, CAST(sum(done) AS BIGINT) AS n_done, CAST(CASE WHEN bool_and(good) THEN 0 ELSE sum(done) END AS BIGINT) AS n_compensated FROM
(SELECT saga_id, branch_no, bool_and(ok) AS good, coalesce(min(i) FILTER (WHERE NOT ok) - 1, count(*)) AS done FROM
(SELECT *, row_number() OVER (PARTITION BY saga_id, branch_no ORDER BY step_no) AS i FROM ({d.duckdb(d.PARALLEL)})) GROUP BY saga_id, branch_no) GROUP BY saga_id""")
def saga_parallel(spark, sf_dir):
    return saga.parallel(d.derived(spark, sf_dir, d.PARALLEL))


@query(f"""SELECT saga_id, step_no, uri FROM (SELECT saga_id, step_no, CASE WHEN ok THEN 'sb://./' || lead(activity) OVER w ELSE 'sb://./' || lag(activity) OVER w || 'Compensation' END AS uri, f
FROM {_SAGA} JOIN {_FAILS} USING (saga_id) WINDOW w AS (PARTITION BY saga_id ORDER BY step_no)) WHERE (f IS NULL OR step_no <= f) AND uri IS NOT NULL""")
def saga_next_uri(spark, sf_dir):
    return saga.next_messages(d.derived(spark, sf_dir, d.SAGA))


@query(f"""SELECT saga_id, count(*) FILTER (WHERE step_no > 4) = 0 AS is_completed, TRUE AS is_in_progress, 'sb://./' || min(activity) FILTER (WHERE step_no = 5) AS progress_uri, 'sb://./' || arg_max(activity, step_no) FILTER (WHERE step_no <= 4) || 'Compensation' AS compensation_uri FROM {_SAGA} GROUP BY saga_id""")
def saga_slip_state(spark, sf_dir):
    return saga.slips(d.derived(spark, sf_dir, d.SAGA), 4)


@query("SELECT user_id AS member, event_id, CASE WHEN user_id % 5 <> 0 THEN props END AS payload FROM events")
def erasure_view(spark, sf_dir):
    kek = encryption.KeyOfKeys(bytes(range(32)))
    members = _table(spark, sf_dir, "events").select("user_id").distinct()
    plain = members.select(F.col("user_id").alias("key_id"), F.unhex(F.sha2(F.col("user_id").cast("string"), 256)).alias("data_key"))
    keys = plain.select("key_id", encryption.wrapped(F.col("data_key"), kek).alias("wrapped"))
    rows = _table(spark, sf_dir, "events").join(plain, F.col("user_id") == F.col("key_id")).select("key_id", "event_id", encryption.encrypted(F.col("props"), F.col("data_key")).alias("payload"))
    kept, _ = encryption.shred_members(keys, members.where("user_id % 5 = 0").select(F.col("user_id").alias("key_id")))
    return encryption.readable(rows, kept, kek).select(F.col("key_id").alias("member"), "event_id", "payload")


@query(f"""SELECT saga_id, '{{"completedWorkLogs":[' || coalesce(string_agg('{{"activityTypeName":"' || activity || '","result":{{"ok":true}}}}', ',' ORDER BY step_no) FILTER (WHERE step_no <= 2), '')
|| '],"nextWorkItems":[' || coalesce(string_agg('{{"activityTypeName":"' || activity || '","arguments":{{"step":' || step_no || '}}}}', ',' ORDER BY step_no) FILTER (WHERE step_no > 2), '') || ']}}' AS slip FROM {_SAGA} GROUP BY saga_id""")
def saga_slip_json(spark, sf_dir):
    def items(test, key, value):
        found = F.array_sort(F.collect_list(F.when(test, F.struct("step_no", "activity", F.array(F.struct(F.lit(key).alias("key"), value.alias("value"))).alias("entries")))))
        return F.transform(found, lambda x: F.struct(x["activity"].alias("activity"), x["entries"].alias("entries")))

    rows = d.derived(spark, sf_dir, d.SAGA).groupBy("saga_id").agg(items(F.col("step_no") <= 2, "ok", F.lit("true")).alias("logs"), items(F.col("step_no") > 2, "step", F.col("step_no").cast("string")).alias("items"))
    return rows.select("saga_id", saga.slip_json(F.col("logs"), F.col("items")).alias("slip"))


@query(f"""WITH RECURSIVE flows AS (SELECT saga_id, list({{'a': activity, 'ok': ok, 'undo': step_no * saga_id % 7 <> 0}} ORDER BY step_no) AS steps FROM {_SAGA} GROUP BY saga_id),
run AS (SELECT saga_id, CAST(0 AS BIGINT) AS delivery, TRUE AS forward, 1 AS next, CAST([] AS INTEGER[]) AS logs, CAST(NULL AS VARCHAR) AS direction, CAST(NULL AS VARCHAR) AS activity, CAST(NULL AS BOOLEAN) AS result FROM flows
UNION ALL SELECT saga_id, delivery + 1, forward = res, CASE WHEN forward THEN next + 1 ELSE next END, CASE WHEN NOT forward THEN logs[1:len(logs) - 1] WHEN res THEN list_append(logs, spot) ELSE logs END,
CASE WHEN forward THEN 'forward' ELSE 'backward' END, act, res FROM (SELECT r.*, steps[r.spot].a AS act, CASE WHEN forward THEN steps[r.spot].ok ELSE steps[r.spot].undo END AS res, len(steps) AS n
FROM (SELECT *, CASE WHEN forward THEN next ELSE logs[len(logs)] END AS spot FROM run) r JOIN flows USING (saga_id)) WHERE spot IS NOT NULL AND spot <= n)
SELECT saga_id, delivery, direction, activity, result FROM run WHERE delivery > 0""")
def saga_hosts(spark, sf_dir):
    """Deliveries where every seventh compensation refuses."""
    return saga.run_hosts(d.derived(spark, sf_dir, d.SAGA).withColumn("undo_ok", F.col("step_no") * F.col("saga_id") % 7 != 0))


_WORK = ("CASE activity WHEN 'error' THEN FALSE WHEN 'click' THEN step_no % 5 <> 0 ELSE TRUE END", "step_no % 2 = 0")


@query(f"SELECT saga_id, step_no, activity, {_WORK[0]} AS ok, {_WORK[1]} AS undo_ok FROM {_SAGA}")
def saga_performed(spark, sf_dir):
    """Steps with the results of each activity's functions."""
    rows = d.derived(spark, sf_dir, d.SAGA).drop("ok").withColumn("arguments", F.col("step_no"))
    undo = lambda x: x % 2 == 0
    work = dict.fromkeys(("view", "signup", "purchase"), (lambda x: F.lit(True), undo))
    work |= {"error": (lambda x: F.lit(False), undo), "click": (lambda x: x % 5 != 0, undo)}
    return saga.performed(rows, work).select("saga_id", "step_no", "activity", "ok", "undo_ok")


@query(f"""SELECT saga_id, step_no, uri, activity, direction FROM (SELECT saga_id, step_no, CASE WHEN ok THEN 'sb://./' || activity ELSE 'sb://./' || activity || 'Compensation' END AS uri, activity, CASE WHEN ok THEN 'forward' ELSE 'backward' END AS direction FROM {_SAGA})
WHERE activity <> 'view'""")
def saga_deliveries(spark, sf_dir):
    """Messages with the activity that accepts them; nobody takes those for view."""
    rows = d.derived(spark, sf_dir, d.SAGA)
    uri = F.when(F.col("ok"), saga.work_address(F.col("activity"))).otherwise(saga.compensation_address(F.col("activity")))
    known = rows.select("activity").where("activity <> 'view'").distinct()
    return saga.deliveries(rows.select("saga_id", "step_no", uri.alias("uri")), known).select("saga_id", "step_no", "uri", "activity", "direction")


@query("SELECT event_type || CAST(user_id % 3 AS VARCHAR) AS name, arg_max('A' || CAST(event_id % 7 AS VARCHAR), event_id) AS activity FROM events GROUP BY 1")
def saga_resolver(spark, sf_dir):
    return saga.resolver(_registrations(spark, sf_dir))


def _registrations(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("name"), F.concat(F.lit("A"), (F.col("event_id") % 7).cast("string")).alias("activity"), F.col("event_id").alias("registered_no"))


@query("""SELECT activity, coalesce(name, activity) AS name, name IS NOT NULL AS registered FROM (SELECT DISTINCT 'A' || CAST(event_id % 9 AS VARCHAR) AS activity FROM events)
LEFT JOIN (SELECT 'A' || CAST(event_id % 7 AS VARCHAR) AS activity, arg_max(event_type || CAST(user_id % 3 AS VARCHAR), event_id) AS name FROM events GROUP BY 1) USING (activity)""")
def saga_wire_names(spark, sf_dir):
    known = _table(spark, sf_dir, "events").select(F.concat(F.lit("A"), (F.col("event_id") % 9).cast("string")).alias("activity")).distinct()
    return saga.wire_names(_registrations(spark, sf_dir), known)


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'expected JSON object for routing slip' WHEN 2 THEN 'missing field "arguments"' WHEN 3 THEN 'field "completedWorkLogs" is not an array' END AS error,
CASE WHEN event_id % 4 = 0 THEN event_type END AS first_log, CASE WHEN event_id % 4 = 0 THEN '{{}}' END AS arguments FROM events""")
def saga_parse_slip(spark, sf_dir):
    """Slips read from texts, with defaults for what is missing and an error for what is malformed."""
    log = F.concat(F.lit('{"activityTypeName":"'), "event_type", F.lit('","result":{"a":1}}'))
    good = F.concat(F.lit('{"completedWorkLogs":['), log, F.lit('],"nextWorkItems":[{"activityTypeName":"B","arguments":null}]}'))
    text = F.when(F.col("event_id") % 4 == 0, good).when(F.col("event_id") % 4 == 1, "[]").when(F.col("event_id") % 4 == 2, '{"nextWorkItems":[{"activityTypeName":"B"}]}').otherwise('{"completedWorkLogs":5}')
    rows = _table(spark, sf_dir, "events").select("event_id", saga.parse_slip(text).alias("p"))
    first = lambda items: F.get(F.col(f"p.slip.{items}"), 0)
    return rows.select("event_id", "p.error", first("completedWorkLogs")["activityTypeName"].alias("first_log"), first("nextWorkItems")["arguments"].alias("arguments"))


@query("""SELECT event_id AS saga_id, CASE WHEN event_type = 'error' THEN 'cannot deserialize work log 0: activity type not registered: error' ELSE 'cannot deserialize work item 1: activity type not registered: C' END AS error
FROM events WHERE event_type = 'error' OR event_id % 2 = 0""")
def saga_unreadable(spark, sf_dir):
    """Parsed slips of which a part names an activity that isn't registered."""
    log = F.concat(F.lit('{"activityTypeName":"'), "event_type", F.lit('","result":{}}'))
    items = F.when(F.col("event_id") % 2 == 0, '{"activityTypeName":"B","arguments":{}},{"activityTypeName":"C","arguments":{}}').otherwise('{"activityTypeName":"B","arguments":{}}')
    text = F.concat(F.lit('{"completedWorkLogs":['), log, F.lit('],"nextWorkItems":['), items, F.lit("]}"))
    events = _table(spark, sf_dir, "events")
    slips = events.select(F.col("event_id").alias("saga_id"), saga.parse_slip(text)["slip"].alias("slip"))
    known = events.where("event_type <> 'error'").select(F.col("event_type").alias("name")).distinct().union(spark.createDataFrame([("B",)], "name string"))
    return saga.unreadable(slips, known)


@query("SELECT user_id AS member, event_id, props AS payload FROM events")
def erasure_rotated(spark, sf_dir):
    """Payloads read after the key of keys was changed."""
    old, new = encryption.KeyOfKeys(bytes(range(32))), encryption.KeyOfKeys(bytes(range(1, 33)))
    events = _table(spark, sf_dir, "events")
    plain = events.select("user_id").distinct().select(F.col("user_id").alias("key_id"), F.unhex(F.sha2(F.col("user_id").cast("string"), 256)).alias("data_key"))
    keys = encryption.rotated(plain.select("key_id", encryption.wrapped(F.col("data_key"), old).alias("wrapped")), old, new)
    rows = events.join(plain, F.col("user_id") == F.col("key_id")).select("key_id", "event_id", encryption.encrypted(F.col("props"), F.col("data_key")).alias("payload"))
    return encryption.readable(rows, keys, new).select(F.col("key_id").alias("member"), "event_id", "payload")


@query("SELECT DISTINCT user_id AS member, CAST(1 AS INTEGER) AS keys_destroyed, CAST(1 AS INTEGER) AS aggregates_affected FROM events WHERE user_id % 5 = 0")
def erasure_counts(spark, sf_dir):
    """What each shredded member's erasure reports."""
    members = _table(spark, sf_dir, "events").select(F.col("user_id").alias("key_id")).distinct()
    gone = members.where("key_id % 5 = 0")
    kept, counts = encryption.shred_members(members, gone)
    return members.join(kept, "key_id", "left_anti").select(F.col("key_id").alias("member"), *[F.lit(n).alias(k) for k, n in counts.items()])
