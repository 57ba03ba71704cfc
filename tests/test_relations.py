import pytest
from pyspark.sql import functions as F

from tidemill.plans.relations import Catalog, ManyToMany, OneToMany, Row
from tidemill.sources.tables import load, save_bucketed

from .conftest import SF


@pytest.fixture(scope="module")
def fleet(spark):
    devices = spark.createDataFrame([(1, "android", True), (2, "ios", False), (3, "linux", None)], "id int, platform string, enrolled boolean")
    policies = spark.createDataFrame([(1, 1, "vpn", True), (2, 1, "wifi", False), (3, 2, "vpn", None)], "id int, device_id int, name string, enforced boolean")
    owners = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "device int, owner int")
    people = spark.createDataFrame([(10, "Ann"), (11, "Bo")], "pid int, person string")
    return Catalog(
        {"devices": devices, "policies": policies, "owners": owners, "people": people},
        {"devices": {"policies": OneToMany("policies", (("id", "device_id"),)), "owners": ManyToMany("owners", (("id", "device"),), (("owner", "pid"),), "people")}},
    )


def ids(found):
    return sorted(r["id"] for r in (found.rows if isinstance(found, Row) else found).collect())


def test_quantifiers(fleet):
    assert ids(fleet.exists("devices", "policies", F.col("name") == "vpn")) == [1, 2]
    assert ids(fleet.exists("devices", "policies", (F.col("name") == "vpn") & F.col("enforced"))) == [1]
    assert ids(fleet.exists("devices", "policies")) == [1, 2]
    # An unknown related row makes neither "some" true nor "all" false.
    assert ids(fleet.forall("devices", "policies", F.col("enforced"))) == [2, 3]
    assert ids(fleet.exists("devices", "owners", F.col("person") == "Bo")) == [1]
    assert ids(fleet.forall("devices", "owners", F.col("person") == "Ann")) == [2, 3]


def test_nested_and_marked(fleet):
    both = fleet.exists(fleet.exists("devices", "policies", F.col("name") == "vpn"), "owners", lambda people: fleet.where(people, F.col("person") == "Ann"))
    assert ids(both) == [1, 2]
    assert ids(fleet.forall("devices", "owners", lambda people: fleet.where(people, F.col("person") == "Ann"))) == [2, 3]
    marked = fleet.marked("devices", "policies", F.col("name") == "wifi", "wifi").rows
    assert {r["id"]: r["wifi"] for r in marked.collect()} == {1: True, 2: False, 3: False}


def test_paths(fleet):
    assert sorted((r["id"], r["policies_name"]) for r in fleet.along("devices", "policies").collect() if r["policies_name"]) == [(1, "vpn"), (1, "wifi"), (2, "vpn")]
    assert fleet.along("devices", "policies").count() == 4
    assert sorted((r["id"], r["owners_person"] or "") for r in fleet.along("devices", "owners").collect()) == [(1, "Ann"), (1, "Bo"), (2, "Ann"), (3, "")]


def test_declarations_are_checked(fleet, spark):
    with pytest.raises(ValueError, match="no relation"):
        fleet.exists("devices", "nothing")
    with pytest.raises(ValueError, match="no table"):
        fleet.rows("nothing")
    with pytest.raises(ValueError, match="no column"):
        Catalog(fleet.tables, {"devices": {"p": OneToMany("policies", (("id", "other"),))}})


def test_bucketed_tables_join_without_a_shuffle(spark):
    tables = load(spark, SF, ["customer", "orders"])
    catalog = Catalog({"customer": save_bucketed(tables["customer"], "customer_bucketed", ["c_custkey"], 4), "orders": save_bucketed(tables["orders"], "orders_bucketed", ["o_custkey"], 4)}, {"customer": {"orders": OneToMany("orders", (("c_custkey", "o_custkey"),))}})
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = catalog.exists("customer", "orders", F.col("o_totalprice") > 100_000).rows
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == tables["customer"].join(tables["orders"].where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
