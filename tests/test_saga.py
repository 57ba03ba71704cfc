import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemill.operators import saga

STEPS = "saga_id bigint, step_no bigint, activity string, ok boolean"


def steps(spark, *sagas):
    return spark.createDataFrame([(s, k + 1, f"A{k + 1}", ok) for s, oks in enumerate(sagas) for k, ok in enumerate(oks)], STEPS)


def test_outcomes(spark):
    t = steps(spark, [True, True, False], [False], [True, True], [True, False, True])
    got = {r["saga_id"]: (r["completed"], r["failed_activity"], r["n_done"], r["n_compensated"]) for r in saga.outcomes(t).collect()}
    assert got == {0: (False, "A3", 2, 2), 1: (False, "A1", 0, 0), 2: (True, None, 2, 0), 3: (False, "A2", 1, 1)}
    undone = sorted((r["saga_id"], r["compensation_no"], r["activity"]) for r in saga.compensations(t).collect())
    assert undone == [(0, 1, "A2"), (0, 2, "A1"), (3, 1, "A1")]
    sent = {(r["saga_id"], r["step_no"]): r["uri"] for r in saga.next_messages(t).collect()}
    assert sent == {(0, 1): "sb://./A2", (0, 2): "sb://./A3", (0, 3): "sb://./A2Compensation", (2, 1): "sb://./A2", (3, 1): "sb://./A2", (3, 2): "sb://./A1Compensation"}


def test_slips(spark):
    (r,) = saga.slips(steps(spark, [True, True, True]), 1).collect()
    assert (r["is_completed"], r["is_in_progress"], r["progress_uri"], r["compensation_uri"]) == (False, True, "sb://./A2", "sb://./A1Compensation")


def test_fallback(spark):
    rows = [(1, 1, 1, "a", False), (1, 2, 1, "b", True), (2, 1, 1, "a", True), (2, 1, 2, "b", False), (2, 2, 1, "c", False), (3, 1, 1, "a", True), (3, 2, 1, "b", True)]
    t = spark.createDataFrame(rows, "saga_id bigint, alt_no bigint, alt_step bigint, activity string, ok boolean")
    got = {r["saga_id"]: tuple(r)[1:] for r in saga.fallback(t).collect()}
    assert got == {1: (True, 2, 2, 0), 2: (False, None, 2, 1), 3: (True, 1, 1, 0)}


def test_parallel(spark):
    rows = [(1, 0, 1, "a", True), (1, 0, 2, "x", False), (1, 1, 1, "b", True), (2, 0, 1, "a", True), (2, 0, 2, "a", True), (2, 1, 1, "b", True)]
    t = spark.createDataFrame(rows, "saga_id bigint, branch_no bigint, step_no bigint, activity string, ok boolean")
    got = {r["saga_id"]: tuple(r)[1:] for r in saga.parallel(t).collect()}
    assert got == {1: (False, 2, 2, 2), 2: (True, 2, 3, 0)}


def brute_hosts(rows):
    pending, logs, out, forward = list(rows), [], [], True
    while True:
        if forward:
            if not pending:
                return out
            name, ok, undo = pending.pop(0)
            out.append(("forward", name, ok))
            if ok:
                logs.append((name, undo))
            elif not logs:
                return out
            forward = ok
        else:
            if not logs:
                return out
            name, undo = logs.pop()
            out.append(("backward", name, undo))
            forward = not undo


def test_hosts_with_refusals(spark):
    rng = random.Random(2)
    sagas = {s: [(f"A{k}", rng.random() < 0.7, rng.random() < 0.7) for k in range(rng.randint(1, 6))] for s in range(25)}
    t = spark.createDataFrame([(s, k, n, ok, undo) for s, rows in sagas.items() for k, (n, ok, undo) in enumerate(rows)], "saga_id bigint, step_no bigint, activity string, ok boolean, undo_ok boolean")
    got = {}
    for r in saga.run_hosts(t).orderBy("saga_id", "delivery").collect():
        got.setdefault(r["saga_id"], []).append((r["direction"], r["activity"], r["result"]))
    assert got == {s: brute_hosts(rows) for s, rows in sagas.items()}


def test_hosts_of_a_long_workflow(spark):
    rows = [(f"A{k}", k < 5999, True) for k in range(6000)]
    t = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "saga_id bigint, step_no bigint, activity string, ok boolean, undo_ok boolean")
    got = [(r["direction"], r["activity"], r["result"]) for r in saga.run_hosts(t).orderBy("delivery").collect()]
    assert len(got) == 11_999 and got == brute_hosts(rows)


def test_addresses_and_names(spark):
    known = spark.createDataFrame([("A",), ("B",)], "activity string")
    sent = spark.createDataFrame([("sb://./A",), ("sb://./BCompensation",), ("sb://./C",)], "uri string")
    assert {(r["uri"], r["activity"], r["direction"]) for r in saga.deliveries(sent, known).collect()} == {("sb://./A", "A", "forward"), ("sb://./BCompensation", "B", "backward")}
    names = spark.createDataFrame([("car", "A", 1), ("car", "B", 2)], "name string, activity string, registered_no int")
    assert [tuple(r) for r in saga.resolver(names).collect()] == [("car", "B")]
    assert {tuple(r) for r in saga.wire_names(names, known).collect()} == {("A", "car", True), ("B", "car", True)}
    assert [tuple(r) for r in saga.wire_names(names.limit(0), known.limit(1)).collect()] == [("A", "A", False)]
    with pytest.raises(PySparkException):
        saga.resolver(names.withColumn("name", F.lit(""))).collect()


def test_work_of_activities(spark):
    t = spark.createDataFrame([(1, 1, "A", 3), (1, 2, "B", 4), (2, 1, "B", None)], "saga_id bigint, step_no bigint, activity string, arguments int")
    work = {"A": (lambda x: x > 2, lambda x: x > 5), "B": (lambda x: x < 0, lambda x: F.lit(True))}
    assert {(r["saga_id"], r["step_no"]): (r["ok"], r["undo_ok"]) for r in saga.performed(t, work).collect()} == {(1, 1): (True, False), (1, 2): (False, True), (2, 1): (False, True)}
    with pytest.raises(PySparkException):
        saga.performed(t, {"A": work["A"]}).collect()


def test_indexed_wire_errors(spark):
    """The first part that has no name or no activity, logs before items."""
    names = spark.createDataFrame([(1, "work item", 0, ""), (1, "work log", 1, ""), (1, "work log", 0, "A"), (2, "work item", 2, ""), (3, "work item", 0, "A")], "saga_id bigint, part string, position int, activity string")
    resolver = spark.createDataFrame([("A", "car", True)], "activity string, name string, registered boolean")
    assert {tuple(r) for r in saga.unserializable(names, resolver).collect()} == {(1, "cannot serialize work log 1: activity type not registered"), (2, "cannot serialize work item 2: activity type not registered")}
    text = '{"completedWorkLogs":[{"activityTypeName":"car","result":{}},{"activityTypeName":"van","result":{}}],"nextWorkItems":[{"activityTypeName":"bus","arguments":{}}]}'
    slips = spark.createDataFrame([(1, text), (2, text.replace("van", "car")), (3, "{}")], "saga_id bigint, t string").select("saga_id", saga.parse_slip(F.col("t"))["slip"].alias("slip"))
    known = spark.createDataFrame([("car",)], "name string")
    assert {tuple(r) for r in saga.unreadable(slips, known).collect()} == {(1, "cannot deserialize work log 1: activity type not registered: van"), (2, "cannot deserialize work item 0: activity type not registered: bus")}


def test_fold(spark):
    t = spark.createDataFrame([(1, 2, 5), (1, 1, 3), (2, 1, 4)], "k int, v int, p int")
    got = {r["k"]: r["state"] for r in saga.folded(t, "k", "v", F.lit(1), lambda s, p: s * 10 + p, "p").collect()}
    assert got == {1: 135, 2: 14}


def test_wire_form(spark):
    kind = "array<struct<activity: string, entries: array<struct<key: string, value: string>>>>"
    t = spark.createDataFrame([([("Car", [("id", "7"), ("b", '{"x":1}')])], [("Ho\"tel", [("z", '"y"'), ("a", None)])])], f"logs {kind}, items {kind}")
    text = t.select(saga.slip_json(F.col("logs"), F.col("items")).alias("j")).head()["j"]
    assert text == '{"completedWorkLogs":[{"activityTypeName":"Car","result":{"id":7,"b":{"x":1}}}],"nextWorkItems":[{"activityTypeName":"Ho\\"tel","arguments":{"z":"y","a":null}}]}'
    cases = {
        text: None,
        "{}": None,
        '{"nextWorkItems": null}': None,
        '{"nextWorkItems": [{"activityTypeName": "A", "arguments": null}]}': None,
        '{"nextWorkItems": [{"activityTypeName": "A"}]}': 'missing field "arguments"',
        '{"completedWorkLogs": [{"result": {}}]}': 'missing field "activityTypeName"',
        '{"nextWorkItems": 5}': 'field "nextWorkItems" is not an array',
        "[]": "expected JSON object for routing slip",
        "{": "malformed JSON",
    }
    t = spark.createDataFrame([(c,) for c in cases], "j string").select("j", saga.parse_slip(F.col("j")).alias("p"))
    got = {r["j"]: r["p"] for r in t.collect()}
    assert {k: p["error"] for k, p in got.items()} == cases
    slip = got[text]["slip"]
    assert json.loads(slip["nextWorkItems"][0]["arguments"]) == {"z": "y", "a": None} and slip["nextWorkItems"][0]["activityTypeName"] == 'Ho"tel'
    assert got["{}"]["slip"]["nextWorkItems"] == [] and got['{"nextWorkItems": [{"activityTypeName": "A", "arguments": null}]}']["slip"]["nextWorkItems"][0]["arguments"] == "{}"
