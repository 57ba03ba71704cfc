import random
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemill.functions.partitions import by_stream
from tidemill.operators import inbox as i
from tidemill.operators import outbox as o
from tidemill.sources.log_tables import LogTable, latest, unit_of_work
from tidemill.streaming import logs


def uuid(n):
    return f"550e8400-e29b-41d4-a716-{n:012d}"


def messages(spark, *rows):
    return spark.createDataFrame([(u, '{"order": %d}' % n, '{"event_id": "%s"}' % uuid(n)) for u, n in rows], "uri string, payload string, metadata string")


def publish(box, rows):
    with unit_of_work(box.messages) as (n,):
        box.publish(n, rows)


def test_log_table(spark, tmp_path):
    t = LogTable(spark, f"{tmp_path}/t", "k string, v int").setup()
    assert t.setup().read().count() == 0
    t.append(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    t.append(spark.createDataFrame([("a", 0)], "k string, v int"))
    assert {tuple(r) for r in latest(t.read(), ["k"]).select("k", "v").collect()} == {("a", 0), ("b", 2)}
    first = t.begin()
    t.append(spark.createDataFrame([("c", 3)], "k string, v int"))
    assert t.read().count() == 3  # an open commit holds back the later one
    t.write(first, spark.createDataFrame([("d", 4)], "k string, v int"))
    t.commit(first)
    assert t.read().count() == 5
    with pytest.raises(RuntimeError), unit_of_work(t) as (n,):
        t.write(n, spark.createDataFrame([("e", 5)], "k string, v int"))
        raise RuntimeError
    assert t.read().count() == 5
    t.rewrite(lambda rows: rows.where("v > 1"))
    assert sorted(r["k"] for r in t.read().collect()) == ["b", "c", "d"]
    t.cleanup()


def test_numeric_transaction_order(spark):
    rows = spark.createDataFrame([(1, "99"), (2, "100"), (3, "18446744073709551615")], "position bigint, tx string").select("position", o.txid(F.col("tx")).alias("transaction_id"), F.lit("u").alias("uri"))
    assert [r["position"] for r in o.batch(o.pending(rows)).collect()] == [1, 2, 3]
    assert [r["position"] for r in o.batch(o.pending(rows, (99, 1))).collect()] == [2, 3]
    assert [r["position"] for r in o.pending(rows, horizon=100).collect()] == [1]


def test_outbox(spark, tmp_path):
    box = o.Outbox(spark, f"{tmp_path}/box", batch_size=2).setup()
    publish(box, messages(spark, ("kafka://orders", 1), ("kafka://orders/eu", 2), ("kafka://users", 3)))
    assert box.get_position("g") == (Decimal(0), 0)
    got = []
    handler = lambda rows: got.extend(r["payload"] for r in rows.collect())
    assert box.drain(handler, group="g") == 2 and len(got) == 3
    assert not box.dispatch(handler, group="g")
    other = []
    assert box.drain(lambda rows: other.extend(r["uri"] for r in rows.collect()), group="h", uri="kafka://orders") == 1
    assert sorted(other) == ["kafka://orders", "kafka://orders/eu"]
    box.set_position(Decimal(0), 0, "g")
    assert box.drain(handler, group="g") == 2 and len(got) == 6  # a position can go back


def test_drain_reads_the_log_once_for_many_batches(spark, tmp_path, monkeypatch):
    """Batches are whole and in order, also where they share folders; what comes meanwhile and positions that others write count."""
    monkeypatch.setattr(o, "FOLDERS", 3)
    box = o.Outbox(spark, f"{tmp_path}/box", batch_size=2).setup()
    for n in (0, 10):
        publish(box, messages(spark, *[("u/x" if k % 2 else "u", n + k) for k in range(10)]).repartition(3))
    reads, whole = [], o.Outbox.read
    monkeypatch.setattr(o.Outbox, "read", lambda self: reads.append(1) or whole(self))
    got = []

    def handler(rows):
        got.append([(r["transaction_id"], r["position"]) for r in rows.collect()])
        if len(got) == 3:
            publish(box, messages(spark, ("u", 20)))

    assert box.drain(handler, group="g", uri="u") == 11 and len(reads) == 3
    assert [len(b) for b in got] == [2] * 10 + [1]
    assert sum(got, []) == sorted(tuple(r) for r in whole(box).select("transaction_id", "position").collect())
    other, taken = o.Outbox(spark, f"{tmp_path}/box").setup(), []

    def back():
        if len(taken) == 4:
            other.set_position(*o.START, "h")
        return len(taken) == 6

    assert box.drain(lambda rows: taken.append([(r["transaction_id"], r["position"]) for r in rows.collect()]), back, group="h") == 6
    assert taken == got[:4] + got[:2]
    assert not list((tmp_path / "box/staged").iterdir())


def test_outbox_errors_and_visibility(spark, tmp_path):
    box = o.Outbox(spark, f"{tmp_path}/box").setup()
    publish(box, messages(spark, ("u", 1)))
    with pytest.raises(ValueError, match="duplicate"):
        publish(box, messages(spark, ("u", 1)))
    with pytest.raises(ValueError, match="UUID"):
        publish(box, messages(spark, ("u", 5)).withColumn("metadata", F.lit("{}")))
    assert box.read().count() == 1
    open_ = box.messages.begin()
    publish(box, messages(spark, ("u", 2)))
    assert box.fetch("g").count() == 1
    box.publish(open_, messages(spark, ("u", 3)))
    box.messages.commit(open_)
    assert box.fetch("g").count() == 3

    def fail(rows):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        box.dispatch(fail, group="g")
    assert box.get_position("g") == (Decimal(0), 0)
    seen = []
    for row in box.iterate("it"):
        seen.append(row["position"])
        if len(seen) == 2:
            break
    rest = list(box.iterate("it"))
    assert len(rest) == 2  # the message in hand when the loop broke off comes again


def test_outbox_workers_and_retention(spark, tmp_path):
    box = o.Outbox(spark, f"{tmp_path}/box").setup()
    publish(box, messages(spark, *[(f"u{n}", n) for n in range(10)]))
    taken = []
    for w in range(3):
        box.drain(lambda rows: taken.extend(r["uri"] for r in rows.collect()), group="g", worker=w, workers=3)
    assert sorted(taken) == sorted(f"u{n}" for n in range(10))
    box.apply_retention()
    assert box.read().count() < 10
    bad = spark.createDataFrame([("{", "x")], "payload string, metadata string")
    assert tuple(o.readable_rows(bad).head()) == ("{}", "{}")


def test_publish_reads_one_column(spark, tmp_path):
    box = o.Outbox(spark, f"{tmp_path}/box").setup()
    publish(box, messages(spark, ("u", 1)))
    fresh = spark.createDataFrame([(uuid(1),), (uuid(2),)], "event_id string")
    plan = box.known(fresh)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:string>" in plan
    assert [r["event_id"] for r in box.known(fresh).collect()] == [uuid(1)]


def test_a_rewrite_that_dies(spark, tmp_path):
    """Whatever step a rewrite ends at, readers see all rows or what it leaves, and a later one goes on."""
    for step in ("write", "_replace", "commit"):
        t = LogTable(spark, f"{tmp_path}/{step}", "k string").setup()
        t.append(spark.createDataFrame([("a",), ("b",)], "k string"))
        broken = LogTable(spark, t.path, "k string")

        def die(*_):
            raise RuntimeError

        setattr(broken, step, die)
        with pytest.raises(RuntimeError):
            broken.rewrite(lambda rows: rows.where("k > 'a'"))
        assert sorted(r["k"] for r in t.read().collect()) == ["a", "b"], step
    # Between the commit and the clean-up nothing counts twice.
    n = t.begin()
    t.write(n, spark.createDataFrame([("c",)], "k string"))
    t._replace(n, t._settled())
    for m in [m for m in t._numbers("open") if m != n]:
        t.rollback(m)
    t.commit(n)
    assert [r["k"] for r in t.read().collect()] == ["c"]


def test_numbers_belong_to_one_writer(spark, tmp_path):
    t = LogTable(spark, f"{tmp_path}/t", "k string").setup()
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: t.begin(), range(40)))
    assert len(set(numbers)) == 40


def message(stream, position, event, needs=()):
    deps = ", ".join('{"tenant_id": "t", "stream_type": "%s", "stream_id": {"id": 1}, "stream_position": %d}' % n for n in needs)
    return ("t", stream, '{ "id": 1}', position, "u", "{}", '{"event_id": "%s", "causal_dependencies": [%s]}' % (uuid(event), deps))


INBOX = "tenant_id string, stream_type string, stream_id string, stream_position bigint, uri string, payload string, metadata string"


def test_inbox(spark, tmp_path):
    box = i.Inbox(spark, f"{tmp_path}/in").setup()
    put = lambda *rows: box.publish(spark.createDataFrame(list(rows), INBOX))
    put(message("Order", 2, 2, [("Order", 1)]))
    put(message("Order", 2, 2, [("Order", 1)]))
    assert box.read().count() == 1
    got = []
    handler = lambda r: got.append((r["stream_type"], r["stream_position"]))
    assert not box.dispatch(handler)
    put(message("Order", 1, 1), message("User", 1, 3, [("Order", 2)]))
    with pytest.raises(ValueError, match="event_id"):
        put(message("Other", 9, 1))
    assert box.drain(handler) == 3
    assert got == [("Order", 1), ("Order", 2), ("User", 1)]
    box.apply_retention(10**9)
    assert box.read().count() == 0


def test_next_message_of_equal_positions(spark):
    """Of messages received at one position the least key is next, in whatever order the rows come."""
    rows = [("t", s, "{}", 1, 7) for s in ("C", "A", "B")]
    schema = "tenant_id string, stream_type string, stream_id string, stream_position bigint, received_position bigint"
    for given in (rows, rows[::-1], rows[1:] + rows[:1]):
        table = spark.createDataFrame(given, schema).coalesce(1)
        assert [r["stream_type"] for r in i.next_message(table, i.predecessor_edges(table), table.limit(0)).collect()] == ["A"]


def test_inbox_numbers_of_equal_arrivals(spark, tmp_path):
    """Messages of one arrival are numbered by key, however many tasks they come from."""
    rows = [(*message(f"S{n:02}", 1, n), n // 20) for n in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    box = i.Inbox(spark, f"{tmp_path}/in").setup()
    box.publish(spark.createDataFrame(rows[::-1], f"{INBOX}, arrival int"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["stream_type"] for r in box.read().orderBy("received_position").collect()] == [r[1] for r in rows]


def test_inbox_failure_and_waves(spark, tmp_path):
    box = i.Inbox(spark, f"{tmp_path}/in").setup()
    box.publish(spark.createDataFrame([message("A", 1, 1), message("B", 1, 2), message("A", 2, 3, [("A", 1), ("B", 1)])], INBOX))

    def fail(r):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        box.dispatch(fail)
    assert box.acks.read().count() == 0
    waves = []
    while box.dispatch_wave(lambda rows: waves.append(rows.count())):
        pass
    assert waves == [2, 1]
    assert sorted(box.eligible(w, 2).count() for w in range(2)) == [0, 0]


def test_inbox_works_nothing_out_twice(spark, tmp_path):
    """What is published is evaluated once, and a wave is a table that was written, not a plan."""
    box, seen = i.Inbox(spark, f"{tmp_path}/in").setup(), spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([message("A", n, n, [("A", n - 1)] if n % 2 == 0 else []) for n in range(1, 21)], INBOX).withColumn("metadata", F.udf(counted)("metadata"))
    box.publish(rows)
    assert seen.value == 20
    plans, sizes = [], []

    def handler(wave):
        plans.append(wave._jdf.queryExecution().optimizedPlan().toString())
        sizes.append(wave.count())

    assert box.drain_waves(handler) == 2 and sizes == [10, 10]
    assert not [p for p in plans if "Join" in p]
    assert not list((tmp_path / "in/staged").iterdir())


def test_inbox_iterator(spark, tmp_path):
    """A message is acknowledged when the next one is asked for; an iterator that is closed leaves the one in hand."""
    box = i.Inbox(spark, f"{tmp_path}/in").setup()
    box.publish(spark.createDataFrame([message("A", 1, 1), message("A", 2, 2, [("A", 1)]), message("A", 3, 3, [("A", 2)])], INBOX))
    rows = box.iterate()
    assert [next(rows)["stream_position"], next(rows)["stream_position"]] == [1, 2]
    assert box.acks.read().count() == 1
    rows.close()
    seen = []
    for r in box.iterate(interval=0.01, stop=lambda: len(seen) == 2):
        seen.append(r["stream_position"])
    assert seen == [2, 3] and box.acks.read().count() == 3


def test_inbox_workers_poll(spark, tmp_path):
    """Concurrent workers take every message once, each stream in order, until they are stopped; an error ends them."""
    box = i.Inbox(spark, f"{tmp_path}/in", by_stream()).setup()
    rows = [message(f"S{s}", p, 10 * s + p, [(f"S{s}", p - 1)] if p > 1 else []) for s in range(4) for p in (1, 2)]
    box.publish(spark.createDataFrame(rows, INBOX))
    taken = []
    box.poll(lambda wave: taken.extend((r["stream_type"], r["stream_position"]) for r in wave.collect()), interval=0.05, stop=lambda: len(taken) >= 8, concurrency=3)
    assert sorted(taken) == sorted((f"S{s}", p) for s in range(4) for p in (1, 2))
    assert all(taken.index((f"S{s}", 1)) < taken.index((f"S{s}", 2)) for s in range(4))
    assert box.acks.read().count() == 8
    box.publish(spark.createDataFrame([message("S9", 1, 99)], INBOX))

    def fail(wave):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        box.poll(fail, interval=0.05, concurrency=2)
    assert box.eligible().count() == 1


def test_waves(spark):
    rows = [message("A", 1, 1), message("B", 1, 2), message("A", 2, 3, [("A", 1), ("B", 1)]), message("C", 1, 4, [("A", 2)]), message("D", 1, 5, [("E", 1)])]
    table = spark.createDataFrame(rows, INBOX).withColumn("stream_id", F.lit('{"id":1}'))
    found = i.waves(table, i.dependency_edges(table), lambda t: t.checkpoint())
    assert {(r["stream_type"], r["stream_position"]): r["wave"] for r in found.collect()} == {("A", 1): 0, ("B", 1): 0, ("A", 2): 1, ("C", 1): 2}


def test_drain_order_against_a_worker(spark):
    rng = random.Random(1)
    rows = [("t", f"s{s}", "{}", p, r) for r, (s, p) in enumerate(sorted(((s, p) for s in range(6) for p in range(1, 12) if rng.random() < 0.9), key=lambda _: rng.random()))]
    table = spark.createDataFrame(rows, "tenant_id string, stream_type string, stream_id string, stream_position bigint, received_position bigint")
    mine = [(r["stream_type"], r["stream_position"]) for r in i.drain_order(table).orderBy("drain_key", "stream_position").collect()]
    waiting, done, taken = sorted(rows, key=lambda r: r[4]), set(), []
    while ready := [r for r in waiting if r[3] == 1 or (r[1], r[3] - 1) in done]:
        waiting.remove(ready[0])
        done.add((ready[0][1], ready[0][3]))
        taken.append((ready[0][1], ready[0][3]))
    assert mine == taken


def test_streams(spark, tmp_path):
    where, schema = f"{tmp_path}/messages", "transaction_id decimal(20,0), position bigint, uri string"
    got = []
    handler = lambda rows, n: got.extend((r["transaction_id"], r["position"]) for r in rows.collect())
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).select((F.lit(100) - F.col("id")).cast("decimal(20,0)").alias("transaction_id"), "id", F.lit("u/x").alias("uri")).withColumnRenamed("id", "position").coalesce(1).write.mode("append").parquet(where)
        query = logs.dispatched(logs.message_stream(spark, where, schema), handler, f"{tmp_path}/check", uri="u").start()
        query.awaitTermination()
    assert len(got) == 20 and len(set(got)) == 20  # the second start goes on where the first ended
    assert got[:10] == sorted(got[:10])


def test_stream_workers(spark, tmp_path):
    where, schema = f"{tmp_path}/messages", "transaction_id decimal(20,0), position bigint, uri string"
    spark.range(40).select(F.lit(1).cast("decimal(20,0)").alias("transaction_id"), "id", F.concat(F.lit("u"), "id").alias("uri")).withColumnRenamed("id", "position").write.parquet(where)
    got = []
    for w in range(3):
        logs.dispatched(logs.message_stream(spark, where, schema), lambda rows, n: got.extend(r["position"] for r in rows.collect()), f"{tmp_path}/check{w}", worker=w, workers=3).start().awaitTermination()
    assert sorted(got) == list(range(40))


def test_streams_wait_for_gaps(spark, tmp_path):
    where, schema = f"{tmp_path}/in", "tenant_id string, stream_type string, stream_id string, stream_position bigint, uri string, payload string"
    out = []
    for k, positions in enumerate([[2, 4, 2], [1], [3, 1]]):
        spark.createDataFrame([("t", "s", "1", p, "u", "{}") for p in positions], schema).coalesce(1).write.mode("append").parquet(where)
        ordered = logs.in_stream_order(logs.message_stream(spark, where, schema))
        query = ordered.writeStream.foreachBatch(lambda rows, n, k=k: out.extend((k, r["stream_position"]) for r in rows.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    assert out == [(1, 1), (1, 2), (2, 3), (2, 4)]
    first = logs.first_deliveries(logs.message_stream(spark, where, schema)).writeStream.format("memory").queryName("first_deliveries").trigger(availableNow=True).start()
    first.awaitTermination()
    assert spark.table("first_deliveries").count() == 4
