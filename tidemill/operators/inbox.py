"""An inbox: messages stored once, and handed on in the order received as far as their causal dependencies are done.

A message's key is (tenant_id, stream_type, stream_id, stream_position), with stream_id as canonical JSON. A message
is eligible once all messages that it depends on are processed; those that wait are never dropped.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json_keys
from ..functions.partitions import belongs_to, by_uri, effective_worker
from ..sources.log_tables import LogTable, unit_of_work

KEY = ["tenant_id", "stream_type", "stream_id", "stream_position"]
MESSAGES = "tenant_id string, stream_type string, stream_id string, stream_position bigint, uri string, payload string, metadata string, event_id string, received_position bigint"
ACKS = "tenant_id string, stream_type string, stream_id string, stream_position bigint, processed_position bigint"


def first_arrivals(rows: DataFrame) -> DataFrame:
    """One row per key, the one received first: a minimum per key, with partial sums before the shuffle."""
    rest = [c for c in rows.columns if c not in KEY]
    first = rows.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "received_position").alias("__first"))
    return first.select(*KEY, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*rows.columns)


def event_id_conflicts(rows: DataFrame, event_id: Column | None = None) -> DataFrame:
    """(event_id, n_keys): event ids that messages with different keys carry."""
    named = rows.withColumn("event_id", json_keys.field(F.col("metadata"), "event_id") if event_id is None else event_id)
    return named.where("event_id is not null").groupBy("event_id").agg(F.count_distinct(*KEY).alias("n_keys")).where("n_keys > 1")


def dependency_edges(messages: DataFrame) -> DataFrame:
    """(key, needs_...): one row per dependency of a message, read from its metadata."""
    return messages.select(*KEY, F.explode(json_keys.dependencies(F.col("metadata"))).alias("d")).select(*KEY, *[F.col(f"d.{k}").alias(f"needs_{k}") for k in KEY])


def predecessor_edges(messages: DataFrame) -> DataFrame:
    """(key, needs_...): each message depends on the one before it in its stream."""
    return messages.where("stream_position > 1").select(*KEY, *[F.col(k).alias(f"needs_{k}") for k in KEY[:3]], (F.col("stream_position") - 1).alias("needs_stream_position"))


def unprocessed(messages: DataFrame, acks: DataFrame) -> DataFrame:
    return messages.join(acks.select(*KEY), KEY, "left_anti")


def eligible(messages: DataFrame, edges: DataFrame, acks: DataFrame) -> DataFrame:
    """Unprocessed messages all of whose dependencies are processed: two anti joins, whatever the depth of dependencies."""
    done = acks.select(*[F.col(k).alias(f"needs_{k}") for k in KEY])
    unmet = edges.join(done, [f"needs_{k}" for k in KEY], "left_anti").select(*KEY)
    return unprocessed(messages, acks).join(unmet, KEY, "left_anti")


def next_message(messages: DataFrame, edges: DataFrame, acks: DataFrame) -> DataFrame:
    """The eligible message received first, or no row; of those received at one position, the one with the least key."""
    return eligible(messages, edges, acks).orderBy("received_position", *KEY).limit(1)


def drain_order(messages: DataFrame) -> DataFrame:
    """messages with drain_key, in whose order (drain_key, stream_position) one worker takes them all, each depending on
    the one before it in its stream.

    A message comes after all before it in its stream, so its key is the largest received_position so far. Messages
    beyond a gap in their stream never become eligible and are left out.
    """
    stream = Window.partitionBy(*KEY[:3]).orderBy("stream_position")
    key = F.max("received_position").over(stream.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumns({"drain_key": key, "__n": F.row_number().over(stream)}).where("stream_position = __n").drop("__n")


def waves(messages: DataFrame, edges: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, wave): in which round each message becomes eligible, for dependencies of any shape; those that never do are left out.

    One round for each depth of dependencies. step writes a round's table and reads it back, so that plans stay short.
    """
    done, left, n = None, messages.select(*KEY), 0
    while True:
        acks = messages.limit(0).select(*KEY) if done is None else done
        ready = step(eligible(left, edges, acks).select(*KEY).withColumn("wave", F.lit(n).cast("bigint")))
        if not ready.limit(1).count():
            return ready if done is None else done
        done, n = ready if done is None else done.unionByName(ready), n + 1


def retained(messages: DataFrame, acks: DataFrame, older_than: int) -> DataFrame:
    """Messages that aren't processed, and those received after older_than."""
    done = acks.select(*KEY).withColumn("__done", F.lit(True))
    return messages.join(done, KEY, "left").where(F.col("__done").isNull() | (F.col("received_position") > older_than)).select(*messages.columns)


def lag(messages: DataFrame, acks: DataFrame) -> DataFrame:
    """(lag): how far the last processed position is behind the last received one."""
    received = messages.agg(F.max("received_position").alias("r"))
    done = acks.agg(F.coalesce(F.max("processed_position"), F.lit(0)).alias("p"))
    return received.join(F.broadcast(done)).select((F.col("r") - F.col("p")).alias("lag"))  # one row each


class Inbox:
    """Messages and acknowledgements in log tables under a folder; one sequence numbers receipts and acknowledgements."""

    def __init__(self, spark: SparkSession, path: str, key: Column | None = None):
        self.spark, self.path, self.key = spark, path, by_uri() if key is None else key
        self.messages = LogTable(spark, f"{path}/messages", MESSAGES)
        self.acks = LogTable(spark, f"{path}/acks", ACKS)

    def setup(self) -> Inbox:
        self.messages.setup()
        self.acks.setup()
        return self

    def cleanup(self) -> None:
        """Nothing to close."""

    def _last(self) -> int:
        last = self.messages.read().agg(F.max("received_position").alias("m")).head()["m"] or 0
        return max(last, self.acks.read().agg(F.max("processed_position").alias("m")).head()["m"] or 0)

    def publish(self, rows: DataFrame) -> None:
        """Stores messages whose key is new, in the order of the column arrival if there is one, those of one arrival by
        key. Repeats are ignored; an event id under another key is an error, and nothing is stored then."""
        canonical = rows.withColumn("stream_id", json_keys.canonical(F.col("stream_id")))
        order = F.col("arrival") if "arrival" in rows.columns else F.monotonically_increasing_id()
        start, stored = self._last(), self.messages.read()
        named = canonical.withColumns({"received_position": order, "event_id": json_keys.event_id(F.col("metadata"))})
        fresh = first_arrivals(named).join(stored.select(*KEY), KEY, "left_anti")
        # Numbers in order without one task for all rows: a number within each sorted part, after the parts before it.
        # The parts are written first, so that checking, counting and numbering see the same ones and work none out again.
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        try:
            fresh.orderBy("received_position", *KEY).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}).write.parquet(staged)
            parts = self.spark.read.parquet(staged)
            self._check_event_ids(parts, stored)
            counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
            before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n"))  # a row per part
            number = F.lit(start) + F.col("__before") + (F.col("__i") - F.shiftleft(F.col("__p").cast("bigint"), 33)) + 1
            self.messages.append(parts.join(F.broadcast(before), "__p").withColumn("received_position", number))
        finally:
            self.messages.delete(staged)

    def _check_event_ids(self, fresh: DataFrame, stored: DataFrame) -> None:
        """An error if an event id of new messages is that of another key."""
        # Only stored messages with one of these event ids matter, and of all of them only ids that stand in two rows.
        met = stored.select(*KEY, "event_id").join(fresh.select("event_id").distinct(), "event_id", "left_semi")
        both = met.unionByName(fresh.select(*KEY, "event_id"))
        repeated = both.where("event_id is not null").groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")
        if not repeated.isEmpty() and not event_id_conflicts(both.join(repeated, "event_id", "left_semi"), F.col("event_id")).isEmpty():
            raise ValueError("duplicate event_id under another key")

    def read(self) -> DataFrame:
        return self.messages.read().drop("commit_id")

    def eligible(self, worker: int = 0, workers: int = 1) -> DataFrame:
        messages = self.read()
        ready = eligible(messages, dependency_edges(messages), self.acks.read())
        return ready.where(belongs_to(self.key, worker, workers))

    def dispatch(self, handler: Callable[[Row], None], worker: int = 0, workers: int = 1) -> bool:
        """Hands the next message to handler and marks it as processed; False if none is eligible. An error leaves it first."""
        rows = self.eligible(worker, workers).orderBy("received_position", *KEY).limit(1).collect()
        if not rows:
            return False
        with unit_of_work(self.acks) as (n,):
            handler(rows[0])
            self.acks.write(n, self.spark.createDataFrame([(*[rows[0][k] for k in KEY], self._last() + 1)], ACKS))
        return True

    def dispatch_wave(self, handler: Callable[[DataFrame], None], worker: int = 0, workers: int = 1) -> bool:
        """Hands all eligible messages to handler at once and marks them as processed: one job for each depth of
        dependencies instead of one for each message. A wave can be read until its handler returns. Processed positions are
        those of the wave after all before it; waves of workers that run at the same time can have equal ones."""
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        try:
            # Written once: what is eligible isn't worked out again for the handler and the acknowledgements.
            self.eligible(worker, workers).write.parquet(staged)
            ready = self.spark.read.parquet(staged)
            if ready.isEmpty():
                return False
            start = self._last()
            with unit_of_work(self.acks) as (n,):
                handler(ready)
                self.acks.write(n, ready.withColumn("processed_position", F.col("received_position") + start))
            return True
        finally:
            self.messages.delete(staged)

    def drain(self, handler: Callable[[Row], None], stop: Callable[[], bool] = lambda: False, **options) -> int:
        n = 0
        while not stop() and self.dispatch(handler, **options):
            n += 1
        return n

    def drain_waves(self, handler: Callable[[DataFrame], None], stop: Callable[[], bool] = lambda: False, **options) -> int:
        """Dispatches waves until nothing is eligible or stop() says so, and returns how many."""
        n = 0
        while not stop() and self.dispatch_wave(handler, **options):
            n += 1
        return n

    def poll(self, handler: Callable[[DataFrame], None], interval: float = 1.0, stop: Callable[[], bool] = lambda: False, concurrency: int = 1, process: int = 0, processes: int = 1) -> None:
        """Hands on eligible messages, wave by wave, until stop() says so; with nothing eligible it looks again after interval
        seconds. Each of the concurrent workers takes the keys that belong to it, as do those of other processes. An error in
        a handler leaves its wave eligible; the other workers end their waves, and then it is raised."""
        broken = threading.Event()

        def work(local: int) -> None:
            worker, workers = effective_worker(process, concurrency, local, processes)
            while not (stop() or broken.is_set()):
                try:
                    idle = not self.dispatch_wave(handler, worker, workers)
                except BaseException:
                    broken.set()
                    raise
                if idle and not (stop() or broken.is_set()):
                    broken.wait(interval)

        with ThreadPoolExecutor(concurrency) as pool:
            for done in [pool.submit(work, k) for k in range(concurrency)]:
                done.result()

    def iterate(self, interval: float = 1.0, stop: Callable[[], bool] = lambda: False) -> Iterator[Row]:
        """Eligible message after message, in the order received; a message is acknowledged when the next one is asked for,
        and not if the iterator is closed before. With nothing eligible it waits, until stop() says so."""
        while not stop():
            row = self.eligible().orderBy("received_position", *KEY).limit(1).collect()
            if row:
                yield row[0]
                self._processed(row[0])
            elif not stop():
                time.sleep(interval)

    def _processed(self, row: Row) -> None:
        self.acks.append(self.spark.createDataFrame([(*[row[k] for k in KEY], self._last() + 1)], ACKS))

    def apply_retention(self, older_than: int) -> None:
        """Takes away messages received up to older_than that are processed; their acknowledgements stay, for those
        that depend on them."""
        self.messages.rewrite(lambda rows: retained(rows, self.acks.read(), older_than))
