"""An outbox: messages read in the order (transaction, position), by consumer groups that keep their own positions.

Transaction ids are DECIMAL(20,0), which holds unsigned 64-bit numbers and orders them as numbers. The functions work on
any DataFrame with the columns position, transaction_id and uri; Outbox keeps messages and positions in log tables.
Delivery is at least once: a batch's position is written after its handler has run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json_keys
from ..functions.partitions import belongs_to, group_of_worker
from ..sources.log_tables import LogTable, latest

MESSAGES = "position bigint, transaction_id decimal(20,0), uri string, payload string, metadata string, event_id string, created_at timestamp"
OFFSETS = "consumer_group string, uri string, offset_acked bigint, last_processed_transaction_id decimal(20,0), updated_at timestamp"
BATCH = 100
FOLDERS = 1000  # at most so many folders for the batches of a round of drain
START = (Decimal(0), 0)


def txid(c: Column | int | str | Decimal) -> Column:
    return (c if isinstance(c, Column) else F.lit(str(c))).cast("decimal(20,0)")


def after(transaction_id: Decimal | int | str, position: int) -> Column:
    """Messages strictly after a place; plain comparisons, so that the scan can skip row groups."""
    return (F.col("transaction_id") > txid(transaction_id)) | ((F.col("transaction_id") == txid(transaction_id)) & (F.col("position") > position))


def committed_below(horizon: Decimal | int | str) -> Column:
    """Messages of transactions below the oldest open one."""
    return F.col("transaction_id") < txid(horizon)


def addressed(uri: str) -> Column:
    """Messages to an address or below it; the empty address takes all."""
    return F.lit(True) if not uri else (F.col("uri") == uri) | F.col("uri").startswith(f"{uri}/")


def pending(messages: DataFrame, place: tuple = START, horizon=None, uri: str = "", worker: int = 0, workers: int = 1) -> DataFrame:
    """The messages that a consumer at a place has yet to read."""
    out = messages.where(after(*place)).where(addressed(uri))
    if horizon is not None:
        out = out.where(committed_below(horizon))
    return out.where(belongs_to(F.col("uri"), worker, workers)) if workers > 1 else out


def batch(messages: DataFrame, size: int = BATCH) -> DataFrame:
    """The first messages in order."""
    return messages.orderBy("transaction_id", "position").limit(size)


def positions(offsets: DataFrame, order: str = "commit_id") -> DataFrame:
    """The current position of each group and address: the last one written, which may be an earlier place."""
    return latest(offsets, ["consumer_group", "uri"], order)


def readable_rows(messages: DataFrame) -> DataFrame:
    """Payload and metadata as canonical JSON; malformed texts become {}."""
    return messages.withColumns({c: json_keys.payload_or(F.col(c), "{}") for c in ("payload", "metadata")})


def consumed_everywhere(messages: DataFrame, current: DataFrame) -> DataFrame:
    """Messages below every group's position, both numbers taken as their least over the groups: a filter that the scan sees."""
    floor = current.agg(F.min("last_processed_transaction_id").alias("tx"), F.min("offset_acked").alias("pos")).head()
    return messages.limit(0) if floor["tx"] is None else messages.where(~after(floor["tx"], floor["pos"]))


def duplicate_events(messages: DataFrame) -> DataFrame:
    """(event_id, n): event ids that several messages carry."""
    return messages.withColumn("event_id", json_keys.event_id(F.col("metadata"))).where("event_id is not null").groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")


class Outbox:
    """Messages and positions in log tables under a folder. A message's transaction is its commit."""

    def __init__(self, spark: SparkSession, path: str, batch_size: int = BATCH):
        self.spark, self.path, self.batch_size = spark, path, batch_size
        self.messages = LogTable(spark, f"{path}/messages", MESSAGES)
        self.offsets = LogTable(spark, f"{path}/offsets", OFFSETS)

    def setup(self) -> Outbox:
        self.messages.setup()
        self.offsets.setup()
        return self

    def cleanup(self) -> None:
        """Nothing to close."""

    def publish(self, n: int, rows: DataFrame) -> None:
        """Adds messages (uri, payload, metadata) to an open commit of self.messages, whose number is their transaction.

        An event id that is no UUID, or that a message has already, is an error. Of the stored messages one column is read.
        """
        rows = rows.withColumn("event_id", json_keys.event_id(F.col("metadata")))
        ids = rows.groupBy("event_id").agg(F.count("*").alias("n"))
        found = ids.agg(F.bool_or(~json_keys.valid_uuid(F.col("event_id"))).alias("bad"), F.max("n").alias("n")).head()
        if found["bad"]:
            raise ValueError("event_id is not a UUID")
        if (found["n"] or 0) > 1 or not self.known(ids).isEmpty():
            raise ValueError("duplicate event_id")
        place = F.monotonically_increasing_id() + 1
        when = F.col("created_at") if "created_at" in rows.columns else F.current_timestamp()
        self.messages.write(n, rows.withColumns({"position": place, "transaction_id": F.lit(n), "created_at": when}))

    def known(self, ids: DataFrame) -> DataFrame:
        """(event_id): those of ids that a message has."""
        return self.messages.read().select("event_id").join(ids.select("event_id"), "event_id", "left_semi")

    def read(self) -> DataFrame:
        return self.messages.read()

    def get_position(self, group: str = "", uri: str = "") -> tuple[Decimal, int]:
        """(transaction, position) of a group, ("0", 0) for one that is unknown."""
        rows = positions(self.offsets.read()).where((F.col("consumer_group") == group) & (F.col("uri") == uri)).collect()
        return (rows[0]["last_processed_transaction_id"], rows[0]["offset_acked"]) if rows else START

    def set_position(self, transaction_id, position: int, group: str = "", uri: str = "") -> int:
        """Writes a group's position, whatever it was before, and returns the commit's number."""
        row = self.spark.range(1).select(F.lit(group).alias("consumer_group"), F.lit(uri).alias("uri"), F.lit(position).alias("offset_acked"), txid(transaction_id).alias("last_processed_transaction_id"), F.current_timestamp().alias("updated_at"))
        return self.offsets.append(row)

    def ensure_group(self, group: str, uri: str = "") -> None:
        """Starts a group that is unknown at the beginning."""
        if not self.offsets.read().where((F.col("consumer_group") == group) & (F.col("uri") == uri)).limit(1).count():
            self.set_position(*START, group, uri)

    def fetch(self, group: str = "", uri: str = "", worker: int = 0, workers: int = 1) -> DataFrame:
        group = group_of_worker(group, worker, workers)
        return batch(pending(self.read(), self.get_position(group, uri), self.messages.horizon(), uri, worker, workers), self.batch_size)

    def dispatch(self, handler: Callable[[DataFrame], None], group: str = "", uri: str = "", worker: int = 0, workers: int = 1) -> bool:
        """Hands the next batch to handler and then moves the group on; False if there is none. An error leaves the position."""
        own = group_of_worker(group, worker, workers)
        self.ensure_group(own, uri)
        rows = self.fetch(group, uri, worker, workers)
        last = rows.agg(F.max(F.struct("transaction_id", "position")).alias("m")).head()["m"]
        if last is None:
            return False
        handler(rows)
        self.set_position(last["transaction_id"], last["position"], own, uri)
        return True

    def drain(self, handler: Callable[[DataFrame], None], stop: Callable[[], bool] = lambda: False, group: str = "", uri: str = "", worker: int = 0, workers: int = 1) -> int:
        """Dispatches until nothing is left or stop() says so, and returns the number of batches.

        What is pending is sorted and cut into batches once for all of them, and then again for what has come meanwhile, so
        that the log isn't read for each batch. A batch can be read until its handler returns. A position that someone else
        writes counts from the next batch on.
        """
        own, n, stopped = group_of_worker(group, worker, workers), 0, stop()
        while not stopped:
            self.ensure_group(own, uri)
            rows = pending(self.read(), self.get_position(own, uri), self.messages.horizon(), uri, worker, workers)
            staged, before = f"{self.path}/staged/{uuid.uuid4().hex}", n
            try:
                for part, last in self._cut(rows, staged):
                    handler(part)
                    written = self.set_position(last["transaction_id"], last["position"], own, uri)
                    n, stopped = n + 1, stop()
                    if stopped or self._moved(written, own, uri):
                        break
            finally:
                self.messages.delete(staged)
            if n == before:
                break
        return n

    def _moved(self, written: int, group: str, uri: str) -> bool:
        """Whether a group has a position written after a commit."""
        return self.offsets.settled_after(written) and not self.offsets.read(written).where((F.col("consumer_group") == group) & (F.col("uri") == uri)).isEmpty()

    def _cut(self, rows: DataFrame, staged: str) -> Iterator[tuple[DataFrame, Row]]:
        """Batch after batch of rows in order, each with its last place. Every batch is in one folder, which others may share
        where there are more batches than folders."""
        # Numbers in order without one task for all rows: a number within each sorted part, after the parts before it.
        # The parts are written first, so that counting and numbering see the same ones.
        rows.orderBy("transaction_id", "position").withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}).write.parquet(f"{staged}/sorted")
        parts = self.spark.read.parquet(f"{staged}/sorted")
        counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
        before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n"))  # a row per part
        number = F.col("__before") + (F.col("__i") - F.shiftleft(F.col("__p").cast("bigint"), 33))
        total = counts.agg(F.sum("__n").alias("n")).head()["n"]
        if not total:
            return
        shared = -(-total // (self.batch_size * FOLDERS))
        numbered = parts.join(F.broadcast(before), "__p").withColumn("__batch", F.floor(number / self.batch_size))
        numbered.drop("__p", "__i", "__before").withColumn("__folder", F.floor(F.col("__batch") / shared)).write.partitionBy("__folder").parquet(f"{staged}/batches")
        schema = self.spark.read.parquet(f"{staged}/batches").drop("__folder").schema
        for k in range(-(-total // self.batch_size)):
            part = self.spark.read.schema(schema).parquet(f"{staged}/batches/__folder={k // shared}").where(F.col("__batch") == k).drop("__batch")
            last = part.agg(F.max(F.struct("transaction_id", "position")).alias("m")).head()["m"]
            yield part.coalesce(1).sortWithinPartitions("transaction_id", "position"), last  # one batch

    def iterate(self, group: str = "", uri: str = "") -> Iterator[Row]:
        """Message after message; a message is acknowledged when the next one is asked for."""
        self.ensure_group(group, uri)
        for row in pending(self.read(), self.get_position(group, uri), self.messages.horizon(), uri).orderBy("transaction_id", "position").toLocalIterator():
            yield row
            self.set_position(row["transaction_id"], row["position"], group, uri)

    def apply_retention(self) -> None:
        """Takes away the messages that all groups have read."""
        current = positions(self.offsets.read())
        self.messages.rewrite(lambda rows: rows.join(consumed_everywhere(rows, current).select("transaction_id", "position"), ["transaction_id", "position"], "left_anti"))
