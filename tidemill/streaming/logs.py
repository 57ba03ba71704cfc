"""Structured Streaming front ends of the outbox and the inbox."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.partitions import belongs_to
from ..operators.inbox import KEY
from ..operators.outbox import addressed


def message_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Messages as they are appended to a folder of Parquet files; files_per_batch holds a batch back in size."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dispatched(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, uri: str = "", poll: str | None = None, worker: int = 0, workers: int = 1) -> DataStreamWriter:
    """A query that hands every micro-batch, in order within it, to handler; its checkpoint is the group's position.

    Delivery is at least once with the batch's number, so that handlers can write under it. Without poll, the query takes
    what is there and ends; with it, it looks again at that interval. Several workers each have a query and a checkpoint.
    """

    def run(batch: DataFrame, number: int) -> None:
        handler(batch.orderBy("transaction_id", "position"), number)

    writer = stream.where(addressed(uri)).where(belongs_to(F.col("uri"), worker, workers)).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)


def first_deliveries(stream: DataFrame) -> DataFrame:
    """Each key's first delivery. The keys stay in the state store for good, as late repeats are never let through."""
    return stream.dropDuplicates(KEY)


def in_stream_order(stream: DataFrame) -> DataFrame:
    """(tenant_id, stream_type, stream_id, stream_position, uri, payload): messages of each stream without gaps, in order.

    A message waits in the state of its stream until the one before it has come, however late; nothing is dropped but
    repeats.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, positions, uris, payloads = state.get if state.exists else (0, [], [], [])
        waiting = {p: (u, x) for p, u, x in zip(positions, uris, payloads, strict=True)}
        for rows in batches:
            later = rows[rows["stream_position"] > done].drop_duplicates("stream_position")
            new = zip(later["stream_position"].tolist(), zip(later["uri"], later["payload"], strict=True), strict=True)
            waiting = dict(new) | waiting
        out = []
        while done + 1 in waiting:
            done += 1
            out.append((*key, done, *waiting.pop(done)))
        state.update((done, list(waiting), [u for u, _ in waiting.values()], [x for _, x in waiting.values()]))
        yield pd.DataFrame(out, columns=[*KEY, "uri", "payload"])

    return (
        stream.select(*KEY, "uri", "payload")
        .groupBy(*KEY[:3])
        .applyInPandasWithState(fold, "tenant_id string, stream_type string, stream_id string, stream_position bigint, uri string, payload string", "done bigint, positions array<bigint>, uris array<string>, payloads array<string>", "append", "NoTimeout")
    )


def lag_stream(stream: DataFrame) -> DataFrame:
    """(uri, received): messages received so far per address."""
    return stream.groupBy("uri").agg(F.max("received_position").alias("received"))
