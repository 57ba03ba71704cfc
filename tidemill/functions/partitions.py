"""Which worker takes which message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_uri() -> Column:
    return F.col("uri")


def by_stream() -> Column:
    """tenant:stream type:stream id."""
    return F.concat_ws(":", "tenant_id", "stream_type", "stream_id")


def by_expression(sql: str) -> Column:
    return F.expr(sql)


def worker_of(key: Column, workers: int) -> Column:
    """0 to workers-1, the same for equal keys in any engine: from the first 8 digits of the key's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(workers)).cast("int")


def belongs_to(key: Column, worker: int, workers: int) -> Column:
    return worker_of(key, workers) == worker if workers > 1 else F.lit(True)


def effective_worker(process: int, concurrency: int, local: int, processes: int) -> tuple[int, int]:
    """(worker, workers) of a local worker among processes of equal concurrency."""
    return process * concurrency + local, processes * concurrency


def group_of_worker(group: str, worker: int, workers: int) -> str:
    """The consumer group under which a worker keeps its position: its own where there are several."""
    return f"{group}:{worker}" if workers > 1 else group
