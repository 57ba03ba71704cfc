"""Token ids as packed binary rows, by best-fit-decreasing packing.

Pieces are placed longest first, each in the fullest sequence that still has room; a segment tree over remaining
capacities finds it. Documents over the capacity are cut without loss. A row is one sequence: its ids and its position
ids as little-endian numbers (positions start anew with each piece), padded to the capacity, and the cumulative lengths
of its segments.

Packing goes block by block inside each task: as many documents as make BLOCK_TOKENS are packed together, and their ids
are written once where they are. The pieces of sequences that a block leaves under FULL of the capacity, one or two of
its thousands, meet in a second packing over all tasks. So few ids are shuffled, memory has a bound, and a lost task is
made again from its documents.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, cut, small_batches, text_or_empty
from .packing import CAPACITY, END_ID, Plan, encoded, piece_sizes, place
from .pretokens import largest_id

PAD_ID = 0
#: Tokens that are packed together.
BLOCK_TOKENS = 4_000_000
#: The share of the capacity from which a block's sequence stays as it is.
FULL = 0.97

SCHEMA = "sequence_id bigint, doc_ids array<bigint>, pieces array<int>, lengths array<int>, ids binary"
_ARROW = pa.schema([("sequence_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])


class CapacityTree:
    """Which remaining capacities have bins: a segment tree with the smallest such capacity from a given one on."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, there: bool) -> None:
        k = room + self.size
        self.any[k] = there
        while k := k >> 1:
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def least_from(self, room: int) -> int | None:
        k = room + self.size
        if self.any[k]:
            return room
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for counts[length] pieces of each length. Bins with equal room are handled together, as ranges."""
    plan, tree, bins = Plan(), CapacityTree(capacity), defaultdict(deque)

    def add(room: int, first: int, n: int) -> None:
        if not bins[room]:
            tree.set(room, True)
        bins[room].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.least_from(length)
            if room is None:
                each = capacity // length
                n = -(-left // each)
                add(capacity, plan.bins, n)
                plan.bins += n
                continue
            first, n = bins[room].popleft()
            # A bin stays the fullest with room for this length until it has none: it takes all that fit.
            each = min(room // length, left)
            whole = min(n, left // each)
            plan.runs.append((length, rank, each, first, capacity - room))
            if whole < n:
                bins[room].appendleft((first + whole, n - whole))
            if not bins[room]:
                tree.set(room, False)
            if room - each * length:
                add(room - each * length, first, whole)
            rank, left = rank + whole * each, left - whole * each
    return plan


def sequences(parts: list[tuple], capacity: int) -> list[list[tuple]]:
    """The parts (doc_id, piece, ids) of each sequence in order, by best-fit decreasing."""
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for p in parts:
        by_length[len(p[2])].append(p)
    plan = best_fit_decreasing({k: len(v) for k, v in by_length.items()}, capacity)
    bins: list[list[tuple]] = [[] for _ in range(plan.bins)]
    ends: dict[int, int] = {}
    for length, rank, each, first, offset in reversed(plan.runs):
        own = by_length[length]
        for k, part in enumerate(own[rank : ends.get(length, len(own))]):
            bins[first + k // each].append((offset + k % each * length, part))
        ends[length] = rank
    return [[part for _, part in sorted(b, key=lambda x: x[0])] for b in bins]


def _blocks(docs: DataFrame, path: str, capacity: int, end_id: int | None, kind: str) -> DataFrame:
    """Rows of SCHEMA: sequences packed inside the tasks, and single pieces without a sequence_id for the second packing."""

    def run(batches):
        parts, tokens, made = [], 0, TaskContext.get().partitionId() << 33

        def packed():
            nonlocal parts, tokens, made
            found = sequences(parts, capacity)
            full = [x for x in found if sum(len(p[2]) for p in x) >= FULL * capacity]
            rest = [[p] for x in found if sum(len(p[2]) for p in x) < FULL * capacity for p in x]
            rows = [*zip(range(made, made + len(full)), full, strict=True), *((None, x) for x in rest)]
            for at in range(0, len(rows), ARROW_ROWS):
                yield pa.RecordBatch.from_pylist([{"sequence_id": n, "doc_ids": [p[0] for p in x], "pieces": [p[1] for p in x], "lengths": [len(p[2]) for p in x], "ids": np.concatenate([p[2] for p in x]).tobytes()} for n, x in rows[at : at + ARROW_ROWS]], schema=_ARROW)
            parts, tokens, made = [], 0, made + len(full)

        for b in batches:
            for i, ids in zip(b.column(0).to_pylist(), encoded(b.column(1).to_pylist(), path, end_id), strict=True):
                at = 0
                for k, size in enumerate(piece_sizes(len(ids), capacity)):
                    parts.append((i, k, ids[at : at + size].astype(kind)))
                    at += size
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield from packed()
        yield from packed()

    return docs.mapInArrow(run, SCHEMA)


def _gathered(placed: DataFrame) -> DataFrame:
    """Rows of SCHEMA from placed pieces; their numbers are negative."""
    together = placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").select((-1 - F.col("sequence_id")).alias("sequence_id"), "doc_id", "piece", "length", "ids")

    def run(batches):
        now, parts = None, []
        for b in batches:
            rows = []
            for of, *part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != now and parts:
                    rows.append((now, parts))
                    parts = []
                now = of
                parts.append(part)
            yield made(rows)
        if parts:
            yield made([(now, parts)])

    def made(rows):
        return pa.RecordBatch.from_pylist([{"sequence_id": n, "doc_ids": [p[0] for p in x], "pieces": [p[1] for p in x], "lengths": [p[2] for p in x], "ids": b"".join(p[3] for p in x)} for n, x in rows], schema=_ARROW)

    return together.mapInArrow(run, SCHEMA)


def packed_rows(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int | None = END_ID, pad_id: int = PAD_ID, width: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, doc_ids, pieces, cu_seqlens, input_ids, position_ids.

    input_ids and position_ids are capacity numbers of width bytes each. Rows with null ids or texts are packed like
    others (a null text has end_id alone); an empty table gives no rows. Pieces of one length are placed in any order. An id
    that width bytes can't hold is an error before any row is made.
    """
    if max(largest_id(path), capacity - 1, pad_id, end_id or 0) >= 1 << 8 * width:
        raise ValueError(f"{width} bytes can't hold the ids or positions")
    small_batches(docs.sparkSession)
    kind = f"<u{width}"
    blocks = cut(_blocks(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text).alias("t")), path, capacity, end_id, kind), "packed-blocks")
    single = lambda name: F.get(name, 0).alias(name.removesuffix("s"))
    rest = blocks.where("sequence_id is null").select(single("doc_ids"), single("pieces"), F.get("lengths", 0).cast("bigint").alias("length"), "ids")
    every = blocks.where("sequence_id is not null").unionByName(_gathered(place(rest, best_fit_decreasing, capacity)))
    out = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())])

    def run(batches):
        for b in batches:
            bounds = [np.concatenate(([0], np.cumsum(x))) for x in b.column(3).to_pylist()]
            ids, positions = np.full((len(bounds), capacity), pad_id, dtype=kind), np.zeros((len(bounds), capacity), dtype=kind)
            for k, (own, x) in enumerate(zip(b.column(4).to_pylist(), bounds, strict=True)):
                ids[k, : x[-1]] = np.frombuffer(own, dtype=kind)
                positions[k, : x[-1]] = np.arange(x[-1]) - np.repeat(x[:-1], np.diff(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(x[-1]) for x in bounds], type=pa.int64()), b.column(1), b.column(2), pa.array([x.tolist() for x in bounds], type=pa.list_(pa.int32())), pa.array([x.tobytes() for x in ids], type=pa.binary()), pa.array([x.tobytes() for x in positions], type=pa.binary())], schema=out)

    return every.mapInArrow(run, "sequence_id bigint, n_tokens bigint, doc_ids array<bigint>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary")


def write_packed(rows: DataFrame, path: str) -> None:
    """The packed rows as Parquet, split by Spark."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def documents_of(rows: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, ids): the ids of each document back from packed rows, in order; for round trips."""
    part = F.explode(F.arrays_zip("doc_ids", "pieces", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("at"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("to"))).alias("p")
    cutout = rows.select(part, "input_ids").select(F.col("p.doc_ids").alias("doc_id"), "p.pieces", F.expr(f"substring(input_ids, p.at * {width} + 1, (p.to - p.at) * {width})").alias("ids"))
    parts = cutout.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pieces", F.hex("ids").alias("h")))).alias("parts"))
    return parts.select("doc_id", F.unhex(F.array_join("parts.h", "")).alias("ids"))
