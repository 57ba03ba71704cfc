"""Token pieces of documents, and the placing of pieces in sequences of one capacity.

Placing needs only how many pieces have each length, and that is at most one number per token of capacity, whatever the
size of the corpus. A planner turns those counts into runs: "the pieces of this length with ranks r, r+1, ... go to bins
b, b+1, ..., q to each, from this offset on". Every piece then finds its run by its length and its rank among the pieces
of that length. Ranks come from row numbers in salted groups and the sums of the groups before, so that a length that a
third of all pieces have is no task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, small_batches, text_or_empty
from .pretokens import Forms, Merges, split, text_chunks

CAPACITY, END_ID = 1024, 2
#: Pieces in a ranking group at least; a length with n pieces has groups of about sqrt(n).
GROUP = 64
_FORMS: dict[str, tuple[Forms, str | None]] = {}


def _forms(path: str) -> tuple[Forms, str | None]:
    if path not in _FORMS:
        merges = Merges(path)
        _FORMS[path] = Forms(merges.ids, np.uint32), next(iter(merges.special), None)
    return _FORMS[path]


def encoded(texts: list[str], path: str, end_id: int | None) -> list[np.ndarray]:
    """The ids of each text, those that the tokenizers library gives for the file, then end_id."""
    forms, special = _forms(path)
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for chunk in text_chunks(texts):
        joined, starts, hashes, first = split([t for _, t in chunk], special)
        if not len(starts):
            continue
        slots = forms.lookup(joined, starts, hashes)
        sizes = forms.sizes[slots]
        after = np.cumsum(sizes)
        flat = forms.flat[np.repeat(forms.firsts[slots] - after + sizes, sizes) + np.arange(after[-1])]
        bounds = np.concatenate(([0], after))[first].tolist()
        for k, (i, _) in enumerate(chunk):
            parts[i].append(flat[bounds[k] : bounds[k + 1]])
    end = [] if end_id is None else [np.array([end_id], dtype=np.uint32)]
    return [np.concatenate([*p, *end]) if p or end else np.zeros(0, dtype=np.uint32) for p in parts]


def piece_sizes(n: int, capacity: int) -> list[int]:
    """The sizes of the pieces of n tokens: a shorter one comes first."""
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int | None = END_ID, width: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row: a document over capacity is cut into pieces of capacity tokens, the
    first of which may be shorter. ids: little-endian numbers of width bytes, joined.

    Null text is empty: its only id is end_id, and without one it has no piece.
    """
    small_batches(docs.sparkSession)
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text).alias("t"))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = encoded(texts, path, end_id)
            owner, number, start, length = [], [], [], []
            for i, x in zip(ids, found, strict=True):
                at = 0
                for k, size in enumerate(piece_sizes(len(x), capacity)):
                    owner.append(i), number.append(k), start.append(at), length.append(size)
                    at += size
            flat = np.concatenate([*found, np.zeros(0, dtype=np.uint32)]).astype(f"<u{width}")
            offsets = np.concatenate(([0], np.cumsum(np.array(length, dtype=np.int64)))) * width
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(owner, type=pa.int64()), pa.array(number, type=pa.int32()), pa.array(start, type=pa.int64()), pa.array(length, type=pa.int64()), blob], names=["doc_id", "piece", "start", "length", "ids"])

    return df.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


@dataclass
class Plan:
    """Runs of a packing, and how many bins it has."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first rank, pieces per bin, first bin, offset
    bins: int = 0


def place(table: DataFrame, planner, capacity: int = CAPACITY) -> DataFrame:
    """table (with doc_id, piece, length and any more columns) with sequence_id and offset, by planner(counts, capacity) -> Plan.

    Repeated rows are pieces of their own; pieces of one length take its places in any order. Lengths must be 1 to capacity. An empty table stays empty.
    """
    spark = table.sparkSession
    table = cut(table, "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    plan = planner(counts, capacity)
    n_groups, salt, base, rank = fresh(table, "groups", "salt", "base", "rank")
    groups = spark.createDataFrame([(k, max(1, round(n / max(GROUP, n**0.5)))) for k, n in counts.items()], f"length bigint, `{n_groups}` bigint")
    salted = table.join(F.broadcast(groups), "length").withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.col(n_groups))).drop(n_groups)
    sizes = cut(salted.groupBy("length", salt).agg(F.count("*").alias("n")), "piece-groups")
    before = sizes.withColumn(base, F.sum("n").over(Window.partitionBy("length").orderBy(salt)) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "piece")) - 1
    ranked = salted.join(before, ["length", salt]).withColumn(rank, F.col(base) + within)
    ranked = ranked.select(*[F.col(f"`{c}`") for c in table.columns], rank)
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((runs, runs[:, 0] << 44 | runs[:, 1]))
    schema = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length = table.columns.index("length")

    def run(batches):
        runs, keys = shared.value
        for b in batches:
            length, rank = b.column(at_length).to_numpy(zero_copy_only=False), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            mine = runs[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - mine[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(mine[:, 3] + nth // mine[:, 2]), pa.array(mine[:, 4] + nth % mine[:, 2] * length)], names=schema.names)

    return ranked.mapInArrow(run, schema)
