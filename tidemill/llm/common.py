"""What the text operators share: scratch tables, word spans and window hashes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python: documents can be long, so few at a time.
ARROW_ROWS = 256
#: Characters or bytes that a numpy kernel works on at a time (a longer document is one chunk).
CHUNK = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or the warehouse where it is unset. On a cluster a
    warehouse in a local folder is an error, as executors don't see each other's."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        if not spark.sparkContext.master.startswith("local") and (where.startswith("file:") or "://" not in where):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df written once as a table in the shared folder and read back: it ends the lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for tables in _SCRATCH:
        tables.made.append(out)
    return out


class Scratch:
    """The tables that cut() made inside a with-block of scratch(); those that aren't kept are deleted at its end."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def keep(self, table: DataFrame) -> DataFrame:
        self.made = [t for t in self.made if t is not table]
        return table


_SCRATCH: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """For work whose result is a table of its own at the end of the block, so that no plan needs the others any more."""
    _SCRATCH.append(tables := Scratch())
    try:
        yield tables
    finally:
        _SCRATCH.remove(tables)
        for t in tables.made:
            drop_cut(t)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files behind a table from cut() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a table that is broadcast, some tens of bytes each; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def few(table: DataFrame) -> DataFrame:
    """A written table as it is to be joined: broadcast if its rows, which are counted, are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, and so the memory of a Python worker. The option is the session's from then on, as
    it is read when a query runs; a lower one stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def text_or_empty(name: str = "text") -> Column:
    """The column as a string, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def byte_chunks(texts: list[bytes], limit: int = CHUNK):
    """Ranges of consecutive texts with about limit bytes in all; a longer text is a range of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


# Odd multipliers, so that they have inverses modulo 2**64.
_B, _C = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 12), dtype=np.uint64)
        out[1:] = base
        _POWERS[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that close sums become far hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _B) -> np.ndarray:
    """A 64-bit hash of each values[start:end], by differences of prefix sums."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), n + 1)
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + length * np.uint64(_C))


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and one more): words are runs without space and tab to carriage return.

    One long text is hashed in slices that end at blanks, so that beside it there is little but a number for each word.
    """
    if len(texts) == 1 and len(texts[0]) > 2 * CHUNK:
        parts, at = [], 0
        while at < len(texts[0]):
            found = _BLANK.search(texts[0], at + CHUNK)
            to = found.start() if found else len(texts[0])
            parts.append(_words_of([texts[0][at:to]])[0])
            at = to
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    return _words_of(texts)


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), first
    return span_hashes(_BYTE[joined], starts, ends), first


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position; positions with fewer words after them have none."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(len(words) - n + 1)
    return span_hashes(words, starts, starts + n, _C)
