"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, lower-cased (every character beyond ASCII counts as a letter). For each document,
the windows of MIN_MATCH tokens that it shares with benchmark items are the seeds, and bound from above how much of an
item it can cover. Where that bound reaches the threshold, greedy string tiling runs: the longest common run of
unmarked tokens is marked in both, again and again until none of MIN_MATCH tokens is left. Runs are found by running
Karp-Rabin: hashes of all windows of the search length are matched and checked token by token, and the search length is
halved towards the longest common run and then shrinks. The share of an item's tokens under tiles is its coverage, in
whatever order its passages stand in the document. Tiles never overlap, in the item or in the document.

A document is contaminated by an item if the coverage is at least MIN_COVERAGE. Items with under MIN_MATCH tokens, null
or empty texts, and empty tables contaminate nothing. Repeated items and documents are each taken by themselves. Texts of
any length are tiled whole.

The benchmark is the query set of this search. It is cut into blocks of at most BLOCK_WORDS tokens (one longer item is a
block of its own), and every block runs against all documents, with nothing but that block in a task's memory. The driver
reads the benchmark row by row, and holds one block at a time beside what Spark keeps of the broadcast ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_chunks, fresh, small_batches, text_or_empty, window_hashes, words_of

MIN_MATCH, MIN_COVERAGE = 5, 0.5
#: Tokens of the benchmark in a block, 16 bytes and some each.
BLOCK_WORDS = 1_000_000

_OTHER = re.compile(rb"[^0-9a-z\x80-\xff]+")


def normalised(text: str) -> bytes:
    return _OTHER.sub(b" ", text.lower().encode("utf-8", "surrogatepass"))


class Block:
    """Items of the benchmark with the seeds of them all, sorted by hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.tokens = [t for _, t in items]
        grams = [window_hashes(t, MIN_MATCH) for t in self.tokens]
        sizes = [len(g) for g in grams]
        hashes = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(items)), sizes)[order]
        self.at = (np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, dtype=np.int64))[order]
        self.first = np.cumsum([0, *map(len, self.tokens)])

    def likely(self, seeds: np.ndarray, threshold: float) -> list[int]:
        """Items of which the windows with these hashes could cover enough."""
        lo, hi = np.searchsorted(self.hashes, seeds), np.searchsorted(self.hashes, seeds, side="right")
        hits = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange((hi - lo).sum())
        begin = np.sort(self.first[self.item[hits]] + self.at[hits])
        item = np.searchsorted(self.first, begin, side="right") - 1
        # Each window covers MIN_MATCH tokens, or those up to the next window of its item.
        gap = np.minimum(np.append(begin[1:], begin[-1] + MIN_MATCH) - begin, MIN_MATCH)
        last = np.append(item[1:] != item[:-1], True)
        gap[last] = MIN_MATCH
        heads = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
        covered = np.add.reduceat(gap, heads)
        return [int(k) for k, n in zip(item[heads], covered, strict=True) if n >= threshold * len(self.tokens[k])]


def tiles(item: np.ndarray, doc: np.ndarray, shortest: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """The greedy tiling of two token arrays: (start in item, start in doc, length), longest first; of equal ones, the first in item, then in doc.

    The length of the longest common run of unmarked tokens is searched by halving, with the hashes of all windows of a
    length; all runs of that length are marked in one pass, in which each place of the document is looked at once. So the
    time follows the tokens and the number of different lengths, also where tokens repeat.
    """
    if min(len(item), len(doc)) < shortest:
        return []
    # Only the stretches of the document whose windows are in the item count; a gap stays between two of them.
    hit = np.flatnonzero(np.isin(window_hashes(doc, shortest), window_hashes(item, shortest)))
    if not len(hit):
        return []
    change = np.zeros(len(doc) + 1, dtype=np.int32)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + shortest, -1)
    open_ = np.cumsum(change[:-1]) > 0
    kept = np.flatnonzero(open_ | np.append(False, open_[:-1]))
    doc, free_doc, free_item = doc[kept], open_[kept], np.ones(len(item), dtype=bool)
    found: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))
    while most >= shortest and (length := _longest(item, doc, free_item, free_doc, shortest, most)):
        found += [(a, int(kept[d]), length) for a, d in _marked(item, doc, free_item, free_doc, length)]
        most = length - 1
    return found


def _windows(tokens: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of length unmarked tokens."""
    before = np.concatenate(([0], np.cumsum(free)))
    starts = np.flatnonzero(before[length:] - before[:-length] == length)
    return starts, window_hashes(tokens, length)[starts]


def _longest(item, doc, free_item, free_doc, shortest: int, most: int) -> int:
    """The length of the longest common run of unmarked tokens, at most most; 0 if none has the shortest length."""
    low, high = shortest - 1, most
    while low < high:
        middle = (low + high + 1) // 2
        if np.isin(_windows(item, free_item, middle)[1], _windows(doc, free_doc, middle)[1]).any():
            low = middle
        else:
            high = middle - 1
    return low if low >= shortest else 0


def _marked(item, doc, free_item, free_doc, length: int):
    """(start in item, start in doc) of the runs of this length, each marked before the next is looked for."""
    starts, hashes = _windows(item, free_item, length)
    places, theirs = _windows(doc, free_doc, length)
    both = np.intersect1d(hashes, theirs)
    at: dict[int, list[int]] = {h: [] for h in both.tolist()}
    there = np.isin(theirs, both)
    for d, h in zip(places[there].tolist()[::-1], theirs[there].tolist()[::-1], strict=True):
        at[h].append(d)
    mine, until = np.isin(hashes, both), 0
    for a, h in zip(starts[mine].tolist(), hashes[mine].tolist(), strict=True):
        left = at[h]
        # A window that meets a tile of this length has its first or its last token in it, and never becomes free again.
        while left and not (free_doc[left[-1]] and free_doc[left[-1] + length - 1]):
            left.pop()
        if a < until or not left or not np.array_equal(item[a : a + length], doc[left[-1] : left[-1] + length]):
            continue
        d = left.pop()
        free_item[a : a + length] = False
        free_doc[d : d + length] = False
        until = a + length
        yield a, d


def _matches(block: Block, tokens: np.ndarray, seeds: np.ndarray, threshold: float):
    for k in block.likely(np.unique(seeds), threshold):
        item = block.tokens[k]
        laid = tiles(item, tokens)
        covered = sum(n for _, _, n in laid)
        if covered >= threshold * len(item):
            yield block.ids[k], len(item), covered, laid


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    """The benchmark in blocks: rows stream to the driver, which holds one block at a time."""
    rows = benchmark.select(F.col(item_id).cast("bigint").alias("i"), text_or_empty(text).alias("t"))
    items, size = [], 0
    for r in rows.toLocalIterator():
        tokens = words_of([normalised(r["t"])])[0]
        if len(tokens) < MIN_MATCH:
            continue
        if items and size + len(tokens) > BLOCK_WORDS:
            yield Block(items)
            items, size = [], 0
        items.append((r["i"], tokens))
        size += len(tokens)
    if items:
        yield Block(items)


def _per_text(texts: list[str], block: Block, threshold: float):
    """(number of the text, item, tokens of the item, covered, tiles) for each match of a batch."""
    raw = [normalised(t) for t in texts]
    for lo, hi in byte_chunks(raw):
        tokens, first = words_of(raw[lo:hi])
        grams = window_hashes(tokens, MIN_MATCH)
        hit = np.zeros(len(grams), dtype=bool)
        if len(block.hashes) and len(grams):
            hit = block.hashes[np.minimum(np.searchsorted(block.hashes, grams), len(block.hashes) - 1)] == grams
        for k in range(lo, hi):
            a, b = first[k - lo], first[k - lo + 1]
            last = max(a, b - MIN_MATCH + 1)
            if last > a and (own := hit[a:last]).any():
                for m in _matches(block, tokens[a:b], grams[a:last][own], threshold):
                    yield k, *m


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = MIN_COVERAGE, id_col: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_tokens, covered_tokens, n_tiles, coverage, tiles) for every document and item over the threshold.

    tiles: start in the item, start in the document and length of each, in tokens.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id bigint, item_id bigint, item_tokens bigint, covered_tokens bigint, n_tiles bigint, coverage double, tiles array<struct<item_start: bigint, doc_start: bigint, length: bigint>>"
    arrow = pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())]))
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text).alias("t"))
    parts = []
    for block in _blocks(benchmark, item_id, text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for b in batches:
                ids, found = b.column(0).to_pylist(), list(_per_text(b.column(1).to_pylist(), shared.value, threshold))
                cols = [[ids[f[0]] for f in found], [f[1] for f in found], [f[2] for f in found], [f[3] for f in found], [len(f[4]) for f in found], [f[3] / f[2] for f in found]]
                laid = [[{"item_start": x, "doc_start": y, "length": n} for x, y, n in f[4]] for f in found]
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], pa.array(laid, type=arrow)], names=["doc_id", "item_id", "item_tokens", "covered_tokens", "n_tiles", "coverage", "tiles"])

        parts.append(df.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = MIN_COVERAGE) -> DataFrame:
    """The documents that no item contaminates, in the columns they had, in one pass per block of the benchmark."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs
    for block in _blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast(block)
        names = out.columns
        df = out.select("*", text_or_empty().alias(fresh(out, "whole")[0]))

        def run(batches, shared=shared, n=len(names), names=names):
            for b in batches:
                bad = {f[0] for f in _per_text(b.column(n).to_pylist(), shared.value, threshold)}
                stays = pa.array([i not in bad for i in range(b.num_rows)], type=pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)], names=names).filter(stays)

        out = df.mapInArrow(run, T.StructType(out.schema.fields))
    return out
