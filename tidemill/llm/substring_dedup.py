"""Substring deduplication by level-wise doubling.

Words are runs without space and tab to carriage return. A window is WINDOW consecutive words of a document; a word is
removed if a window over it has a word sequence that also starts in a document with a smaller id. All is judged on the
input.

Levels go from a length of at most SHORTEST words by doubling to WINDOW. At each length below it, of the shorter windows
inside one whole window only the one with the least hash has to be known: equal whole windows choose the same, so each
document offers few of its places and still no repeat is missed. Places whose words stand in one document alone end there.
Only whole windows that chose a repeated one are looked at again, at twice the length, until none is left or the whole
length is reached; twice that length would remove nothing more.

Documents with one and the same word sequence are one document to all levels, the one with the smallest id; of the
others every word goes if there are WINDOW of them. Whole windows are known by two 64-bit hashes (by one where there is
only one level) and sequences by SHA-256;
the shorter windows by one, as a false repeat there only makes a candidate more. Texts are fetched for candidates alone.

Null text has no words. Rows with a null id lose nothing and take nothing from others. Rows with the same id are
documents of their own, and take nothing from each other; a row is known by its id and a hash of its text (tag).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, cut, few, mix, small_batches, text_or_empty, window_hashes, words_of

WINDOW = 50
#: Words of the first level's windows at most.
SHORTEST = 16
_PLACE = np.uint64((1 << 28) - 1)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive keys: the rest of one block and the start of the next."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=keys.dtype)
    blocks = np.full(-(-len(keys) // width) * width, np.iinfo(keys.dtype).max, dtype=keys.dtype)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def lengths(window: int) -> list[int]:
    """The lengths of all levels, each at most twice the one before."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def anchors(words: np.ndarray, first: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows inside one text, the shorter window that each chooses, the hashes of all of these)."""
    hashes = window_hashes(words, length)
    keys = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64)  # ties go to the left
    least = _sliding_least(keys, window - length + 1)
    ends = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(len(least)) + window <= ends[: len(least)])
    return starts, (least[starts] & _PLACE).astype(np.int64), hashes


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate([*values, np.zeros(0, dtype=np.int64)]).astype(kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _sketch(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, n_words, sha, hashes, places): each row's word sequence and the windows that it chooses at the first level."""
    length = lengths(window)[0]

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            rows = []
            for lo, hi in byte_chunks(texts):
                words, first = words_of(texts[lo:hi])
                _, chosen, hashes = anchors(words, first, window, length)
                chosen = np.unique(chosen)
                bounds = np.searchsorted(chosen, first)
                for k, t in enumerate(texts[lo:hi]):
                    own = chosen[bounds[k] : bounds[k + 1]]
                    sha = _digest(t.split())
                    rows.append((int(first[k + 1] - first[k]), sha, hashes[own].view(np.int64), own - first[k]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], type=pa.int64()), pa.array(cols[1], type=pa.binary()), _lists(cols[2], pa.int64()), _lists(cols[3], pa.int32())], names=["doc_id", "tag", "n_words", "sha", "hashes", "places"])

    return docs.mapInArrow(run, "doc_id bigint, tag bigint, n_words bigint, sha binary, hashes array<bigint>, places array<int>")


def _extended(candidates: DataFrame, window: int, length: int, longer: int) -> DataFrame:
    """(doc_id, tag, place, hash, twin): what the whole windows that chose a repeated one of length words choose at the longer length."""

    def run(batches):
        for b in batches:
            ids, tags, texts, places = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()
            rows = []
            for lo, hi in byte_chunks(texts):
                words, first = words_of(texts[lo:hi])
                _, chosen, _ = anchors(words, first, window, length)
                repeated = np.zeros(len(words) + 1, dtype=bool)
                for k in range(lo, hi):
                    repeated[first[k - lo] + np.array(places[k], dtype=np.int64)] = True
                _, next_chosen, hashes = anchors(words, first, window, longer)
                found = np.unique(next_chosen[repeated[chosen]])
                twins = window_hashes(mix(words), longer) if longer == window else hashes
                bounds = np.searchsorted(found, first)
                for k in range(lo, hi):
                    own = found[bounds[k - lo] : bounds[k - lo + 1]]
                    rows.append((ids[k], tags[k], own - first[k - lo], hashes[own].view(np.int64), twins[own].view(np.int64)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.int64()), pa.array(cols[1], type=pa.int64()), _lists(cols[2], pa.int32()), _lists(cols[3], pa.int64()), _lists(cols[4], pa.int64())], names=["doc_id", "tag", "places", "hashes", "twins"])

    out = candidates.mapInArrow(run, "doc_id bigint, tag bigint, places array<int>, hashes array<bigint>, twins array<bigint>")
    return out.select("doc_id", "tag", F.explode(F.arrays_zip("places", "hashes", "twins")).alias("w")).select("doc_id", "tag", F.col("w.places").alias("place"), F.col("w.hashes").alias("hash"), F.col("w.twins").alias("twin"))


def _repeated(rows: DataFrame) -> DataFrame:
    """rows (doc_id, hash, twin, ...) of hashes in two documents or more, with the first of them: sums before any join.

    The join is by sorting whatever the size is, so that hashes that are in many documents can be split.
    """
    firsts = rows.groupBy("hash", "twin").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "twin", "first")
    return rows.join(cut(firsts, "repeated").hint("merge"), ["hash", "twin"])


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, tag, t, ...): rows (doc_id, tag, ...) with their texts, of which only those that have rows move."""
    wanted = cut(rows.select("doc_id", "tag"), "wanted")
    some = texts.select("doc_id", "tag", "t").join(few(wanted), ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])
    return some.join(rows, ["doc_id", "tag"])


def _ranges(covered: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[0::2], edges[1::2], strict=True)]


def _removal(found: DataFrame, window: int) -> DataFrame:
    """found (doc_id, tag, text, starts) -> what covering those windows removes."""
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            ids, tags, texts, starts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()
            rows = []
            for i, tag, text, at in zip(ids, tags, texts, starts, strict=True):
                words = text.split()
                change = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(change, at, 1)
                np.add.at(change, np.array(at) + window, -1)
                covered = np.cumsum(change[:-1]) > 0
                rows.append((i, tag, int(covered.sum()), _digest([w for w, c in zip(words, covered.tolist(), strict=True) if not c]), _ranges(covered)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, type=pa.int64()) for c in cols[:3]], pa.array(cols[3], type=pa.binary()), pa.array(cols[4], type=arrow)], names=["doc_id", "tag", "n_removed", "kept", "removed"])

    return found.mapInArrow(run, "doc_id bigint, tag bigint, n_removed bigint, kept binary, removed array<struct<start: bigint, end: bigint>>")


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) for every row; removed: ranges of words, end exclusive.

    kept_sha256 is of the words that stay, joined by one space. An empty table stays empty; texts of any length are whole.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text).alias("t")).select("doc_id", F.xxhash64("t").alias("tag"), "t")
    sketch = cut(_sketch(base, window), "sketch")
    copies = sketch.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = cut(copies.where("first < last").select("sha", "first"), "copies")
    rows = sketch.select("doc_id", "tag", "n_words", "sha").join(few(copies), "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    rows = cut(rows.drop("first"), "rows")
    # The first level looks at the documents that aren't copies.
    own = sketch.where("doc_id is not null").select("doc_id", "tag", "hashes", "places").join(few(cut(rows.where("copy").select("doc_id", "tag"), "sequence-copies")), ["doc_id", "tag"], "left_anti")
    places = own.select("doc_id", "tag", F.explode(F.arrays_zip("hashes", "places")).alias("a")).select("doc_id", "tag", F.col("a.places").alias("place"), F.col("a.hashes").alias("hash"), F.col("a.hashes").alias("twin"))
    texts, levels = base, lengths(window)
    for length, longer in zip(levels, levels[1:], strict=False):
        repeated = cut(_repeated(places).groupBy("doc_id", "tag").agg(F.collect_set("place").alias("places")), "repeated-places")
        texts = cut(_with_texts(repeated, texts), "candidates")
        places = cut(_extended(texts, window, length, longer), "longer-places")
        if places.isEmpty():
            break
    covered = cut(_repeated(places).where("doc_id > first").groupBy("doc_id", "tag").agg(F.collect_set("place").alias("starts")), "covered")
    found = _with_texts(covered, texts)
    gone = cut(_removal(found, window), "removal")
    out = rows.join(gone, ["doc_id", "tag"], "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end")))
    nothing_left = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), nothing_left).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept_sha256"),
        F.when(F.col("copy"), everything).otherwise(F.coalesce("removed", none)).alias("removed"),
    )
