"""SimHash near-duplicates, with the pigeonring as filter.

A document's fingerprint has the bits that are set in over half the XXH64 hashes (seed 42) of its word shingles. A-Z are
lower-cased, words are runs without space and tab to carriage return, repeated shingles count repeatedly, a text with
fewer words is one shingle, and a text without words (null counts as empty) has fingerprint zero. Documents link if
their fingerprints differ in at most 2 of 64 bits.

The 64 bits are a ring of 5 segments. If two fingerprints differ in at most 2 bits, then from some segment on every
chain of k segments differs in at most floor(2k/5) bits: none in chains of 1 and 2, one in chains of 3 and 4, two in
all. So only fingerprints that agree in two adjacent segments meet, and of those only pairs that keep to the budgets
from there on get the full Hamming check.

Documents with equal fingerprints are one node, so copies aren't expanded. Fingerprints that meet in a bucket of at most
BUCKET are compared in pairs. A larger bucket is split by more bits, chain by chain. The budget of the chain of four says
that two segments more differ in at most one bit, so a fingerprint goes to the places that leave out one bit of those: what
meets there agrees in all other bits of four segments. Places that are still crowded are split by the last segment too,
where a fingerprint goes to itself and to its neighbours at one bit: two that are within the budget have one of those in
common, and at most 15 share it. So rows follow the fingerprints, however large a bucket is, and what meets anywhere, in a
bucket, a place or a part of one, is held against the same budgets before the full Hamming check.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, few, fresh, small_batches, text_or_empty
from .components import components

SHINGLE, BITS, SEED = 3, 2, 42
#: Fingerprints of a bucket that are compared in pairs.
BUCKET = 32
#: First bit and bits of each segment of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(line, SEED), "big", signed=True)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts, ends = np.concatenate(([0], ends[:-shingle] + 1)), ends[shingle - 1 :]
    total, n = np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, n, 65_536):
        places = zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in places]), dtype=np.uint8).reshape(-1, 8)
        total += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, mark, fp) for every row of docs; mark: a hash of the text, which tells rows without an id apart."""
    small_batches(docs.sparkSession)
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty().alias("t")).select("doc_id", "t", F.xxhash64("t").alias("mark"))

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([fingerprint(t, shingle) for t in texts], type=pa.int64())], names=["doc_id", "mark", "fp"])

    return df.mapInArrow(run, "doc_id bigint, mark bigint, fp bigint")


def _mask(segments: list[int]) -> int:
    """The bits of these segments, as a signed number."""
    bits = sum(((1 << n) - 1) << at for at, n in (SEGMENTS[s % 5] for s in segments))
    return bits - (1 << 64) if bits >> 63 else bits


def _differ(segments: list[int]) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(_mask(segments))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _single(segments: list[int]) -> list[int]:
    """The bits of these segments, each by itself, as signed numbers."""
    return [_signed(1 << at + k) for at, n in (SEGMENTS[s % 5] for s in segments) for k in range(n)]


def _crowds(rows: DataFrame, bucket: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """rows (s, out, key, fp) of places with several fingerprints: (small places as (s, out, fps), the rows of larger ones)."""
    place = ["s", "out", "key"]
    sizes = cut(rows.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1"), f"ring-sizes-{tag}")
    met = cut(rows.join(sizes, place), f"ring-met-{tag}")
    small = met.where(F.col("n") <= bucket).groupBy(*place).agg(F.collect_set("fp").alias("fps")).select("s", "out", "fps")
    return small, met.where(F.col("n") > bucket).select(*place, "fp")


def _of(s: Column, choices: list[Column]) -> Column:
    """The choice for the segment s."""
    return F.element_at(F.array(*choices), s + 1)


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links between the distinct fingerprints fp of prints, enough for their components."""
    fp, nothing = F.col("fp"), F.lit(0).cast("bigint")
    keys = F.array(*[F.struct(F.lit(s).alias("s"), fp.bitwiseAND(F.lit(_mask([s, s + 1]))).alias("key")) for s in range(5)])
    small, crowded = _crowds(prints.select("fp", F.explode(keys).alias("k")).select("k.s", nothing.alias("out"), "k.key", "fp"), bucket, "two")
    # Chains of four, whole and but for one bit of the last two segments.
    outs = _of(F.col("s"), [F.array(nothing, *[F.lit(b) for b in _single([s + 2, s + 3])]) for s in range(5)])
    masks = _of(F.col("s"), [F.lit(_mask([s, s + 1, s + 2, s + 3])) for s in range(5)])
    places = crowded.select("s", "fp", F.explode(outs).alias("out"))
    places = places.select("s", "out", fp.bitwiseAND(masks).bitwiseAND(F.bitwise_not("out")).alias("key"), "fp")
    closer, packed = _crowds(places, bucket, "four")
    # All five: a place's fingerprints differ in the bit left out and in the last segment.
    flips = _of(F.col("s"), [F.array(nothing, *[F.lit(b) for b in _single([s + 4])]) for s in range(5)])
    points = packed.select("s", "out", "fp", F.explode(F.array_union(flips, F.array("out"))).alias("flip"))
    stars = points.groupBy("s", "out", fp.bitwiseXOR(F.col("flip")).alias("key")).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    # The pairs of small places, of which those that leave a bit out take only what differs in it; stars of the points.
    groups = small.union(closer)
    beyond = lambda x: (x > F.col("a")) & ((F.col("out") == 0) | (x.bitwiseXOR(F.col("a")).bitwiseAND(F.col("out")) != 0))
    pairs = groups.select("s", "out", F.explode("fps").alias("a"), "fps").select("s", "a", F.explode(F.filter("fps", beyond)).alias("b"))
    pairs = pairs.union(stars.select("s", F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))
    within = F.lit(False)
    for s in range(5):
        within = within | ((F.col("s") == s) & (_differ([s + 2]) <= 1) & (_differ([s + 2, s + 3]) <= 1))
    return pairs.where(within).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def named(prints: DataFrame, nodes: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """prints (doc_id, node, ...) with component_id, from nodes (node, first: the node's smallest doc_id) and links (u, v) between them."""
    roots = cut(components(found), "ring-roots")
    labelled = nodes.join(roots, nodes[node] == roots["v"], "left").select(node, "first", F.coalesce("root", node).alias("root"))
    labelled = cut(labelled, "ring-labels")
    names = cut(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "ring-names")
    final = cut(labelled.join(few(names), "root").select(node, "component_id"), "ring-final")
    return prints.join(few(final), node).select(*prints.columns, "component_id")


def cluster(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp, ...) with component_id, the smallest doc_id that the row's document reaches, itself included.

    Rows with a null doc_id take part, but give no name; a component without any id has component_id null. Repeated rows
    each get their component.
    """
    prints = cut(prints, "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "ring-nodes")
    return named(prints, nodes, links(nodes), "fp")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    out = cluster(fingerprints(docs, shingle))
    return out.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that give their component its name, in the columns they had; of repeated rows one stays.

    Rows without an id stay only in components without any id, one of each text.
    """
    return keepers(docs, cut(cluster(fingerprints(docs, shingle)), "clusters"))


def keepers(docs: DataFrame, clustered: DataFrame) -> DataFrame:
    """The rows of docs that name their component in clustered (doc_id, mark, component_id), a written table.

    Only rows that docs has more than once are shuffled with their texts.
    """
    named = clustered.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    number, mark = fresh(docs, "id", "mark")
    stays = named.groupBy(F.col("doc_id").alias(number), F.col("mark").alias(mark)).agg(F.count("*").alias("rows"))
    # Rows with one id and different texts have one name: the text with the least hash stays. Without an id, every text does.
    rank = F.when(F.col(number).isNull(), 1).otherwise(F.row_number().over(Window.partitionBy(number, F.when(F.col(number).isNull(), F.col(mark))).orderBy(mark)))
    stays = cut(stays.withColumn("nth", rank).where("nth = 1").drop("nth"), "stays")
    same = F.col("doc_id").eqNullSafe(F.col(number)) & (F.xxhash64(text_or_empty()) == F.col(mark))
    once = docs.join(few(stays.where("rows = 1").drop("rows")), same, "left_semi")
    repeated = cut(stays.where("rows > 1").drop("rows"), "stays-repeated")
    if repeated.isEmpty():
        return once
    copies = docs.join(few(repeated), same).dropDuplicates([number, mark])
    return once.union(copies.select(*[F.col(f"`{c}`") for c in docs.columns]))
