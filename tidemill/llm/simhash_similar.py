"""Near-duplicates by similarity: shared first shingles, the pigeonring over wide SimHashes, and the exact similarity last.

Two documents link if SIMILARITY of their sets of five-word shingles is shared (Jaccard). A-Z are lower-cased, words are
runs without space and tab to carriage return, a text with fewer words is one shingle, and texts without words (null
counts as empty) are alike. Rows with the same text are one node, so copies aren't expanded.

Candidates. Two sets that share SIMILARITY share one of the first shingles (a fifth and one more) of each, in whatever
order all shingles are put, and the first one that they share leaves room behind it for what they must share. So texts
meet in buckets of such shingles, and none of the pairs is lost. Shingles that are common in a sample of documents come
last in the order, which saves pairs and changes no result.

Large groups. In every bucket all nodes are first compared with one leader, the least of it and so the same one in most
buckets of a group; a node makes at most a row for each of its first shingles. What is left are nodes of a bucket of three
or more that belong to different components. Those are compared inside tasks, in blocks of at most about BLOCK nodes of a
bucket. Pairs that pass all of these filters are near. Of these, at first only those of a spanning forest of a block's
components become rows, the nearest ones, and when they have been verified, all that are left between components:
* room behind the shingle, as above, and only in the first bucket that two nodes share (of their first HEAD shingles);
* the pigeonring over SimHashes of 512 bits of the shingle sets: in the ring of 64 segments, the cumulative differences
  from some segment on must stay within the proportional share of MOST bits for every chain;
* the full Hamming check. At the similarity, fingerprints differ in 77 bits or less on average with a standard deviation
  of 8, so MOST is five of those away. Sets of under SMALL shingles skip both, as their bits depend on each other;
* the parities of the shingles' hashes, which differ in no more bits than the sets in shingles.
So rows follow the nodes and the near pairs, however crowded a bucket is. Then the whole sets are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few, mix, scratch, small_batches, text_or_empty, window_hashes, words_of
from .components import components
from .simhash_dedup import keepers

SHINGLE, SIMILARITY = 5, 0.8
PARTS, SEGMENTS, MOST, SMALL = 8, 64, 118, 64
#: Segments of a chain that is looked at before the full Hamming check.
LOOK = 16
#: Nodes of a bucket that are compared with each other in one place.
BLOCK = 384
#: First shingles that a node takes along to tell in which bucket it met another first.
HEAD = 32
#: Pairs with one node whose sets meet in one place.
SPREAD = 256
#: Documents whose shingles are counted to put common ones last, and how many of those are sent to all tasks, 8 bytes each.
SAMPLE, COMMON, SEEN = 10_000, 200_000, 3
#: Bits of the parities of a set.
PARITIES = 1024
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, PARTS, dtype=np.uint64)
_BITS = np.array([bin(x).count("1") for x in range(256)], dtype=np.int16)


def shingles(text: str | bytes, n: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = words_of([(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower()])[0]
    return np.unique(window_hashes(words, min(n, len(words)))) if len(words) else np.zeros(1, dtype=np.uint64)


def wide(found: np.ndarray) -> bytes:
    """The SimHash of a set of shingles."""
    total = np.zeros(64 * PARTS, dtype=np.int64)
    for at in range(0, len(found), 4096):
        total += np.unpackbits(mix(found[at : at + 4096, None] ^ _SEEDS).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(found)).tobytes()


def parities(found: np.ndarray) -> bytes:
    """For each of PARITIES parts of the hashes, if an odd number of shingles is in it."""
    return np.packbits(np.bincount(found.astype(np.int64) & (PARITIES - 1), minlength=PARITIES).astype(np.uint8) & 1).tobytes()


def first_shingles(found: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """Those of a set's shingles of which it shares one with every set at the similarity, common ones last."""
    late = np.zeros(len(found), dtype=bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    return np.concatenate((found[~late], found[late]))[: len(found) - math.ceil(least * len(found) - 1e-6) + 1]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def in_ring(a: np.ndarray, b: np.ndarray, most: int = MOST) -> np.ndarray:
    """Which pairs of fingerprints (rows of bytes) pass the chains and the full check."""
    apart = _BITS[a ^ b]
    budgets = np.arange(1, LOOK + 1) * most // SEGMENTS
    sums = np.cumsum(np.concatenate((np.zeros((len(apart), 1), dtype=np.int16), apart, apart[:, :LOOK]), axis=1), axis=1)
    starts = np.ones((len(apart), SEGMENTS), dtype=bool)
    for k in range(1, LOOK + 1):
        starts &= sums[:, k : k + SEGMENTS] - sums[:, :SEGMENTS] <= budgets[k - 1]
    out = starts.any(axis=1)
    out[out] = apart[out].sum(axis=1) <= most
    return out


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """The sorted hashes of the commonest shingles in a sample of documents."""
    base = docs.select(text_or_empty().alias("t"))
    step = max(1, base.count() // SAMPLE)

    def run(batches):
        for b in batches:
            found = [shingles(t, shingle) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])

    rows = base.where(F.pmod(F.xxhash64("t"), F.lit(step)) == 0).mapInArrow(run, "key bigint")
    some = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "key").limit(COMMON)
    return np.sort(some.select("key").toArrow().column(0).to_numpy().view(np.uint64))


def _marks(text: Column) -> list[Column]:
    """Two hashes that tell texts apart."""
    return [F.xxhash64(text).alias("mark"), F.xxhash64(text, F.lit(1)).alias("twin")]


def _sketches(docs: DataFrame, shingle: int, least: float, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, mark, twin, row, n, prints, bits, keys) for every row of docs: a number of its own, the size of its set, its
    SimHash, its parities and its first shingles."""
    small_batches(docs.sparkSession)
    common = _common(docs, shingle)
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty().alias("t")).select("doc_id", *_marks(F.col("t")), "t")

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            found = [shingles(t, shingle) for t in b.column(3).cast(pa.binary()).to_pylist()]
            keys = [first_shingles(x, common, least).view(np.int64) for x in found]
            made = [pa.array(range(row, row + len(found)), pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(map(wide, found), pa.binary()), pa.array(map(parities, found), pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=["doc_id", "mark", "twin", "row", "n", "prints", "bits", "keys"])
            row += len(found)

    return df.mapInArrow(run, "doc_id bigint, mark bigint, twin bigint, row bigint, n bigint, prints binary, bits binary, keys array<bigint>")


def _room(n: Column, left: Column, other_n: Column, other_left: Column, least: float) -> Column:
    return F.least(left, other_left) >= F.lit(least / (1 + least)) * (n + other_n) - 1e-6


def _met(nodes: DataFrame, least: float) -> DataFrame:
    """(key, node, n, left) of the first shingles that several nodes have; left: shingles from this one on in the order.

    The smaller one of two similar sets has a shared shingle so early that there is room for two sets of its size.
    """
    each = nodes.select("node", "n", F.posexplode("keys").alias("at", "key")).select("key", "node", "n", (F.col("n") - F.col("at")).alias("left"))
    early = F.max(_room(F.col("n"), F.col("left"), F.col("n"), F.col("left"), least))
    shared = cut(each.groupBy("key").agg(F.count("*").alias("size"), early.alias("early")).where("size > 1 and early").select("key"), "shingle-shared")
    return cut(each.join(few(shared), "key"), "shingle-met")


def _led(met: DataFrame, least: float) -> DataFrame:
    """(u, v): the nodes of each bucket that could be similar to its leader."""
    order = F.struct(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("left").alias("left_v"))
    tops = met.groupBy("key").agg(F.min(order).alias("top")).select("key", "top.*")
    pairs = met.join(tops, "key").where(F.col("node") != F.col("v")).where(_room(F.col("n"), F.col("left"), F.col("n_v"), F.col("left_v"), least))
    return pairs.select(F.col("node").alias("u"), "v").distinct()


def _forest(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of a least spanning forest (Prim), but for those of negative length."""
    n = len(apart)
    nearest, parent, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, dtype=bool)
    edges = []
    for _ in range(n):
        k = int(np.argmin(np.where(left, nearest, np.inf)))
        if not left[k]:
            k = int(np.argmax(left))  # a new tree
        elif nearest[k] >= 0 and parent[k] >= 0:
            edges.append((parent[k], k))
        left[k] = False
        better = left & (apart[k] < nearest)
        nearest[better], parent[better] = apart[k][better], k
    return np.array([x for x, _ in edges], dtype=np.int64), np.array([y for _, y in edges], dtype=np.int64)


def _pairs_in(rows: dict[str, np.ndarray], least: float, most: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one block that pass the filters; forest: only those that join the components in it."""
    n, left, share = rows["n"], rows["left"], least / (1 + least)
    one, two = [], []
    for k in range(len(n) - 1):
        ok = (rows["root"][k + 1 :] != rows["root"][k]) & (np.minimum(left[k + 1 :], left[k]) >= share * (n[k + 1 :] + n[k]) - 1e-6)
        if rows["i"][0] != rows["j"][0]:
            ok &= rows["salt"][k + 1 :] != rows["salt"][k]
        hits = k + 1 + np.flatnonzero(ok)
        one.append(np.full(len(hits), k)), two.append(hits)
    a, b = np.concatenate(one), np.concatenate(two)
    apart = np.zeros(len(a))
    for at in range(0, len(a), 8192):
        x, y = ({k: rows[k][p[at : at + 8192]] for k in ("n", "prints", "bits")} for p in (a, b))
        apart[at : at + 8192] = _apart(x, y, least, most)
    kept = apart < np.inf
    a, b, apart = a[kept], b[kept], apart[kept]
    if forest:
        apart_all = np.full((len(n), len(n)), np.inf)
        apart_all[a, b] = apart_all[b, a] = apart
        apart_all[rows["root"][:, None] == rows["root"]] = -1
        a, b = _forest(apart_all) if len(a) else (a, b)
    elif len(a):
        key, heads = rows["key"][0], {k: rows["head"][k].tolist() for k in {*a.tolist(), *b.tolist()}}
        sets = {k: set(h) for k, h in heads.items()}
        here = [next((h for h in heads[x] if h in sets[y]), key) == key for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        a, b = a[here], b[here]
    return a, b


def _crossing(met: DataFrame, nodes: DataFrame, roots: DataFrame, least: float, most: int, forest: bool) -> DataFrame:
    """(u, v): the pairs of different components (node, root) that share a first shingle and pass the filters.

    Buckets of two have no other pair than their leader's.
    """
    rows = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("n").alias("least_n"), F.count("*").alias("size")).where("a < b and size > 2")
    rows = rows.join(mixed.drop("a", "b"), "key").where(_room(F.col("n"), F.col("left"), F.col("least_n"), F.col("left"), least))
    rows = cut(rows.select("key", "node", "root", "n", "left", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "similar-mixed")
    rows = rows.join(nodes.select("node", "prints", "bits", F.slice("keys", 1, HEAD).alias("head")), "node")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = [F.col("key"), F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j")]
    rows = rows.select(*place, "salt", "node", "root", "n", "left", "prints", "bits", "head").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    numbers = ("key", "i", "j", "salt", "node", "root", "n", "left")

    def blocks(batches):
        """Whole blocks as dicts of arrays."""
        waiting: list = []
        for b in batches:
            x = {name: b.column(name).to_numpy() for name in numbers}
            for name in ("prints", "bits"):
                x[name] = np.frombuffer(b"".join(b.column(name).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            x["head"] = b.column("head").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((x["key"][1:] != x["key"][:-1]) | (x["i"][1:] != x["i"][:-1]) | (x["j"][1:] != x["j"][:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                part = {k: v[lo:hi] for k, v in x.items()}
                if waiting and any(waiting[-1][k][0] != part[k][0] for k in ("key", "i", "j")):
                    yield {k: np.concatenate([w[k] for w in waiting]) for k in part}
                    waiting = []
                waiting.append(part)
        if waiting:
            yield {k: np.concatenate([w[k] for w in waiting]) for k in waiting[0]}

    def run(batches):
        for x in blocks(b for b in batches if b.num_rows):
            if len(x["n"]) > 1:
                a, b = _pairs_in(x, least, most, forest)
                if len(a):
                    u, v = x["node"][a], x["node"][b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return rows.mapInArrow(run, "u bigint, v bigint").distinct()


def _near(pairs: DataFrame, nodes: DataFrame, least: float, most: int) -> DataFrame:
    """The pairs (u, v) that pass the filters on fingerprints and parities."""
    of = lambda end: nodes.select(F.col("node").alias(end), F.struct("n", "prints", "bits").alias(f"of_{end}"))

    def run(batches):
        for b in batches:
            x, y = ({name: part.field(name) for name in ("n", "prints", "bits")} for part in b.columns[2:])
            x, y = ({"n": p["n"].to_numpy(), **{k: np.frombuffer(b"".join(p[k].to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for k in ("prints", "bits")}} for p in (x, y))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["u", "v"]).filter(pa.array(_apart(x, y, least, most) < np.inf))

    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "of_u", "of_v").mapInArrow(run, "u bigint, v bigint")


def _apart(x: dict[str, np.ndarray], y: dict[str, np.ndarray], least: float, most: int) -> np.ndarray:
    """How far apart pairs are by their parities, as a share of both sizes; infinite for those that a filter rules out."""
    out = _BITS[x["bits"] ^ y["bits"]].sum(axis=1) / (x["n"] + y["n"])
    good = out <= (1 - least) / (1 + least) + 1e-9
    large = good & (np.minimum(x["n"], y["n"]) >= SMALL)
    good[large] = in_ring(x["prints"][large], y["prints"][large], most)
    out[~good] = np.inf
    return out


def _whole(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, id_col: str = "doc_id") -> DataFrame:
    """(node, found): the whole set of every node in pairs (u, v), 8 bytes a shingle. Only their texts move."""
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = cut(nodes.select("node", "mark", "twin", "first").join(few(cut(ends, "similar-ends")), "node", "left_semi"), "similar-wanted")
    base = docs.select(F.col(id_col).cast("bigint").alias("d"), text_or_empty().alias("t")).select("d", "t", *[m.alias(f"t_{k}") for k, m in enumerate(_marks(F.col("t")))])
    own = (F.col("t_0") == F.col("mark")) & (F.col("t_1") == F.col("twin")) & F.col("d").eqNullSafe(F.col("first"))
    texts = base.join(few(wanted), own).select("node", "t").dropDuplicates(["node"])

    def run(batches):
        for b in batches:
            found = [shingles(t, shingle).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["node", "found"])

    return cut(texts.mapInArrow(run, "node bigint, found binary"), "similar-sets")


def _alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar.

    For each v, and each SPREAD of its pairs, the set of v goes once to where the sets of the others pass.
    """
    pairs = cut(pairs, "similar-pairs")
    sets = _whole(docs, nodes, pairs, shingle)
    salts = pairs.groupBy("v").agg(F.ceil(F.count("*") / SPREAD).alias("salts"))
    salted = pairs.join(salts, "v").select("v", F.pmod(F.xxhash64("u"), F.col("salts")).alias("salt"), "u")
    others = salted.join(sets.withColumnRenamed("node", "u"), "u").select("v", "salt", "u", "found")
    own = salted.select("v", "salt").distinct().join(sets.withColumnRenamed("node", "v"), "v").select("v", "salt", F.lit(None).cast("bigint").alias("u"), "found")
    rows = own.union(others).repartition("v", "salt").sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first())

    def run(batches):
        mine = None
        for b in batches:
            us, vs = [], []
            for v, u, found in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                x = np.frombuffer(found.as_buffer(), dtype=np.uint64)
                if u is None:
                    mine = x.copy()
                elif similarity(mine, x) >= least:
                    us.append(u), vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return cut(rows.mapInArrow(run, "u bigint, v bigint"), "similar-links")


def links(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """(node, root) of all nodes with a link; nodes: (node, mark, twin, first, n, prints, bits, keys) of the texts in docs."""
    met = _met(nodes, least)
    alike = lambda pairs: _alike(pairs, docs, nodes, shingle, least)
    roots = cut(components(alike(_near(_led(met, least), nodes, least, most))), "similar-roots").toDF("node", "root")
    for forest in (True, False):
        roots = _joined(roots, alike(_crossing(met, nodes, roots, least, most, forest)))
    return roots


def _joined(roots: DataFrame, crossing: DataFrame) -> DataFrame:
    """roots (node, root) after links (u, v) between the components: each two components are linked once."""
    of = lambda end: roots.toDF(end, f"root_{end}")
    lifted = crossing.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")).distinct()
    tops = cut(components(lifted), "similar-roots").toDF("root", "top")
    ends = roots.union(tops.select("root", "root")).distinct()
    return cut(ends.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "similar-tops")


def cluster(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """(doc_id, mark, component_id) for every row of docs; component_id: the smallest doc_id that the document reaches.

    A node is the texts that are equal, by two 64-bit hashes. Repeated rows each get their component; rows without an id
    take part, but give no name, and a component without any id has component_id null.
    """
    rows = cut(_sketches(docs, shingle, least), "similar-rows")
    texts = cut(rows.groupBy("mark", "twin").agg(F.min("row").alias("node"), F.min("doc_id").alias("first")), "similar-texts")
    nodes = rows.drop("doc_id", "mark", "twin").withColumnRenamed("row", "node").join(few(texts), "node")
    roots = links(docs, nodes, shingle, least, most)
    labelled = cut(texts.join(roots, "node", "left").select("mark", "twin", "first", F.coalesce("root", "node").alias("root")), "similar-labelled")
    names = cut(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "similar-names")
    named = cut(labelled.join(few(names), "root").select("mark", "twin", "component_id"), "similar-named")
    return rows.select("doc_id", "mark", "twin").join(few(named), ["mark", "twin"]).select("doc_id", "mark", "component_id")


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, component_id (null where no document of the component has an id)."""
    return cluster(docs, **options).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that give their component its name, in the columns they had; of repeated rows one stays.

    Rows without an id stay only in components without any id, one of each text. An empty table stays empty.
    """
    with scratch() as tables:
        clustered = tables.keep(cut(cluster(docs, **options), "similar-clusters"))
    return keepers(docs, clustered)
