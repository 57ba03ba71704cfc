"""Near-duplicates by similarity against all pairs of shingle sets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import simhash_similar

from .helpers import awkward, documents, empty, prose


def brute_shingles(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute_similar(texts):
    """The smallest id of each id's component of links at a similarity of 0.8."""
    sets, root = {i: brute_shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= 0.8 * large and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
    return " ".join(words)


def test_against_all_pairs(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(30, 300)) for _ in range(60)]
    texts += [edited(rng, t, rng.randint(0, max(1, len(t.split(" ")) // 40))) for t in texts[:30]]
    texts += [edited(rng, t, len(t.split(" ")) // 4) for t in texts[:10]] + texts[:5] + [texts[0].upper(), "", " ", "one word", "one word"]
    want = brute_similar(dict(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in simhash_similar.similar_documents(documents(spark, texts)).collect()}
    assert got == want
    assert len(set(want.values())) < 80


def test_a_large_group_of_copies(spark):
    """Copies of one text that are mostly too far from each other: only their source links them."""
    rng = random.Random(8)
    source = prose(rng, 400)
    texts = [edited(rng, source, 7) for _ in range(120)]
    texts.insert(70, source)
    want = brute_similar(dict(enumerate(texts)))
    assert set(want.values()) == {0}
    got = {r["component_id"] for r in simhash_similar.similar_documents(documents(spark, texts)).collect()}
    assert got == {0}


def test_crowded_buckets_without_links(spark):
    """Many texts of the same words in other orders share every bucket and no shingle, but for a pair and its copies."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.sample(words, len(words))) for _ in range(50)]
    texts += [texts[7] + " w1", texts[31], "w0 " + texts[44]]
    want = brute_similar(dict(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in simhash_similar.similar_documents(documents(spark, texts)).collect()}
    assert got == want and want[50] == 7 and want[51] == 31 and want[52] == 44


def test_copies_that_differ_by_a_block(spark):
    """Tails cut off, passages appended and inserted, at similarities around 0.8 to 0.9."""
    rng = random.Random(12)
    sources = [prose(rng, rng.randint(100, 600)) for _ in range(60)]
    texts = list(sources)
    for k, t in enumerate(sources):
        words, share = t.split(), rng.uniform(0.1, 0.25)
        n, block = int(share * len(words)), prose(rng, int(share * len(words)))
        at = rng.randrange(len(words))
        texts.append((" ".join(words[:-n]), f"{t} {block}", " ".join([*words[:at], block, *words[at:]]))[k % 3])
    want = brute_similar(dict(enumerate(texts)))
    assert 30 < sum(want[60 + k] == k for k in range(60)) < 60
    got = {r["doc_id"]: r["component_id"] for r in simhash_similar.similar_documents(documents(spark, texts)).collect()}
    assert got == want


def test_parts_of_large_groups(spark):
    """Two sets of copies, each with links of its own, that hang together by one text only; no source text of all is there."""
    rng, texts = random.Random(6), []
    for _ in range(12):
        source = prose(rng, 400)
        near = edited(rng, source, 8)
        far = edited(rng, near, 8)
        texts += [edited(rng, source, 1) for _ in range(12)] + [near] + [edited(rng, far, 1) for _ in range(12)]
    rng.shuffle(texts)
    want = brute_similar(dict(enumerate(texts)))
    assert len(set(want.values())) < 24
    got = {r["doc_id"]: r["component_id"] for r in simhash_similar.similar_documents(documents(spark, texts)).collect()}
    assert got == want


def test_ring_is_exact():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (400, simhash_similar.SEGMENTS), dtype=np.uint8)
    apart = rng.integers(0, 2 * simhash_similar.MOST, 400)
    bits = np.unpackbits(a, axis=1)
    for row, n in zip(bits, apart.tolist(), strict=True):
        row[rng.permutation(512)[:n]] ^= 1
    assert (simhash_similar.in_ring(a, np.packbits(bits, axis=1)) == (apart <= simhash_similar.MOST)).all()


def test_fingerprints_keep_similar_sets():
    """Sets at the similarity stay within the bits of the ring and of the parities."""
    rng = np.random.default_rng(9)
    for n in (simhash_similar.SMALL, 100, 1000) * 60:
        both, a, b = (np.sort(rng.integers(0, 1 << 63, k, dtype=np.uint64)) for k in (math.ceil(0.8 * n), n - math.ceil(0.8 * n), n // 20))
        x, y = np.union1d(both, a[: len(a) - len(b)]), np.union1d(both, b)
        assert simhash_similar.similarity(x, y) >= 0.79
        one, two = (np.frombuffer(simhash_similar.wide(s), dtype=np.uint8)[None] for s in (x, y))
        assert simhash_similar.in_ring(one, two).all()
        odd = np.unpackbits(np.frombuffer(simhash_similar.parities(x), dtype=np.uint8) ^ np.frombuffer(simhash_similar.parities(y), dtype=np.uint8)).sum()
        assert odd <= len(np.setxor1d(x, y))


def test_rows_of_a_crowded_bucket_without_links(spark):
    """2,000 texts that share a rare passage and nothing else meet in the passage's buckets; no pair of them becomes a row."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(12))
    texts = [passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(12)) for _ in range(2000)]
    docs = documents(spark, texts)
    rows = simhash_similar._sketches(docs, 5, 0.8).cache()
    nodes = rows.select(F.col("row").alias("node"), "mark", "twin", F.col("doc_id").alias("first"), "n", "prints", "bits", "keys")
    met = nodes.select("node", "n", F.lit(7).cast("bigint").alias("key"), F.col("n").alias("left"))
    alone = spark.createDataFrame([], "node bigint, root bigint")
    assert simhash_similar._led(met, 0.8).count() == 1999
    assert simhash_similar._crossing(met, nodes, alone, 0.8, simhash_similar.MOST, False).count() == 0


def test_edges(spark):
    rows = simhash_similar.similar_documents(awkward(spark)).collect()
    assert len(rows) == 7
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert simhash_similar.similar_documents(empty(spark)).count() == 0
    kept = simhash_similar.one_of_each(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert kept.count() == 3
    assert simhash_similar.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4, 5, 400_000])
def test_long_and_short_texts(n):
    text = " ".join(f"w{k}" for k in range(n))
    assert len(simhash_similar.wide(simhash_similar.shingles(text))) == 64
    assert len(simhash_similar.shingles(text)) == max(1, n - 4)
