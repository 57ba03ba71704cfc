import hashlib
import random

import corpus_pipeline
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import components, line_dedup, oracle, queries, simhash_dedup, substring_dedup

from ..conftest import same_as_duckdb
from .helpers import awkward, documents, empty, prose


def brute_print(text, n=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_against_all_pairs(spark):
    rng = random.Random(3)
    base = [prose(rng, rng.randint(0, 120)) for _ in range(60)]
    texts = base + base[:20] + [t + " End." for t in base[:30]] + ["", "a", "A b", "a B"]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_duplicates(documents(spark, texts)).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    roots = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}


def test_links_of_crowded_buckets(spark):
    """A bucket of any size gives the components that all pairs would, whichever way it goes."""
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = {i: rng.getrandbits(64) for i in range(40)}
    for i in range(40, 400):
        x = center if i % 3 else prints[i % 40]
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        prints[i] = x
    table = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in prints.items()], "doc_id bigint, fp bigint")
    want = brute_components(prints)
    for bucket in (1, 8, 1000):
        simhash_dedup.BUCKET, kept = bucket, simhash_dedup.BUCKET
        linked = simhash_dedup.links(table.select("fp").distinct(), bucket)
        simhash_dedup.BUCKET = kept
        for r in linked.limit(500).collect():
            assert (r["u"] ^ r["v"]).bit_count() <= 2 or ((r["u"] ^ r["v"]) & ((1 << 64) - 1)).bit_count() <= 2
        roots = {r["v"]: r["root"] for r in components.components(linked).collect()}
        signed = {i: x - (1 << 64) if x >> 63 else x for i, x in prints.items()}
        mine = {}
        for i in sorted(prints):
            mine.setdefault(roots.get(signed[i], signed[i]), []).append(i)
        theirs = {}
        for i, r in want.items():
            theirs.setdefault(r, []).append(i)
        assert sorted(mine.values()) == sorted(theirs.values()), bucket


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "u bigint, v bigint")
    got = {r["v"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_one_of_each(spark):
    texts = ["same text here again", "same text here again", "other words", "same text here again"]
    kept = simhash_dedup.one_of_each(documents(spark, texts, [7, 3, 5, 3]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_simhash_edges(spark):
    rows = simhash_dedup.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 7
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0
    assert simhash_dedup.one_of_each(awkward(spark)).count() == 3


def brute_removal(docs, window):
    words = {d: (t or "").encode().split() for d, t in docs}
    first = {}
    for d in sorted(words):
        for p in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][p : p + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < d:
                gone.update(range(p, p + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(11)
    passages = [prose(rng, rng.randint(20, 140)) for _ in range(6)]
    texts = []
    for k in range(60):
        parts = [prose(rng, rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[9], " ".join(["a"] * 130), "a " * 60, " ".join(["x", "y"] * 70), None, ""]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    for window in (50, 7):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(documents(spark, texts, ids), window).collect()}
        want = brute_removal(list(zip(ids, texts, strict=True)), window)
        assert got == want
        assert sum(x[1] > 0 for x in want.values()) > 5


def test_substring_edges(spark):
    long = " ".join(f"w{i}" for i in range(80))
    docs = documents(spark, [long, long, long + " tail", long, None], [5, 5, 9, None, None])
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == [(-1, 0, 0), (-1, 80, 0), (5, 80, 0), (5, 80, 0), (9, 81, 80)]
    assert substring_dedup.substring_dedup(awkward(spark)).count() == 7
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_same_id_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = documents(spark, [a, b, a + " " + b, b + " x"], [1, 1, 2, 0])
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == [(0, 61, 0), (1, 60, 0), (1, 60, 60), (2, 120, 120)]


def test_line_dedup(spark):
    texts = [f"Menu\nstory {i}\n\nMenu\nend" if i % 2 == 0 else f"Menu\nnews {i}" for i in range(12)]
    docs = documents(spark, texts + [None, ""])
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.drop_boilerplate(docs).collect()}
    assert got[0] == ("story 0\n", 3)
    assert got[1] == ("news 1", 1)
    assert got[12] == (None, 0) and got[13] == ("", 0)
    assert line_dedup.clean(docs).columns == docs.columns
    assert {r["doc_id"]: r["n_chars"] for r in line_dedup.clean(docs).collect()}[0] == len("story 0\n")


def test_line_dedup_by_join_and_edges(spark, monkeypatch):
    texts = [f"Menu\nstory {i}" for i in range(10)]
    want = sorted(r["text"] for r in line_dedup.drop_boilerplate(documents(spark, texts)).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(r["text"] for r in line_dedup.drop_boilerplate(documents(spark, texts)).collect()) == want
    assert line_dedup.drop_boilerplate(awkward(spark)).count() == 7
    assert line_dedup.drop_boilerplate(empty(spark)).count() == 0


def test_copies_do_not_empty_themselves(spark):
    """Copies of one text that are a third of their site, and the pipeline's stage, which keeps their lines."""
    texts = [f"Menu\nstory {k}" for k in range(20)] + ["Menu\nOne tale\nof copies"] * 10
    docs = documents(spark, texts).withColumn("source", F.lit("site"))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {k: f"story {k}" if k < 20 else "One tale\nof copies" for k in range(30)}


def test_sql(spark):
    for name in ("op9_line_dedup", "op10_substring_dedup"):
        same_as_duckdb(spark, name, queries.QUERIES[name], oracle.ORACLE_SQL[name])
