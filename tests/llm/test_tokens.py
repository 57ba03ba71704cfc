import json
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import packing, pretokens, queries, token_counts, token_output
from tidemill.llm.best_fit_packing import fullest, minimum_slack, pack
from tidemill.llm.token_output import CapacityTree, best_fit_decreasing

from .helpers import awkward, documents, empty, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(1)
    alphabet = "ab '\n\t strevlmdS<|endoftext|>1½é漢😀_.\x1f\u0085  "
    texts = ["", " ", "it's 'sun we'll x''s 's\n'm DON'T", "<|endoftext|>", "a<|endoftext|>  b <|endoftext|><|endoftext|> ", "aaaaaaaaaaaaaaaaaaaaaaa", "é́ñ½²Ⅷ٣", "   \n  \t x", " 's", "12'34's", "<|endoftext|", "x" * 5000, "ab" * 3000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    return texts + ["".join(rng.choice(["<|endoftext|>", " ", "a", "'s", "\n", " b"]) for _ in range(rng.randint(1, 9))) for _ in range(500)] + [prose(rng, 300) for _ in range(20)]


def test_kernels_give_what_the_library_gives(library):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.encoded(texts, PATH, None)] == want
    assert token_counts.counted(texts, PATH).tolist() == [len(x) for x in want]


def test_every_code_point(library):
    """Each code point beside letters, digits, blanks and apostrophes, in texts of 2,000."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(3)
    beside = ["a", "1", " ", "'s", "\n", "x'", ".", " b", "", "'ll"]
    texts = ["".join(rng.choice(beside) + c for c in points[at : at + 2000]) for at in range(0, len(points), 2000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.counted(texts, PATH).tolist() == [len(x) for x in want]
    assert [x.tolist() for x in packing.encoded(texts, PATH, None)] == want


def test_whole_tables_against_the_library(spark, library):
    """Counts and digests of all documents of a table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    ids = {i: e.ids for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op3_token_counts(spark, "/root/testdata/sf0.01").collect()} == {i: len(x) for i, x in ids.items()}
    for r in queries.op2_best_fit_packing(spark, "/root/testdata/sf0.01").collect():
        whole = [*ids[r["doc_id"]], 2]
        assert r["ids_crc32"] == crc32(np.array(whole[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())


def test_ids_that_two_bytes_cannot_hold(spark, tmp_path):
    """A vocabulary of 70,000 ids is an error for two bytes, before any row is made, and none for four."""
    with open(PATH, encoding="utf-8") as f:
        loaded = json.load(f)
    loaded["model"]["vocab"] |= {f"<extra {k}>": k for k in range(50257, 70_000)}
    path = f"{tmp_path}/large.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(loaded, f)
    docs = documents(spark, ["one text"])
    with pytest.raises(ValueError):
        token_output.packed_rows(docs, path)
    assert token_output.packed_rows(docs, path, width=4).count() == 1


def test_long_texts_and_small_caches(library, monkeypatch):
    """Cutting long texts and starting the cache anew change nothing."""
    rng = random.Random(2)
    texts = [prose(rng, 3000), "x" * 3000 + " " + prose(rng, 500), "<|endoftext|> " * 300, "a b " * 2000]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(pretokens, "CACHE", 50)
    monkeypatch.setattr(pretokens.text_chunks, "__defaults__", (1000,))
    assert token_counts.counted(texts, PATH).tolist() == want
    assert [len(x) for x in packing.encoded(texts, PATH, None)] == want


def test_counts_table(spark, library):
    texts = odd_texts()[:200] + [None]
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.token_counts(documents(spark, texts), PATH, limit=20).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 20)
    assert token_counts.token_counts(awkward(spark), PATH).count() == 7
    assert token_counts.token_counts(empty(spark), PATH).count() == 0


def layout(plan, counts):
    """bin -> [(offset, length)] of a plan."""
    runs, bins = defaultdict(list), defaultdict(list)
    for length, rank, each, first, offset in sorted(plan.runs):
        runs[length].append((rank, each, first, offset))
    for length, n in counts.items():
        own = [*runs[length], (n, 0, 0, 0)]
        assert own[0][0] == 0
        for (rank, each, first, offset), (end, *_) in zip(own, own[1:], strict=False):
            for k in range(end - rank):
                bins[first + k // each].append((offset + k % each * length, length))
    return bins


def proper(plan, counts, capacity):
    bins = layout(plan, counts)
    assert sorted(bins) == list(range(plan.bins))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def brute_best_fit(counts, capacity):
    rooms = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_plans():
    rng = random.Random(4)
    for _ in range(120):
        capacity = rng.choice([10, 60, 1024])
        counts = {rng.randint(1, capacity): rng.randint(1, rng.choice([3, 80])) for _ in range(rng.randint(1, 40))}
        for planner in (minimum_slack, best_fit_decreasing):
            proper(planner(counts, capacity), counts, capacity)
        bins = layout(best_fit_decreasing(counts, capacity), counts)
        assert sorted(capacity - sum(n for _, n in parts) for parts in bins.values()) == brute_best_fit(counts, capacity)


def test_fullest_is_the_fullest():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        taken = fullest(counts, room)
        assert all(n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)


def test_capacity_tree():
    rng, tree, there = random.Random(8), CapacityTree(100), set()
    for _ in range(500):
        room = rng.randint(0, 100)
        tree.set(room, rng.random() < 0.5)
        there = there | {room} if tree.any[room + tree.size] else there - {room}
        at = rng.randint(0, 100)
        assert tree.least_from(at) == min((x for x in there if x >= at), default=None)


def test_packing_table(spark, library):
    rng = random.Random(9)
    texts = [prose(rng, rng.choice([0, 3, 40, 300])) for _ in range(80)] + [prose(rng, 2500), None]
    capacity = 256
    table = packing.pieces(documents(spark, texts), PATH, capacity)
    rows = pack(table.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc")), capacity).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["crc"]))
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        sizes = [len(ids)] if len(ids) <= capacity else [*([len(ids) % capacity] if len(ids) % capacity else []), *[capacity] * (len(ids) // capacity)]
        at, want = 0, []
        for k, n in enumerate(sizes):
            want.append((k, at, n, crc32(np.array(ids[at : at + n], dtype="<u4").tobytes())))
            at += n
        assert sorted(by_doc[i]) == want
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(by_bin) <= -(-total // capacity) + 3


def test_hot_length_and_repeated_rows(spark):
    table = spark.createDataFrame([(i // 3, 0, 10) for i in range(3000)] + [(i, 1, i % 7 + 1) for i in range(200)], "doc_id bigint, piece int, length bigint")
    rows = pack(table, 64).collect()
    assert len(rows) == 3200 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3200
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 0, 65)], "doc_id bigint, piece int, length bigint"), 64)


def test_packed_rows_round_trip(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_TOKENS", 3000)
    rng = random.Random(10)
    texts = [prose(rng, rng.choice([1, 30, 200])) for _ in range(40)] + [prose(rng, 1500), ""]
    rows = token_output.packed_rows(documents(spark, texts), PATH, 128)
    token_output.write_packed(rows, f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    for r in back.collect():
        positions, bounds = np.frombuffer(r["position_ids"], dtype="<u2"), r["cu_seqlens"]
        assert len(positions) == 128 and bounds[-1] == r["n_tokens"] <= 128
        assert positions[: bounds[-1]].tolist() == [k for a, b in zip(bounds, bounds[1:], strict=False) for k in range(b - a)]
    got = {r["doc_id"]: np.frombuffer(r["ids"], dtype="<u2").tolist() for r in token_output.documents_of(back).collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_token_edges(spark):
    assert token_output.packed_rows(awkward(spark), PATH).count() == 1
    assert token_output.packed_rows(empty(spark), PATH).count() == 0
    assert pack(packing.pieces(awkward(spark), PATH)).count() == 7
    assert pack(packing.pieces(empty(spark), PATH)).count() == 0
    assert packing.pieces(awkward(spark), PATH, end_id=None).count() == 4
