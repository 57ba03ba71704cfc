"""The pipeline against plain Python, stage by stage, on the smallest tables."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import decontaminate, line_dedup, quality_rules, queries

from ..conftest import SF
from .helpers import awkward, documents, prose
from .test_similar import brute_similar
from .test_text import brute_tiles

BLANKS = " \t\n\x0b\x0c\r"


def brute_quality(text):
    """The cleaned text of a document, or None if it is rejected."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    if len(words) < 50 or 2 * len(again) > len(words):
        return None
    stays, lost = [], 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        chars, ended = sum(map(len, own)), bool(own) and own[-1].endswith(quality_rules.TERMINAL)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(own))
        separators, symbols = (sum(c in of for c in line) for of in (quality_rules.SEPARATORS, quality_rules.SYMBOLS))
        navigation = separators >= 2 and not ended or set(low.split(" ")) <= set(quality_rules.NAVIGATION)
        if own and (navigation or 10 * symbols > chars or len(own) < 4 and not ended or any(p in low for p in quality_rules.BOILERPLATE)):
            lost += chars
        else:
            stays.append(line)
    return "\n".join(stays) if lost <= 0.4 * sum(map(len, words)) else None


def brute_lines(docs):
    """(id, text, source) after boilerplate lines go; copies of a text count once."""
    texts = {(t, s) for _, t, s in docs}
    sites, seen = Counter(s for _, s in texts), Counter()
    for text, s in texts:
        seen.update({(s, line.strip(BLANKS)) for line in text.split("\n") if line.strip(BLANKS)})
    bad = {k for k, n in seen.items() if n >= line_dedup.MIN_DOCS and n > line_dedup.MAX_RATIO * sites[k[0]]}
    return [(i, "\n".join(x for x in text.split("\n") if (s, x.strip(BLANKS)) not in bad), s) for i, text, s in docs]


def grams(tokens, n=decontaminate.MIN_MATCH):
    return {tuple(tokens[k : k + n]) for k in range(len(tokens) - n + 1)}


def brute_clean(docs, items):
    bench = [tokens for t in items if len(tokens := re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())) >= 5]
    seeds = [grams(item) for item in bench]
    bad = set()
    for i, text, _ in docs:
        own = re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())
        mine = grams(own)
        for item, theirs in zip(bench, seeds, strict=True):
            # At most five tokens for each shared window: without enough of them there is nothing to tile.
            if 10 * len(mine & theirs) >= len(item) and 2 * sum(n for _, _, n in brute_tiles(item, own)) >= len(item):
                bad.add(i)
    return [d for d in docs if d[0] not in bad]


def test_pipeline_against_plain_python(spark):
    base = duckdb.connect()
    docs = [(i, t or "", s) for i, t, s in base.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()]
    docs = brute_lines([(i, cleaned, s) for i, t, s in docs if (cleaned := brute_quality(t)) is not None])
    roots = brute_similar({i: t for i, t, _ in docs})
    docs = [d for d in docs if roots[d[0]] == d[0]]
    docs = brute_clean(docs, [t for (t,) in base.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in docs}
    sizes, bins = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        sizes[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(sizes) == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(want.values()) // 1024) + 2


def test_contaminated_pairs_of_a_whole_table(spark):
    """Every document against every item, tiled by plain Python."""
    base = duckdb.connect()
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    items = {i: w for i, t in base.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall() if len(w := words(t)) >= 5}
    want = {}
    for i, t in base.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        own = words(t)
        mine = grams(own)
        for k, item in items.items():
            if 10 * len(mine & grams(item)) >= len(item) and 2 * (n := sum(x for _, _, x in brute_tiles(item, own))) >= len(item):
                want[i, k] = n
    got = {(r["doc_id"], r["item_id"]): r["covered_tokens"] for r in queries.op1_decontamination(spark, SF).collect()}
    assert got == want and want


def test_stages_keep_the_columns(spark):
    """Names that clash with any that the stages use: the columns and their values stay, as whole rows."""
    rng = random.Random(4)
    texts = [prose(rng, 80) + "\nshared line of the site, with a full stop." for _ in range(12)]
    plain = documents(spark, [*texts, texts[0], None, ""])
    extra = [c for c in awkward(spark).columns if c not in plain.columns]
    docs = plain.select("*", *[F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")).alias(name) for name in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.schema == docs.schema or [(f.name, f.dataType) for f in kept.schema] == [(f.name, f.dataType) for f in docs.schema], name
        rows = kept.collect()
        assert rows, name
        for r in rows:
            assert all(r[c] == f"{c} {r['doc_id']}" for c in extra), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 15
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward(spark), SF).columns == awkward(spark).columns
