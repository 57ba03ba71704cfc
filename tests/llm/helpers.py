import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = ["the", "and", "er", "on", "tion", "ba", "Ko", "ñé", "lu", "x", "漢字", "😀", "st", "re"]


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", ". ", ".\n", "  "]) for w in words).strip()


def documents(spark, texts, ids=None):
    """A documents table; ids default to the places in the list."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"src{k % 2}", len(t) if t is not None else None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def awkward(spark):
    """Null texts and ids, empty and blank texts, repeated rows, and columns whose names could clash."""
    docs = documents(spark, [None, "", " \n\t ", "One line.", "One line.", "word", None], [1, 2, 3, 4, 4, None, None])
    from pyspark.sql import functions as F

    for name in ("__whole", "__mark", "__id", "__place", "__stay", "whole", "row", "mark", "id", "site", "bad", "stay", "base_failed", "lost_chars", "clean_text", "n_dropped", "rows", "fp", "t", "length", "offset", "piece", "code", "spans", "value", "hash", "n_words", "kept", "component_id", "sequence_id", "n_lines", "rule", "tag", "ids"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
