"""Token counts of a byte-level BPE by rank-synchronous array merging.

Each worker splits its batches into pre-tokens, holds the distinct ones as ragged numpy arrays, lets every sequence merge
its lowest-ranked pair at once, round after round, and counts the symbols that survive. Counts are those of the
tokenizers library with add_special_tokens=False: added tokens inside a text count as one. Nothing is truncated.

Null and empty texts have no bytes and no tokens. One row per row; ids may be null or repeated. An empty table stays
empty; long texts are cut where pre-tokens start, and counted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty
from .pretokens import Forms, Merges, split, text_chunks

LIMIT = 1024
_FORMS: dict[str, tuple[Forms, str | None]] = {}


def _forms(path: str) -> tuple[Forms, str | None]:
    if path not in _FORMS:
        merges = Merges(path)
        _FORMS[path] = Forms(merges.counts, np.int32), next(iter(merges.special), None)
    return _FORMS[path]


def counted(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    forms, special = _forms(path)
    total = np.zeros(len(texts), dtype=np.int64)
    for chunk in text_chunks(texts):
        joined, starts, hashes, first = split([t for _, t in chunk], special)
        if len(starts):
            slots = forms.lookup(joined, starts, hashes)
            found = np.concatenate(([0], np.cumsum(forms.flat[slots], dtype=np.int64)))
            np.add.at(total, [i for i, _ in chunk], found[first[1:]] - found[first[:-1]])
    return total


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; path: the tokenizer's .json on every executor."""
    small_batches(docs.sparkSession)
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text).alias("t"))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            n = counted(texts, path)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, type=pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
