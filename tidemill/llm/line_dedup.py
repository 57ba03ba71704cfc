"""Line deduplication by site-relative frequency.

Documents are grouped by site. A line (blanks around it aside) that stands in more than max_ratio of its site's
documents, and in at least min_docs of them, is boilerplate there and is removed from every document of that site.
Lines without a word are never removed. Each row counts as a document of its own, so repeated rows count repeatedly, or,
with by_text, each distinct text of a site counts once, so that copies don't make their own lines boilerplate; null text is empty; a null site is a site like any other. Lines are known by 64-bit hashes.

Only DataFrame functions run here. The lines travel as hashes, never as text, and documents are not shuffled while the
boilerplate fits BROADCAST_LINES; beyond that the boilerplate is joined by site and one of PARTS parts of it. A site's
list stays short: a document has few lines, and each listed line fills over max_ratio of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, text_or_empty

MAX_RATIO, MIN_DOCS = 0.1, 3
#: Boilerplate lines of all sites together that are broadcast, 8 bytes each and the site's name.
BROADCAST_LINES = 500_000
#: Parts that each site's documents are dealt to where the boilerplate is joined.
PARTS = 64

BLANK_EDGES = "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$"


def _key(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(line, BLANK_EDGES, ""))


def _has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_docs: int = MIN_DOCS, site: str = "source", by_text: bool = False) -> DataFrame:
    """(site, line, n_docs, site_docs): the hashes of each site's boilerplate lines."""
    base = docs.select(F.col(site).cast("string").alias("site"), text_or_empty().alias("t"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("t")), _has_word), _key))
    if by_text:
        base = base.select("site", F.xxhash64("t").alias("mark"), keys.alias("keys")).dropDuplicates(["site", "mark"])
        keys = F.col("keys")
    # A null key per document carries the site's document count through the same shuffle.
    rows = base.select("site", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), keys)).alias("line"))
    counts = rows.groupBy("site", "line").agg(F.count("*").alias("n_docs")).where((F.col("n_docs") >= min_docs) | F.col("line").isNull())
    counts = cut(counts, "line-counts")
    totals = counts.where("line is null").select(F.col("site").alias("s"), F.col("n_docs").alias("site_docs"))
    lines = counts.where("line is not null")
    return lines.join(totals, lines["site"].eqNullSafe(totals["s"])).where(F.col("n_docs") > F.lit(max_ratio) * F.col("site_docs")).select("site", "line", "n_docs", "site_docs")


def _marked(docs: DataFrame, max_ratio: float, min_docs: int, site: str, by_text: bool) -> tuple[DataFrame, Column, Column]:
    """docs with a column of the lines that stay, those lines, and all lines."""
    bad = boilerplate(docs, max_ratio, min_docs, site, by_text)
    own_site, own_bad, own_stay, own_part = fresh(docs, "site", "bad", "stay", "part")
    lists = cut(bad.groupBy("site").agg(F.collect_set("line").alias(own_bad)), "line-sites")
    n = lists.agg(F.sum(F.size(own_bad))).head()[0] or 0
    lists = lists.withColumnRenamed("site", own_site)
    same = F.col(f"`{site}`").cast("string").eqNullSafe(F.col(own_site))
    if n <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(lists), same, "left")
    else:  # a site may hold a third of the documents: its list, which is short, goes to many parts
        lists = lists.withColumn(own_part, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = docs.join(lists, same & (F.pmod(F.xxhash64(text_or_empty()), F.lit(PARTS)).cast("int") == F.col(own_part)), "left")
    lines = _lines(text_or_empty())
    stays = F.filter(lines, lambda x: ~(_has_word(x) & F.array_contains(F.col(own_bad), _key(x))))
    return joined.withColumn(own_stay, F.when(F.col(own_bad).isNull(), lines).otherwise(stays)), F.col(own_stay), lines


def drop_boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_docs: int = MIN_DOCS, site: str = "source", by_text: bool = False) -> DataFrame:
    """docs with text cleaned, every other column as it was, and n_lines, n_dropped beside them (columns of docs with these
    two names are replaced). An empty table stays empty; texts of any length are whole."""
    made, stay, lines = _marked(docs, max_ratio, min_docs, site, by_text)
    keep = [F.col(f"`{c}`") if c != "text" else _text(stay, lines) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return made.select(*keep, F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(stay)).cast("bigint").alias("n_dropped"))


def _text(stay: Column, lines: Column) -> Column:
    return F.when(F.size(stay) == F.size(lines), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text")


def clean(docs: DataFrame, max_ratio: float = MAX_RATIO, min_docs: int = MIN_DOCS, site: str = "source", by_text: bool = False) -> DataFrame:
    """The documents in the columns they had, whatever their names are, without their boilerplate lines; n_chars, if there,
    follows the text."""
    made, stay, lines = _marked(docs, max_ratio, min_docs, site, by_text)
    new = {"text": _text(stay, lines)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(stay) == F.size(lines), F.col("n_chars")).otherwise(F.length(F.array_join(stay, "\n"))).cast(docs.schema["n_chars"].dataType)
    return made.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
