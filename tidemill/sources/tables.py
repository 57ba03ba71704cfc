"""Tables laid out for the joins of their relations.

Two tables bucketed by the columns of a relation into the same number of buckets join without a shuffle; one that isn't
is shuffled alone. Pick the columns of the relation that is followed most, and buckets of a few hundred MB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_bucketed(rows: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Writes rows as a table of the session's catalog, bucketed and sorted by keys, and reads it back.

    Rows are dealt by key before writing, so that each bucket is one file.
    """
    rows.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return rows.sparkSession.table(name)


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The Parquet tables of a folder by name, for a Catalog."""
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}
