"""Messages, deliveries and workflow steps derived from the events table, the same way in Spark and in DuckDB.

Each text is SQL with three gaps: $events, $div (whole division) and $text (the text type).
"""

from __future__ import annotations

import zlib
from string import Template

from pyspark.sql import DataFrame, SparkSession

OUTBOX = """SELECT event_id + 1 AS position, CAST(95 + event_id $div 7 AS DECIMAL(20,0)) AS transaction_id,
concat('kafka://', event_type, CASE WHEN user_id % 2 = 0 THEN '' ELSE concat('/', CAST(user_id AS $text)) END) AS uri,
props AS payload, concat('{"event_id":"', md5(CAST(event_id AS $text)), '"}') AS metadata, ts AS created_at FROM $events"""

INBOX = """SELECT * FROM (SELECT event_id, concat('tenant', CAST(user_id % 3 AS $text)) AS tenant_id, event_type AS stream_type,
concat('{"id":', CAST(user_id AS $text), '}') AS stream_id,
CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS BIGINT) AS stream_position,
(event_id * 7919) % 1000003 + 1 AS received_position, props AS payload FROM $events) t WHERE event_id % 97 <> 0"""

# A workflow is what a user does within 5,000 events, so that no workflow grows with the table and no event is left out.
SAGA = """SELECT user_id * 1000000 + event_id $div 5000 AS saga_id, CAST(row_number() OVER (PARTITION BY user_id, event_id $div 5000 ORDER BY event_id) AS BIGINT) AS step_no,
event_type AS activity, event_type <> 'error' AS ok FROM $events"""

FALLBACK = f"SELECT saga_id, (step_no - 1) $div 2 + 1 AS alt_no, (step_no - 1) % 2 + 1 AS alt_step, activity, ok FROM ({SAGA}) s"

PARALLEL = f"SELECT saga_id, step_no % 2 AS branch_no, step_no, activity, ok FROM ({SAGA}) s"


def duckdb(sql: str) -> str:
    return Template(sql).substitute(events="events", div="//", text="VARCHAR")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    view = f"tidemill_events_{zlib.crc32(sf_dir.encode()):08x}"
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView(view)
    return spark.sql(Template(sql).substitute(events=view, div="DIV", text="STRING"))
