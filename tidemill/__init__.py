"""Specification filters over related tables, ordered message logs, idempotent ingestion, workflow outcomes and column
encryption as Spark jobs."""
