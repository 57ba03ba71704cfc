"""JSON texts: canonical keys, fields, and the lists of causal dependencies in message metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def canonical(c: Column) -> Column:
    """A text that is equal for equal JSON values, whatever the order of keys and the blanks; null for malformed texts."""
    return F.to_json(F.try_parse_json(c))


def payload_or(c: Column, otherwise: str) -> Column:
    """The canonical text, or otherwise for malformed and missing ones."""
    return F.coalesce(canonical(c), F.lit(otherwise))


def field(c: Column, name: str) -> Column:
    """The text of one key, dots in its name included."""
    return F.get_json_object(c, "$['" + name + "']")


def path(c: Column, *names: str) -> Column:
    """The text at nested keys."""
    return F.get_json_object(c, "$" + "".join(f"['{n}']" for n in names))


def event_id(metadata: Column) -> Column:
    """The event_id if it is a text, else null."""
    v = F.try_variant_get(F.try_parse_json(metadata), "$.event_id", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def valid_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def dependencies(metadata: Column) -> Column:
    """The causal dependencies, as array<struct<tenant_id, stream_type, stream_id, stream_position>>.

    Malformed entries are left out one by one; no list gives an empty array. stream_id is canonical JSON.
    """
    items = F.try_variant_get(F.try_parse_json(metadata), "$.causal_dependencies", "array<variant>")
    text = lambda v, name: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
    whole = lambda v: F.when(F.schema_of_variant(F.try_variant_get(v, "$.stream_position", "variant")) == "BIGINT", F.try_variant_get(v, "$.stream_position", "bigint"))

    def one(v: Column) -> Column:
        return F.struct(text(v, "tenant_id").alias("tenant_id"), text(v, "stream_type").alias("stream_type"), F.to_json(F.try_variant_get(v, "$.stream_id", "variant")).alias("stream_id"), whole(v).alias("stream_position"))

    read = F.transform(F.coalesce(items, F.array().cast("array<variant>")), one)
    return F.filter(read, lambda d: d["tenant_id"].isNotNull() & d["stream_type"].isNotNull() & d["stream_id"].isNotNull() & d["stream_position"].isNotNull())
