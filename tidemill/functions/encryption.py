"""Columns encrypted with AES-256-GCM under data keys, which are wrapped by a key of keys and can be destroyed.

A blob is nonce (12 bytes), ciphertext and tag (16). Every encryption draws its own nonce unless one is given. Key tables
are DataFrames (key_id, wrapped), so that erasing a member is leaving out its row, and all that it encrypted reads null.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BYTES, NONCE_BYTES, LEAST_BYTES = 32, 12, 28


class KeyOfKeys:
    """32 bytes that wrap data keys; they never show in text."""

    def __init__(self, raw: bytes):
        if len(raw) != KEY_BYTES:
            raise ValueError("a key has 32 bytes")
        self._raw = bytes(raw)

    @classmethod
    def of(cls, raw: bytes) -> KeyOfKeys | None:
        return cls(raw) if len(raw) == KEY_BYTES else None

    @classmethod
    def random(cls) -> KeyOfKeys:
        return cls(secrets.token_bytes(KEY_BYTES))

    def __repr__(self) -> str:
        return "KeyOfKeys(...)"

    def column(self) -> Column:
        return F.unhex(F.lit(self._raw.hex()))


def new_data_key() -> tuple[bytes, bytes]:
    """A data key and a nonce."""
    return secrets.token_bytes(KEY_BYTES), secrets.token_bytes(NONCE_BYTES)


def encrypted(data: Column, key: Column, nonce: Column | None = None) -> Column:
    args = [data, key, F.lit("GCM"), F.lit("DEFAULT")]
    return F.aes_encrypt(*args) if nonce is None else F.aes_encrypt(*args, nonce)


def decrypted(blob: Column, key: Column) -> Column:
    """The data, or null for short, damaged or foreign blobs and for a missing key."""
    return F.when(F.octet_length(blob) >= LEAST_BYTES, F.try_aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT")))


def wrapped(data_key: Column, kek: KeyOfKeys, nonce: Column | None = None) -> Column:
    return encrypted(data_key, kek.column(), nonce)


def unwrapped(blob: Column, kek: KeyOfKeys) -> Column:
    return decrypted(blob, kek.column())


def rotated(keys: DataFrame, old: KeyOfKeys, new: KeyOfKeys) -> DataFrame:
    """The key table under a new key of keys; the payloads stay as they are."""
    return keys.withColumn("wrapped", wrapped(unwrapped(F.col("wrapped"), old), new))


def readable(rows: DataFrame, keys: DataFrame, kek: KeyOfKeys, payload: str = "payload", key_id: str = "key_id") -> DataFrame:
    """rows with payload decrypted; null where the key is gone."""
    k = keys.select(F.col("key_id").alias("__key"), unwrapped(F.col("wrapped"), kek).alias("__data_key"))
    return rows.join(k, F.col(key_id) == F.col("__key"), "left").withColumn(payload, decrypted(F.col(payload), F.col("__data_key")).cast("string")).drop("__key", "__data_key")


def is_forgotten(rows: DataFrame, keys: DataFrame, key_id: str = "key_id") -> DataFrame:
    """rows whose key is gone."""
    return rows.join(keys.select(F.col("key_id").alias("__key")), F.col(key_id) == F.col("__key"), "left_anti")


def shred_members(keys: DataFrame, members: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(the key table without these members' keys, keys destroyed and aggregates affected per member)."""
    return keys.join(members.select("key_id"), "key_id", "left_anti"), {"keys_destroyed": 1, "aggregates_affected": 1}


def shred_community(keys: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(an empty key table, the counts for the one key of keys destroyed)."""
    return keys.limit(0), {"keys_destroyed": 1, "aggregates_affected": 0}
