"""Keyed tokens, digests and name-based UUIDs as native expressions (no Python workers)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PREFIX = "PSN-"
DEV_AUDIT_KEY = "fixture-audit-key--not-a-secret"
AUDIT_KEY_CONF = "spark.pullwise.audit.key"
UUID_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"     # fixed value: RFC 4122 URL namespace


def pads(key: str) -> tuple[str, str]:
    """The inner and outer HMAC pads of a key, as hex."""
    raw = key.encode("utf-8")
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def hmac_sha256_hex(value: Column, key: str) -> Column:
    inner_pad, outer_pad = (F.unhex(F.lit(p)) for p in pads(key))
    inner = F.sha2(F.concat(inner_pad, F.encode(value.cast("string"), "UTF-8")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


WHOLE = 64      # digits of a whole digest; 12 are for readers, joins and distinct counts take all


def token(value: Column, key: str, digits: int = 12) -> Column:
    """Stable keyed stand-in of an identifier value; null stays null."""
    return F.concat(F.lit(TOKEN_PREFIX), F.substring(hmac_sha256_hex(value, key), 1, digits))


def is_token(value: Column) -> Column:
    return F.coalesce(value.startswith(TOKEN_PREFIX), F.lit(False))


def audit_key(spark) -> str:
    """The key of the audit log's subject tokens, from the session configuration."""
    return spark.conf.get(AUDIT_KEY_CONF, DEV_AUDIT_KEY)


def manifest_digest(*fields: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the manifest's JSON (fields in sorted order, nulls kept)."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256), 1, 16)


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12))
