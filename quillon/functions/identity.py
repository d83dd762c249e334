"""Stable identities: content hashes, keyed pseudonyms, canonical JSON; all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256)


def hmac_sha256(key: bytes, namespace: str, message: Column) -> Column:
    """Keyed pseudonym of "namespace:message" (HMAC with SHA-256). The key has 16 bytes at least."""
    import hashlib

    if len(key) < 16:
        raise ValueError("the key needs 16 bytes or more")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ pad for b in block) for pad in (0x36, 0x5C))
    text = F.concat(F.lit(f"{namespace}:"), message.cast("string")).cast("binary")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), text), 256))), 256)


def json_string(c: Column) -> Column:
    """A JSON string with its quotes; null for null. Non-ASCII text stays as it is."""
    return F.when(c.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object with sorted keys and no spaces. Values are text (quoted) or, for names that begin with '#', already JSON."""
    parts: list[Column] = []
    for i, (name, c) in enumerate(sorted(fields.items(), key=lambda kv: kv[0].lstrip("#"))):
        raw = name.startswith("#")
        parts += [F.lit(("," if i else "") + f'"{name.lstrip("#")}":'), F.coalesce(c.cast("string"), F.lit("null")) if raw else json_string(c)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def content_sha256(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields).cast("binary"), 256)
