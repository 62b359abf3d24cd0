"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The DNS name space of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

_HEX = "0123456789abcdef"


def _dashed(hex32: Column) -> Column:
    return F.regexp_replace(hex32, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid5(text: Column) -> Column:
    """Name-based UUID (version 5, DNS name space) computed in the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(text, "UTF-8")))
    # Two fixed bits mark the variant: the 17th hex digit becomes 8, 9, a or b.
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab"), F.pmod(nibble, F.lit(4)) + F.lit(1), F.lit(1))
    return _dashed(
        F.concat(
            F.substring(digest, 1, 12),
            F.lit("5"),
            F.substring(digest, 14, 3),
            variant,
            F.substring(digest, 18, 15),
        )
    )


def safe_uuid(raw: Column, missing: Column | None = None) -> Column:
    """Valid UUID text in canonical form; other text hashed; nothing -> ``missing`` or random.

    Accepts the spellings a UUID parser accepts: any case, with or without
    dashes, in braces or with the ``urn:uuid:`` prefix.
    """
    stripped = F.regexp_replace(F.regexp_replace(raw, "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", "")
    is_uuid = stripped.rlike(r"^[0-9a-fA-F]{32}$")
    return (
        F.when(raw.isNull() | (raw == ""), F.uuid() if missing is None else missing)
        .when(is_uuid, _dashed(F.lower(stripped)))
        .otherwise(uuid5(raw))
    )


def hash_uniform(key: Column, low: float, high: float, seed: int = 0) -> Column:
    """A number in [low, high) fixed by the key, equal on every re-run."""
    unit = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return F.lit(low) + unit * F.lit(high - low)
