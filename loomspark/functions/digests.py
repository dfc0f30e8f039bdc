"""Fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its keys in order, no blanks, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def fingerprint(domain: str, version: int, **fields: Column) -> Column:
    """Digest of a value within a named domain and schema version."""
    return sha256_text(canonical_json(domain=F.lit(domain), schema=F.lit(version), value=F.struct(*[fields[k].alias(k) for k in sorted(fields)])))
