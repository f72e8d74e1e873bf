"""Stable identities: a prefix and 32 hex digits of a hash over length-prefixed parts, so ("ab", "c") differs from ("a", "bc")."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    texts = [F.lit(prefix), *(p.cast("string") for p in parts)]
    sized = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat(*sized), 256), 1, 32))


def stable_id_sql(prefix: str, *parts: str) -> str:
    """The same in DuckDB's SQL."""
    texts = [f"'{prefix}'", *(f"CAST({p} AS VARCHAR)" for p in parts)]
    sized = " || ".join(f"strlen({t}) || ':' || {t}" for t in texts)
    return f"'{prefix}:' || substr(sha256({sized}), 1, 32)"
