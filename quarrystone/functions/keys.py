"""Content-addressed keys.  Nulls take a place, so shifted nulls never collide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(columns) -> list[Column]:
    return [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]


def record_hash(*columns: Column | str, separator: str = "||") -> Column:
    return F.sha2(F.concat_ws(separator, *_parts(columns)), 256)


def surrogate_key(*columns: Column | str, separator: str = "|") -> Column:
    return F.md5(F.concat_ws(separator, *_parts(columns)))


def stable_id(prefix: str, *columns: Column | str, length: int = 16) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.concat_ws("|", *_parts(columns))), 1, length))


def row_fingerprint() -> Column:
    """sha256 of the whole row as JSON; orders samples the same way every time."""
    return F.sha2(F.to_json(F.struct("*")), 256)
