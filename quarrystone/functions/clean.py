"""Cleaning expressions.  Raw text never raises: what can't be read becomes null."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Every string column trimmed, but for audit columns (a leading underscore) and ``keep``."""
    skip = set(keep)
    return df.select(*[
        F.trim(F.col(f"`{n}`")).alias(n) if t == "string" and not n.startswith("_") and n not in skip
        else F.col(f"`{n}`") for n, t in df.dtypes])


def conform(df: DataFrame, *key: str) -> DataFrame:
    """A trimmed dimension with one row for each key."""
    return trimmed(df).dropDuplicates(list(key))


def number(c: Column | str, kind: str = "double") -> Column:
    return _col(c).try_cast(kind)


def currency(c: Column | str, kind: str = "decimal(10,2)") -> Column:
    """``$1,234.50`` as a decimal."""
    return F.regexp_replace(_col(c), r"[$,]", "").try_cast(kind)


def money(c: Column | str) -> Column:
    """Two decimals as a double, rounded once from an exact decimal."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 2).cast("decimal(18,2)").cast("double")


def average(c: Column | str, places: int = 2) -> Column:
    """An average to a few decimals: through six digits, so that halves round the same way everywhere."""
    return F.round(F.avg(c).cast("decimal(20,6)"), places).cast("decimal(18,2)").cast("double")


def exact(c: str) -> Column:
    """An amount of two decimals that is a double, as a decimal."""
    return F.col(c).cast("decimal(18,2)")


def date_of(c: Column | str, formats: Iterable[str], epoch_millis: bool = False) -> Column:
    """The first of ``formats`` that reads the text; then, if asked for, milliseconds since 1970."""
    c = F.trim(_col(c).cast("string"))
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    if epoch_millis:
        n = c.try_cast("bigint")  # what is not in the years 1 to 9999 is no date
        tries.append(F.timestamp_millis(F.when(n.between(-62135596800000, 253402300799999), n)))
    return F.to_date(F.coalesce(*tries))


def fiscal_year(c: Column | str) -> Column:
    """``2024`` → 2024, ``2023-2024`` → 2024, ``FY25`` → 2025, anything else null."""
    t = F.upper(F.trim(_col(c)))
    return (F.when(t.rlike(r"^\d{4}$"), t.try_cast("int"))
            .when(t.rlike(r"^\d{4}-\d{4}$"), F.substring(t, 6, 4).try_cast("int"))
            .when(t.rlike(r"^FY\d{2}$"), F.substring(t, 3, 2).try_cast("int") + 2000))


def mapped(c: Column | str, values: Mapping[str, str]) -> Column:
    """A literal lookup on the trimmed lower-case text; unknown values become null."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.create_map(*pairs)[F.lower(F.trim(_col(c)))]


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or a null of that kind where the table doesn't have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def renamed(df: DataFrame, mapping: Mapping[str, tuple[str | None, str]]) -> DataFrame:
    """A fixed layout from any layout: new name → (old name or None, kind)."""
    lower = {c.lower(): c for c in df.columns}
    return df.select(*[
        (F.col(lower[old.lower()]) if old and old.lower() in lower else F.lit(None)).cast(kind).alias(new)
        for new, (old, kind) in mapping.items()])


def tier(c: Column | str, steps: Iterable[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """The name of the first threshold (highest first) that the value reaches, or exceeds if ``strict``."""
    c, out = _col(c), None
    for least, name in steps:
        test = c > least if strict else c >= least
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def same_text(c: Column | str, wanted: str | None) -> Column:
    """Case-insensitive filter; ``All`` or nothing lets every row pass."""
    if wanted is None or wanted.strip().lower() in ("", "all"):
        return F.lit(True)
    return F.lower(_col(c)) == wanted.strip().lower()


def slug_words(c: Column | str, prefix: str) -> Column:
    """The last part of a URL as words: prefix off, dashes to spaces; empty becomes null."""
    c = F.regexp_replace(F.regexp_replace(_col(c), prefix, ""), "-+", " ")
    return F.nullif(F.trim(c), F.lit(""))


def spend_tier(c: Column | str) -> Column:
    return tier(c, ((500, "High"), (200, "Medium")), "Low")


def identifier(name: str) -> str:
    """A table or column name that is safe inside SQL text; raises otherwise."""
    import re

    parts = name.split(".")
    if not 1 <= len(parts) <= 3 or not all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", p) for p in parts):
        raise ValueError(f"not an identifier: {name!r}")
    return ".".join(f"`{p}`" for p in parts)
