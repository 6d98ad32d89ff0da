"""Dotted versions as one comparable number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_number(v: Column) -> Column:
    """major * 10^12 + minor * 10^6 + patch; a missing or malformed part is 0; null stays null."""
    part = lambda i: F.coalesce(F.try_to_number(F.regexp_extract(F.get(F.split(v, r"\."), F.lit(i)), r"^(\d{1,6})$", 1), F.lit("999999")).cast("long"), F.lit(0).cast("long"))
    return F.when(v.isNotNull(), part(0) * 1_000_000_000_000 + part(1) * 1_000_000 + part(2))


def packed(v: str) -> int:
    a, b, c = map(int, v.split("."))
    return a * 10**12 + b * 10**6 + c
