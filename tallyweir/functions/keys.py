"""Keys derived from business columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def surrogate_key(business_key: str | Column) -> Column:
    """Hash key, so a fact carries its foreign keys without a join.

    A NULL business key hashes to 42, the hash's seed: all NULL references share that value.
    """
    return F.xxhash64(F.col(business_key) if isinstance(business_key, str) else business_key)


def date_key(moment: str | Column) -> Column:
    """yyyyMMdd as an integer; arithmetic on the calendar parts, so no text is formatted per row."""
    ts = F.col(moment) if isinstance(moment, str) else moment
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")
