"""Each source's own clock and the trailing window it anchors."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

WINDOW_DAYS = 30


def as_of_date(df: DataFrame, moment: str) -> Column:
    """Last day seen, as a scalar subquery; NULL when the source is empty."""
    return df.select(F.max(F.col(moment)).cast("date")).scalar()


def window_start(df: DataFrame, moment: str, days: int = WINDOW_DAYS) -> Column:
    """First midnight of the ``days`` days ending on the last day seen, as a scalar subquery.

    The bound itself comes out of the subquery: compared with a bare column, its value reaches the
    Parquet scan at run time, which a date computed around the subquery would not. An empty source
    gives NULL, which makes every window on it empty.
    """
    return df.select(F.date_sub(F.max(F.col(moment)).cast("date"), days - 1).cast("timestamp")).scalar()


def last_day(moment: str) -> Column:
    """Aggregate: the last day seen, as a number of days since 1970.

    A number means the same to the driver whatever its operating system's zone; a timestamp would
    reach Python as local time.
    """
    return F.unix_date(F.max(F.col(moment)).cast("date"))


def start_before(day: int | None, days: int = WINDOW_DAYS) -> Column:
    """The same bound from an already known ``last_day``."""
    if day is None:
        return F.lit(None).cast("timestamp")
    return F.lit(date(1970, 1, 1) + timedelta(days=day - days + 1)).cast("timestamp")


def _inside(moment: str, start: Column, days: int) -> Column:
    # One subquery in both bounds: two different ones would be merged and not reach the scan.
    ts = F.col(moment)
    return (ts >= start) & (ts < start + F.expr(f"INTERVAL '{days}' DAY"))


def in_trailing_window(moment: str, start: Column, days: int = WINDOW_DAYS) -> Column:
    """F08 as a flag, never NULL."""
    return F.coalesce(_inside(moment, start, days), F.lit(False))


def trailing_window(df: DataFrame, moment: str, start: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """rows of the ``days`` days from ``start``, both end days included.

    Half-open on the raw timestamp; a scan of files written in time order skips the rest.
    """
    return df.where(_inside(moment, start, days))
