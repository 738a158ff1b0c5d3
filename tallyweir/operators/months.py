"""A07, F08 on facts kept by month: a trailing window opens only the months it touches.

A month is the number of a partition, year and month of the moment's UTC day. The window's bounds, which
are known when a plan is made or only once a subquery ran, are compared with that number as well as
with the moment: the first decides which partitions are opened, the second which rows are inside.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tallyweir.operators.windows import WINDOW_DAYS, start_before, trailing_window

MONTH = "_month"


def month_of(moment: Column) -> Column:
    """Year and month as one number, 202601; NULL for a missing moment."""
    return (F.year(moment) * 100 + F.month(moment)).cast("int")


def by_month(df: DataFrame, moment: str) -> DataFrame:
    """The rows with their month, dealt out so that a file holds one month's, in order of the moment.

    A month goes to as many tasks as its bytes ask for: a large one is no single file, a small one no thousand.
    """
    placed = df.withColumn(MONTH, month_of(F.col(moment)))
    return placed.hint("rebalance", F.col(MONTH)).sortWithinPartitions(MONTH, moment)


def newest_month(table: DataFrame) -> Column:
    """The last month with rows, as a scalar subquery that reads no column of the files."""
    return table.select(F.max(MONTH)).scalar()


def start_of_window(table: DataFrame, moment: str, days: int = WINDOW_DAYS) -> Column:
    """First midnight of the window that ends on the last day seen; only the newest month is read for it."""
    last = table.where(F.col(MONTH) == newest_month(table)).agg(F.max(moment).cast("date").alias("day"))
    return last.select(F.date_sub("day", days - 1).cast("timestamp")).scalar()


def months_from(table: DataFrame, moment: str, days: int = WINDOW_DAYS) -> tuple[Column, Column]:
    """First and last month of the window, each as one scalar subquery."""
    last = table.where(F.col(MONTH) == newest_month(table)).agg(F.max(moment).cast("date").alias("day"))
    first = last.select(month_of(F.date_sub("day", days - 1))).scalar()
    return first, newest_month(table)


def recent(table: DataFrame, moment: str, days: int = WINDOW_DAYS) -> DataFrame:
    """F08 on a fact by month, anchored on its own last day.

    The months are pruned by a subquery when the plan runs; rows without a moment are in no month and in
    no window.
    """
    first, last = months_from(table, moment, days)
    inside = table.where((F.col(MONTH) >= first) & (F.col(MONTH) <= last))
    return trailing_window(inside, moment, start_of_window(table, moment, days), days)


def recent_before(table: DataFrame, moment: str, day: int | None, days: int = WINDOW_DAYS) -> DataFrame:
    """The same before a ``last_day`` that the write observed: the months are pruned when the plan is made."""
    if day is None:
        return table.where(F.lit(False))
    end = date(1970, 1, 1) + timedelta(days=day)
    begin = end - timedelta(days=days - 1)
    first, last = (d.year * 100 + d.month for d in (begin, end))
    inside = table.where((F.col(MONTH) >= first) & (F.col(MONTH) <= last))
    return trailing_window(inside, moment, start_before(day, days), days)
