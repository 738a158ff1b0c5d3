"""The calendar dimension."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweir.functions.keys import date_key

# The span of the published dimension.
FIRST_DAY = date(2020, 1, 1)
LAST_DAY = date(2030, 12, 31)


def calendar_days(spark: SparkSession, first: date | Column, last: date | Column) -> DataFrame:
    """One row per day, both ends included; the ends may be scalar subqueries."""
    ends = [F.lit(end) if isinstance(end, date) else end for end in (first, last)]
    span = F.sequence(*ends, F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(span).alias("FullDate"))


def dim_date(
    spark: SparkSession, first: date | Column = FIRST_DAY, last: date | Column = LAST_DAY
) -> DataFrame:
    """Calendar attributes per day; weeks start on Sunday (day 1)."""
    day = F.col("FullDate")
    return calendar_days(spark, first, last).select(
        day,
        date_key("FullDate").alias("DateKey"),
        F.year(day).alias("Year"),
        F.quarter(day).alias("Quarter"),
        F.month(day).alias("Month"),
        F.date_format(day, "MMMM").alias("MonthName"),
        F.dayofmonth(day).alias("Day"),
        F.dayofweek(day).alias("DayOfWeek"),
        F.date_format(day, "EEEE").alias("DayName"),
        F.dayofweek(day).isin(1, 7).alias("IsWeekend"),
    )
