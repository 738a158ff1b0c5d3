"""the fail-closed split every Silver table goes through."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

VALID = "_is_valid"
REASON = "_quarantine_reason"
RULE_VIOLATION = "silver_quality_rule_violation"


class Split(NamedTuple):
    valid: DataFrame
    quarantined: DataFrame


def fail_closed(rule: Column) -> Column:
    """A rule that cannot be evaluated counts as broken."""
    return F.coalesce(rule, F.lit(False))


def with_verdict(df: DataFrame, rule: Column, reason: str = RULE_VIOLATION) -> DataFrame:
    """Every input row, tagged; one scan serves both halves when written partitioned by the tag."""
    return df.withColumn(VALID, fail_closed(rule)).withColumn(
        REASON, F.when(~F.col(VALID), F.lit(reason))
    )


def quarantine_split(df: DataFrame, rule: Column, reason: str = RULE_VIOLATION) -> Split:
    """(valid, quarantined), together exactly the input; the second half carries the reason."""
    passes = fail_closed(rule)
    return Split(
        valid=df.where(passes),
        quarantined=df.where(~passes).withColumn(REASON, F.lit(reason)),
    )
