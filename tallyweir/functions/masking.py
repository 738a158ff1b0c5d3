"""Column masks of the governed views."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Visible prefix length and the two mask texts.
VISIBLE_PREFIX = 5
PARTIAL_MASK = "XXXXXX"
FULL_MASK = "XXXX"


def partial_mask(column: str | Column, visible: int = VISIBLE_PREFIX) -> Column:
    """Keep the first characters, mask the rest; a value too short to split is masked whole."""
    value = F.col(column) if isinstance(column, str) else column
    shown = F.when(F.length(value) > visible, F.substring(value, 1, visible)).otherwise("")
    return F.when(value.isNotNull(), F.concat(shown, F.lit(PARTIAL_MASK)))


def full_mask(column: str | Column) -> Column:
    """Hide the value, keep whether there is one."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value.isNotNull(), F.lit(FULL_MASK))
