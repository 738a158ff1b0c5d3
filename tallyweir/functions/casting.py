"""Casts that turn bad input into NULL, so that the quality rules can quarantine it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

_PLAIN = r"[A-Za-z_][A-Za-z0-9_]{0,254}"
_IDENTIFIER = re.compile(_PLAIN)


def cast_if_present(df: DataFrame, column: str, to: str) -> DataFrame:
    """cast a column where the frame has it, leave the frame alone otherwise.

    ``try_cast`` because ANSI mode raises on text like ``abc`` where a NULL is wanted.
    """
    present = {name.lower() for name in df.columns}
    if column.lower() not in present:
        return df
    return df.withColumn(column, F.col(column).try_cast(to))


def cast_timestamps(df: DataFrame, *columns: str) -> DataFrame:
    """make the named columns zoned timestamps, whatever they arrived as."""
    for column in columns:
        df = cast_if_present(df, column, "timestamp")
    return df


def json_scalar(document: str, path: str, to: str = "string") -> Column:
    """One scalar out of a JSON text column; missing, malformed or uncastable reads as NULL."""
    value = F.get_json_object(F.col(document), f"$.{path}")
    return value if to == "string" else value.try_cast(to)


def is_identifier(column: str) -> Column:
    """F16 over a column of names; NULL stays NULL."""
    return F.col(column).rlike(rf"\A{_PLAIN}\z")


def quoted(column: str) -> Column:
    """The back-quoted name, NULL where it is no plain identifier."""
    return F.when(is_identifier(column), F.concat(F.lit("`"), F.col(column), F.lit("`")))


def quoted_identifier(name: str) -> str:
    """F16: back-quoted table or schema name, refused unless it is a plain identifier."""
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not a safe identifier: {name!r}")
    return f"`{name}`"
