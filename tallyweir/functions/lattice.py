"""Kinds of JSON values, how two of them meet, and how a value reads as the kind they met at.

A value is a whole or fractional number, a text, a boolean, an object or an array. Whole and fractional
numbers meet at fractional ones; objects and arrays are kept as JSON text and meet only their own kind.
Any other two kinds conflict: the column keeps its kind, and a value of another one reads as NULL.
"""

from __future__ import annotations

from collections.abc import Set

from pyspark.sql import Column, functions as F

# Column type of each kind of value; the order decides where one load brings several that conflict.
KINDS = {
    "whole": "bigint",
    "fractional": "double",
    "boolean": "boolean",
    "text": "string",
    "object": "string",
    "array": "string",
}
# Pairs of kinds that a wider one holds, and that one.
WIDENED = {frozenset(("whole", "fractional")): "fractional"}
ABSENT = "null"


# Kind of each type that a variant tells, without its parameters.
TYPES = {
    "BIGINT": "whole", "DECIMAL": "fractional", "DOUBLE": "fractional", "FLOAT": "fractional",
    "BOOLEAN": "boolean", "STRING": "text", "OBJECT": "object", "ARRAY": "array",
}


def kind_of(value: Column) -> Column:
    """Kind of a variant; ``null`` for a JSON null and for NULL.

    A whole number beyond 64 bits, or written with a fraction or an exponent, is fractional. The type is asked
    for once: it takes a walk through the whole value.
    """
    own = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    kinds = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, own), F.lit(ABSENT))


def join_kinds(before: str | None, after: str | None) -> tuple[str | None, bool]:
    """Kind that holds both, and whether they conflict; in a conflict the earlier one stays.

    None is a property without a value so far; it meets anything.
    """
    if before is None or after is None or before == after:
        return before or after, False
    for narrow, wide in WIDENED.items():
        if {before, after} <= narrow | {wide}:
            return wide, False
    return before, True


def join_all(kinds: Set[str]) -> tuple[str | None, bool]:
    """Kind of a property whose values in one load have these kinds, and whether any conflict.

    A load has no order to say which came first: the kind first in ``KINDS`` stays, so that the same
    documents always give the same columns.
    """
    met, conflict = None, False
    for kind in KINDS:
        if kind in kinds:
            met, clash = join_kinds(met, kind)
            conflict = conflict or clash
    return met, conflict


def read_as(value: Column, kind: str) -> Column:
    """The variant as the column type of ``kind``; NULL if it is of a kind that this one doesn't hold."""
    narrow = [k for kinds, wide in WIDENED.items() if wide == kind for k in kinds]
    held = kind_of(value).isin(kind, *narrow)
    if kind in ("object", "array"):
        return F.when(held, F.to_json(value))
    return F.when(held, F.try_variant_get(value, "$", KINDS[kind]))
