"""Joins that hold up when one key owns a large share of the rows.

AQE splits an oversized partition of a sort-merge or shuffled-hash join only where the join sits
directly on the two exchanges, and only on sides the join type lets it split. Three cases fall
outside that and are handled here:

* the right side is deduplicated on the join key (an aggregate sits between exchange and join):
  ``left_lookup`` answers the heavy keys of the left side by a broadcast of at most one row per key;
* a left join whose *right* side has a heavy key: ``left_fanout`` joins those keys as an inner join,
  which AQE may split on either side;
* a deduplicated right side much smaller than the left: ``spread_lookup`` gives it an exchange of its
  own, after which AQE splits the left side, and salts on request.

Heavy keys come from a mergeable frequent-items sketch: one pass over one column, no shuffle of
keys, and a result bounded by ``MAX_HEAVY_KEYS`` whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyweir.session import scan_size

MAX_HEAVY_KEYS = 1_000
TRACKED_KEYS = 20_000
# A key below this many rows fits one task; an input below this many bytes cannot hold a harmful one.
HEAVY_ROWS = 1_000_000
HEAVY_INPUT_BYTES = 1 << 30

SALTS = 1
_SALT = "_salt"


def heavy_keys(
    df: DataFrame, key: str, min_rows: int = HEAVY_ROWS, min_bytes: int = HEAVY_INPUT_BYTES
) -> list:
    """Keys owning at least ``min_rows`` rows (None for NULL), at most ``MAX_HEAVY_KEYS`` of them.

    Correctness never depends on the answer: any list gives the same join result. An input of
    unknown size is looked at.
    """
    scanned = scan_size(df)
    if scanned.complete and scanned.known_bytes < min_bytes:
        return []
    sketch = df.select(
        F.expr(f"approx_top_k(`{key}`, {MAX_HEAVY_KEYS}, {TRACKED_KEYS})").alias("top")
    )
    found = sketch.select(F.inline("top")).where(F.col("count") >= min_rows).select("item")
    return [row["item"] for row in found.collect()]


def _is_heavy(key: str, heavy: Sequence) -> Column:
    named = [value for value in heavy if value is not None]
    is_named = F.col(key).isin(named) if named else F.lit(False)
    is_null = F.col(key).isNull() if None in heavy else F.lit(False)
    return F.coalesce(is_named, F.lit(False)) | is_null


def left_lookup(left: DataFrame, right: DataFrame, key: str, heavy: Sequence = ()) -> DataFrame:
    """Left join to a right side holding at most one row per key; ``heavy`` are keys of the left.

    The heavy part is broadcast: at most one row for each of the bounded heavy keys.
    """
    if not heavy:
        return left.join(right, key, "left")
    hot = _is_heavy(key, heavy)
    hot_right = F.broadcast(right.where(hot))
    return (
        left.where(~hot).join(right.where(~hot), key, "left")
        .unionByName(left.where(hot).join(hot_right, key, "left"))
    )


def left_fanout(left: DataFrame, right: DataFrame, key: str, heavy: Sequence = ()) -> DataFrame:
    """Left join keeping every match; ``heavy`` are keys of the right, in a bounded list.

    A listed key that the right lacks costs nothing but its look-up: its left rows come back unmatched.
    """
    if not heavy:
        return left.join(right, key, "left")
    hot = _is_heavy(key, [value for value in heavy if value is not None])
    # One row for each listed key at most.
    present = F.broadcast(right.where(hot).select(key).distinct())
    return (
        left.where(~hot).join(right.where(~hot), key, "left")
        .unionByName(left.where(hot).join(right.where(hot), key, "inner"))
        .unionByName(left.where(hot).join(present, key, "left_anti"), allowMissingColumns=True)
    )


def spread_lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_on: Sequence[str],
    salts: int = SALTS,
) -> DataFrame:
    """Left join to a deduplicated right side through exchanges AQE can split.

    The salt makes the join key differ from the key the right side was grouped on, so the right gets
    an exchange of its own and a heavy key of the left is split at run time. With more than one salt
    a heavy key is also spread up front, at the price of repeating the right side; the salt is a
    hash of ``spread_on`` columns of the left row, so a retried task repeats it.
    """
    salt = F.pmod(F.xxhash64(*spread_on), F.lit(salts)).cast("int")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        left.withColumn(_SALT, salt)
        .join(right.withColumn(_SALT, every_salt), [*keys, _SALT], "left")
        .drop(_SALT)
    )


def mark_members(
    left: DataFrame, members: DataFrame, key: str, flag: str, heavy: Sequence = ()
) -> DataFrame:
    """Every left row, with ``flag`` true where its key occurs among ``members`` (never NULL).

    The member keys are deduplicated first (map-side combine folds copies), so nothing fans out.
    """
    known = members.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    found = left_lookup(left, known, key, heavy)
    return found.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).select(*left.columns, flag)
