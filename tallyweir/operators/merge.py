"""Merges, document upserts and snapshot comparison as joins and aggregates.

Each takes the target as a frame and returns the new target; ``sinks.tables.overwrite`` publishes it
to a new folder, so a merge may read the table it replaces.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyweir import model
from tallyweir.operators.skew import HEAVY_INPUT_BYTES, heavy_keys, left_lookup, mark_members
from tallyweir.session import scan_size

_KNOWN = "_known"
_MATCHED = "_matched"
_ROWS = "_source_rows"
_NEW = "_new_"
_DEALT = "_dealt"


def merge_insert_missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target plus the source rows whose key it lacks. NULL keys match nothing, so they are inserted.

    The target's keys are cut to those of the source first: with a source small enough for Spark to
    broadcast, the target is scanned for one column and not shuffled.
    """
    asked = source.select(key).where(F.col(key).isNotNull()).distinct()
    known = target.select(key).join(asked, key, "left_semi")
    marked = mark_members(source, known, key, _KNOWN, heavy_keys(source, key))
    return target.unionByName(marked.where(~F.col(_KNOWN)).drop(_KNOWN))


def merge_update_matched(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target rows take all columns of the source row with their key; other source rows are ignored.

    A NULL in the matched source row overwrites. Two source rows for one target row are ambiguous
    and stop the job.
    """
    columns = [name for name in target.columns if name.lower() != key.lower()]
    folded = (
        source.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias(_ROWS),
            *(F.first(name).alias(_NEW + name) for name in columns),
        )
    )
    ambiguous = F.concat(F.lit(f"several source rows match {key} "), F.col(key).cast("string"))
    matched = F.when(F.col(_ROWS) > 1, F.raise_error(ambiguous).cast("boolean")).otherwise(
        F.col(_ROWS).isNotNull()
    )
    # A heavy key of the target can only hurt beside a source too large to broadcast.
    size = scan_size(source)
    small = size.complete and size.known_bytes < HEAVY_INPUT_BYTES
    joined = left_lookup(target, folded, key, () if small else heavy_keys(target, key))
    updated = {
        name: F.when(F.col(_MATCHED), F.col(_NEW + name)).otherwise(F.col(name)) for name in columns
    }
    # The filter keeps the ambiguity check even where later plans drop columns.
    return (
        joined.withColumn(_MATCHED, matched)
        .where(F.col(_MATCHED).isNotNull())
        .select(*(updated[name].alias(name) if name in updated else F.col(name) for name in target.columns))
    )


def latest_documents(
    versions: DataFrame, written: Sequence[str | Column], keys: Sequence[str] = model.DOCUMENT_KEY
) -> DataFrame:
    """Last write per document key, in the order of ``written``; equal moments fall back to a hash of the content.

    An aggregate rather than a ranking window: copies of one document fold before they are brought together,
    so a key with any number of versions never lands whole in one task. The fold sorts what it is given. Versions
    are therefore dealt out first, in parts of a bounded size that Spark may split within a key; splits of a
    compressed log hold any amount.
    """
    order = [F.col(item) if isinstance(item, str) else item for item in written]
    names = [item for item in written if isinstance(item, str)]
    body = [name for name in versions.columns if name not in names and name not in keys]
    document = F.struct(*(F.col(f"`{name}`") for name in body))
    # A hash as tie-breaker instead of the document, which the buffer would then hold twice.
    newest = F.max_by(document, F.struct(*order, F.xxhash64(F.to_json(document))))
    # By a hash, which is no key to Spark: the parts of a key that it splits meet after the fold.
    dealt = versions.withColumn(_DEALT, F.xxhash64(*keys)).hint("rebalance", F.col(_DEALT))
    kept = dealt.groupBy(*keys).agg(newest.alias("_document")).select(*keys, "_document.*")
    return kept.select(*(F.col(f"`{name}`") for name in versions.columns if name not in names))


def upsert_documents(
    target: DataFrame, batch: DataFrame, written: Sequence[str] = (),
    keys: Sequence[str] = model.DOCUMENT_KEY,
) -> DataFrame:
    """Replace or add whole documents by (partition key, id); fields a new version omits become NULL.

    ``written`` are columns of the batch giving its load order; they are not part of the document.
    The same id under another partition key is another document. The batch is folded to one version
    per key first, so the target is only probed: with a batch that fits a broadcast it is not shuffled.
    """
    newest = latest_documents(batch, written, keys)
    untouched = target.join(newest.select(*keys), list(keys), "left_anti")
    added = [name for name in newest.columns if name not in target.columns]
    return untouched.unionByName(newest, allowMissingColumns=True).select(*target.columns, *added)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """What each key went through between two snapshots: insert, update or delete.

    Rows are compared whole and NULL-safe, by a 128-bit content hash. A union and one aggregate
    instead of a full outer join: only key and hash travel, folded map-side. Keys may repeat: then
    their row multisets are compared.
    """
    if dict(before.dtypes) != dict(after.dtypes):
        raise ValueError("snapshots of different columns or types: every row would read as changed")
    keys = [key] if isinstance(key, str) else list(key)
    measures = ("_before", "_after", "_before_hash", "_after_hash", "_before_check", "_after_check")

    def side(df: DataFrame, is_after: bool) -> DataFrame:
        # Values as they are stored, to the microsecond; a hash skips NULLs, so each says whether it is one.
        content = [c for name in sorted(df.columns) for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
        values = (F.lit(1), F.xxhash64(*content), F.xxhash64(F.lit("check"), *content))
        zero = F.lit(0)
        columns = [
            (value if of_after == is_after else zero).cast("decimal(38,0)")
            for value in values for of_after in (False, True)
        ]
        return df.select(*keys, *(c.alias(name) for c, name in zip(columns, measures)))

    both = (
        side(before, False).unionByName(side(after, True))
        .groupBy(*keys).agg(*(F.sum(name).alias(name) for name in measures))
    )
    same = reduce(
        Column.__and__, (F.col(measures[i]) == F.col(measures[i + 1]) for i in (0, 2, 4))
    )
    change = (
        F.when(F.col("_before") == 0, "insert")
        .when(F.col("_after") == 0, "delete")
        .when(~same, "update")
    )
    return both.select(*keys, change.alias("change")).where(F.col("change").isNotNull())
