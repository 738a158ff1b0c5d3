"""Source validation as aggregates.

A profile is one scan and one aggregate per table. Uniqueness is counted by grouping on the key,
which folds copies map-side, instead of a count-distinct beside the other measures, which would
expand every row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyweir import model
from tallyweir.operators.counts import row_counts
from tallyweir.operators.skew import heavy_keys, mark_members

_KNOWN = "_known"


class CheckFailed(RuntimeError):
    """A gate or a validation found violations."""


def _violations(rule: Column) -> Column:
    """Rows breaking a rule; a row the rule cannot judge breaks it."""
    return F.count_if(~F.coalesce(rule, F.lit(False)))


def null_counts(columns: Sequence[str]) -> list[Column]:
    """V03 measures."""
    return [F.count_if(F.col(name).isNull()).alias(f"null_{name}") for name in columns]


def prefix_violations(columns: Sequence[str]) -> list[Column]:
    """V07 measures: keys that do not start with their prefix."""
    return [
        _violations(F.col(name).startswith(model.KEY_PREFIXES[name])).alias(f"bad_{name}")
        for name in columns
    ]


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """A10: keys occurring more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """One row with total rows, distinct non-NULL keys, and whether every row has its own key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.count(key).alias("distinct_keys"),
    ).withColumn("is_unique", F.col("total") == F.col("distinct_keys"))


def distinct_keys(df: DataFrame, key: str) -> Column:
    """Distinct non-NULL keys as a scalar subquery, beside the one-pass measures."""
    return df.select(key).distinct().agg(F.count(key)).scalar().alias(f"distinct_{key}")


def transactions_profile(transactions: DataFrame) -> DataFrame:
    """A08, V03, V05, V07 for transactions, in one pass."""
    keys = ("TransactionID", "CustomerID", "AccountID", "MerchantID", "DeviceID")
    amount = F.col("Amount").try_cast("double")
    measured = transactions.agg(
        F.count(F.lit(1)).alias("total"),
        *null_counts(keys),
        *prefix_violations(keys),
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
        _violations(amount > 0).alias("non_positive_amount"),
        F.count_if(amount >= model.AMOUNT_CEILING).alias("outlier_amount"),
    )
    return measured.select("*", distinct_keys(transactions, "TransactionID"))


def risk_profile_checks(risk: DataFrame) -> DataFrame:
    """A08, V03, V05 for risk scores, in one pass; a missing band is a bad band."""
    measured = risk.agg(
        F.count(F.lit(1)).alias("total"),
        *null_counts(["TransactionID"]),
        F.min("RiskScore").alias("min_score"),
        F.max("RiskScore").alias("max_score"),
        _violations(F.col("RiskScore").between(0, 100)).alias("out_of_range"),
        _violations(F.col("RiskBand").isin(*model.RISK_BANDS)).alias("bad_band"),
    )
    return measured.select("*", distinct_keys(risk, "TransactionID"))


def merchants_profile(merchants: DataFrame) -> DataFrame:
    """A08, V03 for merchants."""
    measured = merchants.agg(F.count(F.lit(1)).alias("total"), *null_counts(["MerchantID"]))
    return measured.select("*", distinct_keys(merchants, "MerchantID"))


def orphans(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key is unknown to the parent; a NULL key is unknown."""
    return (
        mark_members(df, parent, key, _KNOWN, heavy_keys(df, key)).where(~F.col(_KNOWN)).drop(_KNOWN)
    )


def orphan_counts(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Orphan rows and distinct orphan ids.

    Rows are folded per key before the lookup: only distinct keys travel, each once.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    unknown = mark_members(per_key, parent, key, _KNOWN).where(~F.col(_KNOWN))
    return unknown.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"),
        F.count(key).alias("orphan_ids"),
    )


def id_differences(expected: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, as ``missing`` (expected, not live) or ``unexpected``.

    Both sides are stacked and folded by id: one shuffle, and copies of an id fold map-side.
    """
    def side(df: DataFrame, is_live: bool) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(
            key, F.lit(not is_live).alias("_expected"), F.lit(is_live).alias("_live")
        )

    seen = (
        side(expected, False).unionByName(side(live, True)).groupBy(key)
        .agg(F.bool_or("_expected").alias("_expected"), F.bool_or("_live").alias("_live"))
    )
    return seen.where(F.col("_expected") != F.col("_live")).select(
        key, F.when(F.col("_expected"), "missing").otherwise("unexpected").alias("difference")
    )


def document_violations(documents: DataFrame, container: str) -> DataFrame:
    """One row per check with its violations, over every document rather than a sample."""
    required = [F.col(name).isNull() for name in model.REQUIRED_FIELDS[container]]
    device = (
        F.get_json_object("device", "$.deviceId") if container == "digitalSessions"
        else F.col("deviceId") if container == "devices"
        else F.lit(None).cast("string")
    )
    badly_keyed = device.isNotNull() & ~device.rlike(model.DEVICE_ID_PATTERN)
    measured = documents.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(reduce(Column.__or__, required)).alias("missing_required"),
        _violations(F.col("customerId").rlike(model.CUSTOMER_ID_PATTERN)).alias("bad_customer_id"),
        F.count_if(badly_keyed).alias("bad_device_id"),
    )
    return measured.select(F.lit(container).alias("container"), "*")


def schema_variation(documents: DataFrame, container: str) -> DataFrame:
    """Is the optional field present on some, but not all, documents."""
    field = model.OPTIONAL_FIELD[container]
    return documents.agg(
        F.count(field).alias("with_field"), F.count(F.lit(1)).alias("documents")
    ).select(
        F.lit(container).alias("container"),
        F.lit(field).alias("field"),
        "with_field",
        "documents",
        ((F.col("with_field") > 0) & (F.col("with_field") < F.col("documents"))).alias("varies"),
    )


def document_checks(
    containers: Mapping[str, DataFrame], expected: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """V08 together: (check, violations) over every document of the containers; ``require_clean`` raises on it.

    Required fields, customer and device patterns, ids that occur more than once over all partition
    keys, an optional field that is on all documents or none, and, for containers with ``expected``
    ids, what is missing or unexpected.
    """
    def counted(rows: DataFrame, container: str, label: str) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(f"{container}: {label}").alias("check"), "violations"
        )

    parts = []
    for container, documents in containers.items():
        measured = document_violations(documents, container)
        labels = {"missing_required": "required fields present", "bad_customer_id": "customerId well formed",
                  "bad_device_id": "deviceId well formed"}
        pairs = F.array(*(
            F.struct(F.lit(f"{container}: {label}").alias("check"), F.col(name).cast("bigint").alias("violations"))
            for name, label in labels.items()
        ))
        parts += [measured.select(F.inline(pairs)), counted(duplicate_keys(documents, "id"), container, "id unique")]
        if container in model.OPTIONAL_FIELD:
            uniform = schema_variation(documents, container).where(~F.col("varies"))
            parts.append(counted(uniform, container, f"{model.OPTIONAL_FIELD[container]} varies"))
        if expected and container in expected:
            both = id_differences(expected[container], documents, "id")
            for kind in ("missing", "unexpected"):
                parts.append(counted(both.where(F.col("difference") == kind), container, f"no {kind} ids"))
    return reduce(DataFrame.unionByName, parts)


def gate_nonempty(frames: Mapping[str, DataFrame]) -> dict[str, int]:
    """Rows per table, all counted in one job; an empty table stops the run."""
    counted = {row["table_name"]: row["row_count"] for row in row_counts(frames).collect()}
    empty = [name for name in frames if counted[name.lower()] == 0]
    if empty:
        raise CheckFailed(f"queryable but empty: {', '.join(empty)}")
    return {name: counted[name.lower()] for name in frames}


def table_checks(transactions: DataFrame, risk: DataFrame, merchants: DataFrame) -> DataFrame:
    """V03-V07 together: (check, violations), one row per check over the three tables."""
    def unpivot(profile: DataFrame, table: str, measures: Mapping[str, str]) -> DataFrame:
        pairs = F.array(
            *(F.struct(F.lit(f"{table}: {label}").alias("check"),
                       F.col(name).cast("bigint").alias("violations"))
              for name, label in measures.items())
        )
        return profile.select(F.inline(pairs))

    keys = ("TransactionID", "CustomerID", "AccountID", "MerchantID", "DeviceID")
    parts = [
        unpivot(transactions_profile(transactions), "transactions", {
            **{f"null_{key}": f"{key} present" for key in keys},
            **{f"bad_{key}": f"{key} starts with {model.KEY_PREFIXES[key]}" for key in keys},
            "non_positive_amount": "Amount positive",
            "outlier_amount": f"Amount below {model.AMOUNT_CEILING}",
        }),
        unpivot(risk_profile_checks(risk), "risk scores", {
            "null_TransactionID": "TransactionID present",
            "out_of_range": "RiskScore within 0 and 100",
            "bad_band": "RiskBand known",
        }),
        unpivot(merchants_profile(merchants), "merchants", {"null_MerchantID": "MerchantID present"}),
    ]
    for table, frame, key in (
        ("transactions", transactions, "TransactionID"),
        ("risk scores", risk, "TransactionID"),
        ("merchants", merchants, "MerchantID"),
    ):
        repeated = uniqueness(frame, key).withColumn("repeated", F.col("total") - F.col("distinct_keys"))
        parts.append(unpivot(repeated, table, {"repeated": f"{key} unique"}))
    for table, frame, parent, key in (
        ("risk scores", risk, transactions, "TransactionID"),
        ("transactions", transactions, merchants, "MerchantID"),
    ):
        parts.append(unpivot(orphan_counts(frame, parent, key), table, {"orphan_ids": f"{key} known"}))
    return reduce(DataFrame.unionByName, parts)


def require_clean(checks: DataFrame) -> None:
    """Stop when any check of ``table_checks`` or ``document_checks`` has violations, naming them (a handful of rows)."""
    broken = checks.where(F.col("violations") > 0).collect()
    if broken:
        listed = "; ".join(f"{row['check']} ({row['violations']})" for row in broken)
        raise CheckFailed(f"{len(broken)} checks failed: {listed}")
