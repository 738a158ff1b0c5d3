"""J05 kept up to date: the profile's window moves by adding new days and taking off old ones.

Measures are folded to (customer, day) and usage to (customer, device, country, day) once, when their rows
arrive, and kept in logs partitioned by spans of days. Beside them lie the sums over the window. An advance folds
the new rows only, adds those inside the new window, and adds or takes off the logged days on which the old and
the new window differ; facts are never read again. Late rows, repeated runs and alerts ahead of the
sessions' clock come out as they do in a profile of all facts.

Amounts and scores are summed as decimals: taking off a day leaves exactly what never adding it would.
Distinct devices are counted exactly, as usage whose sessions inside the window have not all gone.

One state row names the folder of the sums and the batch it stands for; it is published last. A lost advance
is repeated under the same batch number and overwrites its own folders.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tallyweir import model
from tallyweir.operators.customer_metrics import device_signals, flag_usage
from tallyweir.operators.windows import WINDOW_DAYS
from tallyweir.plans.risk_profile import SCORE_TOTAL, SCORED, profile_of
from tallyweir.sinks.tables import Lake, overwrite
from tallyweir.sources.tables import rows_frame

STATE = "profile_state"
_BATCH, _SPAN, _DAY = "_batch", "_span", "day"
# Days of a partition of the logs, which hold their rows in order of the day.
SPAN_DAYS = 32
# A clock drives the window of the rows folded under it.
TRANSACTIONS, SESSIONS = "transactions", "sessions"

_EXACT = "decimal(38,10)"
MEASURES = {
    "TransactionCount": "bigint", "Amount": _EXACT, "UnknownAmounts": "bigint", "EndlessAmounts": "bigint",
    "HighRisk": "bigint", "ScoreTotal": _EXACT, "Scored": "bigint", "Alerts": "bigint",
}
USAGE_KEY = ("CustomerID", "DeviceID", "GeoCountry")
USAGE = {"Sessions": "bigint", "FailedLogins": "bigint"}

STATE_SCHEMA = T.StructType([
    T.StructField("batch", T.IntegerType()), T.StructField("days", T.IntegerType()),
    T.StructField("transactions_last", T.IntegerType()), T.StructField("sessions_last", T.IntegerType()),
    T.StructField("folder", T.StringType()),
])


class State(NamedTuple):
    """The latest batch taken, the window's length, the last day of each clock, and where the sums lie."""

    batch: int
    days: int
    transactions_last: int | None
    sessions_last: int | None
    folder: str | None

    def window(self, clock: str) -> tuple[int, int] | None:
        """First and last day of the clock's window."""
        last = self.transactions_last if clock == TRANSACTIONS else self.sessions_last
        return None if last is None else (last - self.days + 1, last)


def _day(moment: str) -> Column:
    return F.unix_date(F.col(moment).cast("date"))


def _schema(columns: dict[str, str], *keys: str) -> str:
    return ", ".join([*(f"{key} string" for key in keys), *(f"{name} {kind}" for name, kind in columns.items())])


def _summed(df: DataFrame, columns: dict[str, str], *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(name).cast(kind).alias(name) for name, kind in columns.items()))


def daily_measures(fact_transactions: DataFrame, fact_alerts: DataFrame) -> DataFrame:
    """(CustomerID, clock, day) with summable measures; rows without a moment are on no day."""
    amount = F.col("Amount")
    unknown = F.coalesce(F.isnan(amount), F.lit(False))
    endless = F.coalesce(F.abs(amount) == float("inf"), F.lit(False))
    none = F.lit(0).cast("bigint")
    spent = fact_transactions.select(
        "CustomerID", F.lit(TRANSACTIONS).alias("clock"), _day("TransactionTimestamp").alias(_DAY),
        F.lit(1).cast("bigint").alias("TransactionCount"),
        F.when(~(unknown | endless), amount).try_cast(_EXACT).alias("Amount"),
        unknown.cast("bigint").alias("UnknownAmounts"), endless.cast("bigint").alias("EndlessAmounts"),
        F.coalesce(F.col("RiskBand").isin(*model.ELEVATED_BANDS), F.lit(False)).cast("bigint").alias("HighRisk"),
        F.col("RiskScore").try_cast(_EXACT).alias("ScoreTotal"),
        F.col("RiskScore").isNotNull().cast("bigint").alias("Scored"), none.alias("Alerts"),
    )
    alerted = fact_alerts.select(
        "CustomerID", F.lit(SESSIONS).alias("clock"), _day("AlertTimestamp").alias(_DAY),
        F.lit(1).cast("bigint").alias("Alerts"),
    )
    both = spent.unionByName(alerted, allowMissingColumns=True).where(F.col(_DAY).isNotNull())
    folded = _summed(both, MEASURES, "CustomerID", "clock", _DAY)
    return folded.fillna(0, [name for name, kind in MEASURES.items() if kind == "bigint"])


def daily_usage(fact_sessions: DataFrame) -> DataFrame:
    """(CustomerID, DeviceID, GeoCountry, day) with sessions and those with a failed login."""
    failed = F.coalesce(F.col("AuthFailedAttempts") > 0, F.lit(False))
    rows = fact_sessions.select(
        *USAGE_KEY, _day("LoginTimestamp").alias(_DAY),
        F.lit(1).cast("bigint").alias("Sessions"), failed.cast("bigint").alias("FailedLogins"),
    )
    return _summed(rows.where(F.col(_DAY).isNotNull()), USAGE, *USAGE_KEY, _DAY)


def _between(first: int, last: int) -> Column:
    """Days from ``first`` to ``last``: the partitions to open, and the rows in them."""
    return F.col(_SPAN).between(first // SPAN_DAYS, last // SPAN_DAYS) & F.col(_DAY).between(first, last)


def _inside(window: tuple[int, int] | None) -> Column:
    return F.lit(False) if window is None else _between(*window)


def _moved(before: tuple[int, int] | None, after: tuple[int, int] | None) -> Column:
    """1 for a day that the window gained, -1 for one that it lost, 0 for all others."""
    return _inside(after).cast("bigint") - _inside(before).cast("bigint")


def _differs(before: tuple[int, int] | None, after: tuple[int, int] | None) -> Column:
    """Days on which the windows differ, as ranges that a scan can prune by."""
    if before is None or after is None:
        return _inside(before) | _inside(after)
    if before == after:
        return F.lit(False)
    (b0, b1), (a0, a1) = before, after
    return _between(min(a0, b0), max(a0, b0) - 1) | _between(min(a1, b1) + 1, max(a1, b1))


class DailyProfile:
    """The profile's state in a lake; ``advance`` takes new rows of the facts, ``profile`` tells the result."""

    def __init__(self, lake: Lake, days: int = WINDOW_DAYS):
        self.lake, self.days = lake, days
        self.root = f"{lake.root}/{lake.schema}/daily_profile"

    def state(self) -> State:
        if not self.lake.exists(STATE):
            return State(0, self.days, None, None, None)
        return State(*self.lake.read(STATE).first())

    def _log(self, name: str, columns: dict[str, str], *keys: str) -> DataFrame:
        schema = f"{_schema(columns, *keys)}, {_DAY} int, {_BATCH} int, {_SPAN} int"
        return self.lake.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")

    def _logged(self, name: str, folded: DataFrame, batch: int) -> None:
        spans = folded.withColumn(_SPAN, F.floor(F.col(_DAY) / SPAN_DAYS).cast("int")).hint("rebalance", F.col(_SPAN))
        spans.sortWithinPartitions(_SPAN, _DAY).write.mode("overwrite").partitionBy(_SPAN).parquet(f"{self.root}/{name}/{_BATCH}={batch}")

    def _sums(self, state: State, name: str, schema: str) -> DataFrame:
        spark = self.lake.spark
        if state.folder is None:
            return rows_frame(spark, [], T.StructType.fromDDL(schema))
        return spark.read.schema(schema).parquet(f"{state.folder}/{name}")

    def advance(self, transactions: DataFrame, sessions: DataFrame, alerts: DataFrame) -> State:
        """Take the rows of the facts that are new since the last advance, whatever their moments."""
        before = self.state()
        if before.days != self.days:
            raise ValueError(f"the state was kept for windows of {before.days} days")
        batch = before.batch + 1
        self._logged("measures", daily_measures(transactions, alerts), batch)
        self._logged("usage", daily_usage(sessions), batch)
        measures = self._log("measures", MEASURES, "CustomerID", "clock")
        usage = self._log("usage", USAGE, *USAGE_KEY)
        new = F.col(_BATCH) == batch
        # Later batches can only be left-overs of an advance that was lost.
        old = F.col(_BATCH) < batch

        spent = measures.where(new & (F.col("clock") == TRANSACTIONS)).agg(F.max(_DAY)).first()[0]
        used = usage.where(new).agg(F.max(_DAY)).first()[0]
        latest = lambda a, b: max((x for x in (a, b) if x is not None), default=None)
        after = State(batch, self.days, latest(before.transactions_last, spent), latest(before.sessions_last, used),
                      f"{self.root}/sums/{uuid.uuid4().hex}")

        windows = {clock: (before.window(clock), after.window(clock)) for clock in (TRANSACTIONS, SESSIONS)}
        clocked = {clock: F.col("clock") == clock for clock in windows}
        gained = reduce(Column.__or__, (clocked[c] & _inside(w[1]) for c, w in windows.items()))
        differs = reduce(Column.__or__, (clocked[c] & _differs(*w) for c, w in windows.items()))
        sign = F.when(clocked[TRANSACTIONS], _moved(*windows[TRANSACTIONS])).otherwise(_moved(*windows[SESSIONS]))
        self._moved_sums(before, after, "measures", MEASURES, ("CustomerID",), [
            measures.where(new & gained),
            _times(measures.where(old & differs), MEASURES, sign),
        ])
        self._moved_sums(before, after, "usage", USAGE, USAGE_KEY, [
            usage.where(new & _inside(windows[SESSIONS][1])),
            _times(usage.where(old & _differs(*windows[SESSIONS])), USAGE, _moved(*windows[SESSIONS])),
        ])
        named = [df.select("CustomerID") for df in (transactions, sessions, alerts)]
        known = self._sums(before, "customers", "CustomerID string")
        everyone = reduce(DataFrame.unionByName, [known, *named]).where(F.col("CustomerID").isNotNull()).distinct()
        everyone.write.parquet(f"{after.folder}/customers")
        overwrite(self.lake, rows_frame(self.lake.spark, [tuple(after)], STATE_SCHEMA), STATE)
        return after

    def _moved_sums(
        self, before: State, after: State, name: str, columns: dict[str, str], keys: tuple[str, ...], changes: list[DataFrame]
    ) -> None:
        schema = _schema(columns, *keys)
        stacked = [self._sums(before, name, schema), *(df.select(*keys, *columns) for df in changes)]
        summed = _summed(reduce(DataFrame.unionByName, stacked), columns, *keys)
        counted = ("TransactionCount", "Alerts") if name == "measures" else ("Sessions",)
        summed.where(reduce(Column.__or__, (F.col(c) != 0 for c in counted))).write.parquet(f"{after.folder}/{name}")

    def profile(self, devices: DataFrame) -> DataFrame:
        """The profile as of the last advance, beside the devices as they are now."""
        state = self.state()
        sums = self._sums(state, "measures", _schema(MEASURES, "CustomerID"))
        # A total that holds a NaN is one, and reads as 0.0 like a missing one.
        total = (
            F.when(F.col("UnknownAmounts") > 0, F.lit(float("nan")))
            .when(F.col("EndlessAmounts") > 0, F.lit(float("inf")))
            .otherwise(F.col("Amount").cast("double"))
        )
        scored = F.col("Scored") > 0
        measured = sums.select(
            "CustomerID",
            F.col("TransactionCount").alias("TransactionCount30D"), total.alias("TotalTransactionAmount30D"),
            F.col("HighRisk").alias("HighRiskTransactionCount"), F.col("Alerts").alias("FraudAlertCount"),
            F.when(scored, F.col("ScoreTotal").cast("double")).alias(SCORE_TOTAL), F.col("Scored").alias(SCORED),
        )
        usage = self._sums(state, "usage", _schema(USAGE, *USAGE_KEY)).drop("Sessions")
        return profile_of((
            self._sums(state, "customers", "CustomerID string"),
            measured,
            device_signals(flag_usage(usage, devices)),
            devices.select(F.col("customerId").alias("CustomerID")),
        ))


def _times(df: DataFrame, columns: dict[str, str], sign: Column) -> DataFrame:
    """The rows with every measure taken off, added, or left out as ``sign`` says."""
    return df.withColumn("_sign", sign).where(F.col("_sign") != 0).withColumns(
        {name: (F.col(name) * F.col("_sign")).cast(kind) for name, kind in columns.items()}
    )
