"""Every operator as a query over the driver's tables, beside its independent SQL statement.

Names start with the inventory id of the operator. A query without SQL returns what SQL elsewhere
cannot state (hash keys, arbitrary samples).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweir import model
from tallyweir.frames import Frames, portable, rounded_profile, without_keys
from tallyweir.functions import rules
from tallyweir.functions.casting import cast_if_present, is_identifier, quoted
from tallyweir.functions.keys import surrogate_key
from tallyweir.operators import checks, counts, customer_metrics, governance, merge, months, skew, windows
from tallyweir.operators.quality import VALID, with_verdict
from tallyweir.oracle import _exact, stated
from tallyweir.plans import audit, consumption, gold, incremental, loading, refresh, serving, silver
from tallyweir.plans.daily_profile import DailyProfile
from tallyweir.session import shared_folder
from tallyweir.sinks import keyed, tables as sinks
from tallyweir.sources import bindings, calendar, documents, evolution, tables
from tallyweir.streaming import documents as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = datetime(2026, 1, 31, tzinfo=timezone.utc)


def query(name: str, sql: str | None = None):
    """Register ``plan(frames)``; it runs over whatever folder of driver tables it is given."""
    def register(plan: Callable[[Frames], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: portable(plan(Frames(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return plan
    return register


# --- sources ----------------------------------------------------------------------------------


@query("s01_table_scan", "SELECT * FROM orders")
def _(f):
    return tables.read_table(f.spark, f"{f.sf_dir}/orders.parquet", bindings.DRIVER_SCHEMAS["orders"])


@query("s02_named_scan", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(f):
    f.driver("supplier").createOrReplaceTempView("driver_supplier")
    return tables.read_named(f.spark, "driver_supplier").select("s_suppkey", "s_name", "s_acctbal")


@query("s03_path_scan", """
SELECT event_type, count(*) AS n, true AS missing_is_none FROM events GROUP BY event_type""")
def _(f):
    events = tables.read_path(f.spark, f"{f.sf_dir}/events.parquet")
    absent = tables.read_path(f.spark, f"{f.sf_dir}/absent.parquet", on_missing="none")
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.lit(absent is None).alias("missing_is_none")
    )


def _session_files(f: Frames) -> str:
    folder = shared_folder(f.spark, "sessions") + "/digitalSessions"
    bindings.session_lines(f.sources.spread_sessions).write.text(folder)
    return folder


_ACCEPTED = "json_valid(device) AND customerId IS NOT NULL"


@query("s04_document_scan", stated(f"""
SELECT outcome, count(*) AS documents, count(DISTINCT id) AS ids FROM (
  SELECT CASE WHEN {_ACCEPTED} THEN 'accepted' ELSE 'rejected' END AS outcome,
         CASE WHEN {_ACCEPTED} THEN id END AS id FROM src_sessions)
GROUP BY outcome"""))
def _(f):
    scan = documents.read_documents(f.spark, _session_files(f), "digitalSessions", "quarantine")
    outcome = scan.accepted.select(F.lit("accepted").alias("outcome"), "id").unionByName(
        scan.rejected.select(F.lit("rejected").alias("outcome"), F.lit(None).cast("string").alias("id"))
    )
    return outcome.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("id").alias("ids")
    )


@query("s05_nested_as_text", stated(f"""
SELECT id, sessionId, customerId, device, geo, authentication, activities, sessionRiskScore,
       CAST(NULL AS VARCHAR) AS changeType
FROM src_sessions WHERE {_ACCEPTED}"""))
def _(f):
    scan = documents.read_documents(f.spark, _session_files(f), "digitalSessions", "quarantine")
    return scan.accepted.select(
        "id", "sessionId", "customerId", "device", "geo", "authentication", "activities",
        "sessionRiskScore", "changeType",
    )


# What a first load of sessions brings beside the contract, and a second one.
_FIRST_PROPERTIES = ("""concat(',"visits":', n, ',"verified":', n % 2 = 0, ',"tags":["a",', n, '],"note":null')""")
_SECOND_PROPERTIES = (
    """concat(',"visits":', if(n % 4 = 0, concat(n, '.5'), string(n)), ',"verified":', if(n % 4 = 0, '"yes"', 'true'),
              ',"tags":', if(n % 4 = 0, concat('{"t":', n, '}'), '["b"]'), ',"note":"', n, '"',
              if(n % 10 = 0, '', concat(',"campaign":{"k":', n, '}')))""")


@query("s05_evolved_documents", stated(f"""
SELECT id, sessionId, sessionRiskScore,
       CASE WHEN n % 2 = 1 OR n % 4 <> 0 THEN n ELSE n + 0.5 END::DOUBLE AS visits,
       CASE WHEN n % 2 = 1 THEN false WHEN n % 4 <> 0 THEN true END AS verified,
       CASE WHEN n % 2 = 1 THEN '["a",' || n || ']' WHEN n % 4 <> 0 THEN '["b"]' END AS tags,
       CASE WHEN n % 2 = 0 AND n % 10 <> 0 THEN '{{"k":' || n || '}}' END AS campaign,
       CASE WHEN n % 2 = 0 THEN n::VARCHAR END AS note
FROM (SELECT *, substr(id, 9)::BIGINT AS n FROM src_sessions WHERE {_ACCEPTED})
WHERE n % 2 = 0 OR n % 3 <> 0"""))
def _(f):
    """Two loads: numbers widen, booleans and arrays meet other kinds, two properties are new, one is missing at times."""
    folder, lake = shared_folder(f.spark, "evolving"), f.lake("evolving")
    accepted = f.sources.spread_sessions.where("device LIKE '%}' AND customerId IS NOT NULL")
    number = "cast(substr(id, 9) as bigint)"
    for name, condition, properties in (("first", "n % 3 <> 0", _FIRST_PROPERTIES), ("second", "n % 2 = 0", _SECOND_PROPERTIES)):
        # Chosen by the id before the line is made, which a later choice would make several times over.
        chosen = accepted.selectExpr("*", f"{number} AS n").where(condition)
        lines = bindings.session_lines(chosen, "n")
        lines = lines.selectExpr(f"concat(substr(value, 1, length(value) - 1), {properties}, '}}') AS value")
        lines.write.text(f"{folder}/{name}")
        evolution.load_evolving(lake, f"{folder}/{name}", "digitalSessions")
    return lake.read("digitalSessions").select(
        "id", "sessionId", "sessionRiskScore", "visits", "verified", "tags", "campaign", "note"
    )


@query("s06_required_tables", """
SELECT 'driver_orders' AS table_name, count(*) AS row_count FROM orders
UNION ALL SELECT 'driver_supplier', count(*) FROM supplier""")
def _(f):
    names = {"driver_orders": f.driver("orders"), "driver_supplier": f.driver("supplier")}
    for name, df in names.items():
        df.createOrReplaceTempView(name)
    tables.require_tables(f.spark, names)
    return counts.row_counts({name: f.spark.table(name) for name in names})


@query("s07_p04_calendar", """
WITH days AS (
  SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE
         AS FullDate FROM orders
), per_day AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1)
SELECT FullDate, strftime(FullDate, '%Y%m%d')::INTEGER AS DateKey, year(FullDate)::INTEGER AS "Year",
       quarter(FullDate)::INTEGER AS "Quarter", month(FullDate)::INTEGER AS "Month",
       strftime(FullDate, '%B') AS MonthName, day(FullDate)::INTEGER AS "Day",
       (dayofweek(FullDate) + 1)::INTEGER AS DayOfWeek, strftime(FullDate, '%A') AS DayName,
       dayofweek(FullDate) IN (0, 6) AS IsWeekend, coalesce(n, 0) AS transactions
FROM days LEFT JOIN per_day ON d = FullDate""")
def _(f):
    orders = f.driver("orders")
    day = F.to_date("o_orderdate")
    days = calendar.dim_date(
        f.spark, orders.select(F.min(day)).scalar(), orders.select(F.max(day)).scalar()
    )
    per_day = orders.groupBy(day.alias("FullDate")).agg(F.count(F.lit(1)).alias("transactions"))
    return days.join(per_day, "FullDate", "left").fillna(0, ["transactions"])


@query("s08_ordinals", """
SELECT unnest(range((SELECT count(*) FROM orders),
                    (SELECT count(*) FROM orders) + (SELECT count(*) FROM supplier))) AS Ordinal""")
def _(f):
    return tables.ordinals(f.spark, f.driver("orders").count(), f.driver("supplier").count())


@query("s09_rows_frame", """
SELECT 'orders' AS table_name, count(*) AS row_count, CAST(NULL AS VARCHAR) AS error_message FROM orders
UNION ALL SELECT 'events', count(*), NULL FROM events""")
def _(f):
    counted = counts.row_counts({name: f.driver(name) for name in ("orders", "events")}).collect()
    schema = model._ddl("table_name string, row_count bigint, error_message string")
    return tables.rows_frame(f.spark, [(*row, None) for row in counted], schema)


# --- sinks and merges -------------------------------------------------------------------------


@query("k01_overwrite", stated("SELECT * FROM s_merchants"))
def _(f):
    lake = f.lake("overwrite")
    sinks.overwrite(lake, f.sources.merchants.select("MerchantID"), "merchants")
    sinks.overwrite(lake, f.merchants.valid, "merchants")
    return lake.read("merchants")


@query("k02_gold_stamp", stated("""
SELECT MerchantID, MerchantName, MerchantCategory, City, State, Country, MerchantRiskCategory,
       TIMESTAMP '2026-01-31 00:00:00' AS _gold_loaded_at FROM s_merchants"""))
def _(f):
    lake = f.lake("gold")
    sinks.write_gold(lake, gold.dim_merchant(f.merchants.valid), "DimMerchant", AS_OF)
    return without_keys(lake.read("dimmerchant"))


@query("k03_append_audit", """
SELECT stage, count(*) AS n, sum(rows_read)::BIGINT AS rows_read FROM (
  SELECT 'orders' AS stage, (SELECT count(*) FROM orders) AS rows_read
  UNION ALL SELECT 'events', (SELECT count(*) FROM events)
  UNION ALL SELECT 'events', (SELECT count(*) FROM events)) GROUP BY stage""")
def _(f):
    lake = f.lake("audit")
    for name in ("orders", "events", "events"):
        audit.log_run(
            lake, run_id="r1", stage=name, status="Succeeded", rows_read=f.driver(name).count()
        )
    return lake.read(audit.RUN_LOG_TABLE).groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rows_read").alias("rows_read")
    )


@query("k04_seed", stated("""
SELECT 'transactions' AS table_name, count(*) AS row_count, count(*) AS reported FROM src_transactions
UNION ALL SELECT 'transaction_risk_scores', count(*), count(*) FROM src_risk
UNION ALL SELECT 'merchants', count(*), count(*) FROM src_merchants"""))
def _(f):
    lake = f.lake("seed")
    named = f.sources.by_name()
    seeded = sinks.seed_tables(lake, {name: named[name] for name in model.TABLE_SOURCES})
    reported = F.create_map(*(
        F.lit(x) for name, rows in seeded.items() for x in (name, F.lit(rows).cast("bigint"))
    ))
    return counts.row_counts({name: lake.read(name) for name in seeded}).withColumn(
        "reported", reported[F.col("table_name")]
    )


@query("k05_snapshot", stated("""
SELECT DeviceID, CustomerID, OS, CASE WHEN fp IS NOT NULL THEN 'XXXX' END AS DeviceFingerprint, IsTrusted
FROM (SELECT deviceId AS DeviceID, customerId AS CustomerID, operatingSystem AS OS,
             deviceFingerprint AS fp, trusted AS IsTrusted FROM s_devices)"""))
def _(f):
    lake = f.lake("serving")
    sinks.overwrite(lake, f.device_dimension, "_base_dimdevice")
    return without_keys(serving.governed("dimdevice", lake.read("_base_dimdevice")))


@query("k06_result_stamp", stated("""
SELECT layer, table_name, row_count, TIMESTAMP '2026-01-31 00:00:00' AS _demo_run_at FROM (
  SELECT 'silver' AS layer, 'merchants' AS table_name, count(*) AS row_count FROM s_merchants
  UNION ALL SELECT 'silver', 'devices', count(*) FROM s_devices)"""))
def _(f):
    lake = f.lake("results")
    found = counts.table_inventory(
        {"silver": {"merchants": f.merchants.valid, "devices": f.devices.valid}}
    )
    sinks.write_result(lake, found, "demo_table_inventory", AS_OF)
    return lake.read("demo_table_inventory")


@query("k07_split_write", stated("""
SELECT 'sessions' AS table_name, count(*) AS row_count, count(device_deviceId) AS with_device FROM s_sessions
UNION ALL SELECT 'quarantine_sessions', count(*), count(device) FROM j_sessions WHERE NOT ok
UNION ALL SELECT 'fraud_alerts', count(*), NULL FROM s_alerts
UNION ALL SELECT 'quarantine_fraud_alerts', count(*), NULL FROM j_alerts WHERE NOT ok"""))
def _(f):
    lake = f.lake("split")
    for table, source in (("sessions", f.sources.digital_sessions), ("fraud_alerts", f.sources.fraud_alerts)):
        tagged = with_verdict(silver.typed(table, source), rules.BY_TABLE[table]())
        original = source.columns
        published = original
        if table == "sessions":
            published = f.sessions.valid.columns
            tagged = silver.with_session_columns(tagged)
        sinks.write_split(lake, tagged, table, published, original)
    none = F.lit(None).cast("bigint")
    measured = [
        lake.read(table).agg(
            F.count(F.lit(1)).alias("row_count"), (F.count(column) if column else none).alias("with_device")
        ).select(F.lit(table).alias("table_name"), "*")
        for table, column in (
            ("sessions", "device_deviceId"), ("quarantine_sessions", "device"),
            ("fraud_alerts", None), ("quarantine_fraud_alerts", None),
        )
    ]
    return reduce(DataFrame.unionByName, measured)


def _renumbered_orders(f: Frames, shift: int) -> DataFrame:
    return f.driver("orders").withColumn("o_orderkey", F.col("o_orderkey") + shift)


@query("m01_merge_insert_missing", stated("""
SELECT TransactionID, AccountID, Amount FROM src_transactions
UNION ALL
SELECT TransactionID, AccountID, Amount FROM (
  SELECT CASE WHEN k % 101 = 0 THEN printf('BAD-%09d', k) ELSE printf('TXN-%09d', k) END AS TransactionID,
         printf('ACCT%09d', o_custkey * 2 + k % 2) AS AccountID,
         CASE WHEN k % 83 = 0 THEN NULL WHEN k % 89 = 0 THEN -o_totalprice ELSE o_totalprice END AS Amount
  FROM (SELECT *, o_orderkey + 1000 AS k FROM orders))
WHERE TransactionID NOT IN (SELECT TransactionID FROM src_transactions)"""))
def _(f):
    columns = ("TransactionID", "AccountID", "Amount")
    batch = bindings.transactions(_renumbered_orders(f, 1000))
    return merge.merge_insert_missing(
        f.sources.transactions.select(*columns), batch.select(*columns), "TransactionID"
    )


@query("m02_merge_update_matched", stated("""
SELECT r.TransactionID, CASE WHEN k IS NULL THEN r.RiskScore WHEN k % 7 = 0 THEN NULL
         ELSE (k % 100)::DOUBLE END AS RiskScore,
       CASE WHEN k IS NULL THEN r.RiskBand ELSE 'Low' END AS RiskBand,
       CASE WHEN k IS NULL THEN r.ModelVersion ELSE 'synthetic-risk-v2' END AS ModelVersion
FROM src_risk r LEFT JOIN (SELECT o_orderkey + 500 AS k FROM orders) b ON r.TransactionID = printf('TXN-%09d', k)"""))
def _(f):
    batch = _renumbered_orders(f, 500).selectExpr(
        "format_string('TXN-%09d', o_orderkey) AS TransactionID",
        "if(o_orderkey % 7 = 0, NULL, cast(o_orderkey % 100 as double)) AS RiskScore",
        "'Low' AS RiskBand", "'synthetic-risk-v2' AS ModelVersion",
    )
    target = f.sources.transaction_risk_scores.select(*batch.columns)
    return merge.merge_update_matched(target, batch, "TransactionID")


_BATCH_ORDERS = "o_orderkey % 50 = 0"


@query("m01_partition_insert", stated(f"""
SELECT TransactionID, AccountID, Amount FROM src_transactions
UNION ALL
SELECT TransactionID, AccountID, Amount FROM (
  SELECT CASE WHEN k % 101 = 0 THEN printf('BAD-%09d', k) ELSE printf('TXN-%09d', k) END AS TransactionID,
         printf('ACCT%09d', o_custkey * 2 + k % 2) AS AccountID,
         CASE WHEN k % 83 = 0 THEN NULL WHEN k % 89 = 0 THEN -o_totalprice ELSE o_totalprice END AS Amount
  FROM (SELECT *, o_orderkey + 1000 AS k FROM orders WHERE {_BATCH_ORDERS}))
WHERE TransactionID NOT IN (SELECT TransactionID FROM src_transactions)"""))
def _(f):
    lake, columns = f.lake("keyed"), ("TransactionID", "AccountID", "Amount")
    keyed.write_keyed(lake, f.sources.transactions.select(*columns), "transactions", "TransactionID")
    batch = bindings.transactions(_renumbered_orders(f, 1000).where("(o_orderkey - 1000) % 50 = 0"))
    keyed.insert_missing_into(lake, "transactions", batch.select(*columns))
    return keyed.read_keyed(lake, "transactions")


@query("m02_partition_update", stated(f"""
SELECT r.TransactionID, CASE WHEN k IS NULL THEN r.RiskScore WHEN k % 7 = 0 THEN NULL
         ELSE (k % 100)::DOUBLE END AS RiskScore,
       CASE WHEN k IS NULL THEN r.RiskBand ELSE 'Low' END AS RiskBand
FROM src_risk r LEFT JOIN (SELECT o_orderkey + 500 AS k FROM orders WHERE {_BATCH_ORDERS}) b
  ON r.TransactionID = printf('TXN-%09d', k)"""))
def _(f):
    batch = _renumbered_orders(f, 500).where("(o_orderkey - 500) % 50 = 0").selectExpr(
        "format_string('TXN-%09d', o_orderkey) AS TransactionID",
        "if(o_orderkey % 7 = 0, NULL, cast(o_orderkey % 100 as double)) AS RiskScore", "'Low' AS RiskBand",
    )
    lake = f.lake("keyed")
    keyed.write_keyed(lake, f.sources.transaction_risk_scores.select(*batch.columns), "scores", "TransactionID")
    keyed.update_matched_in(lake, "scores", batch)
    return keyed.read_keyed(lake, "scores")


def _device_batch(f: Frames) -> DataFrame:
    """Two versions of every device of every user renumbered by 5; the second one lost trust and history."""
    moved = f.driver("events").withColumn("user_id", F.col("user_id") + 5)
    first = bindings.devices(moved).drop("geoHistory").where(F.col("customerId").isNotNull())
    second = first.withColumn("trusted", F.lit(False)).withColumn("changeType", F.lit("update"))
    return first.withColumn("changeType", F.lit("insert")).withColumn("_seq", F.lit(1)).unionByName(
        second.withColumn("_seq", F.lit(2))
    )


def _upserted_devices(f: Frames) -> DataFrame:
    target = f.sources.devices.where(F.col("customerId").isNotNull())
    return merge.upsert_documents(target, _device_batch(f), ["_seq"])


_BATCH_DEVICES = """
batch AS (
  SELECT printf('DEV-%06d', n) AS id, printf('CUST-%06d', u) AS customerId,
         CASE WHEN n % 113 = 0 THEN NULL ELSE printf('DEV-%06d', n) END AS deviceId, n
  FROM (SELECT u, unnest([u * 3, u * 3 + 1, u * 3 + 2]) AS n
        FROM (SELECT DISTINCT user_id + 5 AS u FROM events)) WHERE n % 127 <> 0
), target AS (SELECT * FROM src_devices WHERE customerId IS NOT NULL
), untouched AS (
  SELECT * FROM target t WHERE NOT EXISTS (
    SELECT 1 FROM batch b WHERE b.id = t.id AND b.customerId = t.customerId)
)"""


@query("m03_document_upsert", stated(f""", {_BATCH_DEVICES}
SELECT id, customerId, deviceId, trusted, geoHistory, CAST(NULL AS VARCHAR) AS changeType FROM untouched
UNION ALL SELECT id, customerId, deviceId, false, NULL, 'update' FROM batch"""))
def _(f):
    return _upserted_devices(f).select("id", "customerId", "deviceId", "trusted", "geoHistory", "changeType")


@query("m04_incremental_transactions", stated("""
SELECT 'transactions' AS object, TransactionID, Currency, MerchantCategory FROM (
  SELECT TransactionID, Currency, MerchantCategory FROM src_transactions
  UNION ALL
  SELECT printf('TXN-%09d', i + 1), 'USD', 'Digital Goods'
  FROM (SELECT unnest(range((SELECT count(*) FROM orders), (SELECT count(*) FROM orders) + 25)) AS i))
UNION ALL
SELECT 'scores', TransactionID, RiskBand, ModelVersion FROM (
  SELECT TransactionID, RiskBand, ModelVersion FROM src_risk
  UNION ALL
  SELECT printf('TXN-%09d', i + 1), 'High', 'synthetic-risk-v1'
  FROM (SELECT unnest(range((SELECT count(*) FROM orders), (SELECT count(*) FROM orders) + 25)) AS i))"""))
def _(f):
    new = incremental.incremental_transactions(f.spark, f.driver("orders").count(), 25, AS_OF)
    transactions = merge.merge_insert_missing(
        silver.typed("transactions", f.sources.transactions), new.transactions, "TransactionID"
    )
    scores = merge.merge_insert_missing(
        silver.typed("transaction_risk", f.sources.transaction_risk_scores), new.scores, "TransactionID"
    )
    return transactions.select(
        F.lit("transactions").alias("object"), "TransactionID", "Currency", "MerchantCategory"
    ).unionByName(scores.select(
        F.lit("scores").alias("object"), "TransactionID",
        F.col("RiskBand").alias("Currency"), F.col("ModelVersion").alias("MerchantCategory"),
    ))


@query("m05_changed_scores", stated("""
SELECT TransactionID,
       CASE TransactionID WHEN 'TXN-000000001' THEN 91.25 WHEN 'TXN-000000002' THEN 88.0 ELSE RiskScore END::DOUBLE
         AS RiskScore,
       CASE WHEN TransactionID IN ('TXN-000000001', 'TXN-000000002') THEN 'Critical' ELSE RiskBand END AS RiskBand,
       CASE WHEN TransactionID IN ('TXN-000000001', 'TXN-000000002') THEN TIMESTAMP '2026-01-31 00:00:00'
            ELSE ScoredTimestamp END AS ScoredTimestamp
FROM src_risk"""))
def _(f):
    target = silver.typed("transaction_risk", f.sources.transaction_risk_scores)
    changes = incremental.incremental_changes(f.spark, AS_OF)
    return merge.merge_update_matched(target, changes.scores, "TransactionID").select(
        "TransactionID", "RiskScore", "RiskBand", "ScoredTimestamp"
    )


@query("m05_new_merchant", stated("""
SELECT MerchantID, MerchantName, MerchantCategory, City FROM src_merchants
UNION ALL
SELECT * FROM (VALUES ('MER001501', 'Synthetic Incremental Merchant Co', 'Digital Goods', 'Springfield'))
WHERE NOT EXISTS (SELECT 1 FROM src_merchants WHERE MerchantID = 'MER001501')"""))
def _(f):
    changes = incremental.incremental_changes(f.spark, AS_OF)
    return merge.merge_insert_missing(f.sources.merchants, changes.merchants, "MerchantID").select(
        "MerchantID", "MerchantName", "MerchantCategory", "City"
    )


@query("m06_document_batch", stated("""
SELECT 'digitalSessions' AS container, id, customerId, loginTimestamp AS detail, CAST(NULL AS VARCHAR) AS changeType
FROM src_sessions WHERE customerId IS NOT NULL
UNION ALL SELECT 'digitalSessions', 'SESSION-INC-000001', 'CUST-000001', '2026-01-31T00:00:00.000Z', 'insert'
UNION ALL SELECT 'devices', id, customerId, geoHistory, NULL FROM src_devices
WHERE customerId IS NOT NULL AND NOT (id = 'DEV-000001' AND customerId = 'CUST-000001')
UNION ALL SELECT 'devices', 'DEV-000001', 'CUST-000001',
  '[{"country":"GB","state":"ENG","city":"London","timestamp":"2026-01-31T00:00:00.000Z"}]', 'update'
UNION ALL SELECT 'fraudAlerts', id, customerId, status, NULL FROM src_alerts
WHERE NOT (id = 'ALERT-00000001' AND customerId = 'CUST-000001')
UNION ALL SELECT 'fraudAlerts', 'ALERT-INC-000001', 'CUST-000001', 'open', 'insert'
UNION ALL SELECT 'fraudAlerts', 'ALERT-00000001', 'CUST-000001', 'investigating', 'update'"""))
def _(f):
    named = {name: df for name, df in f.sources.by_name().items() if name in model.DOCUMENT_SOURCES}
    identified = {name: df.where(F.col("customerId").isNotNull()) for name, df in named.items()}
    after = incremental.apply_document_batch(identified, incremental.document_batch(f.spark, AS_OF))
    detail = {"digitalSessions": "loginTimestamp", "devices": "geoHistory", "fraudAlerts": "status"}
    return reduce(DataFrame.unionByName, (
        df.select(F.lit(name).alias("container"), "id", "customerId",
                  F.col(detail[name]).alias("detail"), "changeType")
        for name, df in after.items()
    ))


@query("m07_snapshot_changes", stated(f""", {_BATCH_DEVICES}
SELECT b.id, b.customerId, CASE WHEN t.id IS NULL THEN 'insert' ELSE 'update' END AS change
FROM batch b LEFT JOIN target t ON t.id = b.id AND t.customerId = b.customerId"""))
def _(f):
    before = f.sources.devices.where(F.col("customerId").isNotNull()).withColumn(
        "changeType", F.lit(None).cast("string")
    )
    return merge.snapshot_changes(before, _upserted_devices(f), ["id", "customerId"])


# --- filters and quality rules ----------------------------------------------------------------


@query("f01_split", stated("""
SELECT 'transactions' AS table_name, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS quarantined FROM j_transactions
UNION ALL SELECT 'transaction_risk', count(*) FILTER (ok), count(*) FILTER (NOT ok) FROM j_risk
UNION ALL SELECT 'merchants', count(*) FILTER (ok), count(*) FILTER (NOT ok) FROM j_merchants
UNION ALL SELECT 'sessions', count(*) FILTER (ok), count(*) FILTER (NOT ok) FROM j_sessions
UNION ALL SELECT 'devices', count(*) FILTER (ok), count(*) FILTER (NOT ok) FROM j_devices
UNION ALL SELECT 'fraud_alerts', count(*) FILTER (ok), count(*) FILTER (NOT ok) FROM j_alerts"""))
def _(f):
    sizes = counts.row_counts(f.silver)
    base = F.regexp_replace("table_name", "^quarantine_", "")
    bad = F.col("table_name").startswith("quarantine_")
    return sizes.groupBy(base.alias("table_name")).agg(
        F.sum(F.when(~bad, F.col("row_count")).otherwise(0)).alias("valid"),
        F.sum(F.when(bad, F.col("row_count")).otherwise(0)).alias("quarantined"),
    )


@query("f02_transactions_rule", stated("SELECT TransactionID, CustomerID, Amount, ok FROM j_transactions"))
def _(f):
    judged = with_verdict(silver.typed("transactions", f.sources.transactions), rules.transactions())
    return judged.select("TransactionID", "CustomerID", "Amount", F.col(VALID).alias("ok"))


@query("f03_j01_risk_rule", stated("SELECT TransactionID, RiskScore, known, ok FROM j_risk"))
def _(f):
    marked = silver.with_known_transactions(
        silver.typed("transaction_risk", f.sources.transaction_risk_scores), f.transactions.valid
    )
    return with_verdict(marked, rules.transaction_risk()).select(
        "TransactionID", "RiskScore", F.col(rules.KNOWN_TRANSACTION).alias("known"),
        F.col(VALID).alias("ok"),
    )


@query("f04_merchants_rule", stated("SELECT MerchantID, MerchantCategory, ok FROM j_merchants"))
def _(f):
    return with_verdict(f.sources.merchants, rules.merchants()).select(
        "MerchantID", "MerchantCategory", F.col(VALID).alias("ok")
    )


@query("f05_sessions_quarantine", stated("""
SELECT id, sessionId, customerId, device, geo, authentication, loginTimestamp,
       'silver_quality_rule_violation' AS _quarantine_reason FROM j_sessions WHERE NOT ok"""))
def _(f):
    return f.sessions.quarantined.select(
        "id", "sessionId", "customerId", "device", "geo", "authentication", "loginTimestamp",
        "_quarantine_reason",
    )


@query("f06_devices_rule", stated("SELECT id, deviceId, customerId, ok FROM j_devices"))
def _(f):
    return with_verdict(f.sources.devices, rules.devices()).select(
        "id", "deviceId", "customerId", F.col(VALID).alias("ok")
    )


@query("f07_fraud_alerts_rule", stated("SELECT id, alertId, severity, ok FROM j_alerts"))
def _(f):
    return with_verdict(f.sources.unlinked_fraud_alerts, rules.fraud_alerts()).select(
        "id", "alertId", "severity", F.col(VALID).alias("ok")
    )


@query("f08_trailing_window", stated("""
SELECT TransactionID, TransactionTimestamp, Amount FROM w_t""", 30))
def _(f):
    rows = f.transactions.valid
    return windows.trailing_window(
        rows, "TransactionTimestamp", windows.window_start(rows, "TransactionTimestamp")
    ).select("TransactionID", "TransactionTimestamp", "Amount")


@query("f08_trailing_week", stated("SELECT SessionID, LoginTimestamp FROM w_s", 7))
def _(f):
    return f.recent_sessions(7).select("SessionID", "LoginTimestamp")


@query("a07_f08_month_window", stated("""
SELECT 'week' AS span, TransactionID, TransactionTimestamp FROM w_t UNION ALL
SELECT 'none', NULL, NULL WHERE false""", 7))
def _(f):
    """The trailing week of a fact kept by month."""
    lake = f.lake("months")
    columns = ("TransactionID", "TransactionTimestamp", "Amount")
    sinks.write_by_month(lake, f.transactions.valid.select(*columns), "facttransactions", "TransactionTimestamp")
    week = months.recent(lake.read("facttransactions"), "TransactionTimestamp", 7)
    return week.select(F.lit("week").alias("span"), "TransactionID", "TransactionTimestamp")


@query("f09_a12_u01_customer_spine", stated("SELECT CustomerID FROM spine"))
def _(f):
    return f.customers.select("CustomerID")


@query("f10_untrusted_devices", stated("SELECT deviceId AS DeviceID, customerId AS CustomerID FROM s_devices WHERE trusted = false"))
def _(f):
    return f.device_dimension.where(~F.col("IsTrusted")).select("DeviceID", "CustomerID")


@query("f11_outside_history", stated("""
SELECT DISTINCT s.CustomerID, s.DeviceID, s.GeoCountry FROM w_s s JOIN home h ON h.DeviceID = s.DeviceID
WHERE s.GeoCountry IS NOT NULL AND NOT list_contains(h.countries, s.GeoCountry)""", 30))
def _(f):
    used = customer_metrics.device_usage(f.recent_sessions())
    flagged = customer_metrics.flag_usage(used, f.devices.valid)
    return flagged.where("IsAnomaly").select("CustomerID", "DeviceID", "GeoCountry")


@query("f12_rows_without_claim", stated("""
SELECT CustomerID, CustomerRiskScore, CustomerRiskBand FROM profile WHERE CustomerRiskBand <> 'High'""", 30))
def _(f):
    return governance.secure_rows(f.profile(), None).select(
        "CustomerID", "CustomerRiskScore", "CustomerRiskBand"
    )


@query("f12_rows_with_claim", stated("""
SELECT CustomerID, CustomerRiskScore, CustomerRiskBand FROM profile""", 30))
def _(f):
    return governance.secure_rows(f.profile(), governance.INVESTIGATOR).select(
        "CustomerID", "CustomerRiskScore", "CustomerRiskBand"
    )


@query("f13_cast_if_present", """
SELECT event_id, try_cast(props->>'$.k' AS INTEGER) AS k, try_cast(event_type AS INTEGER) AS event_type FROM events""")
def _(f):
    events = f.driver("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    for column in ("k", "event_type", "absent"):
        events = cast_if_present(events, column, "int")
    return events


@query("f14_timestamp_casts", stated("""
SELECT 'session' AS kind, id, loginTimestamp AS moment FROM t_sessions
UNION ALL SELECT 'alert', id, createdTimestamp FROM j_alerts
UNION ALL SELECT 'transaction', TransactionID, TransactionTimestamp FROM src_transactions"""))
def _(f):
    sources = (
        ("session", "sessions", f.sources.digital_sessions, "id", "loginTimestamp"),
        ("alert", "fraud_alerts", f.sources.unlinked_fraud_alerts, "id", "createdTimestamp"),
        ("transaction", "transactions", f.sources.transactions, "TransactionID", "TransactionTimestamp"),
    )
    return reduce(DataFrame.unionByName, (
        silver.typed(table, source).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(moment).alias("moment")
        )
        for kind, table, source, key, moment in sources
    ))


@query("f16_safe_identifiers", """
SELECT name, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]{0,254}') AS accepted,
       CASE WHEN regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]{0,254}') THEN '`' || name || '`' END AS quoted
FROM (SELECT DISTINCT unnest([n_name, n_name || '#1', replace(n_name, ' ', '_')]) AS name FROM nation)""")
def _(f):
    nations = tables.read_path(f.spark, f"{f.sf_dir}/nation.parquet")
    named = nations.select(F.explode(F.array(
        "n_name", F.concat("n_name", F.lit("#1")), F.replace("n_name", F.lit(" "), F.lit("_"))
    )).alias("name"))
    return named.distinct().select(
        "name", is_identifier("name").alias("accepted"), quoted("name").alias("quoted")
    )


# --- projections ------------------------------------------------------------------------------


@query("p01_flatten_sessions", stated("SELECT * FROM s_sessions"))
def _(f):
    return f.sessions.valid


@query("p02_surrogate_keys", stated("""
SELECT 'customer' AS kind, count(DISTINCT CustomerID) AS keys, count(DISTINCT CustomerID) AS hashes,
       count(*) FILTER (CustomerID IS NULL) AS null_keys FROM src_transactions
UNION ALL SELECT 'account', count(DISTINCT AccountID), count(DISTINCT AccountID), 0 FROM src_transactions
UNION ALL SELECT 'merchant', count(DISTINCT MerchantID), count(DISTINCT MerchantID), 0 FROM src_merchants
UNION ALL SELECT 'device', count(DISTINCT deviceId), count(DISTINCT deviceId),
  count(*) FILTER (deviceId IS NULL) FROM src_devices"""))
def _(f):
    kinds = (
        ("customer", f.sources.transactions, "CustomerID"),
        ("account", f.sources.transactions, "AccountID"),
        ("merchant", f.sources.merchants, "MerchantID"),
        ("device", f.sources.devices, "deviceId"),
    )
    def measured(kind, df, key):
        per_key = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
        per_hash = per_key.groupBy(surrogate_key("key").alias("hash")).agg(
            F.count("key").alias("keys"),
            F.sum(F.when(F.col("key").isNull(), F.col("rows")).otherwise(0)).alias("null_rows"),
        )
        return per_hash.agg(
            F.sum("keys").alias("keys"),
            F.count_if(F.col("keys") > 0).alias("hashes"),
            F.sum(F.when(F.col("hash") == 42, F.col("null_rows")).otherwise(0)).alias("null_keys"),
        ).select(F.lit(kind).alias("kind"), "keys", "hashes", "null_keys")
    return reduce(DataFrame.unionByName, (measured(*kind) for kind in kinds))


@query("p03_date_keys", stated("""
SELECT 'transactions' AS fact, DateKey, count(*) AS n FROM fact_t GROUP BY DateKey
UNION ALL SELECT 'sessions', DateKey, count(*) FROM fact_s GROUP BY DateKey
UNION ALL SELECT 'alerts', DateKey, count(*) FROM fact_a GROUP BY DateKey"""))
def _(f):
    facts = {"transactions": f.fact_transactions, "sessions": f.fact_sessions, "alerts": f.unlinked_alerts}
    return reduce(DataFrame.unionByName, (
        df.groupBy("DateKey").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fact"), "DateKey", "n")
        for name, df in facts.items()
    ))


@query("p05_dim_merchant", stated("SELECT * FROM s_merchants"))
def _(f):
    return without_keys(f.merchant_dimension)


@query("p06_dim_device", stated("""
SELECT deviceId AS DeviceID, customerId AS CustomerID, operatingSystem AS OS,
       deviceFingerprint AS DeviceFingerprint, trusted AS IsTrusted FROM s_devices"""))
def _(f):
    return without_keys(f.device_dimension)


@query("p07_fact_sessions", stated("SELECT * FROM fact_s"))
def _(f):
    return without_keys(f.fact_sessions)


@query("p08_fact_alerts", stated("SELECT * FROM fact_a"))
def _(f):
    return without_keys(f.fact_alerts)


@query("p09_j02_fact_transactions", stated("SELECT * EXCLUDE (AccountID, MerchantID) FROM fact_t"))
def _(f):
    return without_keys(gold.fact_transactions(f.transactions.valid, f.risk.valid))


@query("p09_fact_from_scores_in_range", stated("SELECT * EXCLUDE (AccountID, MerchantID) FROM fact_t"))
def _(f):
    return without_keys(f.fact_transactions)


@query("p10_p11_score_and_band", stated("""
SELECT CustomerID, CustomerRiskScore, CustomerRiskBand FROM profile""", 30))
def _(f):
    return f.profile().select("CustomerID", "CustomerRiskScore", "CustomerRiskBand")


@query("p12_masked_customers", stated("""
SELECT CASE WHEN length(CustomerID) > 5 THEN substring(CustomerID, 1, 5) || 'XXXXXX' ELSE 'XXXXXX' END
       AS CustomerID FROM spine"""))
def _(f):
    return without_keys(serving.governed("dimcustomer", f.customers))


@query("p12_owner_sees_customers", stated("SELECT CustomerID FROM spine"))
def _(f):
    return without_keys(serving.governed("dimcustomer", f.customers, privileged=True))


@query("p13_masked_devices", stated("""
SELECT deviceId AS DeviceID, CASE WHEN deviceFingerprint IS NOT NULL THEN 'XXXX' END AS DeviceFingerprint
FROM s_devices"""))
def _(f):
    return serving.governed("dimdevice", f.device_dimension).select("DeviceID", "DeviceFingerprint")


@query("p14_permitted_columns", stated("""
SELECT deviceId AS DeviceID, customerId AS CustomerID, operatingSystem AS OS, trusted AS IsTrusted FROM s_devices"""))
def _(f):
    return without_keys(governance.permitted_columns(
        f.device_dimension, governance.PERMITTED_COLUMNS["dimdevice"]
    ))


def _view(table: str, df: DataFrame) -> DataFrame:
    return without_keys(serving.served(table, df))


@query("p15_view_accounts", stated("SELECT DISTINCT AccountID, CustomerID FROM s_transactions"))
def _(f):
    return _view("dimaccount", f.accounts)


@query("p15_view_merchants", stated("SELECT * FROM s_merchants"))
def _(f):
    return _view("dimmerchant", f.merchant_dimension)


@query("p15_view_transactions", stated("SELECT * EXCLUDE (CustomerID, AccountID, MerchantID) FROM fact_t"))
def _(f):
    return _view("facttransactions", f.fact_transactions)


@query("p15_view_sessions", stated("SELECT * FROM fact_s"))
def _(f):
    return _view("factdigitalsessions", f.fact_sessions)


@query("p15_view_alerts", stated("SELECT * FROM fact_a"))
def _(f):
    return _view("factfraudalerts", f.fact_alerts)


@query("p15_view_dates", stated("""
SELECT "Year", IsWeekend, count(*) AS days, sum(n)::BIGINT AS sessions FROM (
  SELECT d, year(d)::INTEGER AS "Year", dayofweek(d) IN (0, 6) AS IsWeekend, count(LoginTimestamp) AS n
  FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2030-12-31', INTERVAL 1 DAY))::DATE AS d)
  LEFT JOIN fact_s ON LoginTimestamp::DATE = d GROUP BY d)
GROUP BY ALL"""))
def _(f):
    per_day = f.fact_sessions.groupBy("DateKey").agg(F.count(F.lit(1)).alias("n"))
    return _view("dimdate", calendar.dim_date(f.spark)).join(per_day, "DateKey", "left").groupBy("Year", "IsWeekend").agg(
        F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("n"), F.lit(0)).alias("sessions")
    )


@query("p16_governed_profile", stated("""
SELECT * FROM profile WHERE CustomerRiskBand <> 'High'""", 30))
def _(f):
    return rounded_profile(serving.governed("aggcustomerriskprofile", f.profile()))


# --- joins and aggregates ---------------------------------------------------------------------


@query("j03_untrusted_use", stated("""
SELECT DISTINCT s.CustomerID, s.DeviceID FROM w_s s JOIN s_devices d ON d.deviceId = s.DeviceID
WHERE d.trusted = false""", 30))
def _(f):
    flagged = customer_metrics.flag_usage(
        customer_metrics.device_usage(f.recent_sessions()), f.devices.valid
    )
    return flagged.where("IsUntrusted").select("CustomerID", "DeviceID").distinct()


@query("j04_use_with_history", stated("""
SELECT DISTINCT s.CustomerID, s.DeviceID, s.GeoCountry, list_contains(h.countries, s.GeoCountry) AS known
FROM w_s s JOIN home h ON h.DeviceID = s.DeviceID WHERE s.GeoCountry IS NOT NULL""", 30))
def _(f):
    history = customer_metrics.device_home_countries(f.devices.valid)
    used = customer_metrics.device_usage(f.recent_sessions()).where(F.col("GeoCountry").isNotNull())
    known = skew.spread_lookup(used, history, ["DeviceID"], ["CustomerID"]).where(F.col("HomeCountries").isNotNull())
    return known.select(
        "CustomerID", "DeviceID", "GeoCountry",
        F.array_contains("HomeCountries", F.col("GeoCountry")).alias("known"),
    )


@query("j05_risk_profile", stated("SELECT * FROM profile", 30))
def _(f):
    return rounded_profile(f.profile())


@query("j05_risk_profile_week", stated("SELECT * FROM profile", 7))
def _(f):
    return rounded_profile(f.profile(7))


@query("j05_risk_profile_stored", stated("SELECT * FROM profile", 30))
def _(f):
    lake = f.lake("stored")
    flat = {name: df for name, df in f.silver.items() if not name.startswith("quarantine_")}
    gold.refresh_gold(lake, {**flat, "fraud_alerts": f.fraud_alerts.valid}, AS_OF)
    return rounded_profile(lake.read("aggcustomerriskprofile").drop(model.LOAD_STAMP))


@query("j05_risk_profile_daily", stated("SELECT * FROM profile", 30))
def _(f):
    """Three advances: what is older than a fortnight, the next ten days, the rest with late rows of all days.

    The facts are built once and kept, as in a refresh: every advance reads them again, and so does what deals them out.
    """
    lake = f.lake("daily")
    kept = DailyProfile(lake)
    facts = (
        (f.fact_transactions, "TransactionTimestamp", "TransactionID", ("Amount", "RiskBand", "RiskScore")),
        (f.fact_sessions, "LoginTimestamp", "SessionID", ("DeviceID", "GeoCountry", "AuthFailedAttempts")),
        (f.unlinked_alerts, "AlertTimestamp", "AlertID", ()),
    )
    sinks.side_by_side(lake, {
        f"arrived_{key}": partial(sinks.overwrite, lake, fact.select("CustomerID", key, moment, *rest), f"arrived_{key}")
        for fact, moment, key, rest in facts
    })
    placed = []
    for _, moment, key, _ in facts:
        fact = lake.read(f"arrived_{key}")
        last = fact.agg(F.max(F.col(moment).cast("date"))).first()[0]
        age = F.coalesce(F.date_diff(F.lit(last), F.col(moment).cast("date")), F.lit(0))
        late = F.pmod(F.xxhash64(key), F.lit(5)) == 0
        placed.append(fact.withColumn("_turn", F.when((age < 4) | late, 2).when(age < 14, 1).otherwise(0)))
    for turn in range(3):
        kept.advance(*(fact.where(F.col("_turn") == turn) for fact in placed))
    return rounded_profile(kept.profile(f.devices.valid))


@query("j07_i04_fraud_investigation", stated("""
SELECT a.AlertID, a.CustomerID, a.Severity, a.AlertType, a.AlertTimestamp, t.TransactionID, t.Amount,
       t.TransactionType, t.Channel, t.TransactionTimestamp, t.RiskScore, t.RiskBand
FROM fact_a a JOIN fact_t t ON t.TransactionID = a.TransactionID AND t.CustomerID = a.CustomerID"""))
def _(f):
    return consumption.fraud_investigation(f.fact_alerts, f.fact_transactions)


@query("j08_scores_without_transaction", stated("""
SELECT TransactionID, RiskScore FROM src_risk r
WHERE NOT EXISTS (SELECT 1 FROM src_transactions t WHERE t.TransactionID = r.TransactionID)"""))
def _(f):
    return checks.orphans(
        f.sources.transaction_risk_scores, f.sources.transactions, "TransactionID"
    ).select("TransactionID", "RiskScore")


@query("j09_unknown_merchants", stated("""
SELECT count(*) AS orphan_rows, count(DISTINCT MerchantID) AS orphan_ids FROM src_transactions t
WHERE NOT EXISTS (SELECT 1 FROM s_merchants m WHERE m.MerchantID = t.MerchantID)"""))
def _(f):
    return checks.orphan_counts(f.sources.transactions, f.merchants.valid, "MerchantID")


@query("j10_u03_id_differences", stated("""
SELECT coalesce(e.id, l.id) AS id, CASE WHEN l.id IS NULL THEN 'missing' ELSE 'unexpected' END AS difference
FROM (SELECT id FROM src_devices) e
FULL JOIN (SELECT printf('DEV-%06d', unnest([u * 3, u * 3 + 1, u * 3 + 2])) AS id
           FROM (SELECT DISTINCT user_id + 5 AS u FROM events)) l ON e.id = l.id
WHERE e.id IS NULL OR l.id IS NULL"""))
def _(f):
    live = bindings.devices(f.driver("events").withColumn("user_id", F.col("user_id") + 5))
    return checks.id_differences(f.sources.devices.select("id"), live.select("id"), "id")


@query("a01_transaction_metrics", stated(f"""
SELECT CustomerID, TransactionCount30D, {_exact('TotalTransactionAmount30D', 2)} AS TotalTransactionAmount30D,
       {_exact('AverageTransactionRiskScore', 6)} AS AverageTransactionRiskScore, HighRiskTransactionCount
FROM m_t""", 30))
def _(f):
    recent = windows.trailing_window(
        f.fact_transactions, "TransactionTimestamp",
        windows.window_start(f.transactions.valid, "TransactionTimestamp"),
    )
    return rounded_profile(customer_metrics.transaction_metrics(recent))


@query("a02_alert_metrics", stated("SELECT * FROM m_a", 30))
def _(f):
    recent = windows.trailing_window(f.unlinked_alerts, "AlertTimestamp", f.sessions_start())
    return customer_metrics.alert_metrics(recent)


@query("a03_session_metrics", stated("SELECT * FROM m_s", 30))
def _(f):
    return customer_metrics.session_metrics(f.recent_sessions())


@query("a04_untrusted_device_counts", stated("SELECT * FROM m_u", 30))
def _(f):
    return customer_metrics.untrusted_device_counts(f.recent_sessions(), f.devices.valid)


@query("a05_home_countries", stated("SELECT DeviceID, array_to_string(list_sort(countries), ',') AS countries FROM home"))
def _(f):
    return customer_metrics.device_home_countries(f.devices.valid).select(
        "DeviceID", F.array_join(F.array_sort("HomeCountries"), ",").alias("countries")
    )


@query("a06_geographic_anomalies", stated("SELECT * FROM m_g", 30))
def _(f):
    return customer_metrics.geographic_anomaly_counts(f.recent_sessions(), f.devices.valid)


@query("a07_t02_source_clocks", stated("""
SELECT 'transactions' AS source, txn_day AS as_of, (SELECT count(*) FROM w_t) AS recent FROM clocks
UNION ALL SELECT 'sessions', session_day, (SELECT count(*) FROM w_s) FROM clocks
UNION ALL SELECT 'alerts', session_day, (SELECT count(*) FROM w_a) FROM clocks""", 7))
def _(f):
    transactions, moment = f.transactions.valid, "TransactionTimestamp"
    transactions_clock = windows.as_of_date(transactions, moment), windows.window_start(transactions, moment, 7)
    sessions_clock = windows.as_of_date(f.fact_sessions, "LoginTimestamp"), f.sessions_start(7)
    sources = (
        ("transactions", transactions, moment, transactions_clock),
        ("sessions", f.fact_sessions, "LoginTimestamp", sessions_clock),
        ("alerts", f.unlinked_alerts, "AlertTimestamp", sessions_clock),
    )
    return reduce(DataFrame.unionByName, (
        windows.trailing_window(df, column, start, 7).agg(F.count(F.lit(1)).alias("recent")).select(
            F.lit(name).alias("source"), day.alias("as_of"), "recent"
        )
        for name, df, column, (day, start) in sources
    ))


@query("a08_transactions_profile", stated("""
SELECT count(*) AS total, count(*) FILTER (TransactionID IS NULL) AS "null_TransactionID",
       count(*) FILTER (CustomerID IS NULL) AS "null_CustomerID",
       count(*) FILTER (AccountID IS NULL) AS "null_AccountID",
       count(*) FILTER (MerchantID IS NULL) AS "null_MerchantID",
       count(*) FILTER (DeviceID IS NULL) AS "null_DeviceID",
       count(*) FILTER (NOT coalesce(starts_with(TransactionID, 'TXN-'), false)) AS "bad_TransactionID",
       count(*) FILTER (NOT coalesce(starts_with(CustomerID, 'CUST-'), false)) AS "bad_CustomerID",
       count(*) FILTER (NOT coalesce(starts_with(AccountID, 'ACCT'), false)) AS "bad_AccountID",
       count(*) FILTER (NOT coalesce(starts_with(MerchantID, 'MER'), false)) AS "bad_MerchantID",
       count(*) FILTER (NOT coalesce(starts_with(DeviceID, 'DEV-'), false)) AS "bad_DeviceID",
       min(Amount) AS min_amount, max(Amount) AS max_amount,
       count(*) FILTER (NOT coalesce(Amount > 0, false)) AS non_positive_amount,
       count(*) FILTER (Amount >= 1000000) AS outlier_amount,
       count(DISTINCT TransactionID) AS "distinct_TransactionID"
FROM src_transactions"""))
def _(f):
    return checks.transactions_profile(f.sources.transactions)


@query("a08_risk_profile_checks", stated("""
SELECT count(*) AS total, count(*) FILTER (TransactionID IS NULL) AS "null_TransactionID",
       min(RiskScore) AS min_score, max(RiskScore) AS max_score,
       count(*) FILTER (NOT coalesce(RiskScore BETWEEN 0 AND 100, false)) AS out_of_range,
       count(*) FILTER (NOT coalesce(RiskBand IN ('Low','Medium','High','Critical'), false)) AS bad_band,
       count(DISTINCT TransactionID) AS "distinct_TransactionID"
FROM src_risk"""))
def _(f):
    return checks.risk_profile_checks(f.sources.transaction_risk_scores)


@query("a08_merchants_profile", stated("""
SELECT count(*) AS total, count(*) FILTER (MerchantID IS NULL) AS "null_MerchantID",
       count(DISTINCT MerchantID) AS "distinct_MerchantID" FROM src_merchants"""))
def _(f):
    return checks.merchants_profile(f.sources.merchants)


@query("a09_counts_in_one_row", """
SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM supplier) AS supplier,
       (SELECT count(*) FROM events) AS events""")
def _(f):
    return counts.counts_in_one_row({name: f.driver(name) for name in ("orders", "supplier", "events")})


@query("a10_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(f):
    lines = tables.read_table(
        f.spark, f"{f.sf_dir}/lineitem.parquet", "l_orderkey bigint, l_linenumber int"
    )
    return checks.duplicate_keys(lines, "l_orderkey", "l_linenumber")


@query("a11_v09_schema_variation", stated("""
SELECT 'devices' AS container, 'geoHistory' AS field, count(geoHistory) AS with_field, count(*) AS documents,
       count(geoHistory) > 0 AND count(geoHistory) < count(*) AS varies FROM src_devices
UNION ALL SELECT 'fraudAlerts', 'resolution', count(resolution), count(*),
       count(resolution) > 0 AND count(resolution) < count(*) FROM src_alerts"""))
def _(f):
    return checks.schema_variation(f.sources.devices, "devices").unionByName(
        checks.schema_variation(f.sources.unlinked_fraud_alerts, "fraudAlerts")
    )


@query("a13_dim_account", stated("SELECT DISTINCT AccountID, CustomerID FROM s_transactions"))
def _(f):
    return without_keys(f.accounts)


@query("a14_device_usage", stated("""
SELECT CustomerID, DeviceID, GeoCountry, count(*) FILTER (AuthFailedAttempts > 0) AS FailedLogins
FROM w_s GROUP BY ALL""", 30))
def _(f):
    return customer_metrics.device_usage(f.recent_sessions())


@query("a15_restricted_rows_visible", stated("""
SELECT 'none' AS claim, 0::BIGINT AS visible
UNION ALL SELECT 'investigator', count(*) FROM profile WHERE CustomerRiskBand = 'High'""", 30))
def _(f):
    profile = f.profile()
    return reduce(DataFrame.unionByName, (
        serving.restricted_rows_visible(profile, claim).select(F.lit(label).alias("claim"), "visible")
        for label, claim in (("none", None), ("investigator", governance.INVESTIGATOR))
    ))


@query("l02_view_preview", stated("""
SELECT deviceId AS DeviceID, customerId AS CustomerID, operatingSystem AS OS,
       CASE WHEN deviceFingerprint IS NOT NULL THEN 'XXXX' END AS DeviceFingerprint, trusted AS IsTrusted
FROM s_devices ORDER BY deviceId, customerId LIMIT 5"""))
def _(f):
    return serving.preview(without_keys(serving.governed("dimdevice", f.device_dimension)), ("DeviceID", "CustomerID"))


@query("u02_stacked_counts", stated("""
SELECT 'transactions' AS object, count(*) AS row_count FROM src_transactions
UNION ALL SELECT 'transaction_risk_scores', count(*) FROM src_risk
UNION ALL SELECT 'merchants', count(*) FROM src_merchants"""))
def _(f):
    named = f.sources.by_name()
    return counts.row_counts({name: named[name] for name in model.TABLE_SOURCES}, "object")


# --- streaming --------------------------------------------------------------------------------


@query("t01_streamed_documents", stated(f"""
SELECT id, customerId, sessionId, CASE WHEN {_ACCEPTED} THEN device ELSE '{{}}' END AS device, authentication,
       CASE WHEN {_ACCEPTED} THEN sessionRiskScore ELSE -1 END AS sessionRiskScore
FROM src_sessions WHERE customerId IS NOT NULL"""))
def _(f):
    folder = shared_folder(f.spark, "stream")
    sessions = f.sources.spread_sessions
    earlier = sessions.withColumn("sessionRiskScore", F.lit(-1)).withColumn("device", F.lit("{}"))
    for version in (earlier, sessions):
        # Arrives in the same folder; the second load replaces the documents it has an acceptable line for.
        bindings.session_lines(version).write.mode("append").text(f"{folder}/in")
        streaming.start_ingest(
            f.spark, f"{folder}/in", "digitalSessions", f"{folder}/log", f"{folder}/checkpoint",
            rejects=f"{folder}/rejects",
        ).awaitTermination()
    return streaming.current_documents(f.spark, f"{folder}/log", "digitalSessions").select(
        "id", "customerId", "sessionId", "device", "authentication", "sessionRiskScore"
    )


@query("t01_rejected_documents", stated(f"""
SELECT 'accepted' AS outcome, count(*) FILTER ({_ACCEPTED}) AS lines FROM src_sessions
UNION ALL SELECT 'rejected', count(*) FILTER (NOT ({_ACCEPTED})) FROM src_sessions
UNION ALL SELECT 'in all', count(*) FROM src_sessions"""))
def _(f):
    folder = shared_folder(f.spark, "rejects")
    bindings.session_lines(f.sources.spread_sessions).write.text(f"{folder}/in")
    streaming.start_ingest(
        f.spark, f"{folder}/in", "digitalSessions", f"{folder}/log", f"{folder}/checkpoint",
        rejects=f"{folder}/rejects",
    ).awaitTermination()
    accepted = f.spark.read.parquet(f"{folder}/log")
    rejected = streaming.rejected_lines(f.spark, f"{folder}/rejects")
    both = accepted.select(F.lit("accepted").alias("outcome")).unionAll(rejected.select(F.lit("rejected")))
    return both.unionAll(both.select(F.lit("in all"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("lines"))


# --- validation, gates, audit -----------------------------------------------------------------


@query("v01_source_gate", stated("""
SELECT 'transactions' AS table_name, count(*) AS row_count FROM src_transactions
UNION ALL SELECT 'transaction_risk_scores', count(*) FROM src_risk
UNION ALL SELECT 'merchants', count(*) FROM src_merchants
UNION ALL SELECT 'digitalSessions', count(*) FROM src_sessions
UNION ALL SELECT 'devices', count(*) FROM src_devices
UNION ALL SELECT 'fraudAlerts', count(*) FROM src_alerts"""))
def _(f):
    passed = checks.gate_nonempty(f.sources.by_name())
    return tables.rows_frame(
        f.spark, passed.items(), model._ddl("table_name string, row_count bigint")
    )


_GOLD_COUNTS = """
SELECT 'dimcustomer' AS table_name, (SELECT count(*) FROM spine) AS row_count
UNION ALL SELECT 'dimaccount', (SELECT count(*) FROM (SELECT DISTINCT AccountID, CustomerID FROM s_transactions))
UNION ALL SELECT 'dimmerchant', (SELECT count(*) FROM s_merchants)
UNION ALL SELECT 'dimdevice', (SELECT count(*) FROM s_devices)
UNION ALL SELECT 'dimdate', 4018
UNION ALL SELECT 'facttransactions', (SELECT count(*) FROM fact_t)
UNION ALL SELECT 'factdigitalsessions', (SELECT count(*) FROM fact_s)
UNION ALL SELECT 'factfraudalerts', (SELECT count(*) FROM fact_a)
UNION ALL SELECT 'aggcustomerriskprofile', (SELECT count(*) FROM spine)"""
_SILVER_COUNTS = """
SELECT 'transactions' AS table_name, (SELECT count(*) FROM s_transactions) AS row_count
UNION ALL SELECT 'transaction_risk', (SELECT count(*) FROM s_risk)
UNION ALL SELECT 'merchants', (SELECT count(*) FROM s_merchants)
UNION ALL SELECT 'sessions', (SELECT count(*) FROM s_sessions)
UNION ALL SELECT 'devices', (SELECT count(*) FROM s_devices)
UNION ALL SELECT 'fraud_alerts', (SELECT count(*) FROM s_alerts)
UNION ALL SELECT 'quarantine_transactions', (SELECT count(*) FROM j_transactions WHERE NOT ok)
UNION ALL SELECT 'quarantine_transaction_risk', (SELECT count(*) FROM j_risk WHERE NOT ok)
UNION ALL SELECT 'quarantine_merchants', (SELECT count(*) FROM j_merchants WHERE NOT ok)
UNION ALL SELECT 'quarantine_sessions', (SELECT count(*) FROM j_sessions WHERE NOT ok)
UNION ALL SELECT 'quarantine_devices', (SELECT count(*) FROM j_devices WHERE NOT ok)
UNION ALL SELECT 'quarantine_fraud_alerts', (SELECT count(*) FROM j_alerts WHERE NOT ok)"""
_SOURCE_COUNTS = """
SELECT 'transactions' AS table_name, (SELECT count(*) FROM src_transactions) AS row_count
UNION ALL SELECT 'transaction_risk_scores', (SELECT count(*) FROM src_risk)
UNION ALL SELECT 'merchants', (SELECT count(*) FROM src_merchants)
UNION ALL SELECT 'digitalSessions', (SELECT count(*) FROM src_sessions)
UNION ALL SELECT 'devices', (SELECT count(*) FROM src_devices)
UNION ALL SELECT 'fraudAlerts', (SELECT count(*) FROM src_alerts)"""


@query("v02_gold_gate", stated(_GOLD_COUNTS))
def _(f):
    passed = checks.gate_nonempty(f.gold)
    return tables.rows_frame(
        f.spark, passed.items(), model._ddl("table_name string, row_count bigint")
    )


@query("v03_v07_table_checks", stated("""
, t AS (
  SELECT unnest([
    {'check': 'transactions: TransactionID present', 'violations': count(*) FILTER (TransactionID IS NULL)},
    {'check': 'transactions: CustomerID present', 'violations': count(*) FILTER (CustomerID IS NULL)},
    {'check': 'transactions: AccountID present', 'violations': count(*) FILTER (AccountID IS NULL)},
    {'check': 'transactions: MerchantID present', 'violations': count(*) FILTER (MerchantID IS NULL)},
    {'check': 'transactions: DeviceID present', 'violations': count(*) FILTER (DeviceID IS NULL)},
    {'check': 'transactions: TransactionID starts with TXN-', 'violations': count(*) FILTER (NOT coalesce(starts_with(TransactionID, 'TXN-'), false))},
    {'check': 'transactions: CustomerID starts with CUST-', 'violations': count(*) FILTER (NOT coalesce(starts_with(CustomerID, 'CUST-'), false))},
    {'check': 'transactions: AccountID starts with ACCT', 'violations': count(*) FILTER (NOT coalesce(starts_with(AccountID, 'ACCT'), false))},
    {'check': 'transactions: MerchantID starts with MER', 'violations': count(*) FILTER (NOT coalesce(starts_with(MerchantID, 'MER'), false))},
    {'check': 'transactions: DeviceID starts with DEV-', 'violations': count(*) FILTER (NOT coalesce(starts_with(DeviceID, 'DEV-'), false))},
    {'check': 'transactions: Amount positive', 'violations': count(*) FILTER (NOT coalesce(Amount > 0, false))},
    {'check': 'transactions: Amount below 1000000', 'violations': count(*) FILTER (Amount >= 1000000)},
    {'check': 'transactions: TransactionID unique', 'violations': count(*) - count(DISTINCT TransactionID)}
  ]) AS c FROM src_transactions
), r AS (
  SELECT unnest([
    {'check': 'risk scores: TransactionID present', 'violations': count(*) FILTER (TransactionID IS NULL)},
    {'check': 'risk scores: RiskScore within 0 and 100', 'violations': count(*) FILTER (NOT coalesce(RiskScore BETWEEN 0 AND 100, false))},
    {'check': 'risk scores: RiskBand known', 'violations': count(*) FILTER (NOT coalesce(RiskBand IN ('Low','Medium','High','Critical'), false))},
    {'check': 'risk scores: TransactionID unique', 'violations': count(*) - count(DISTINCT TransactionID)},
    {'check': 'risk scores: TransactionID known', 'violations': count(DISTINCT TransactionID) FILTER (TransactionID NOT IN (SELECT TransactionID FROM src_transactions))}
  ]) AS c FROM src_risk
), m AS (
  SELECT unnest([
    {'check': 'merchants: MerchantID present', 'violations': count(*) FILTER (MerchantID IS NULL)},
    {'check': 'merchants: MerchantID unique', 'violations': count(*) - count(DISTINCT MerchantID)}
  ]) AS c FROM src_merchants
), o AS (
  SELECT {'check': 'transactions: MerchantID known',
          'violations': count(DISTINCT MerchantID) FILTER (MerchantID NOT IN (SELECT MerchantID FROM src_merchants))} AS c
  FROM src_transactions
)
SELECT c.check AS "check", c.violations AS violations
FROM (SELECT c FROM t UNION ALL SELECT c FROM r UNION ALL SELECT c FROM m UNION ALL SELECT c FROM o)"""))
def _(f):
    return checks.table_checks(
        f.sources.transactions, f.sources.transaction_risk_scores, f.sources.merchants
    )


@query("v04_uniqueness", stated("""
SELECT 'transactions' AS table_name, count(*) AS total, count(DISTINCT TransactionID) AS distinct_keys,
       count(*) = count(DISTINCT TransactionID) AS is_unique FROM src_transactions
UNION ALL SELECT 'accounts', count(*), count(DISTINCT AccountID), count(*) = count(DISTINCT AccountID) FROM src_transactions
UNION ALL SELECT 'devices', count(*), count(DISTINCT deviceId), count(*) = count(DISTINCT deviceId) FROM src_devices"""))
def _(f):
    tested = (
        ("transactions", f.sources.transactions, "TransactionID"),
        ("accounts", f.sources.transactions, "AccountID"),
        ("devices", f.sources.devices, "deviceId"),
    )
    return reduce(DataFrame.unionByName, (
        checks.uniqueness(df, key).select(F.lit(name).alias("table_name"), "*") for name, df, key in tested
    ))


@query("v06_orphan_scores", stated("""
SELECT count(*) AS orphan_rows, count(DISTINCT TransactionID) AS orphan_ids FROM src_risk r
WHERE NOT EXISTS (SELECT 1 FROM s_transactions t WHERE t.TransactionID = r.TransactionID)"""))
def _(f):
    return checks.orphan_counts(
        f.sources.transaction_risk_scores, f.transactions.valid, "TransactionID"
    )


@query("v08_l03_document_checks", stated("""
SELECT 'digitalSessions' AS container, count(*) AS documents,
       count(*) FILTER (sessionId IS NULL OR customerId IS NULL OR device IS NULL) AS missing_required,
       count(*) FILTER (NOT coalesce(regexp_full_match(customerId, 'CUST-[0-9]{6}'), false)) AS bad_customer_id,
       count(*) FILTER (CASE WHEN json_valid(device) THEN NOT regexp_full_match(device->>'$.deviceId', 'DEV-[0-9]{6}') ELSE false END) AS bad_device_id
FROM src_sessions
UNION ALL SELECT 'devices', count(*), count(*) FILTER (deviceId IS NULL OR customerId IS NULL OR trusted IS NULL),
       count(*) FILTER (NOT coalesce(regexp_full_match(customerId, 'CUST-[0-9]{6}'), false)),
       count(*) FILTER (NOT regexp_full_match(deviceId, 'DEV-[0-9]{6}')) FROM src_devices
UNION ALL SELECT 'fraudAlerts', count(*), count(*) FILTER (alertId IS NULL OR transactionId IS NULL),
       count(*) FILTER (NOT coalesce(regexp_full_match(customerId, 'CUST-[0-9]{6}'), false)), 0 FROM src_alerts"""))
def _(f):
    named = f.sources.by_name()
    return reduce(DataFrame.unionByName, (
        checks.document_violations(named[name], name) for name in model.DOCUMENT_SOURCES
    ))


@query("v08_document_checks", stated("""
, ghosts AS (SELECT DISTINCT printf('DEV-%06d', unnest([u * 3, u * 3 + 1, u * 3 + 2])) AS id
  FROM (SELECT DISTINCT user_id + 5 AS u FROM events)
), d AS (
  SELECT unnest([
    {'check': 'devices: required fields present', 'violations': count(*) FILTER (deviceId IS NULL OR customerId IS NULL OR trusted IS NULL)},
    {'check': 'devices: customerId well formed', 'violations': count(*) FILTER (NOT coalesce(regexp_full_match(customerId, 'CUST-[0-9]{6}'), false))},
    {'check': 'devices: deviceId well formed', 'violations': count(*) FILTER (NOT regexp_full_match(deviceId, 'DEV-[0-9]{6}'))},
    {'check': 'devices: id unique', 'violations': (SELECT count(*) FROM (SELECT id FROM src_devices GROUP BY id HAVING count(*) > 1))},
    {'check': 'devices: geoHistory varies', 'violations': CASE WHEN count(geoHistory) > 0 AND count(geoHistory) < count(*) THEN 0 ELSE 1 END::BIGINT},
    {'check': 'devices: no missing ids', 'violations': (SELECT count(*) FROM ghosts WHERE id NOT IN (SELECT id FROM src_devices WHERE id IS NOT NULL))},
    {'check': 'devices: no unexpected ids', 'violations': (SELECT count(DISTINCT id) FROM src_devices WHERE id NOT IN (SELECT id FROM ghosts))}
  ]) AS c FROM src_devices
)
SELECT c.check AS "check", c.violations AS violations FROM d"""))
def _(f):
    ghosts = bindings.devices(f.driver("events").withColumn("user_id", F.col("user_id") + 5))
    return checks.document_checks({"devices": f.sources.devices}, {"devices": ghosts.select("id")})


@query("v08_duplicate_ids", stated("""
SELECT id, count(*) AS "rows" FROM (
  SELECT id FROM src_devices UNION ALL
  SELECT printf('DEV-%06d', unnest([u * 3, u * 3 + 1, u * 3 + 2])) FROM (SELECT DISTINCT user_id + 5 AS u FROM events))
GROUP BY id HAVING count(*) > 1"""))
def _(f):
    ghosts = bindings.devices(f.driver("events").withColumn("user_id", F.col("user_id") + 5))
    return checks.duplicate_keys(f.sources.devices.select("id").unionByName(ghosts.select("id")), "id")


@query("g01_run_log", """
SELECT 'run-1' AS run_id, 'silver_transform' AS stage, 'Succeeded' AS status,
       TIMESTAMP '2026-01-31 00:00:00' AS start_ts, TIMESTAMP '2026-01-31 00:05:00' AS end_ts,
       (SELECT count(*) FROM orders) AS rows_read, (SELECT count(*) FROM events) AS rows_written,
       CAST(NULL AS VARCHAR) AS error_message, '2026-01-31' AS run_date""")
def _(f):
    return audit.run_log_row(
        f.spark, "run-1", "silver_transform", "Succeeded", "2026-01-31T00:00:00+00:00",
        "2026-01-31T00:05:00+00:00", f.driver("orders").count(), f.driver("events").count(), "",
        "2026-01-31",
    )


@query("g02_logged_stages", stated("""
SELECT 'silver_transform' AS stage, 'Succeeded' AS status, (SELECT count(*) FROM src_merchants) AS rows_read,
       (SELECT count(*) FROM s_merchants) AS rows_written, CAST(NULL AS VARCHAR) AS error_message
UNION ALL SELECT 'gold_build', 'Failed', 0, 0, 'no silver'"""))
def _(f):
    lake = f.lake("stages")

    def work():
        tagged = with_verdict(f.sources.merchants, rules.merchants())
        names = f.sources.merchants.columns
        written = sinks.write_split(lake, tagged, "merchants", names, names)
        return audit.StageCounts(written.read, written.valid)

    def broken():
        raise RuntimeError("no silver")

    audit.logged_stage(lake, "r", "2026-01-31", "silver_transform", work)
    try:
        audit.logged_stage(lake, "r", "2026-01-31", "gold_build", broken)
    except RuntimeError:
        pass
    return lake.read(audit.RUN_LOG_TABLE).select(
        "stage", "status", "rows_read", "rows_written", "error_message"
    )


_RECONCILED = f"""
, src AS ({_SOURCE_COUNTS}), slv AS ({_SILVER_COUNTS}), gld AS ({_GOLD_COUNTS}),
pairs(kind, source_name, silver_name) AS (VALUES
  ('tables', 'transactions', 'transactions'), ('tables', 'transaction_risk_scores', 'transaction_risk'),
  ('tables', 'merchants', 'merchants'), ('documents', 'digitalSessions', 'sessions'),
  ('documents', 'devices', 'devices'), ('documents', 'fraudAlerts', 'fraud_alerts')
), ones(silver_name, gold_name) AS (VALUES ('merchants', 'dimmerchant'), ('devices', 'dimdevice'),
  ('transactions', 'facttransactions'), ('sessions', 'factdigitalsessions'), ('fraud_alerts', 'factfraudalerts')
), results AS (
  SELECT kind AS source, source_name AS object, src.row_count AS source_count,
         v.row_count + q.row_count AS target_count, 'row_count' AS validation_type,
         CASE WHEN src.row_count = v.row_count + q.row_count THEN 'PASS' ELSE 'FAIL' END AS status
  FROM pairs JOIN src ON src.table_name = source_name JOIN slv v ON v.table_name = silver_name
  JOIN slv q ON q.table_name = 'quarantine_' || silver_name
  UNION ALL
  SELECT 'silver_gold', silver_name || '->' || gold_name, slv.row_count, gld.row_count, 'row_count',
         CASE WHEN slv.row_count = gld.row_count THEN 'PASS' ELSE 'FAIL' END
  FROM ones JOIN slv ON slv.table_name = silver_name JOIN gld ON gld.table_name = gold_name
  UNION ALL
  SELECT 'silver_gold', origin || '->' || table_name, NULL, row_count, 'grain_note', 'PASS'
  FROM gld JOIN (VALUES ('*', 'dimcustomer'), ('transactions', 'dimaccount'), ('*', 'aggcustomerriskprofile'))
       g(origin, gold_name) ON gold_name = table_name
  UNION ALL
  SELECT kind, slv.table_name, NULL, slv.row_count, 'quarantine_count', 'PASS'
  FROM pairs JOIN slv ON slv.table_name = 'quarantine_' || silver_name
)"""


@query("r01_r04_reconciliation", stated(_RECONCILED + " SELECT * FROM results"))
def _(f):
    return audit.reconcile(f.spark, f.sources.by_name(), f.silver, f.gold, "run-1", "2026-01-31").select(
        "source", "object", "source_count", "target_count", "validation_type", "status"
    )


@query("r05_i05_failed_checks", stated(_RECONCILED + """
SELECT source, object, CAST(NULL AS BIGINT) AS source_count, target_count, 'FAIL' AS status
FROM results WHERE object = 'merchants'"""))
def _(f):
    lake = f.lake("reconciliation")
    without_merchants = {**f.sources.by_name(), "merchants": None}
    results = audit.reconcile(f.spark, without_merchants, f.silver, f.gold, "run-1", "2026-01-31")
    try:
        audit.record_reconciliation(lake, results)
    except audit.ReconciliationFailed:
        pass
    recorded = lake.read(audit.RECONCILIATION_TABLE)
    return consumption.failed_checks(recorded).select(
        "source", "object", "source_count", "target_count", "status"
    )


@query("i01_table_inventory", stated(f"""
SELECT 'silver' AS layer, * FROM ({_SILVER_COUNTS}) UNION ALL SELECT 'gold', * FROM ({_GOLD_COUNTS})"""))
def _(f):
    return counts.table_inventory({"silver": f.silver, "gold": f.gold})


@query("i02_row_counts", """
SELECT 'orders' AS table_name, count(*) AS row_count FROM orders
UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def _(f):
    return counts.row_counts({"Orders": f.driver("orders"), "Events": f.driver("events"),
                              "SUPPLIER": f.driver("supplier")})


@query("i03_j06_l01_top_risk_customers", stated("""
SELECT CustomerID, CustomerRiskScore, CustomerRiskBand, TransactionCount30D, TotalTransactionAmount30D,
       AverageTransactionRiskScore, FraudAlertCount, FailedLoginCount, UntrustedDeviceCount,
       GeographicAnomalyCount
FROM profile JOIN spine USING (CustomerID) ORDER BY CustomerRiskScore DESC, CustomerID LIMIT 20""", 30))
def _(f):
    return without_keys(rounded_profile(consumption.top_risk_customers(f.profile(), f.customers)))


# --- the whole refresh ------------------------------------------------------------------------


@query("e1_full_refresh", stated(f"""
, src AS ({_SOURCE_COUNTS}), slv AS ({_SILVER_COUNTS}), gld AS ({_GOLD_COUNTS}),
sums AS (
  SELECT (SELECT sum(row_count) FROM src WHERE table_name IN ('transactions','transaction_risk_scores','merchants')) AS st,
         (SELECT sum(row_count) FROM src) AS s,
         (SELECT sum(row_count) FROM slv WHERE table_name NOT LIKE 'quarantine%') AS v,
         (SELECT sum(row_count) FROM gld) AS g
)
SELECT stage, 'Succeeded' AS status, rr::BIGINT AS rows_read, rw::BIGINT AS rows_written FROM (
  SELECT 'source_validation_tables' AS stage, st AS rr, 0 AS rw FROM sums
  UNION ALL SELECT 'source_validation_documents', s - st, 0 FROM sums
  UNION ALL SELECT 'silver_transform', s, v FROM sums
  UNION ALL SELECT 'gold_build', v, g FROM sums
  UNION ALL SELECT 'warehouse_publish', g, 0 FROM sums
  UNION ALL SELECT 'reconciliation', 20, 20
  UNION ALL SELECT 'pipeline_complete', 0, 0)"""))
def _(f):
    lakes = refresh.Lakes(f.lake("silver"), f.lake("gold"), f.lake("serving"))
    refresh.run_medallion(lakes, f.sources.by_name(), "run-1", "2026-01-31", AS_OF)
    return lakes.gold.read(audit.RUN_LOG_TABLE).select("stage", "status", "rows_read", "rows_written")


@query("e4_incremental_batch", stated("""
SELECT 'transactions' AS object, count(*) + 25 AS row_count FROM src_transactions
UNION ALL SELECT 'transaction_risk_scores', count(*) + 25 FROM src_risk
UNION ALL SELECT 'merchants', count(*) + count(DISTINCT 1) FILTER (NOT EXISTS (
  SELECT 1 FROM src_merchants WHERE MerchantID = 'MER001501')) FROM src_merchants"""))
def _(f):
    lake = f.lake("incremental")
    named = f.sources.by_name()
    typed = {"transactions": silver.typed("transactions", named["transactions"]),
             "transaction_risk_scores": silver.typed("transaction_risk", named["transaction_risk_scores"]),
             "merchants": named["merchants"]}
    base = sinks.seed_tables(lake, typed)["transactions"]
    loading.apply_incremental_batch(lake, base, 25, AS_OF)
    return loading.apply_incremental_batch(lake, base, 25, AS_OF)


@query("e4_document_load", stated("""
SELECT 'digitalSessions' AS container, count(*) FILTER (changeType IS NULL) AS unchanged,
       count(*) FILTER (changeType IS NOT NULL) AS changed FROM (
  SELECT CAST(NULL AS VARCHAR) AS changeType FROM src_sessions WHERE customerId IS NOT NULL
  UNION ALL SELECT 'insert')
UNION ALL SELECT 'devices', count(*) FILTER (NOT hit), 1 FROM (
  SELECT id = 'DEV-000001' AND customerId = 'CUST-000001' AS hit FROM src_devices WHERE customerId IS NOT NULL)
UNION ALL SELECT 'fraudAlerts', count(*) FILTER (NOT hit), 2 FROM (
  SELECT id = 'ALERT-00000001' AND customerId = 'CUST-000001' AS hit FROM src_alerts)"""))
def _(f):
    lake = f.lake("documents")
    named = {name: df for name, df in f.sources.by_name().items() if name in model.DOCUMENT_SOURCES}
    loading.upsert_into(lake, {name: df.where(F.col("customerId").isNotNull()) for name, df in named.items()})
    for _ in range(2):
        loading.upsert_into(lake, incremental.document_batch(f.spark, AS_OF))
    return reduce(DataFrame.unionByName, (
        lake.read(name).agg(
            F.count_if(F.col("changeType").isNull()).alias("unchanged"),
            F.count_if(F.col("changeType").isNotNull()).alias("changed"),
        ).select(F.lit(name).alias("container"), "unchanged", "changed")
        for name in model.DOCUMENT_SOURCES
    ))
