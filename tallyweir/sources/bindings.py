"""The six source tables, derived from the driver's ``orders``, ``supplier`` and ``events`` tables.

Every rule here is plain arithmetic on row keys, so SQL can state it independently. Defects are
planted on purpose (bad ids, missing keys, out-of-range scores, unparsable JSON) to exercise every
quality rule. Ids are padded, never cut: beyond the digits the contract allows they grow longer and
fail validation rather than collide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweir.session import configure, size_tasks
from tallyweir.sources.tables import read_table

# Declared, so that a scan reads no footer to infer it.
DRIVER_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def read_driver(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{table}.parquet", DRIVER_SCHEMAS[table])


def _key(prefix: str, number: str, digits: int) -> str:
    """SQL text of a key: the prefix and the number padded to at least ``digits``."""
    text = f"cast({number} as string)"
    return f"concat('{prefix}', lpad({text}, greatest({digits}, length({text})), '0'))"


def transactions(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        f"if(o_orderkey % 101 = 0, {_key('BAD-', 'o_orderkey', 9)}, {_key('TXN-', 'o_orderkey', 9)}) AS TransactionID",
        f"{_key('ACCT', '(o_custkey * 2 + o_orderkey % 2)', 9)} AS AccountID",
        f"if(o_orderkey % 97 = 0, NULL, {_key('CUST-', 'o_custkey', 6)}) AS CustomerID",
        f"{_key('MER', '(o_orderkey % 12)', 6)} AS MerchantID",
        "o_orderdate AS TransactionTimestamp",
        """CASE WHEN o_orderkey % 83 = 0 THEN NULL
                WHEN o_orderkey % 89 = 0 THEN -o_totalprice
                ELSE o_totalprice END AS Amount""",
        "element_at(array('USD', 'CAD', 'EUR', 'GBP'), cast(o_orderkey % 4 + 1 as int)) AS Currency",
        """element_at(array('Purchase', 'Refund', 'Transfer', 'ATM Withdrawal'),
                      cast(o_custkey % 4 + 1 as int)) AS TransactionType""",
        "concat('Category ', o_orderkey % 12 % 9) AS MerchantCategory",
        "o_orderpriority AS Channel",
        "element_at(array('US', 'CA', 'GB', 'DE', 'AU'), cast(o_orderkey % 5 + 1 as int)) AS Country",
        f"{_key('DEV-', '(o_custkey * 3 + o_orderkey % 3)', 6)} AS DeviceID",
        "o_orderkey % 2 = 0 AS CardPresent",
        "o_orderstatus AS TransactionStatus",
    )


def transaction_risk_scores(orders: DataFrame) -> DataFrame:
    """Scores of most transactions (some above 100), and some for transactions that do not exist."""
    scored = orders.where("o_orderkey % 13 <> 0").selectExpr(
        f"{_key('TXN-', 'o_orderkey', 9)} AS TransactionID",
        "cast(o_orderkey * 37 % 10700 as double) / 100 AS RiskScore",
        "o_orderdate AS ScoredTimestamp",
    )
    orphaned = orders.where("o_orderkey % 200 = 0").selectExpr(
        f"{_key('TXN-9', 'o_orderkey', 8)} AS TransactionID",
        "cast(50 as double) AS RiskScore",
        "o_orderdate AS ScoredTimestamp",
    )
    return scored.unionByName(orphaned).selectExpr(
        "TransactionID",
        "RiskScore",
        """CASE WHEN RiskScore >= 85 THEN 'Critical' WHEN RiskScore >= 60 THEN 'High'
                WHEN RiskScore >= 30 THEN 'Medium' ELSE 'Low' END AS RiskBand""",
        "'synthetic-risk-v1' AS ModelVersion",
        "ScoredTimestamp",
        "if(RiskScore >= 30, 'velocity', '') AS RiskFactors",
    )


def merchants(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        f"{_key('MER', 's_suppkey', 6)} AS MerchantID",
        "s_name AS MerchantName",
        "if(s_acctbal < 0, NULL, concat('Category ', s_suppkey % 9)) AS MerchantCategory",
        "concat('City ', s_nationkey) AS City",
        "concat('State ', s_nationkey % 5) AS State",
        "element_at(array('US', 'CA', 'GB', 'DE', 'AU'), s_nationkey % 5 + 1) AS Country",
        "element_at(array('High', 'Medium', 'Low'), cast(s_suppkey % 3 + 1 as int)) AS MerchantRiskCategory",
    )


_ISO = "yyyy-MM-dd''T''HH:mm:ss.SSS''Z''".replace("''", "\\'")


def digital_sessions(events: DataFrame) -> DataFrame:
    return events.where("event_type <> 'error'").selectExpr(
        f"{_key('SESSION-', 'event_id', 9)} AS id",
        f"if(event_id % 211 = 0, NULL, {_key('SESSION-', 'event_id', 9)}) AS sessionId",
        f"if(event_id % 223 = 0, NULL, {_key('CUST-', 'user_id', 6)}) AS customerId",
        f"""if(event_id % 53 = 0, '{{"deviceId":',
              concat({_key('{"deviceId":"DEV-', '(user_id * 3 + event_id % 3)', 6)},
                     if(event_id % 2 = 0, '","deviceType":"Mobile","operatingSystem":"iOS 18.3"',
                                          '","deviceType":"Desktop","operatingSystem":"Windows 11"'),
                     ',"appVersion":"5.1.0"}}')) AS device""",
        f"""if(event_id % 307 = 0, 'not a time', date_format(ts, '{_ISO}')) AS loginTimestamp""",
        f"date_format(ts + interval 10 minutes, '{_ISO}') AS logoutTimestamp",
        "concat('203.0.113.', event_id % 254 + 1) AS ipAddress",
        """CASE WHEN event_id % 59 = 0 THEN '{}'
                WHEN event_id % 25 = 0 THEN '{"country":"GB","state":"ENG","city":"London"}'
                ELSE '{"country":"US","state":"NY","city":"New York"}' END AS geo""",
        """CASE WHEN event_id % 41 = 0 THEN '{"method":"password","failedAttempts":"x"}'
                ELSE concat('{"method":"', if(event_id % 3 = 0, 'biometric', 'password+mfa'),
                            '","mfaUsed":', if(event_id % 5 = 0, 'false', 'true'),
                            ',"failedAttempts":',
                            if(cast(get_json_object(props, '$.k') as bigint) < 15,
                               cast(get_json_object(props, '$.k') as bigint), 0L), '}')
           END AS authentication""",
        """concat('[{"activityType":"', event_type, '"}]') AS activities""",
        "cast(event_id % 101 as int) AS sessionRiskScore",
        "true AS synthetic",
    )


def devices(events: DataFrame) -> DataFrame:
    """Three devices per user seen in the events."""
    owned = events.select("user_id").distinct().selectExpr(
        "user_id", "explode(array(user_id * 3, user_id * 3 + 1, user_id * 3 + 2)) AS n"
    )
    return owned.selectExpr(
        f"{_key('DEV-', 'n', 6)} AS id",
        f"if(n % 113 = 0, NULL, {_key('DEV-', 'n', 6)}) AS deviceId",
        f"if(n % 127 = 0, NULL, {_key('CUST-', 'user_id', 6)}) AS customerId",
        "'2023-01-01T00:00:00.000Z' AS firstSeen",
        "'2024-01-30T00:00:00.000Z' AS lastSeen",
        "if(n % 31 = 0, NULL, n % 7 <> 0) AS trusted",
        f"{_key('SYNTH-FP-', 'n', 16)} AS deviceFingerprint",
        "if(n % 2 = 0, 'iOS 18.3', 'Windows 11') AS operatingSystem",
        "'5.1.0' AS appVersion",
        """if(n % 7 = 0, '["new_device"]', '[]') AS riskSignals""",
        """CASE WHEN n % 6 = 0 THEN NULL
                WHEN n % 23 = 0 THEN '[{"country":'
                WHEN n % 29 = 0 THEN '[]'
                WHEN n % 11 = 0 THEN '[{"country":"US","state":"NY"},{"country":"GB","state":"ENG"}]'
                WHEN n % 13 = 0 THEN '[{"state":"NY"}]'
                ELSE '[{"country":"US","state":"NY"},{"country":"US","state":"IL"}]' END AS geoHistory""",
        "true AS synthetic",
    )


def fraud_alerts(events: DataFrame, orders: DataFrame | None) -> DataFrame:
    """Alerts; every other pair refers to the customer's first transaction.

    Without ``orders`` that reference stays NULL and its lookup is not planned, for plans that do
    not read it.
    """
    alerts = events.where("event_type = 'error'")
    if orders is None:
        alerts = alerts.selectExpr("*", "cast(NULL as bigint) AS first_order")
    else:
        first = orders.groupBy("o_custkey").agg({"o_orderkey": "min"}).toDF("user_id", "first_order")
        alerts = alerts.join(first, "user_id", "left")
    return alerts.selectExpr(
        f"{_key('ALERT-', 'event_id', 8)} AS id",
        f"if(event_id % 103 = 0, NULL, {_key('ALERT-', 'event_id', 8)}) AS alertId",
        f"{_key('CUST-', 'user_id', 6)} AS customerId",
        f"""if(event_id div 2 % 2 = 0 AND first_order IS NOT NULL,
              {_key('TXN-', 'first_order', 9)}, NULL) AS transactionId""",
        f"date_format(ts, '{_ISO}') AS createdTimestamp",
        """element_at(array('transactionAnomaly', 'accountTakeover', 'newDevice', 'geoAnomaly', 'velocity'),
                      cast(event_id % 7 % 5 + 1 as int)) AS alertType""",
        """element_at(array('low', 'medium', 'high', 'critical', 'High'),
                      cast(event_id % 5 + 1 as int)) AS severity""",
        """element_at(array('open', 'investigating', 'resolved', 'dismissed'),
                      cast(event_id % 4 + 1 as int)) AS status""",
        """'["velocityAnomaly"]' AS signals""",
        "'[]' AS investigatorNotes",
        """if(event_id % 4 >= 2, '{"outcome":"falsePositive"}', NULL) AS resolution""",
        "true AS synthetic",
    )


def session_lines(sessions: DataFrame, *carry: str) -> DataFrame:
    """Sessions as JSON lines with their nested parts as real JSON; broken parts make broken lines. ``carry`` stay beside them."""
    text = ("id", "sessionId", "customerId", "loginTimestamp", "logoutTimestamp", "ipAddress")
    nested = ("device", "geo", "authentication", "activities", "sessionRiskScore", "synthetic")
    properties = [f"""concat('"{name}":"', {name}, '"')""" for name in text]
    properties += [f"""concat('"{name}":', cast({name} as string))""" for name in nested]
    # concat_ws leaves out NULLs: an absent value is an absent property.
    return sessions.selectExpr(f"concat('{{', concat_ws(',', {', '.join(properties)}), '}}') AS value", *carry)


@dataclass(frozen=True)
class Sources:
    """The six sources as lazy frames over one folder of driver tables."""

    spark: SparkSession
    sf_dir: str

    def driver(self, table: str) -> DataFrame:
        return read_driver(self.spark, self.sf_dir, table)

    @property
    def transactions(self) -> DataFrame:
        return transactions(self.driver("orders"))

    @property
    def transaction_risk_scores(self) -> DataFrame:
        return transaction_risk_scores(self.driver("orders"))

    @property
    def merchants(self) -> DataFrame:
        return merchants(self.driver("supplier"))

    @property
    def digital_sessions(self) -> DataFrame:
        return digital_sessions(self.driver("events"))

    @property
    def devices(self) -> DataFrame:
        return devices(self.driver("events"))

    @property
    def fraud_alerts(self) -> DataFrame:
        return fraud_alerts(self.driver("events"), self.driver("orders"))

    @property
    def unlinked_fraud_alerts(self) -> DataFrame:
        return fraud_alerts(self.driver("events"), None)

    @property
    def spread_sessions(self) -> DataFrame:
        """``digital_sessions`` dealt to all cores while they are narrow, for writing documents out.

        However few splits the scan has, the texts are not made by as few tasks.
        """
        return digital_sessions(self.driver("events").hint("rebalance", F.col("event_id")))

    def by_name(self) -> dict[str, DataFrame]:
        return {
            "transactions": self.transactions,
            "transaction_risk_scores": self.transaction_risk_scores,
            "merchants": self.merchants,
            "digitalSessions": self.digital_sessions,
            "devices": self.devices,
            "fraudAlerts": self.fraud_alerts,
        }


def bind(spark: SparkSession, sf_dir: str) -> Sources:
    configure(spark)
    sources = Sources(spark, sf_dir)
    size_tasks(spark, sources.driver("orders"), sources.driver("events"))
    return sources
