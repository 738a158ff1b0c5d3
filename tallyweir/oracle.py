"""Independent SQL statement of the demo tables and of every SQL-expressible query.

``PRELUDE`` states the six sources, Silver and Gold over the driver's tables; each query adds its
own final SELECT. Nothing here is used by the library.
"""

from __future__ import annotations


def _exact(expression: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal text of a double."""
    return f"round(({expression})::VARCHAR::DECIMAL(38,18), {digits})::DOUBLE"


_ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"

PRELUDE = f"""
WITH src_transactions AS (
  SELECT CASE WHEN o_orderkey % 101 = 0 THEN printf('BAD-%09d', o_orderkey)
              ELSE printf('TXN-%09d', o_orderkey) END AS TransactionID,
         printf('ACCT%09d', o_custkey * 2 + o_orderkey % 2) AS AccountID,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE printf('CUST-%06d', o_custkey) END AS CustomerID,
         printf('MER%06d', o_orderkey % 12) AS MerchantID,
         o_orderdate AS TransactionTimestamp,
         CASE WHEN o_orderkey % 83 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN -o_totalprice
              ELSE o_totalprice END AS Amount,
         (['USD','CAD','EUR','GBP'])[o_orderkey % 4 + 1] AS Currency,
         (['Purchase','Refund','Transfer','ATM Withdrawal'])[o_custkey % 4 + 1] AS TransactionType,
         'Category ' || (o_orderkey % 12 % 9) AS MerchantCategory,
         o_orderpriority AS Channel,
         (['US','CA','GB','DE','AU'])[o_orderkey % 5 + 1] AS Country,
         printf('DEV-%06d', o_custkey * 3 + o_orderkey % 3) AS DeviceID,
         o_orderkey % 2 = 0 AS CardPresent,
         o_orderstatus AS TransactionStatus
  FROM orders
), raw_scores AS (
  SELECT printf('TXN-%09d', o_orderkey) AS TransactionID,
         (o_orderkey * 37 % 10700)::DOUBLE / 100 AS RiskScore, o_orderdate AS ScoredTimestamp
  FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL
  SELECT printf('TXN-9%08d', o_orderkey), 50::DOUBLE, o_orderdate FROM orders WHERE o_orderkey % 200 = 0
), src_risk AS (
  SELECT TransactionID, RiskScore,
         CASE WHEN RiskScore >= 85 THEN 'Critical' WHEN RiskScore >= 60 THEN 'High'
              WHEN RiskScore >= 30 THEN 'Medium' ELSE 'Low' END AS RiskBand,
         'synthetic-risk-v1' AS ModelVersion, ScoredTimestamp,
         CASE WHEN RiskScore >= 30 THEN 'velocity' ELSE '' END AS RiskFactors
  FROM raw_scores
), src_merchants AS (
  SELECT printf('MER%06d', s_suppkey) AS MerchantID, s_name AS MerchantName,
         CASE WHEN s_acctbal < 0 THEN NULL ELSE 'Category ' || (s_suppkey % 9) END AS MerchantCategory,
         'City ' || s_nationkey AS City, 'State ' || (s_nationkey % 5) AS State,
         (['US','CA','GB','DE','AU'])[s_nationkey % 5 + 1] AS Country,
         (['High','Medium','Low'])[s_suppkey % 3 + 1] AS MerchantRiskCategory
  FROM supplier
), src_sessions AS (
  SELECT printf('SESSION-%09d', event_id) AS id,
         CASE WHEN event_id % 211 = 0 THEN NULL ELSE printf('SESSION-%09d', event_id) END AS sessionId,
         CASE WHEN event_id % 223 = 0 THEN NULL ELSE printf('CUST-%06d', user_id) END AS customerId,
         CASE WHEN event_id % 53 = 0 THEN '{{"deviceId":'
              ELSE '{{"deviceId":"' || printf('DEV-%06d', user_id * 3 + event_id % 3) || '","deviceType":"' ||
                   CASE WHEN event_id % 2 = 0 THEN 'Mobile' ELSE 'Desktop' END || '","operatingSystem":"' ||
                   CASE WHEN event_id % 2 = 0 THEN 'iOS 18.3' ELSE 'Windows 11' END ||
                   '","appVersion":"5.1.0"}}' END AS device,
         CASE WHEN event_id % 307 = 0 THEN 'not a time' ELSE strftime(ts, {_ISO}) END AS loginTimestamp,
         strftime(ts + INTERVAL 10 MINUTE, {_ISO}) AS logoutTimestamp,
         '203.0.113.' || (event_id % 254 + 1) AS ipAddress,
         CASE WHEN event_id % 59 = 0 THEN '{{}}'
              WHEN event_id % 25 = 0 THEN '{{"country":"GB","state":"ENG","city":"London"}}'
              ELSE '{{"country":"US","state":"NY","city":"New York"}}' END AS geo,
         CASE WHEN event_id % 41 = 0 THEN '{{"method":"password","failedAttempts":"x"}}'
              ELSE '{{"method":"' || CASE WHEN event_id % 3 = 0 THEN 'biometric' ELSE 'password+mfa' END ||
                   '","mfaUsed":' || CASE WHEN event_id % 5 = 0 THEN 'false' ELSE 'true' END ||
                   ',"failedAttempts":' ||
                   CASE WHEN (props->>'$.k')::BIGINT < 15 THEN (props->>'$.k')::BIGINT ELSE 0 END || '}}'
              END AS authentication,
         '[{{"activityType":"' || event_type || '"}}]' AS activities,
         (event_id % 101)::INTEGER AS sessionRiskScore, true AS synthetic
  FROM events WHERE event_type <> 'error'
), device_numbers AS (
  SELECT user_id, unnest([user_id * 3, user_id * 3 + 1, user_id * 3 + 2]) AS n
  FROM (SELECT DISTINCT user_id FROM events)
), src_devices AS (
  SELECT printf('DEV-%06d', n) AS id,
         CASE WHEN n % 113 = 0 THEN NULL ELSE printf('DEV-%06d', n) END AS deviceId,
         CASE WHEN n % 127 = 0 THEN NULL ELSE printf('CUST-%06d', user_id) END AS customerId,
         '2023-01-01T00:00:00.000Z' AS firstSeen, '2024-01-30T00:00:00.000Z' AS lastSeen,
         CASE WHEN n % 31 = 0 THEN NULL ELSE n % 7 <> 0 END AS trusted,
         printf('SYNTH-FP-%016d', n) AS deviceFingerprint,
         CASE WHEN n % 2 = 0 THEN 'iOS 18.3' ELSE 'Windows 11' END AS operatingSystem,
         '5.1.0' AS appVersion,
         CASE WHEN n % 7 = 0 THEN '["new_device"]' ELSE '[]' END AS riskSignals,
         CASE WHEN n % 6 = 0 THEN NULL WHEN n % 23 = 0 THEN '[{{"country":' WHEN n % 29 = 0 THEN '[]'
              WHEN n % 11 = 0 THEN '[{{"country":"US","state":"NY"}},{{"country":"GB","state":"ENG"}}]'
              WHEN n % 13 = 0 THEN '[{{"state":"NY"}}]'
              ELSE '[{{"country":"US","state":"NY"}},{{"country":"US","state":"IL"}}]' END AS geoHistory,
         true AS synthetic
  FROM device_numbers
), src_alerts AS (
  SELECT printf('ALERT-%08d', event_id) AS id,
         CASE WHEN event_id % 103 = 0 THEN NULL ELSE printf('ALERT-%08d', event_id) END AS alertId,
         printf('CUST-%06d', user_id) AS customerId,
         CASE WHEN event_id // 2 % 2 = 0 AND first_order IS NOT NULL
              THEN printf('TXN-%09d', first_order) END AS transactionId,
         strftime(ts, {_ISO}) AS createdTimestamp,
         (['transactionAnomaly','accountTakeover','newDevice','geoAnomaly','velocity'])[event_id % 7 % 5 + 1]
           AS alertType,
         (['low','medium','high','critical','High'])[event_id % 5 + 1] AS severity,
         (['open','investigating','resolved','dismissed'])[event_id % 4 + 1] AS status,
         '["velocityAnomaly"]' AS signals, '[]' AS investigatorNotes,
         CASE WHEN event_id % 4 >= 2 THEN '{{"outcome":"falsePositive"}}' END AS resolution,
         true AS synthetic
  FROM events
  LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey)
    ON o_custkey = user_id
  WHERE event_type = 'error'
), j_transactions AS (
  SELECT *, coalesce(regexp_full_match(TransactionID, 'TXN-[0-9]{{9}}') AND CustomerID IS NOT NULL
                     AND TransactionTimestamp IS NOT NULL AND Amount >= 0, false) AS ok
  FROM src_transactions
), s_transactions AS (SELECT * EXCLUDE ok FROM j_transactions WHERE ok
), j_risk AS (
  SELECT r.*, k.TransactionID IS NOT NULL AS known,
         coalesce(RiskScore BETWEEN 0 AND 100 AND k.TransactionID IS NOT NULL, false) AS ok
  FROM src_risk r LEFT JOIN (SELECT DISTINCT TransactionID FROM s_transactions) k USING (TransactionID)
), s_risk AS (SELECT * EXCLUDE (ok, known) FROM j_risk WHERE ok
), j_merchants AS (
  SELECT *, MerchantID IS NOT NULL AND MerchantCategory IS NOT NULL AS ok FROM src_merchants
), s_merchants AS (SELECT * EXCLUDE ok FROM j_merchants WHERE ok
), t_sessions AS (
  SELECT * REPLACE (try_cast(replace(loginTimestamp, 'Z', '') AS TIMESTAMP) AS loginTimestamp,
                    try_cast(replace(logoutTimestamp, 'Z', '') AS TIMESTAMP) AS logoutTimestamp)
  FROM src_sessions
), j_sessions AS (
  SELECT *, customerId IS NOT NULL AND sessionId IS NOT NULL AS ok FROM t_sessions
), s_sessions AS (
  SELECT * EXCLUDE (ok, device, geo, authentication),
         CASE WHEN json_valid(device) THEN device->>'$.deviceId' END AS device_deviceId,
         CASE WHEN json_valid(device) THEN device->>'$.deviceType' END AS device_deviceType,
         CASE WHEN json_valid(device) THEN device->>'$.operatingSystem' END AS device_operatingSystem,
         geo->>'$.country' AS geo_country, geo->>'$.state' AS geo_state, geo->>'$.city' AS geo_city,
         authentication->>'$.method' AS auth_method,
         try_cast(authentication->>'$.mfaUsed' AS BOOLEAN) AS auth_mfaUsed,
         try_cast(authentication->>'$.failedAttempts' AS INTEGER) AS auth_failedAttempts
  FROM j_sessions WHERE ok
), j_devices AS (
  SELECT *, deviceId IS NOT NULL AND customerId IS NOT NULL AS ok FROM src_devices
), s_devices AS (SELECT * EXCLUDE ok FROM j_devices WHERE ok
), j_alerts AS (
  SELECT * REPLACE (try_cast(replace(createdTimestamp, 'Z', '') AS TIMESTAMP) AS createdTimestamp),
         coalesce(alertId IS NOT NULL AND customerId IS NOT NULL
                  AND severity IN ('low','medium','high','critical'), false) AS ok
  FROM src_alerts
), s_alerts AS (SELECT * EXCLUDE ok FROM j_alerts WHERE ok
), spine AS (
  SELECT CustomerID FROM s_transactions UNION SELECT customerId FROM s_sessions
  UNION SELECT customerId FROM s_devices UNION SELECT customerId FROM s_alerts
), fact_t AS (
  SELECT t.TransactionID, t.CustomerID, t.AccountID, t.MerchantID,
         strftime(TransactionTimestamp, '%Y%m%d')::INTEGER AS DateKey, TransactionTimestamp, Amount,
         Currency, TransactionType, Channel, Country, DeviceID, CardPresent, TransactionStatus,
         RiskScore, RiskBand
  FROM s_transactions t LEFT JOIN s_risk r ON t.TransactionID = r.TransactionID
), fact_s AS (
  SELECT sessionId AS SessionID, customerId AS CustomerID, device_deviceId AS DeviceID,
         strftime(loginTimestamp, '%Y%m%d')::INTEGER AS DateKey, loginTimestamp AS LoginTimestamp,
         logoutTimestamp AS LogoutTimestamp, device_deviceType AS DeviceType,
         device_operatingSystem AS DeviceOS, geo_country AS GeoCountry, geo_state AS GeoState,
         geo_city AS GeoCity, ipAddress AS GeoIpAddress, auth_method AS AuthMethod,
         auth_mfaUsed AS AuthMfaUsed, auth_failedAttempts AS AuthFailedAttempts,
         activities AS ActivitiesJson
  FROM s_sessions
), fact_a AS (
  SELECT alertId AS AlertID, customerId AS CustomerID, transactionId AS TransactionID,
         strftime(createdTimestamp, '%Y%m%d')::INTEGER AS DateKey, createdTimestamp AS AlertTimestamp,
         severity AS Severity, alertType AS AlertType
  FROM s_alerts
), clocks AS (
  SELECT (SELECT max(TransactionTimestamp::DATE) FROM fact_t) AS txn_day,
         (SELECT max(LoginTimestamp::DATE) FROM fact_s) AS session_day
), home AS (
  SELECT deviceId AS DeviceID,
         list_distinct(flatten(list(coalesce(json_extract_string(geoHistory, '$[*].country'), [])))) AS countries
  FROM s_devices WHERE geoHistory IS NOT NULL AND json_valid(geoHistory) AND json_array_length(geoHistory) > 0
  GROUP BY deviceId
)"""


def metrics(txn_days: int, session_days: int, name: str = "profile") -> str:
    """CTEs of the windowed metrics and the profile, by the textbook join per metric."""
    return f""",
w_t AS (
  SELECT f.* FROM fact_t f, clocks
  WHERE TransactionTimestamp::DATE BETWEEN txn_day - {txn_days - 1} AND txn_day
), w_s AS (
  SELECT f.* FROM fact_s f, clocks
  WHERE LoginTimestamp::DATE BETWEEN session_day - {session_days - 1} AND session_day
), w_a AS (
  SELECT f.* FROM fact_a f, clocks
  WHERE AlertTimestamp::DATE BETWEEN session_day - {session_days - 1} AND session_day
), m_t AS (
  SELECT CustomerID, count(*) AS TransactionCount30D, sum(Amount) AS TotalTransactionAmount30D,
         avg(RiskScore) AS AverageTransactionRiskScore,
         count(*) FILTER (RiskBand IN ('High','Critical')) AS HighRiskTransactionCount
  FROM w_t GROUP BY CustomerID
), m_a AS (SELECT CustomerID, count(*) AS FraudAlertCount FROM w_a GROUP BY CustomerID
), m_s AS (
  SELECT CustomerID, count(*) FILTER (AuthFailedAttempts > 0) AS FailedLoginCount,
         count(DISTINCT DeviceID) AS DistinctDeviceCount
  FROM w_s GROUP BY CustomerID
), m_u AS (
  SELECT s.CustomerID, count(DISTINCT s.DeviceID) AS UntrustedDeviceCount
  FROM w_s s JOIN s_devices d ON d.deviceId = s.DeviceID WHERE d.trusted = false GROUP BY s.CustomerID
), m_g AS (
  SELECT CustomerID, count(*) AS GeographicAnomalyCount FROM (
    SELECT DISTINCT s.CustomerID, s.DeviceID, s.GeoCountry FROM w_s s JOIN home h ON h.DeviceID = s.DeviceID
    WHERE s.GeoCountry IS NOT NULL AND NOT list_contains(h.countries, s.GeoCountry))
  GROUP BY CustomerID
), joined AS (
  SELECT CustomerID, coalesce(TransactionCount30D, 0) AS TransactionCount30D,
         coalesce(TotalTransactionAmount30D, 0.0::DOUBLE) AS TotalTransactionAmount30D,
         AverageTransactionRiskScore, coalesce(HighRiskTransactionCount, 0) AS HighRiskTransactionCount,
         coalesce(FraudAlertCount, 0) AS FraudAlertCount, coalesce(FailedLoginCount, 0) AS FailedLoginCount,
         coalesce(DistinctDeviceCount, 0) AS DistinctDeviceCount,
         coalesce(UntrustedDeviceCount, 0) AS UntrustedDeviceCount,
         coalesce(GeographicAnomalyCount, 0) AS GeographicAnomalyCount
  FROM spine LEFT JOIN m_t USING (CustomerID) LEFT JOIN m_a USING (CustomerID)
  LEFT JOIN m_s USING (CustomerID) LEFT JOIN m_u USING (CustomerID) LEFT JOIN m_g USING (CustomerID)
), scored AS (
  SELECT *, {_exact('''least(coalesce(AverageTransactionRiskScore, 0.0::DOUBLE) * 0.45::DOUBLE
             + least(FraudAlertCount * 12.0::DOUBLE, 24.0::DOUBLE)
             + least(FailedLoginCount * 2.0::DOUBLE, 12.0::DOUBLE)
             + least(UntrustedDeviceCount * 5.0::DOUBLE, 10.0::DOUBLE)
             + least(GeographicAnomalyCount * 3.0::DOUBLE, 9.0::DOUBLE), 100.0::DOUBLE)''', 2)}
         AS CustomerRiskScore
  FROM joined
), {name} AS (
  SELECT * REPLACE ({_exact('TotalTransactionAmount30D', 2)} AS TotalTransactionAmount30D,
                    {_exact('AverageTransactionRiskScore', 6)} AS AverageTransactionRiskScore),
         CASE WHEN CustomerRiskScore >= 80 THEN 'High' WHEN CustomerRiskScore >= 45 THEN 'Medium'
              ELSE 'Low' END AS CustomerRiskBand
  FROM scored
)"""


def stated(final: str, days: int | None = None) -> str:
    """A complete statement: the prelude, the metrics where a window length is given, the SELECT."""
    return PRELUDE + (metrics(days, days) if days else "") + "\n" + final
