"""Customer risk score: an explainable heuristic on synthetic data, not a calibrated model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weight of the average transaction score, then points per event and their cap.
AVERAGE_WEIGHT = 0.45
SIGNAL_POINTS = {
    "FraudAlertCount": (12.0, 24.0),
    "FailedLoginCount": (2.0, 12.0),
    "UntrustedDeviceCount": (5.0, 10.0),
    "GeographicAnomalyCount": (3.0, 9.0),
}
SCORE_CEILING = 100.0
# Lower bound of a band, highest first.
BAND_FLOORS = (("High", 80), ("Medium", 45))
LOWEST_BAND = "Low"


def customer_risk_score() -> Column:
    """P10: weighted average plus capped signal points, at most 100, two decimals."""
    total = F.coalesce(F.col("AverageTransactionRiskScore"), F.lit(0.0)) * F.lit(AVERAGE_WEIGHT)
    for signal, (points, cap) in SIGNAL_POINTS.items():
        total = total + F.least(F.col(signal) * F.lit(points), F.lit(cap))
    return F.round(F.least(total, F.lit(SCORE_CEILING)), 2)


def customer_risk_band(score: str | Column = "CustomerRiskScore") -> Column:
    """Band of an already rounded score."""
    value = F.col(score) if isinstance(score, str) else score
    band = F.lit(LOWEST_BAND)
    for name, floor in reversed(BAND_FLOORS):
        band = F.when(value >= floor, F.lit(name)).otherwise(band)
    return band
