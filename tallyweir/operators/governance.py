"""Row and column rules of the governed views (the masks are in ``functions.masking``)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tallyweir import model

# The claim that opens the restricted band, and the band.
INVESTIGATOR = "RiskInvestigator"
RESTRICTED_BAND = "High"

# Columns a plain reader may see, by table; a column not named here is denied, also a new one.
PERMITTED_COLUMNS = {
    "dimcustomer": ("customersk", model.LOAD_STAMP),
    "dimdevice": (
        "devicesk", "deviceid", "customerid", "customersk", "os", "istrusted", model.LOAD_STAMP,
    ),
}


def secure_rows(df: DataFrame, claim: str | None) -> DataFrame:
    """hide restricted-band rows without the claim; a row without band is hidden too."""
    if claim == INVESTIGATOR:
        return df
    return df.where(F.col("CustomerRiskBand") != RESTRICTED_BAND)


def permitted_columns(df: DataFrame, permitted: Iterable[str]) -> DataFrame:
    """Project to the permitted columns, in the frame's order."""
    allowed = {name.lower() for name in permitted}
    return df.select(*(name for name in df.columns if name.lower() in allowed))
