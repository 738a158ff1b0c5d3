import pytest

from tallyweir.functions.masking import full_mask, partial_mask
from tallyweir.operators.governance import INVESTIGATOR, PERMITTED_COLUMNS, permitted_columns, secure_rows
from tallyweir.plans import serving


@pytest.mark.parametrize("claim, bands", [
    (None, ["Low", "Medium"]), (INVESTIGATOR, ["High", "Low", "Medium", None]), ("Auditor", ["Low", "Medium"]),
    ("riskinvestigator", ["Low", "Medium"]),
])
def test_row_security(frame, claim, bands):
    df = frame("CustomerRiskBand string", ("High",), ("Medium",), ("Low",), (None,))
    assert sorted((r[0] for r in secure_rows(df, claim).collect()), key=lambda b: b or "z") == bands


def test_masks(frame):
    df = frame("c string", ("CUST-000042",), (None,), ("AB",), ("ABCDE",), ("",))
    assert [r[0] for r in df.select(partial_mask("c")).collect()] == [
        "CUST-XXXXXX", None, "XXXXXX", "XXXXXX", "XXXXXX"
    ]
    assert [r[0] for r in df.select(full_mask("c")).collect()] == ["XXXX", None, "XXXX", "XXXX", "XXXX"]


def test_new_columns_are_denied(frame):
    df = frame("CustomerSK int, CustomerID string, Extra int, _gold_loaded_at int", (1, "c", 2, 3))
    assert permitted_columns(df, PERMITTED_COLUMNS["dimcustomer"]).columns == ["CustomerSK", "_gold_loaded_at"]


def test_views_mask_unless_privileged(frame):
    device = frame(
        "DeviceSK bigint, DeviceID string, CustomerID string, CustomerSK bigint, OS string, "
        "DeviceFingerprint string, IsTrusted boolean", (1, "d", "c", 2, "os", "secret", True))
    assert serving.governed("dimdevice", device).first()["DeviceFingerprint"] == "XXXX"
    assert serving.governed("dimdevice", device, privileged=True).first()["DeviceFingerprint"] == "secret"


def test_a_plain_readers_views_hold_permitted_columns_only(profile_of, sources):
    from tallyweir.plans.gold import build_gold
    from tallyweir.plans.silver import build_silver, flat_frames

    gold = build_gold(flat_frames(build_silver(sources(devices=[{}], transactions=[{}]))))
    plain = serving.serving_views(gold, plain_reader=True)
    full = serving.serving_views(gold)
    assert plain["dimcustomer"].columns == ["CustomerSK"] and "DeviceFingerprint" not in plain["dimdevice"].columns
    assert all(plain[t].columns == full[t].columns for t in full if t not in PERMITTED_COLUMNS)
    for table, names in PERMITTED_COLUMNS.items():
        assert {c.lower() for c in plain[table].columns} <= set(names)
