import pytest
from pyspark.sql import functions as F

from tallyweir import model
from tallyweir.operators import checks
from tallyweir.sources import tables
from tallyweir.sources.calendar import dim_date
from tallyweir.sources.documents import document_schema, read_documents
from tallyweir.session import scan_size, size_tasks, sized_tasks

GOOD = '{"id":"D1","customerId":"CUST-000001","geoHistory":[{"country":"US"}],"trusted":true,"unknown":1}'
LINES = [
    GOOD, "", "   ", '{"id":"","customerId":"c"}', '{"customerId":"c"}', '{"id":"x","customerId":null}',
    '{"id":"broken"',
]


@pytest.fixture
def device_file(spark, folder):
    def write(lines):
        spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode(
            "overwrite").text(folder)
        return folder
    return write


def test_documents_keep_nested_text_and_absent_is_null(spark, device_file):
    found = read_documents(spark, device_file([GOOD, "", "  "]), "devices").collect()
    assert len(found) == 1
    assert found[0]["geoHistory"] == '[{"country":"US"}]' and found[0]["riskSignals"] is None
    assert list(found[0].asDict()) == document_schema("devices").names


def test_documents_without_identity_stop_or_are_set_aside(spark, device_file):
    path = device_file(LINES)
    scan = read_documents(spark, path, "devices", "quarantine")
    assert scan.accepted.count() == 1 and scan.rejected.count() == 4
    assert scan.rejected.where(F.col("_corrupt_record").isNotNull()).count() == 1
    assert all(r["file"].startswith("file:") for r in scan.rejected.collect())
    failing = read_documents(spark, path, "devices")
    for action in (failing.count, failing.collect, failing.select("trusted").count):
        with pytest.raises(Exception, match="are required"):
            action()
    with pytest.raises(ValueError):
        read_documents(spark, path, "devices", "ignore")
    with pytest.raises(ValueError):
        document_schema("nope")


def test_missing_tables_are_named(spark, folder):
    with pytest.raises(tables.SourceUnavailable, match="absent_table"):
        tables.read_named(spark, "absent_table")
    with pytest.raises(tables.SourceUnavailable, match="nowhere"):
        tables.read_path(spark, folder + "/nowhere")
    assert tables.read_path(spark, folder + "/nowhere", on_missing="none") is None
    with pytest.raises(tables.SourceUnavailable, match="a1, a2"):
        tables.require_tables(spark, ["a1", "a2"])


def test_calendar(spark):
    days = dim_date(spark)
    assert days.count() == 4018
    sunday = days.where("DateKey = 20260201").first()
    assert (sunday["DayOfWeek"], sunday["DayName"], sunday["IsWeekend"], sunday["Quarter"]) == (1, "Sunday", True, 1)
    assert sunday["MonthName"] == "February"


def test_gate(frame):
    full, empty = frame("a int", (1,)), frame("a int")
    assert checks.gate_nonempty({"Full": full}) == {"Full": 1}
    with pytest.raises(checks.CheckFailed, match="Empty"):
        checks.gate_nonempty({"Full": full, "Empty": empty})


def test_table_checks(rows):
    clean = (rows("transactions", {}), rows("transaction_risk_scores", {}), rows("merchants", {}))
    found = checks.table_checks(*clean)
    assert found.count() == 21
    checks.require_clean(found)
    broken = checks.table_checks(
        rows("transactions", {}, {}, {"TransactionID": None, "CustomerID": "X", "Amount": 0.0, "MerchantID": "MER9"}),
        rows("transaction_risk_scores", {"RiskScore": float("nan"), "RiskBand": None}, {"TransactionID": "T"}),
        clean[2],
    )
    bad = {r["check"]: r["violations"] for r in broken.where("violations > 0").collect()}
    assert bad == {
        "transactions: TransactionID present": 1,
        "transactions: TransactionID starts with TXN-": 1,
        "transactions: CustomerID starts with CUST-": 1,
        "transactions: Amount positive": 1,
        "transactions: TransactionID unique": 2,
        "transactions: MerchantID known": 1,
        "risk scores: RiskScore within 0 and 100": 1,
        "risk scores: RiskBand known": 1,
        "risk scores: TransactionID known": 1,
    }
    with pytest.raises(checks.CheckFailed, match="9 checks failed"):
        checks.require_clean(broken)


def test_document_checks(rows):
    devices = rows("devices", {}, {"customerId": "C1"}, {"deviceId": "D-1", "customerId": None, "geoHistory": None})
    found = checks.document_violations(devices, "devices").first()
    assert found["documents"] == 3 and found["bad_customer_id"] == 2 and found["bad_device_id"] == 1
    assert found["missing_required"] == 3  # the fixtures leave out firstSeen and others
    assert checks.schema_variation(devices, "devices").first()["varies"] is True
    assert checks.schema_variation(rows("devices", {}), "devices").first()["varies"] is False
    sessions = rows("digitalSessions", {"device": '{"deviceId":"bad"}'}, {"device": "{}"})
    assert checks.document_violations(sessions, "digitalSessions").first()["bad_device_id"] == 1


def test_document_checks_together_raise(rows, frame):
    devices = rows("devices", {"geoHistory": None}, {"customerId": "C1"}, {"customerId": "CUST-000002"}, {"deviceId": "D-1", "id": "D2"})
    found = checks.document_checks({"devices": devices}, {"devices": frame("id string", ("DEV-000001",), ("D3",))})
    counted = {r["check"]: r["violations"] for r in found.collect()}
    assert counted["devices: customerId well formed"] == 1 and counted["devices: deviceId well formed"] == 1
    assert counted["devices: id unique"] == 1 and counted["devices: geoHistory varies"] == 0
    assert counted["devices: no missing ids"] == 1 and counted["devices: no unexpected ids"] == 1
    with pytest.raises(checks.CheckFailed, match="devices: id unique"):
        checks.require_clean(found)


def test_id_differences(frame):
    found = checks.id_differences(frame("id int", (1,), (2,), (2,)), frame("id int", (2,), (3,), (3,)), "id")
    assert {tuple(r) for r in found.collect()} == {(1, "missing"), (3, "unexpected")}


def test_sizes_follow_the_scans_and_only_grow(spark):
    unknown = spark.createDataFrame([(1,)], "a int")
    settings = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")
    before = {key: spark.conf.get(key) for key in settings}
    small, huge = spark.range(1000), spark.range(10**13)
    # A join is what it reads, not the product of its sides; rows from the driver say nothing.
    assert scan_size(small.join(spark.range(1000).withColumnRenamed("id", "n"), F.col("n") > 1)).known_bytes == 16000
    assert scan_size(unknown) == (0, False)
    size_tasks(spark, small, unknown)
    assert {key: spark.conf.get(key) for key in settings} == before
    try:
        size_tasks(spark, huge)
        assert spark.conf.get(settings[0]) == "50000"
        assert int(spark.conf.get(settings[1])) == scan_size(huge).known_bytes // 100_000
        spark.conf.set(settings[0], "7")
        with sized_tasks(spark, huge):
            assert spark.conf.get(settings[0]) == "50000"
        assert spark.conf.get(settings[0]) == "7"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_contracts_name_their_required_fields():
    for container, fields in model.REQUIRED_FIELDS.items():
        assert set(fields) <= set(document_schema(container).names)
