import json

import pytest

from tallyweir.operators.merge import upsert_documents
from tallyweir.sources.documents import document_schema, read_documents
from tallyweir.streaming import documents as streaming


def device(n, trusted=True, customer="CUST-000001", **more):
    return json.dumps({"id": f"D{n}", "customerId": customer, "deviceId": f"D{n}", "trusted": trusted, **more})


@pytest.fixture
def ingest(spark, folder):
    def run(lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder + "/in")
        streaming.start_ingest(
            spark, folder + "/in", "devices", folder + "/log", folder + "/cp", rejects=folder + "/rejects"
        ).awaitTermination()
        return streaming.current_documents(spark, folder + "/log", "devices")
    return run


def content(df):
    return sorted(map(str, df.collect()))


def test_stream_equals_batch_upsert(spark, ingest, folder):
    first = [device(1, appVersion="1"), device(2), device(1, customer="CUST-000002")]
    second = [device(1, False), device(3), '{"id":"nokey"}', "{broken", ""]
    assert ingest(first).count() == 3
    current = ingest(second)
    names = document_schema("devices").names
    rows = lambda lines: spark.read.schema(document_schema("devices")).json(
        spark.sparkContext.parallelize([x for x in lines if "nokey" not in x and "broken" not in x and x]))
    expected = upsert_documents(rows(first), rows(second))
    assert current.columns == names and content(current) == content(expected.select(*names))
    replaced = current.where("id = 'D1' AND customerId = 'CUST-000001'").first()
    assert replaced["trusted"] is False and replaced["appVersion"] is None
    rejected = streaming.rejected_lines(spark, folder + "/rejects")
    assert sorted(r["line"] for r in rejected.collect()) == ['{"id":"nokey"}', "{broken"]
    assert all(r["_file"] and r["_batch"] is not None for r in rejected.collect())
    assert spark.read.parquet(folder + "/log").count() + rejected.count() == 7


def test_without_a_place_for_rejects_a_bad_line_stops_the_stream(spark, folder):
    spark.createDataFrame([(x,) for x in (device(1), "{broken")], "value string").write.text(folder + "/in")
    running = streaming.start_ingest(spark, folder + "/in", "devices", folder + "/log", folder + "/cp")
    with pytest.raises(Exception, match="required"):
        running.awaitTermination()


def test_last_line_of_a_file_wins(ingest):
    current = ingest([device(1, appVersion="9"), device(1, appVersion="1"), device(1, appVersion="5")])
    assert [r["appVersion"] for r in current.collect()] == ["5"]


def test_restart_without_new_files_changes_nothing(ingest):
    once = content(ingest([device(1), device(2)]))
    assert content(ingest([])) == once


def test_compacted_log_reads_the_same(spark, ingest, folder):
    ingest([device(1), device(2)])
    before = content(ingest([device(1, False)]))
    streaming.compact(spark, folder + "/log", "devices", folder + "/compacted")
    assert content(streaming.current_documents(spark, folder + "/compacted", "devices")) == before
    assert spark.read.parquet(folder + "/compacted").count() == 2


def test_streamed_files_read_like_a_batch_scan(spark, ingest, folder):
    current = ingest([device(1), device(2)])
    assert content(read_documents(spark, folder + "/in", "devices")) == content(current)
