"""Documents whose properties change from load to load."""

import json

import pytest
from pyspark.sql import functions as F

from tallyweir.functions.lattice import join_all, join_kinds
from tallyweir.sources import bindings, evolution
from tallyweir.sources.documents import document_schema


@pytest.fixture
def load(spark, lake, folder):
    loads = []

    def write(*documents):
        lines = [(d if isinstance(d, str) else json.dumps(d),) for d in documents]
        path = f"{folder}/load-{len(loads)}"
        loads.append(path)
        spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
        return evolution.load_evolving(lake, path, "devices")
    return write


def device(n, **properties):
    return {"id": f"D{n}", "customerId": "c", "appVersion": "1", **properties}


def stored(lake):
    return {r["id"]: r.asDict() for r in lake.read("devices").collect()}


def test_new_missing_wider_and_conflicting_properties(lake, load):
    first = load(device(1, visits=7, ok=True, tags=["a", 1], note=None, spot={"x": 1.50}), device(2, visits=None))
    assert first == (2, [("ok", "boolean", False), ("spot", "object", False), ("tags", "array", False), ("visits", "whole", False)])
    rows = stored(lake)
    assert rows["D1"]["visits"] == 7 and rows["D1"]["spot"] == '{"x":1.5}' and rows["D1"]["tags"] == '["a",1]'
    assert rows["D2"]["ok"] is None and "note" not in rows["D2"]

    second = load(device(2, visits=2.5, ok="yes", tags={"a": 1}), device(3, visits=4, ok=False, note="7"), device(4, visits="many", spot=[1]))
    kinds = {p.name: (p.kind, p.conflicted) for p in second.properties}
    assert kinds == {"visits": ("fractional", True), "ok": ("boolean", True), "tags": ("array", True), "spot": ("object", True), "note": ("text", False)}
    rows = stored(lake)
    assert [rows[f"D{n}"]["visits"] for n in (1, 2, 3, 4)] == [7.0, 2.5, 4.0, None]
    assert [rows[f"D{n}"]["ok"] for n in (1, 2, 3, 4)] == [True, None, False, None]
    assert rows["D2"]["tags"] is None and rows["D4"]["spot"] is None and rows["D3"]["note"] == "7" and rows["D1"]["note"] is None
    assert list(rows["D1"]) == [*document_schema("devices").names, "ok", "spot", "tags", "visits", "note"]


def test_a_load_twice_changes_nothing_and_the_last_version_stays_whole(lake, load):
    load(device(1, a=1, b="x"), device(1, a=2), device(2, a=3))
    assert stored(lake)["D1"]["a"] == 2 and stored(lake)["D1"]["b"] is None
    before = stored(lake), evolution.stored_properties(lake, "devices")
    load(device(1, a=1, b="x"), device(1, a=2), device(2, a=3))
    assert (stored(lake), evolution.stored_properties(lake, "devices")) == before
    load(device(2))
    assert stored(lake)["D2"]["a"] is None and stored(lake)["D1"]["a"] == 2


def test_values_at_the_edges_of_their_kinds(lake, load):
    load('{"id":"D1","customerId":"c","big":9223372036854775807,"text":"12","quoted":"true","exp":1e3,"dot.ted":1,"":2}',
         '{"id":"D2","customerId":"c","big":12345678901234567890123,"text":"a\\"b\\u00e9","exp":1}', "", "   ")
    rows = stored(lake)
    assert rows["D1"]["big"] == float(9223372036854775807) and rows["D2"]["big"] == 12345678901234567890123.0
    assert rows["D1"]["text"] == "12" and rows["D2"]["text"] == 'a"bé' and rows["D1"]["quoted"] == "true"
    assert rows["D1"]["exp"] == 1000.0 and rows["D1"]["dot.ted"] == 1 and rows["D1"][""] == 2


def test_names_that_differ_in_case_only_get_columns_of_their_own(lake, load):
    load(device(1, AppVersion="upper", extra=1, EXTRA="two"))
    row = stored(lake)["D1"]
    assert row["appVersion"] == "1" and row["AppVersion_2"] == "upper" and row["EXTRA"] == "two" and row["extra_2"] == 1


def test_contract_columns_keep_their_types(lake, load):
    loaded = load(device(1, trusted="yes", geoHistory=[{"country": "US"}]), device(2, trusted=True))
    rows = stored(lake)
    assert loaded.properties == [] and rows["D1"]["trusted"] is None and rows["D2"]["trusted"] is True
    assert rows["D1"]["geoHistory"] == '[{"country":"US"}]'


@pytest.mark.parametrize("line", ["[1]", "7", '{"id":"x"', '{"id":"x"}', '{"id":"","customerId":"c"}', '{"id":"x","customerId":"c","a":1,"a":2}'])
def test_a_line_that_is_no_document_stops_the_load(lake, load, line):
    load(device(1, a=1))
    with pytest.raises(Exception, match="are required"):
        load(device(2, a="x"), line)
    assert set(stored(lake)) == {"D1"} and evolution.stored_properties(lake, "devices") == [("a", "whole", False)]


def test_too_many_properties_stop_the_load(load, monkeypatch):
    monkeypatch.setattr(evolution, "MAX_PROPERTIES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        load(device(1, a=1, b=1, c=1, d=1))


def test_a_lost_load_is_repeated_under_its_columns(lake, load, monkeypatch):
    load(device(1, a=1))
    real = evolution.overwrite

    def lost(lake, df, table, **measures):
        if table == "devices":
            raise RuntimeError("lost")
        return real(lake, df, table, **measures)

    monkeypatch.setattr(evolution, "overwrite", lost)
    with pytest.raises(RuntimeError):
        load(device(2, a=1.5, b=True))
    monkeypatch.setattr(evolution, "overwrite", real)
    assert stored(lake)["D1"]["a"] == 1 and [p.kind for p in evolution.stored_properties(lake, "devices")] == ["fractional", "boolean"]
    load(device(2, a=1.5, b=True))
    assert stored(lake)["D1"]["a"] == 1.0 and stored(lake)["D2"]["b"] is True


def test_kinds_meet_in_any_order():
    assert join_kinds("whole", "fractional") == join_kinds("fractional", "whole") == ("fractional", False)
    assert join_kinds(None, "text") == join_kinds("text", None) == ("text", False)
    assert join_kinds("array", "text") == ("array", True) and join_kinds("text", "array") == ("text", True)
    assert join_all(set()) == (None, False) and join_all({"fractional", "whole"}) == ("fractional", False)
    assert join_all({"text", "whole", "fractional"}) == ("fractional", True)


def test_inference_is_one_shuffle_of_folded_pairs(spark, folder):
    spark.createDataFrame([('{"id":"D1","customerId":"c","a":1}',)], "value string").write.text(folder)
    lines = evolution.document_lines(spark, folder)
    read = evolution.read_evolved(lines, "devices", [evolution.Property("a", "whole", False)])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_a_line_is_parsed_once_and_a_batch_folded_once(spark, lake, folder, load):
    load(device(1, visits=7))
    load(device(1, visits=8), device(2))
    kept = lake.read("devices" + evolution.BATCH_SUFFIX)
    assert sorted((r["id"], r["visits"]) for r in kept.collect()) == [("D1", 8), ("D2", None)]
    assert {k: r["visits"] for k, r in stored(lake).items()} == {"D1": 8, "D2": None}
    lines = evolution.document_lines(spark, f"{folder}/load-1")
    plan = lines.select(F.explode_outer("_values"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1


def test_sessions_are_dealt_out_before_their_lines_are_made(spark):
    lines = bindings.session_lines(bindings.Sources(spark, "/root/testdata/sf0.001").spread_sessions, "id")
    dealt = lines._jdf.queryExecution().executedPlan().toString().split("REBALANCE")
    assert len(dealt) == 2 and "date_format" in dealt[0] and "date_format" not in dealt[1]
