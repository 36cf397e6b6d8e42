"""Readers and sinks: declared schemas, text formats, new-path writes."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation

from campusflow.sources.state import StateTable, append_run, committed_runs, read_appended
from campusflow.sources.tables import CORRUPT, STATE_SCHEMAS, read_table, read_with_rejects, write_table


def test_csv_and_json_read_with_declared_schema(spark, scratch):
    path = os.path.join(scratch, "venues.csv")
    with open(path, "w") as f:
        f.write("id,name,building,capacity,is_available\n1,Hall,B1,100,1\n2,,B2,50,0\n")
    v = read_table(spark, "venues", path, fmt="csv", header="true")
    assert v.schema == STATE_SCHEMAS["venues"]
    assert sorted((r["id"], r["name"]) for r in v.collect()) == [(1, "Hall"), (2, None)]

    jpath = os.path.join(scratch, "hosts.json")
    with open(jpath, "w") as f:
        f.write('{"id": 7, "name": "Ann", "email": "a@x", "role": "Staff"}\n')
    h = read_table(spark, "hosts", jpath, fmt="json")
    assert h.schema == STATE_SCHEMAS["hosts"]
    assert h.first()["phone"] is None


def test_parquet_read_casts_to_declared_types(spark, scratch):
    path = os.path.join(scratch, "tickets")
    spark.createDataFrame([(1, 10, "A", 5, 3)], "id int, event_id int, ticket_type string, price int, quantity long") \
        .write.parquet(path)
    t = read_table(spark, "tickets", path)
    assert t.schema == STATE_SCHEMAS["tickets"]
    assert t.first()["price"] == 5.0


def test_new_state_goes_to_a_new_path(spark, scratch):
    v1 = os.path.join(scratch, "participants", "v=1")
    rows = [(1, 5, datetime(2024, 1, 1), None)]
    state = spark.createDataFrame(rows, STATE_SCHEMAS["participants"])
    write_table(state, v1)
    delta = spark.createDataFrame([(1, 6, datetime(2024, 1, 2), 1)], STATE_SCHEMAS["participants"])
    v2 = os.path.join(scratch, "participants", "v=2")
    write_table(read_table(spark, "participants", v1).unionByName(delta), v2)
    assert read_table(spark, "participants", v1).count() == 1
    assert read_table(spark, "participants", v2).count() == 2


def _lines(scratch, name, *lines):
    path = os.path.join(scratch, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_broken_lines_are_rejects_with_their_text(spark, scratch):
    bad_json = '{"id": 8, "name": "Bo'
    path = _lines(scratch, "hosts.json", '{"id": 7, "name": "Ann", "email": "a@x"}', bad_json, '{"id": "x", "name": "Cy"}', "[1, 2")
    rows, rejects = read_with_rejects(spark, "hosts", path, "json")
    assert [r["id"] for r in rows.collect()] == [7]
    found = {(r["id"], r["column"], r["value"]) for r in rejects.collect()}
    assert found == {(None, CORRUPT, bad_json), (None, CORRUPT, "[1, 2"), (None, "id", "x")}

    long, short = "3,C,B3,70,1,extra", "4,D"
    path = _lines(scratch, "venues.csv", "id,name,building,capacity,is_available", "1,Hall,B1,100,1", "2,,B2,many,0", long, short)
    rows, rejects = read_with_rejects(spark, "venues", path, "csv", header="true")
    assert [r["id"] for r in rows.collect()] == [1]
    found = {(r["id"], r["column"], r["value"]) for r in rejects.collect()}
    assert {(2, "capacity", "many"), (3, CORRUPT, long), (4, CORRUPT, short)} == found


def test_json_events_in_the_applications_shape(spark, scratch):
    path = _lines(scratch, "events.json", '{"id": 1, "name": "A", "date": "2024-03-01", "start_time": "09:00:00", "end_time": "10:30:00", "location_id": 4}')
    rows, rejects = read_with_rejects(spark, "events", path, "json")
    row = rows.first()
    assert (row["start_ts"], row["end_ts"], row["location_id"]) == (datetime(2024, 3, 1, 9), datetime(2024, 3, 1, 10, 30), 4)
    assert rejects.count() == 0


def test_rows_are_counted_while_rejects_are_computed(spark, scratch):
    path = _lines(scratch, "hosts.json", '{"id": 7}', "{", '{"id": "x"}')
    observed = Observation()
    _, rejects = read_with_rejects(spark, "hosts", path, "json", observed=observed)
    rejects.collect()
    assert observed.get == {"read": 3, "rejected": 2}


def test_writing_twice_to_one_path_is_an_error(spark, scratch):
    rows = spark.createDataFrame([(1, 5, datetime(2024, 1, 1), None)], STATE_SCHEMAS["participants"])
    write_table(rows, os.path.join(scratch, "t"))
    with pytest.raises(AnalysisException):
        write_table(rows, os.path.join(scratch, "t"))


def test_appends_count_once(spark, scratch):
    path = os.path.join(scratch, "participants")
    rows = spark.createDataFrame([(1, i, datetime(2024, 1, 1), None) for i in range(3)], STATE_SCHEMAS["participants"])
    assert read_appended(spark, "participants", path).count() == 0
    assert append_run(rows, path, "r1", {"rows": 3})
    assert not append_run(rows, path, "r1")
    rows.write.parquet(os.path.join(path, "run=r2"))  # a run that failed before its commit
    assert read_appended(spark, "participants", path).count() == 3
    assert append_run(rows.limit(1), path, "r2")
    assert read_appended(spark, "participants", path).count() == 4
    assert committed_runs(spark, path) == ["r1", "r2"]


def test_a_change_rewrites_only_its_parts(spark, scratch):
    path = os.path.join(scratch, "tickets")
    schema = STATE_SCHEMAS["tickets"]
    rows = [(i, i // 3, "A", 5.0, i) for i in range(2000)]
    table = StateTable(spark, "tickets", path, ["id"], parts=40)
    table.create(spark.createDataFrame(rows, schema))

    def files(version):
        return [f for d, _, names in os.walk(os.path.join(path, f"v={version}")) for f in names if f.endswith(".parquet")]

    assert len(files(0)) == 40
    changed = [(i, i // 3, "B", 6.0, None) for i in range(0, 2000, 200)] + [(5000, 1, "new", 1.0, 1)]
    gone = spark.createDataFrame([(7,)], "id long")
    again = StateTable(spark, "tickets", path, ["id"])  # the number of parts is the table's
    assert again.merge(spark.createDataFrame(changed, schema), gone) == 1
    assert 1 <= len(files(1)) <= 12
    want = {r[0]: r for r in rows if r[0] != 7} | {r[0]: r for r in changed}
    assert {r["id"]: tuple(r) for r in again.read().collect()} == want
    assert {tuple(r) for r in again.read(0).collect()} == set(rows)
    assert again.merge(spark.createDataFrame([], schema)) == 1
    with pytest.raises(FileExistsError):
        again.create(spark.createDataFrame(rows, schema))
    with pytest.raises(FileExistsError):
        again.files.commit("_versions/1.json", {})


def test_bucketed_state_is_joined_without_moving_it(spark):
    from campusflow.operators.reports import participant_counts
    from campusflow.sources.bucketed import bucketed_tables, save_bucketed
    from campusflow.sources.fixtures import FixtureTables
    from tests.conftest import SMALL
    from tests.test_plans import plan_of

    t = FixtureTables(spark, SMALL)
    db = "state_v1"
    spark.sql(f"create database {db}")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        save_bucketed(t.events, db, "events", 4)
        save_bucketed(t.participants, db, "participants", 4)
        save_bucketed(t.tickets, db, "tickets", 4)
        stored = bucketed_tables(spark, db)
        assert set(stored) == {"events", "participants", "tickets"}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        counts = participant_counts(stored["participants"], stored["events"])
        assert "Exchange" not in plan_of(counts)
        requests = t.order_requests.select("request_id", "event_id")
        joined = requests.join(stored["tickets"], "event_id")
        assert plan_of(joined).count("Exchange hashpartitioning") <= 1  # the requests, not the tickets
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, participant_counts(t.participants, t.events).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql(f"drop database {db} cascade")
