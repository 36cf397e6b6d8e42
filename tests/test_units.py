"""Hand-made cases for the rules the fixtures do not cover."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from campusflow.operators import reports as R
from campusflow.operators.overlap import first_overlapping, overlap_load, overlap_load_before, overlapping_pairs, overlapping_pairs_within
from campusflow.operators.prefix import running_sums, time_block
from campusflow.sources.tables import REQUEST_SCHEMAS, STATE_SCHEMAS

T0 = datetime(2024, 3, 1, 9, 0, 0)
AS_OF = datetime(2024, 3, 1, 12, 0, 0)


def h(hours: float) -> datetime:
    return T0 + timedelta(hours=hours)


def df(spark, name, rows):
    schema = STATE_SCHEMAS.get(name) or REQUEST_SCHEMAS[name]
    return spark.createDataFrame(rows, schema)


# ----------------------------------------------------------------- overlap
def _brute_load(probes, stored):
    out = {}
    for pid, pk, ps, pe in probes:
        if ps is None or pe is None or not ps < pe:
            out[pid] = None
            continue
        out[pid] = sum(w for k, s, e, w in stored if k == pk and s is not None and e is not None and s < pe and e > ps)
    return out


def test_overlap_load_matches_brute_force(spark):
    rnd = random.Random(7)
    stored, probes = [], []
    for i in range(300):
        s = h(rnd.randint(0, 200) / 4)
        e = s + timedelta(minutes=rnd.choice([-60, 0, 15, 30, 60, 240, 3000]))  # some reversed / empty
        stored.append((rnd.randint(0, 3), s, e, rnd.randint(1, 5)))
    stored.append((1, None, h(1), 1))
    for i in range(120):
        s = h(rnd.randint(0, 200) / 4)
        probes.append((i, rnd.randint(0, 3), s, s + timedelta(minutes=rnd.choice([-30, 15, 45, 120, 1440]))))
    probes.append((999, None, h(1), h(2)))
    sdf = spark.createDataFrame(stored, "k long, s timestamp_ntz, e timestamp_ntz, w int")
    pdf = spark.createDataFrame(probes, "pid long, k long, ps timestamp_ntz, pe timestamp_ntz")
    got = {r["pid"]: r["load"] for r in overlap_load(pdf, sdf, ["k"], "pid", ("ps", "pe"), ("s", "e"), weight="w").collect()}
    want = _brute_load(probes, stored)
    want[999] = 0
    assert got == want


def test_touching_intervals_do_not_overlap(spark):
    a = spark.createDataFrame([(1, 1, h(0), h(1))], "a_id long, k long, a_s timestamp_ntz, a_e timestamp_ntz")
    b = spark.createDataFrame([(2, 1, h(1), h(2)), (3, 1, h(0.5), h(1.5))],
                              "b_id long, k long, b_s timestamp_ntz, b_e timestamp_ntz")
    pairs = overlapping_pairs(a, b, ["k"], ("a_s", "a_e"), ("b_s", "b_e")).collect()
    assert [(r["a_id"], r["b_id"]) for r in pairs] == [(1, 3)]


def test_overlapping_pairs_match_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        s = h(rnd.randint(0, 400) / 4)
        rows.append((i, rnd.randint(0, 2), s, s + timedelta(minutes=rnd.choice([-90, 0, 10, 50, 130, 2000]))))
    a = spark.createDataFrame(rows, "a_id long, k long, a_s timestamp_ntz, a_e timestamp_ntz")
    b = a.select(F.col("a_id").alias("b_id"), "k", F.col("a_s").alias("b_s"), F.col("a_e").alias("b_e"))
    got = {(r["a_id"], r["b_id"]) for r in overlapping_pairs(
        a, b, ["k"], ("a_s", "a_e"), ("b_s", "b_e"), extra=F.col("a_id") < F.col("b_id")).collect()}
    want = {(x[0], y[0]) for x in rows for y in rows
            if x[0] < y[0] and x[1] == y[1] and x[2] < y[3] and x[3] > y[2]}
    assert got == want
    within = overlapping_pairs_within(a, ["k"], "a_id", ("a_s", "a_e"), ("x", "y")).collect()
    assert {(r["x"], r["y"]) for r in within} == want and len(within) == len(want)


def test_a_very_long_span_makes_few_rows(spark):
    from campusflow.operators import timeindex as T

    spans = [(1, h(0.37), datetime(9999, 12, 31, 23, 59, 59)), (2, datetime(1, 1, 1, 0, 0, 1), h(3)), (3, h(1), h(3)), (4, h(2), h(2)), (5, None, h(1))]
    d = spark.createDataFrame(spans, "id long, s timestamp_ntz, e timestamp_ntz").withColumns({"lo": T.address("s"), "hi": T.address("e")})
    rows = {r["id"]: r["count"] for r in T.cover(d, "lo", "hi").groupBy("id").count().collect()}
    assert set(rows) == {1, 2, 3} and max(rows.values()) < 100
    cells = T.in_roles(d, "lo", "hi", 1, 2, F.array(F.lit(30))).groupBy("id").count().collect()
    assert max(r["count"] for r in cells) <= 4
    b = d.select(F.col("id").alias("b"), F.col("s").alias("bs"), F.col("e").alias("be"), F.lit(1).alias("k"))
    a = d.select(F.col("id").alias("a"), F.col("s").alias("as"), F.col("e").alias("ae"), F.lit(1).alias("k"))
    pairs = {(r["a"], r["b"]) for r in overlapping_pairs(a, b, ["k"], ("as", "ae"), ("bs", "be"), extra=F.col("a") < F.col("b")).collect()}
    assert pairs == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}  # 4 is a moment inside the others


def test_cover_is_exact(spark):
    from campusflow.operators import timeindex as T

    rnd = random.Random(1)
    spans = [(i, *sorted(rnd.sample(range(-300, 300), 2))) for i in range(60)]
    d = spark.createDataFrame(spans, "id long, lo long, hi long")
    held = {}
    for r in T.cover(d, "lo", "hi").collect():
        cells = range(r["_cell"] << r["_level"], (r["_cell"] + 1) << r["_level"])
        assert not held.setdefault(r["id"], set()) & set(cells)
        held[r["id"]] |= set(cells)
    assert held == {i: set(range(lo, hi)) for i, lo, hi in spans}


def _spans(rnd, n, first=0):
    out = []
    for i in range(n):
        s = h(rnd.randint(0, 300) / 4) + timedelta(seconds=rnd.choice([0, 0, 7]), microseconds=rnd.choice([0, 0, 5]))
        out.append((first + i, rnd.randint(0, 2), s, s + timedelta(minutes=rnd.choice([-90, 0, 10, 50, 130, 2000]))))
    return out


def test_first_overlapping_matches_brute_force(spark):
    rnd = random.Random(5)
    stored, probes = _spans(rnd, 150), _spans(rnd, 80, 1000)
    st = spark.createDataFrame(stored, "id long, k long, s timestamp_ntz, e timestamp_ntz")
    pr = spark.createDataFrame([*probes, (2000, None, h(0), h(9))], "pid long, k long, ps timestamp_ntz, pe timestamp_ntz")
    got = {r["pid"]: r["id"] for r in first_overlapping(pr, st, ["k"], "pid", ("ps", "pe"), ("s", "e"), "id").collect()}
    want = {p: min((i for i, k, s, e in stored if k == pk and s < pe and e > ps), default=None) for p, pk, ps, pe in probes if ps < pe}
    assert got == {p: i for p, i in want.items() if i is not None}


def test_overlap_load_before_matches_brute_force(spark):
    rnd = random.Random(6)
    entries = [(*x, rnd.randint(0, 40), rnd.choice([-1, 1, 3])) for x in _spans(rnd, 150)] + [(900, None, h(0), h(9), 1, 1)]
    probes = [(*x, rnd.randint(0, 40)) for x in _spans(rnd, 80, 1000)] + [(2000, None, h(0), h(9), 30)]
    en = spark.createDataFrame(entries, "id long, k long, s timestamp_ntz, e timestamp_ntz, at long, w int").withColumn("b", F.expr("at div 9"))
    pr = spark.createDataFrame(probes, "pid long, k long, ps timestamp_ntz, pe timestamp_ntz, at long").withColumn("b", F.expr("at div 9"))
    out = overlap_load_before(pr, en, ["k"], "pid", ("ps", "pe"), ("s", "e"), ["at"], "b", "w")
    got = {r["pid"]: r["load"] for r in out.collect()}
    want = {p: sum(w for _, k, s, e, at, w in entries if k is not None and k == pk and at < pat and s < pe and e > ps) for p, pk, ps, pe, pat in probes if ps < pe}
    assert {p: got.get(p, 0) for p in want} == want


# ------------------------------------------------------------ running sums
def test_running_sums_equal_plain_window_with_hot_key(spark):
    rnd = random.Random(11)
    rows = [(0 if i % 3 else rnd.randint(1, 5), h(i / 7), i, rnd.randint(-3, 9)) for i in range(600)]
    rows += [(None, h(i), 10_000 + i, 1) for i in range(5)]
    d = spark.createDataFrame(rows, "k long, t timestamp_ntz, id long, v int")
    got = running_sums(d.withColumn("b", time_block("t", "HOUR")), ["k"], "b", ["t", "id"], {"s": "v"},
                       inclusive=False)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = d.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert {(r["id"], r["s"]) for r in got.collect()} == {(r["id"], r["s"]) for r in want.collect()}


# ----------------------------------------------------------------- reports
def test_listing_rules(spark):
    venues = df(spark, "venues", [(1, "Hall", "B1", 100, 1), (2, "", "B2", 50, 0)])
    hosts = df(spark, "hosts", [(7, "Ann", "a@x", None, "CS", "Staff")])
    events = df(spark, "events", [
        (10, "A", "d", date(2024, 3, 1), h(4), h(5), 1, 7, "S", 10),     # upcoming, venue
        (11, "B", "d", date(2024, 3, 1), h(4), h(5), None, 7, "S", 10),  # no venue → N/A
        (12, "C", "d", date(2024, 3, 1), h(4), h(5), 2, 7, "S", 10),     # empty venue name → N/A
        (13, "D", "d", date(2024, 3, 1), h(4), h(5), 1, 99, "S", 10),    # unknown host → dropped
        (14, "E", "d", date(2024, 3, 1), h(4), None, 1, 7, "S", 10),     # no end → neither list
        (15, "F", "d", date(2024, 3, 1), h(0), h(3), 1, 7, "S", 10),     # ends at as_of → completed
    ])
    up = {r["event_id"]: r["venue_label"] for r in R.upcoming_events(events, venues, hosts, AS_OF).collect()}
    assert up == {10: "Hall", 11: "N/A", 12: "N/A"}
    done = {r["event_id"] for r in R.completed_events(events, venues, hosts, AS_OF).collect()}
    assert done == {15}
    assert [r["status"] for r in R.venues_with_status(venues, ordered=True).collect()] == ["Not Available", "Available"]


def test_participant_counts_keep_same_name_events_apart(spark):
    events = df(spark, "events", [(1, "Same", "", None, None, None, None, 1, "S", 1),
                                   (2, "Same", "", None, None, None, None, 1, "S", 1)])
    parts = df(spark, "participants", [(1, 5, None, None), (1, 6, None, None), (2, 5, None, None)])
    got = {(r["event_id"], r["participant_count"]) for r in R.participant_counts(parts, events).collect()}
    assert got == {(1, 2), (2, 1)}


# ----------------------------------------------------------- request flows
def _world(spark):
    students = df(spark, "students", [(5, "S5", "Five", 3, "A"), (6, "S6", "Six", 3, "A")])
    venues = df(spark, "venues", [(1, "Hall", "B", 100, 1)])
    hosts = df(spark, "hosts", [(7, "Ann", "a@x", None, "CS", "Staff")])
    events = df(spark, "events", [
        (100, "Up", "", date(2024, 3, 1), h(4), h(6), 1, 7, "S", 50),
        (200, "Past", "", date(2024, 3, 1), h(0), h(1), 1, 7, "S", 50),
    ])
    return students, venues, hosts, events


def test_orders_rules(spark):
    from campusflow.plans.orders import apply_orders

    students, venues, hosts, events = _world(spark)
    tickets = df(spark, "tickets", [(1001, 100, "Free", 0.0, 5), (1002, 100, "Paid", 10.0, 3)])
    parts = df(spark, "participants", [])
    reqs = df(spark, "order_requests", [
        (1, h(0), 5, 100, 1001, 1, 0),   # free → Completed, registers 5
        (2, h(0.1), 5, 100, 1002, 1, 1),  # paid → Completed, 5 already registered
        (3, h(0.2), 6, 100, 1002, 1, 0),  # unpaid → Pending, takes stock
        (4, h(0.3), 6, 100, 1002, 1, 0),  # pending repeat is fine
        (5, h(0.4), 6, 100, 1002, 2, 1),  # only 1 left
        (6, h(0.5), 6, 100, 1002, 0, 1),  # non-positive
        (7, h(0.6), 6, 100, 1002, 1, 1),  # last one → Completed, registers 6
        (8, h(0.7), 9, 100, 1001, 1, 1),  # unknown student
        (9, h(0.8), 6, 100, 1002, 1, 1),  # sold out → the ticket is no longer on sale
        (10, h(0.9), 6, 200, 1001, 1, 1),  # ticket of another event
    ])
    out = apply_orders(tickets, parts, students, events, venues, hosts, reqs, AS_OF)
    got = {r["request_id"]: r["reason"] for r in out["decisions"].collect()}
    assert got == {1: None, 2: "ALREADY_REGISTERED", 3: None, 4: None, 5: "OVER_QUANTITY", 6: "NON_POSITIVE",
                   7: None, 8: "UNKNOWN_STUDENT", 9: "INVALID_TICKET", 10: "NO_TICKETS"}
    stock = {r["id"]: r["quantity"] for r in out["tickets_after"].collect()}
    assert stock == {1001: 4, 1002: 0}
    assert {(r["event_id"], r["user_id"]) for r in out["participants_delta"].collect()} == {(100, 5), (100, 6)}
    assert out["orders_delta"].count() == 4


def test_cancellations_refund_lowest_ticket_once(spark):
    from campusflow.plans.orders import apply_cancellations

    students, venues, hosts, events = _world(spark)
    tickets = df(spark, "tickets", [(1002, 100, "B", 10.0, 0), (1001, 100, "A", 0.0, 0)])
    parts = df(spark, "participants", [(100, 5, h(0), None), (200, 5, h(0), None)])
    orders = df(spark, "orders", [(1, 1002, 5, h(0), "Completed"), (2, 1001, 5, h(0), "Completed")])
    reqs = df(spark, "cancel_requests", [
        (1, h(0), 5, 200),   # past event, allowed while an upcoming registration exists
        (2, h(0.1), 5, 100),
        (3, h(0.2), 5, 100),  # no upcoming registration left
        (4, h(0.3), 6, 100),  # no upcoming registration at all
    ])
    out = apply_cancellations(parts, events, tickets, orders, reqs, AS_OF)
    got = {r["request_id"]: r["reason"] for r in out["decisions"].collect()}
    assert got == {1: None, 2: None, 3: "NO_UPCOMING", 4: "NO_UPCOMING"}
    assert {(r["ticket_id"], r["refund"]) for r in out["refunds_by_ticket"].collect()} == {(1001, 1)}
    assert out["orders_removed"].count() == 2
    assert out["participants_after"].count() == 0


def test_feedback_rules(spark):
    from campusflow.plans.registrations import feedback_eligibility

    students, venues, hosts, events = _world(spark)
    parts = df(spark, "participants", [(200, 5, h(0), None), (200, 6, h(0), 0)])
    fb = df(spark, "feedback", [])
    reqs = df(spark, "feedback_requests", [
        (1, h(0), 5, 200, 9, "bad rating"),   # NULL attendance passes; rating invalid
        (2, h(1), 5, 200, 4, "ok"),
        (3, h(2), 5, 200, 5, "again"),
        (4, h(0), 6, 200, 5, "absent"),
        (5, h(0), 6, 100, 5, "not registered"),
    ])
    got = {r["request_id"]: r["reason"]
           for r in feedback_eligibility(reqs, parts, fb, students, events, venues, hosts, AS_OF).collect()}
    assert got == {1: "BAD_RATING", 2: None, 3: "ALREADY_GIVEN", 4: "NOT_ATTENDED", 5: "NOT_PARTICIPANT"}


def test_hosts_two_unique_keys(spark):
    from campusflow.plans.people import apply_new_hosts

    hosts = df(spark, "hosts", [(1, "Old", "old@x", "111", None, "Staff")])
    reqs = df(spark, "host_requests", [
        (1, h(0), "A", "a@x", "222", "Staff", ""),
        (2, h(1), "B", "b@x", "222", "Staff", ""),   # phone taken by 1
        (3, h(2), "C", "b@x", "", "Staff", ""),      # email free again: 2 was refused
        (4, h(3), "D", "d@x", "", "Staff", ""),      # empty phone never collides
        (5, h(4), "E", "old@x", "", "Staff", ""),
    ])
    out = apply_new_hosts(hosts, reqs)
    got = {r["request_id"]: r["accepted"] for r in out["decisions"].collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}
    assert {r["phone"] for r in out["hosts_delta"].collect()} == {"222", None}


def test_new_events_chain(spark):
    from campusflow.plans.events import apply_new_events

    students, venues, hosts, events = _world(spark)
    reqs = df(spark, "event_requests", [
        (1, h(0), "a", "", "2024-03-02", "09:00:00", "10:30:00", 7, 1, 10),
        (2, h(1), "b", "", "2024-03-02", "10:00:00", "11:30:00", 7, 1, 10),  # overlaps 1
        (3, h(2), "c", "", "2024-03-02", "11:00:00", "12:00:00", 7, 1, 10),  # overlaps only refused 2
        (4, h(3), "d", "", "2024-03-02", "10:30:00", "11:00:00", 7, 1, 10),  # touches 1 and 3
        (5, h(4), "e", "", "2024-03-02", "12:00:00", "11:00:00", 7, 1, 10),  # bad time
        (6, h(5), "f", "", "2024-03-01", "13:30:00", "14:00:00", 7, 1, 10),  # stored event 100
        (7, h(6), "g", "", "2024-03-02", "08:00:00", "09:00:00", 7, 1, 500),  # over capacity
    ])
    got = {r["request_id"]: r["reason"] for r in apply_new_events(events, venues, hosts, reqs)["decisions"].collect()}
    assert got == {1: None, 2: "CONFLICT", 3: None, 4: None, 5: "BAD_TIME", 6: "CONFLICT", 7: "OVER_CAPACITY"}


# ------------------------------------------------------------ hot keys
def test_hot_ticket_orders_match_replay(spark):
    """One event with two tickets takes every request: heavy contention,
    repeated buyers, sold-out tickets."""
    from campusflow.plans.orders import apply_orders
    from tests.sequential import replay_orders

    rnd = random.Random(5)
    students, venues, hosts, events = _world(spark)
    students = df(spark, "students", [(u, f"S{u}", f"N{u}", 3, "A") for u in range(1, 40)])
    ticket_rows = [(1, 100, "A", 5.0, 60), (2, 100, "B", 0.0, 15)]
    reqs = []
    for i in range(400):
        reqs.append((i, h(i / 60), rnd.randint(1, 45), 100, rnd.choice([1, 2, 3]), rnd.randint(-1, 6),
                     rnd.choice([0, 1])))
    parts = df(spark, "participants", [(100, 3, h(0), None)])
    out = apply_orders(df(spark, "tickets", ticket_rows), parts, students, events, venues, hosts,
                       df(spark, "order_requests", reqs), AS_OF)
    got = {r["request_id"]: (r["accepted"], r["reason"]) for r in out["decisions"].collect()}
    keys = ["request_id", "request_ts", "user_id", "event_id", "ticket_id", "how_many", "paid"]
    want = replay_orders(
        [dict(zip(["id", "event_id", "ticket_type", "price", "quantity"], t)) for t in ticket_rows],
        {(100, 3)}, set(range(1, 40)), True, [dict(zip(keys, r)) for r in sorted(reqs, key=lambda r: (r[1], r[0]))],
    )
    assert got == want


@pytest.mark.parametrize("crowd", [500, 40])
def test_hot_venue_new_events_match_replay(spark, monkeypatch, crowd):
    from campusflow.plans import admission

    monkeypatch.setattr(admission, "FOLD", crowd)
    from campusflow.plans.events import apply_new_events

    rnd = random.Random(9)
    students, venues, hosts, events = _world(spark)
    rows, accepted = [], []
    for i in range(150):
        start = 8 * 60 + rnd.randint(0, 40) * 15
        end = start + rnd.choice([15, 30, 60, 90, 240])
        rows.append((i, h(i / 100), f"e{i}", "", "2024-03-05", f"{start // 60:02d}:{start % 60:02d}:00",
                     f"{min(end, 1439) // 60:02d}:{min(end, 1439) % 60:02d}:00", 7, 1, 10))
    want = {}
    for r in rows:
        s = datetime.strptime(f"{r[4]} {r[5]}", "%Y-%m-%d %H:%M:%S")
        e = datetime.strptime(f"{r[4]} {r[6]}", "%Y-%m-%d %H:%M:%S")
        if e <= s:
            want[r[0]] = "BAD_TIME"
        elif any(a < e and b > s for a, b in accepted):
            want[r[0]] = "CONFLICT"
        else:
            accepted.append((s, e))
            want[r[0]] = None
    got = {r["request_id"]: r["reason"]
           for r in apply_new_events(events, venues, hosts, df(spark, "event_requests", rows))["decisions"].collect()}
    assert got == want


@pytest.mark.parametrize("crowd", [500, 20])
def test_hot_resource_bookings_match_replay(spark, monkeypatch, crowd):
    from campusflow.plans import admission

    monkeypatch.setattr(admission, "FOLD", crowd)
    from campusflow.plans.bookings import apply_bookings

    rnd = random.Random(13)
    students, venues, hosts, events = _world(spark)
    resources = df(spark, "resources", [(50, "Mic", "AV", 10, "", 1, "Available")])
    stored = df(spark, "bookings", [(1, 100, 50, 4, h(30), h(40))])
    maint = df(spark, "maintenance", [(1, 50, h(60), h(62), "fix")])
    rows, accepted = [], [(h(30), h(40), 4)]
    want = {}
    for i in range(150):
        s = h(24 + rnd.randint(0, 60))
        e = s + timedelta(hours=rnd.choice([1, 2, 5, 12]))
        q = rnd.randint(0, 6)
        rows.append((i, h(i / 100), 100, 50, q, s.strftime("%Y-%m-%d %H:%M:%S"), e.strftime("%Y-%m-%d %H:%M:%S")))
        if q <= 0:
            want[i] = "NON_POSITIVE"
        elif s < h(62) and e > h(60):
            want[i] = "MAINTENANCE"
        elif q > 10 - sum(w for a, b, w in accepted if a < e and b > s):
            want[i] = "INSUFFICIENT"
        else:
            accepted.append((s, e, q))
            want[i] = None
    out = apply_bookings(events, venues, hosts, resources, stored, maint, df(spark, "booking_requests", rows), AS_OF)
    got = {r["request_id"]: r["reason"] for r in out["decisions"].collect()}
    assert got == want


LIVE = "request_id long, _ord long, location_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, need int, cap int, takes boolean"


def _one_by_one(rows):
    """The requests of ``rows`` (as LIVE) that fit when they are asked in order."""
    held, out = {}, set()
    for i, _, k, s, e, need, cap, takes in sorted(rows, key=lambda r: r[1]):
        if need <= cap - sum(w for a, b, w in held.get(k, []) if a < e and b > s):
            out.add(i)
            if takes:
                held.setdefault(k, []).append((s, e, need))
    return out


def _admitted(spark, rows, max_rounds=None):
    from campusflow.plans import admission

    status = admission.admit_overlapping(spark.createDataFrame(rows, LIVE), ["location_id"], max_rounds)
    assert status.count() == len(rows)
    return {r["request_id"] for r in status.where("accepted").collect()}


def test_crowd_on_one_venue_hour_is_decided_without_pairs(spark):
    """10,000 requests for one hour of one venue."""
    rnd = random.Random(3)
    rows = []
    for i in range(10_000):
        s = h(9) + timedelta(minutes=rnd.randint(0, 45))
        rows.append((i, i, 1, s, min(s + timedelta(minutes=rnd.randint(5, 30)), h(10)), 1, 1, i % 7 > 0))
    assert _admitted(spark, rows, max_rounds=1) == _one_by_one(rows)


def test_a_chain_of_overlapping_requests_takes_one_round(spark):
    rows = [(i, i, 1, h(i), h(i + 1.5), 1, 1, True) for i in range(1000)]
    got = _admitted(spark, rows, max_rounds=1)
    assert got == _one_by_one(rows) == set(range(0, 1000, 2))
    backwards = [(i, 1000 - i, 1, s, e, n, c, t) for i, _, _, s, e, n, c, t in rows]
    assert _admitted(spark, backwards, max_rounds=1) == _one_by_one(backwards)


@pytest.mark.parametrize("fold", [30])
def test_large_busy_periods_equal_the_replay(spark, monkeypatch, fold):
    from campusflow.plans import admission

    monkeypatch.setattr(admission, "FOLD", fold)
    rnd = random.Random(fold)
    rows = []
    for i in range(150):
        s = h(rnd.randint(0, 100) / 2)
        rows.append((i, rnd.randint(0, 10**6), rnd.randint(1, 2), s, s + timedelta(minutes=rnd.choice([20, 60, 200, 900])), rnd.randint(1, 4), 9, rnd.random() < 0.9))
    assert _admitted(spark, rows) == _one_by_one(rows)


def test_decisions_do_not_depend_on_partitioning(spark):
    import __spark_entry__ as entry
    from tests.conftest import SMALL

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(tuple(r) for r in entry.queries()["booking_decisions"](spark, SMALL).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        seven = sorted(tuple(r) for r in entry.queries()["booking_decisions"](spark, SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == seven


def test_event_changes_do_not_collide_within_a_batch(spark):
    from campusflow.plans.events import apply_event_updates

    students, venues, hosts, _ = _world(spark)
    venues = df(spark, "venues", [(1, "Hall", "B", 100, 1), (2, "Annex", "B", 100, 1)])
    events = df(spark, "events", [
        (100, "X", "", date(2024, 3, 2), h(24), h(25), 1, 7, "S", 50),
        (101, "Y", "", date(2024, 3, 2), h(30), h(31), 1, 7, "S", 50),
        (102, "Z", "", date(2024, 3, 2), h(24.5), h(25.5), 2, 7, "S", 50),
    ])
    reqs = df(spark, "event_update_requests", [
        (1, h(0), 100, 2, None, None, "2024-03-02", "12:00:00", "13:00:00", None),  # X to 12-13 at Hall
        (2, h(1), 101, 2, None, None, "2024-03-02", "12:30:00", "13:30:00", None),  # Y clashes with X's new slot
        (3, h(2), 100, 2, None, None, "2024-03-02", "12:15:00", "13:00:00", None),  # X again: no clash with itself
        (4, h(3), 102, 3, None, None, None, None, None, 1),  # Z to Hall at 9:30-10:30: X's old slot, freed by 1
    ])
    got = {r["request_id"]: r["reason"]
           for r in apply_event_updates(events, venues, hosts, reqs, AS_OF)["decisions"].collect()}
    assert got == {1: None, 2: "CONFLICT", 3: None, 4: None}


def test_double_submitted_orders_settle_in_three_rounds(spark):
    """Every buyer clicks twice: first clicks are decided in round 1, repeats in round 2."""
    from campusflow.plans.orders import apply_orders

    n = 10_000
    _, venues, hosts, events = _world(spark)
    students = spark.range(1, n + 1).selectExpr(
        "id", "cast(id as string) as srn", "'N' as name", "3 as semester", "'A' as section"
    )
    reqs = spark.range(0, 2 * n).selectExpr(
        "id as request_id", "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, id) as request_ts",
        "cast(id div 2 + 1 as long) as user_id", "100L as event_id", "1L as ticket_id", "1 as how_many", "1 as paid",
    )
    tickets = df(spark, "tickets", [(1, 100, "Paid", 10.0, n)])
    out = apply_orders(tickets, df(spark, "participants", []), students, events, venues, hosts, reqs, AS_OF, max_rounds=3)
    got = {(r["reason"], r["count"]) for r in out["decisions"].groupBy("reason").count().collect()}
    assert got == {(None, n), ("NO_TICKETS", 1), ("ALREADY_REGISTERED", n - 1)}


def test_null_stock_is_never_on_sale(spark):
    from campusflow.operators.rules import requests_bad_ticket
    from campusflow.plans.orders import apply_orders

    students, venues, hosts, events = _world(spark)
    tickets = df(spark, "tickets", [(1, 100, "A", 5.0, None), (2, 100, "B", 5.0, 3), (3, 200, "A", 5.0, None)])
    reqs = df(spark, "order_requests", [(1, h(0), 5, 100, 1, 1, 1), (2, h(0.1), 5, 200, 3, 1, 1), (3, h(0.2), 5, 100, 2, 1, 1)])
    out = apply_orders(tickets, df(spark, "participants", []), students, events, venues, hosts, reqs, AS_OF)
    got = {r["request_id"]: (r["accepted"], r["reason"]) for r in out["decisions"].collect()}
    assert got == {1: (False, "INVALID_TICKET"), 2: (False, "NO_TICKETS"), 3: (True, None)}
    assert {r["request_id"] for r in requests_bad_ticket(reqs, tickets).collect()} == {1, 2}


def test_datetime_texts_as_strptime(spark):
    import duckdb

    from campusflow.functions.expr import parse_ts
    from oracle.queries import parsed

    texts = [
        "2024-03-01 09:00:00", "2024-3-1 9:00:00", "2024-03-01 9:0:0", "2024-03-01  09:00:00", "2024-03-01 09:00:00 ", " 2024-03-01 09:00:00",
        "2024-13-01 09:00:00", "2024-02-30 09:00:00", "24-03-01 09:00:00", "2024-03-01", "2024-03-01\t09:00:00", "noon", "", "2024-03-01 24:00:00",
        "2024-03-01 09:60:00", "2024-03-01 09:00:61", "2024-03-01T09:00:00", "2024-03-001 09:00:00", "02024-03-01 09:00:00", "0000-01-01 00:00:00",
    ]

    def python(text):
        try:
            return datetime.strptime(text, "%Y-%m-%d %H:%M:%S")
        except ValueError:
            return None

    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["p"] for r in frame.select("t", parse_ts("t").alias("p")).collect()} == {t: python(t) for t in texts}
    got = {t: duckdb.execute(f"select {parsed('t')} from (select ?::varchar as t)", [t]).fetchone()[0] for t in texts}
    assert got == {t: python(t) for t in texts}


def test_order_ranges_cut_one_key_with_one_timestamp(spark):
    from campusflow.plans.common import order_ranges

    rows = spark.range(20_000).selectExpr(
        "1L as k", "timestamp_ntz'2024-03-01 09:00:00' as request_ts", "pmod(hash(id), 1000003) * 20000L + id as request_id", "id % 7 as v"
    )
    blocks = order_ranges(rows, ["k"], ["request_ts", "request_id"])
    sizes = [r["count"] for r in blocks.groupBy("_blk").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 10_000
    got = running_sums(blocks, ["k"], "_blk", ["request_ts", "request_id"], {"s": "v"})
    plain = Window.partitionBy("k").orderBy("request_ts", "request_id")
    want = rows.withColumn("w", F.sum("v").over(plain))
    assert got.join(want.select("request_id", "w"), "request_id").where("s <> w").count() == 0
    assert got.count() == 20_000


# ------------------------------------------------- event changes, one by one
def _change(i, event, kind, name="", text="", day="", start="", end="", venue=None):
    return (i, h(i / 1000), event, kind, name, text, day, start, end, venue)


def _changed(spark, events, rows, **kw):
    from campusflow.plans.events import apply_event_updates

    venues = df(spark, "venues", [(v, f"V{v}", "B", 500, 1) for v in (1, 2, 3)])
    hosts = df(spark, "hosts", [(1, "H", "h@x", None, "", "Staff")])
    out = apply_event_updates(df(spark, "events", events), venues, hosts, df(spark, "event_update_requests", rows), AS_OF, **kw)
    reasons = {r["request_id"]: r["reason"] for r in out["decisions"].collect()}
    after = {r["id"]: (r["name"], r["description"], r["start_ts"], r["end_ts"], r["location_id"]) for r in out["events_after"].collect()}
    return reasons, after


def _event(i, start, hours, venue, name="Old", text="old"):
    return (i, name, text, start.date(), start, start + timedelta(hours=hours), venue, 1, "Scheduled", 10)


def test_partial_changes_of_one_event_add_up(spark):
    day = datetime(2024, 4, 2, 9)
    reasons, after = _changed(spark, [_event(1, day, 1, 1), _event(2, day, 1, 2)], [
        _change(1, 1, 1, name="New"), _change(2, 1, 1, text="newd"),
        _change(3, 2, 2, day="2024-04-05"), _change(4, 2, 2, start="14:00:00", end="15:00:00"),
        _change(5, 2, 2, end="13:00:00"),
    ])
    assert reasons == {1: None, 2: None, 3: None, 4: None, 5: "BAD_TIME"}
    assert after[1][:2] == ("New", "newd")
    assert after[2][2:4] == (datetime(2024, 4, 5, 14), datetime(2024, 4, 5, 15))


def test_a_freed_slot_can_be_taken_in_the_same_batch(spark):
    day = datetime(2024, 4, 2, 9)
    events = [_event(1, day, 2, 1), _event(2, day + timedelta(hours=5), 1, 1), _event(3, day, 1, 2)]
    moves = [
        _change(1, 2, 2, start="09:30:00", end="10:30:00"),  # event 1 is there
        _change(2, 1, 3, venue=3),
        _change(3, 2, 2, start="09:30:00", end="10:30:00"),  # now it is gone
        _change(4, 3, 3, venue=1),  # event 2 is there now
        _change(5, 2, 3, venue=1),  # its own venue
        _change(6, 2, 2, day="2024-04-03"),
        _change(7, 3, 3, venue=1),
    ]
    reasons, after = _changed(spark, events, moves)
    assert reasons == {1: "CONFLICT", 2: None, 3: None, 4: "CONFLICT", 5: "CONFLICT", 6: None, 7: None}
    assert after[2][2] == datetime(2024, 4, 3, 9, 30) and (after[1][4], after[3][4]) == (3, 1)


def test_changes_that_meet_an_unmoved_event_need_one_round(spark):
    """Guessing them all accepted takes a second round."""
    day = datetime(2024, 4, 2, 9)
    events = [_event(1, day, 2, 1), _event(2, day, 1, 2), _event(3, day, 1, 3)]
    moves = [
        _change(1, 2, 3, venue=1), _change(2, 3, 3, venue=1), _change(3, 2, 3, venue=1),
        _change(4, 2, 2, start="noon"), _change(5, 3, 3, venue=1),
    ]
    reasons, after = _changed(spark, events, moves, max_rounds=1)
    assert reasons == {1: "CONFLICT", 2: "CONFLICT", 3: "CONFLICT", 4: "UNPARSEABLE", 5: "CONFLICT"}
    assert [after[k][4] for k in (1, 2, 3)] == [1, 2, 3]


def test_event_changes_equal_the_replay(spark):
    rnd = random.Random(17)
    day = datetime(2024, 4, 2, 0)
    events = [_event(i, day + timedelta(hours=rnd.randint(6, 18)), rnd.choice([1, 2, 3]), rnd.choice([1, 2, 3, None])) for i in range(12)]
    events.append((50, "Bad", "", day.date(), day + timedelta(hours=9), day + timedelta(hours=8), 1, 1, "Scheduled", 10))
    rows = []
    for i in range(50):
        a = rnd.randint(6, 20)
        given = {"day": rnd.choice(["", "", "2024-04-02", "2024-04-03"]), "start": rnd.choice(["", f"{a}:00:00"]), "end": rnd.choice(["", f"{a + 1}:30:00", "noon"])}
        event = rnd.choice([rnd.randint(0, 11), 50])
        rows.append(_change(i, event, 2, **given) if rnd.random() < 0.6 else _change(i, event, 3, venue=rnd.randint(1, 3)))
    now = {e[0]: [e[3].isoformat(), e[4].strftime("%H:%M:%S"), e[5].strftime("%H:%M:%S"), e[4], e[5], e[6]] for e in events}
    want = {}
    for i, _, event, kind, _, _, d, s, e, venue in rows:
        cur = now[event]
        texts = [x or y for x, y in zip((d, s, e), cur)] if kind == 2 else cur[:3]
        try:
            span = [datetime.strptime(f"{texts[0]} {x}", "%Y-%m-%d %H:%M:%S") for x in texts[1:3]] if kind == 2 else cur[3:5]
        except ValueError:
            want[i] = "UNPARSEABLE"
            continue
        place = cur[5] if kind == 2 else venue
        if kind == 2 and span[1] <= span[0]:
            want[i] = "BAD_TIME"
            continue
        others = [o for k, o in now.items() if kind == 3 or k != event]
        want[i] = "CONFLICT" if span[0] < span[1] and any(o[5] == place and o[3] < span[1] and o[4] > span[0] for o in others) else None
        if want[i] is None:
            now[event] = [*texts, *span, place]
    reasons, after = _changed(spark, events, rows)
    assert reasons == want
    assert {k: v[2:] for k, v in after.items()} == {k: tuple(v[3:]) for k, v in now.items()}


# ------------------------------------------------------ hosts and components
def test_components_of_a_long_chain(spark):
    from campusflow.operators.components import components

    rnd = random.Random(2)
    names = rnd.sample(range(10_000), 1200)
    links = list(zip(names[:1000], names[1:1000])) + [(names[1001], names[1002]), (names[1003], names[1003])]
    rnd.shuffle(links)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), max_rounds=25).collect()}
    chain = set(names[:1000])
    assert {k for k, v in got.items() if v == min(chain)} == chain
    assert got[names[1001]] == got[names[1002]] == min(names[1001:1003]) and got[names[1003]] == names[1003]
    assert len(got) == 1003


@pytest.mark.parametrize("fold", [10_000, 7])
def test_hosts_in_chains_of_shared_keys_equal_the_replay(spark, monkeypatch, fold):
    from campusflow.plans import people

    monkeypatch.setattr(people, "FOLD", fold)
    rnd = random.Random(fold)
    n = 1000 if fold > 100 else 60
    # Emails and phones shared in turn, in a random order, and repeats of one phone.
    keys = [(f"e{i // 2}", f"p{(i + 1) // 2}") for i in range(n)] + [(f"x{i}", "p0" if i % 3 else "") for i in range(40)] + [("y", ""), ("y", ""), (None, ""), (None, "p3")]
    rnd.shuffle(keys)
    rows = [(i, h(0), "N", e, p, "Staff", "") for i, (e, p) in enumerate(keys)]
    hosts = [(1, "H", "e5", "p9", "", "Staff"), (2, "H", None, None, "", "Staff")]
    out = people.apply_new_hosts(df(spark, "hosts", hosts), df(spark, "host_requests", rows))
    emails, phones, want = {"e5"}, {"p9"}, {}
    for i, (e, p) in enumerate(keys):
        want[i] = not ((e is not None and e in emails) or (p and p in phones))
        if want[i]:
            emails.add(e)
            phones.add(p)
    assert {r["request_id"]: r["accepted"] for r in out["decisions"].collect()} == want


def test_pairs_are_sought_among_near_spans_only(spark):
    from campusflow.operators import overlap

    times = [("a", 1, 0, 90), ("a", 2, 5000, 5090), ("a", 3, 9000, 8990), ("b", 4, 0, 90)]
    left = spark.createDataFrame(times, "k string, id int, lo long, hi long")
    right = spark.createDataFrame([("a", 60, 120), ("a", 8000, 9500)], "k string, rlo long, rhi long")
    near = overlap._near(left, ("lo", "hi"), right, ("rlo", "rhi"), ["k"])
    found = {r.id for r in near.collect()}
    assert {1, 3} <= found and 4 not in found
    stored = spark.createDataFrame([("a", 0, 10), ("a", 30, 40), ("a", 15, 12), ("c", 0, 10)], "k string, s long, e long")
    probes = spark.createDataFrame([("a", 5, 20), ("a", 50, 45)], "k string, ps long, pe long")
    kept = overlap.inside_probes(stored, probes, ["k"], ("s", "e"), ("ps", "pe"))
    assert sorted(map(tuple, kept.collect())) == [("a", 0, 10), ("a", 15, 12)]
