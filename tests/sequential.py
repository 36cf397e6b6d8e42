"""Test-only brute force: the request flows replayed one request at a time in
plain Python, in batch order, straight from the rules. Inputs come from the
DuckDB oracle views, so this shares no code with the Spark operators.
"""

from __future__ import annotations

import duckdb

from oracle.views import AS_OF_SQL, with_views


def fetch(con: duckdb.DuckDBPyConnection, body: str) -> list[dict]:
    cur = con.execute(with_views(body))
    cols = [d[0] for d in cur.description]
    return [dict(zip(cols, row)) for row in cur.fetchall()]


def replay_orders(tickets: list[dict], registered: set, students: set, has_upcoming: bool,
                  reqs: list[dict]) -> dict[int, tuple[bool, str | None]]:
    """Decide order requests one at a time; ``reqs`` must be in batch order."""
    tickets = {r["id"]: r for r in tickets}
    stock = {tid: r["quantity"] for tid, r in tickets.items()}
    by_event: dict[int, list[int]] = {}
    for tid, r in tickets.items():
        by_event.setdefault(r["event_id"], []).append(tid)
    registered = set(registered)
    out: dict[int, tuple[bool, str | None]] = {}
    for q in reqs:
        rid = q["request_id"]

        def refuse(reason: str) -> None:
            out[rid] = (False, reason)

        if not has_upcoming:
            refuse("EMPTY_LIST")
            continue
        on_sale = [tid for tid in by_event.get(q["event_id"], []) if (stock[tid] or 0) > 0]
        if not on_sale:
            refuse("NO_TICKETS")
            continue
        if q["ticket_id"] not in on_sale:
            refuse("INVALID_TICKET")
            continue
        n = q["how_many"]
        if n is None or n <= 0:
            refuse("NON_POSITIVE")
            continue
        if n > stock[q["ticket_id"]]:
            refuse("OVER_QUANTITY")
            continue
        if not students:
            refuse("EMPTY_LIST")
            continue
        total = tickets[q["ticket_id"]]["price"] * n
        completed = total <= 0 or q["paid"] == 1
        if q["user_id"] not in students:
            refuse("UNKNOWN_STUDENT")
            continue
        key = (q["event_id"], q["user_id"])
        if completed and key in registered:
            refuse("ALREADY_REGISTERED")
            continue
        stock[q["ticket_id"]] -= n
        if completed:
            registered.add(key)
        out[rid] = (True, None)
    return out


def simulate_orders(con: duckdb.DuckDBPyConnection) -> dict[int, tuple[bool, str | None]]:
    tickets = fetch(con, "select * from d_tickets_unset")
    registered = {(r["event_id"], r["user_id"]) for r in fetch(con, "select event_id, user_id from d_participants")}
    students = {r["id"] for r in fetch(con, "select id from d_students")}
    has_upcoming = bool(fetch(con, f"""
        select 1 from d_events e join d_hosts h on e.organizer_id = h.id where e.end_ts > {AS_OF_SQL} limit 1"""))
    reqs = fetch(con, "select * from d_order_requests order by request_ts, request_id")
    return replay_orders(tickets, registered, students, has_upcoming, reqs)


def simulate_hosts(con: duckdb.DuckDBPyConnection) -> dict[int, bool]:
    hosts = fetch(con, "select email, phone from d_hosts")
    emails = {h["email"] for h in hosts if h["email"] is not None}
    phones = {h["phone"] for h in hosts if h["phone"] is not None}
    out = {}
    for q in fetch(con, "select * from d_host_requests order by request_ts, request_id"):
        phone = q["phone"] or None
        if q["email"] in emails or (phone is not None and phone in phones):
            out[q["request_id"]] = False
            continue
        emails.add(q["email"])
        if phone is not None:
            phones.add(phone)
        out[q["request_id"]] = True
    return out


def _parse(text: str | None):
    import datetime as dt

    if text is None:
        return None
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return None


def _overlap(a0, a1, b0, b1) -> bool:
    return a0 < b1 and a1 > b0


def simulate_new_events(con: duckdb.DuckDBPyConnection) -> dict[int, tuple[bool, str | None]]:
    events = fetch(con, "select location_id, start_ts, end_ts from d_events where location_id is not null")
    by_loc: dict[int, list] = {}
    for e in events:
        if e["start_ts"] is not None and e["end_ts"] is not None:
            by_loc.setdefault(e["location_id"], []).append((e["start_ts"], e["end_ts"]))
    venues = {v["id"]: v["capacity"] for v in fetch(con, "select id, capacity from d_venues where is_available = 1")}
    hosts = {h["id"] for h in fetch(con, "select id from d_hosts")}
    out = {}
    for q in fetch(con, "select * from d_event_requests order by request_ts, request_id"):
        rid = q["request_id"]
        s = _parse(f"{q['date_text']} {q['start_text']}")
        e = _parse(f"{q['date_text']} {q['end_text']}")
        if s is None or e is None:
            out[rid] = (False, "UNPARSEABLE")
            continue
        if e <= s:
            out[rid] = (False, "BAD_TIME")
            continue
        if not hosts or not venues:
            out[rid] = (False, "EMPTY_LIST")
            continue
        cap = venues.get(q["location_id"])
        if cap is None:
            out[rid] = (False, "INVALID_VENUE")
            continue
        if q["max_participants"] > cap:
            out[rid] = (False, "OVER_CAPACITY")
            continue
        if any(_overlap(a0, a1, s, e) for a0, a1 in by_loc.get(q["location_id"], [])):
            out[rid] = (False, "CONFLICT")
            continue
        if q["organizer_id"] not in hosts:
            out[rid] = (False, "UNKNOWN_HOST")
            continue
        by_loc.setdefault(q["location_id"], []).append((s, e))
        out[rid] = (True, None)
    return out


def simulate_bookings(con: duckdb.DuckDBPyConnection) -> dict[int, tuple[bool, str | None]]:
    from oracle.views import AS_OF_SQL as A

    bookings: dict[int, list] = {}
    for b in fetch(con, "select resource_id, quantity_booked, booking_start, booking_end from d_bookings"):
        bookings.setdefault(b["resource_id"], []).append((b["booking_start"], b["booking_end"], b["quantity_booked"]))
    maint: dict[int, list] = {}
    for m in fetch(con, "select resource_id, maintenance_start, maintenance_end from d_maintenance"):
        maint.setdefault(m["resource_id"], []).append((m["maintenance_start"], m["maintenance_end"]))
    totals = {r["id"]: r["quantity"] for r in fetch(con, "select id, quantity from d_resources")}
    events = {e["id"] for e in fetch(con, "select id from d_events")}
    upcoming = bool(fetch(con, f"select 1 from d_events e join d_hosts h on e.organizer_id = h.id where e.end_ts > {A} limit 1"))
    out = {}
    for q in fetch(con, "select * from d_booking_requests order by request_ts, request_id"):
        rid = q["request_id"]
        if not upcoming or not totals:
            out[rid] = (False, "EMPTY_LIST")
            continue
        total = totals.get(q["resource_id"])
        if total is None:
            out[rid] = (False, "INVALID_RESOURCE")
            continue
        n = q["quantity"]
        if n > total:
            out[rid] = (False, "OVER_TOTAL")
            continue
        if n <= 0:
            out[rid] = (False, "NON_POSITIVE")
            continue
        s, e = _parse(q["start_text"]), _parse(q["end_text"])
        if s is None or e is None:
            out[rid] = (False, "UNPARSEABLE")
            continue
        if e <= s:
            out[rid] = (False, "BAD_TIME")
            continue
        if any(m0 < e and m1 > s for m0, m1 in maint.get(q["resource_id"], [])):
            out[rid] = (False, "MAINTENANCE")
            continue
        booked = sum(w for b0, b1, w in bookings.get(q["resource_id"], []) if b0 < e and b1 > s)
        if n > total - booked:
            out[rid] = (False, "INSUFFICIENT")
            continue
        if q["event_id"] not in events:
            out[rid] = (False, "UNKNOWN_EVENT")
            continue
        bookings.setdefault(q["resource_id"], []).append((s, e, n))
        out[rid] = (True, None)
    return out
