"""Batch job entry point: run a request flow or a report over stored tables.

    spark-submit --py-files campusflow.zip campusflow/jobs.py \\
        --tables /shared/state --flow orders \\
        --requests /shared/requests/orders/2024-05-01 --out /shared/runs/2024-05-01 \\
        --as-of "2024-05-01 12:00:00"

State tables are read from ``<tables>/<name>`` (declared schemas; parquet or,
with ``--tables-format`` and ``--tables-option``, CSV, JSON or ORC), requests
likewise from ``--requests``; every output DataFrame of the flow (decisions,
deltas, new table states) is written to ``<out>/<output name>``.

Nothing is dropped in silence: values that do not parse, of requests and of
state tables alike, are written to ``rejects`` and ``state_rejects``, and the
numbers of requests read, rejected, accepted and refused, counted in the passes
that write the outputs, to ``<out>/_run.json``. That file is the commit: a run
whose folder has it is not run again, and readers skip folders without it. With
``--strict`` a run whose state tables have rejects is refused before any
decision, since a stored row that is missing could let a request pass.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from campusflow.operators import conflicts as C
from campusflow.operators import reports as R
from campusflow.operators import rules as V
from campusflow.plans import assets, bookings, events, orders, people, registrations, tickets
from campusflow.sources.state import Files
from campusflow.sources.tables import STATE_SCHEMAS, read_with_rejects, write_table

Tables = dict[str, DataFrame]

# flow name -> (request table, runner(tables, requests, as_of) -> outputs)
FLOWS: dict[str, tuple[str, Callable[[Tables, DataFrame, datetime | None], dict[str, DataFrame]]]] = {
    "orders": ("order_requests", lambda t, r, a: orders.apply_orders(
        t["tickets"], t["participants"], t["students"], t["events"], t["venues"], t["hosts"], r, a)),
    "cancellations": ("cancel_requests", lambda t, r, a: orders.apply_cancellations(
        t["participants"], t["events"], t["tickets"], t["orders"], r, a)),
    "new_events": ("event_requests", lambda t, r, a: events.apply_new_events(t["events"], t["venues"], t["hosts"], r)),
    "event_updates": ("event_update_requests", lambda t, r, a: events.apply_event_updates(
        t["events"], t["venues"], t["hosts"], r, a)),
    "bookings": ("booking_requests", lambda t, r, a: bookings.apply_bookings(
        t["events"], t["venues"], t["hosts"], t["resources"], t["bookings"], t["maintenance"], r, a)),
    "maintenance": ("maintenance_requests", lambda t, r, a: assets.apply_maintenance(
        t["resources"], t["bookings"], t["events"], r)),
    "tickets": ("ticket_requests", lambda t, r, a: tickets.apply_ticket_changes(t["tickets"], r, t["events"])),
    "attendance": ("attendance_requests", lambda t, r, a: registrations.apply_attendance(
        t["events"], t["participants"], t["students"], r)),
    "feedback": ("feedback_requests", lambda t, r, a: registrations.apply_feedback(
        r, t["participants"], t["feedback"], t["students"], t["events"], t["venues"], t["hosts"], a)),
    "venue_flags": ("venue_flag_requests", lambda t, r, a: assets.apply_venue_flags(t["venues"], r)),
    "resource_status": ("resource_status_requests", lambda t, r, a: assets.apply_resource_status(t["resources"], r)),
    "new_resources": ("resource_requests", lambda t, r, a: assets.apply_new_resources(r)),
    "new_students": ("student_requests", lambda t, r, a: people.apply_new_students(t["students"], r)),
    "new_hosts": ("host_requests", lambda t, r, a: people.apply_new_hosts(t["hosts"], r)),
}

REPORTS: dict[str, Callable[[Tables, datetime | None], DataFrame]] = {
    "available_venues": lambda t, a: R.available_venues(t["venues"], ordered=True),
    "venues_with_status": lambda t, a: R.venues_with_status(t["venues"], ordered=True),
    "upcoming_events": lambda t, a: R.upcoming_events(t["events"], t["venues"], t["hosts"], a, ordered=True),
    "completed_events": lambda t, a: R.completed_events(t["events"], t["venues"], t["hosts"], a, ordered=True),
    "students_roster": lambda t, a: R.students_roster(t["students"], ordered=True),
    "participants_detail": lambda t, a: R.participants_detail(t["participants"], t["events"], t["students"],
                                                              ordered=True),
    "participant_counts": lambda t, a: R.participant_counts(t["participants"], t["events"], ordered=True),
    "resources_list": lambda t, a: R.resources_list(t["resources"], ordered=True),
    "hosts_list": lambda t, a: R.hosts_list(t["hosts"], ordered=True),
    "upcoming_registrations": lambda t, a: R.upcoming_registrations(t["participants"], t["events"], t["venues"], a,
                                                                    ordered=True),
    "feedback_report": lambda t, a: R.feedback_report(t["feedback"], t["students"], ordered=True),
    "available_tickets": lambda t, a: R.available_tickets(t["tickets"], ordered=True),
    "event_tickets": lambda t, a: R.event_tickets(t["tickets"], ordered=True),
    "event_directory": lambda t, a: R.event_directory(t["events"], ordered=True),
    "attendance_roster": lambda t, a: R.attendance_roster(t["participants"], t["students"], ordered=True),
    "venue_conflicts": lambda t, a: C.venue_conflicts(t["events"]),
    "booking_maintenance_conflicts": lambda t, a: C.booking_maintenance_conflicts(t["bookings"], t["maintenance"]),
    "invalid_semester": lambda t, a: V.invalid_semester(t["students"]),
    "invalid_rating": lambda t, a: V.invalid_rating(t["feedback"]),
    "invalid_events": lambda t, a: V.invalid_spans(t["events"], "events", "id", "start_ts", "end_ts"),
    "invalid_bookings": lambda t, a: V.invalid_spans(t["bookings"], "bookings", "id", "booking_start", "booking_end"),
    "invalid_maintenance": lambda t, a: V.invalid_spans(
        t["maintenance"], "maintenance", "id", "maintenance_start", "maintenance_end"),
    "over_capacity_events": lambda t, a: V.over_capacity_events(t["events"], t["venues"]),
    "duplicate_keys": lambda t, a: V.duplicate_keys(t["students"], t["hosts"], t["participants"]),
    "orphan_rows": lambda t, a: V.orphan_rows(
        t["participants"], t["feedback"], t["bookings"], t["orders"], t["students"], t["events"], t["tickets"],
        t["resources"]),
    "lowest_ticket": lambda t, a: V.lowest_ticket(t["tickets"]),
    "first_feedback": lambda t, a: V.first_feedback(t["feedback"], t["participants"]),
}

# Reports over a table of requests: (request table, runner(tables, requests)).
REQUEST_REPORTS: dict[str, tuple[str, Callable[[Tables, DataFrame], DataFrame]]] = {
    "unknown_student_requests": ("order_requests", lambda t, r: R.unknown_student_requests(r, t["students"], ordered=True)),
    "requests_bad_ticket": ("order_requests", lambda t, r: V.requests_bad_ticket(r, t["tickets"])),
    "unfillable_requests": ("order_requests", lambda t, r: V.unfillable_requests(r, t["tickets"])),
    "invalid_booking_quantity": ("booking_requests", lambda t, r: V.invalid_booking_quantity(r, t["resources"])),
    "invalid_resource_quantity": ("resource_requests", lambda t, r: V.invalid_resource_quantity(r)),
    "requests_bad_venue": ("event_requests", lambda t, r: V.requests_bad_venue(r, t["venues"])),
    "event_request_conflicts": (
        "event_requests", lambda t, r: C.event_request_conflicts(C.with_event_span(r), t["events"])),
    "event_request_conflict_names": (
        "event_requests", lambda t, r: C.event_request_conflict_names(C.with_event_span(r), t["events"])),
    "maintenance_booking_conflicts": (
        "maintenance_requests",
        lambda t, r: C.maintenance_booking_conflicts(C.with_span(r), t["bookings"], t["events"])),
    "maintenance_conflict_names": (
        "maintenance_requests", lambda t, r: C.maintenance_conflict_names(C.with_span(r), t["bookings"], t["events"])),
    "booked_in_slot": ("booking_requests", lambda t, r: C.booked_in_slot(C.with_span(r), t["bookings"])),
    "resource_remaining": (
        "booking_requests",
        lambda t, r: C.resource_remaining(C.booked_in_slot(C.with_span(r), t["bookings"]), t["resources"])),
}


class LazyTables(dict):
    """State tables read on first use from ``<root>/<name>``, or from the tables
    of a catalog database (``sources.bucketed``) if ``root`` is ``catalog:<database>``.
    ``rejects`` has the rejected values of each table read."""

    CATALOG = "catalog:"

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet", **options: str):
        super().__init__()
        self.spark, self.root, self.fmt, self.options = spark, root.rstrip("/"), fmt, options
        self.rejects: dict[str, DataFrame] = {}

    def __missing__(self, name: str) -> DataFrame:
        if self.root.startswith(self.CATALOG):
            rows = self.spark.table(f"{self.root.removeprefix(self.CATALOG)}.{name}")
        else:
            rows, self.rejects[name] = read_with_rejects(self.spark, name, f"{self.root}/{name}", self.fmt, **self.options)
        self[name] = rows
        return rows

    def all_rejects(self) -> DataFrame:
        """(table, key, column, value) of the tables read so far."""
        out = self.spark.createDataFrame([], REJECTS)
        for name, df in self.rejects.items():
            key = F.col(df.columns[0]).cast("string").alias("key")
            out = out.unionByName(df.select(F.lit(name).alias("table"), key, "column", "value"))
        return out


REJECTS = "table string, key string, column string, value string"
#: The commit of a run, with its counts.
RUN_FILE = "_run.json"


class RejectedState(ValueError):
    """State tables hold values that do not parse, and the run is strict."""


def committed(spark: SparkSession, out: str) -> dict | None:
    """The counts of a finished run, None if the folder has no finished run."""
    files = Files(spark, out)
    return files.read(RUN_FILE) if files.exists(RUN_FILE) else None


def run_flow(spark: SparkSession, tables_root: str, flow: str, requests_path: str, out: str,
             as_of: datetime | None = None, fmt: str = "parquet", options: dict[str, str] | None = None,
             tables_fmt: str = "parquet", tables_options: dict[str, str] | None = None, strict: bool = False) -> list[str]:
    """Run one flow and write all its outputs; returns the output names
    written, none if the run was finished before."""
    if committed(spark, out) is not None:
        return []
    kind, runner = FLOWS[flow]
    as_of = as_of or now(spark)
    read, decided = Observation(), Observation()
    requests, rejects = read_with_rejects(spark, kind, requests_path, fmt, observed=read, **(options or {}))
    tables = LazyTables(spark, tables_root, tables_fmt, **(tables_options or {}))
    if strict:
        _refuse_rejects(tables)
    outputs = runner(tables, requests, as_of)
    if "decisions" in outputs:
        counts = [F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused")]
        outputs["decisions"] = outputs["decisions"].observe(decided, *counts)
    outputs |= {"rejects": rejects, "state_rejects": tables.all_rejects()}
    for name, df in outputs.items():
        write_table(df, f"{out.rstrip('/')}/{name}", mode="overwrite")  # left by a run that failed, if anything
    counted = {"flow": flow, "as_of": str(as_of), **read.get, **(decided.get if "decisions" in outputs else {})}
    Files(spark, out).commit(RUN_FILE, counted)
    return sorted(outputs)


def _refuse_rejects(tables: LazyTables) -> None:
    """Read every state table there is and refuse the run if one has rejects."""
    for name in sorted(STATE_SCHEMAS):
        if Files(tables.spark, tables.root).exists(name):
            tables[name]
    bad = {r["table"]: r["count"] for r in tables.all_rejects().groupBy("table").count().collect()}
    if bad:
        raise RejectedState(", ".join(f"{name}: {n} values" for name, n in sorted(bad.items())))


def now(spark: SparkSession) -> datetime:
    """The run's one "now": every output of a run sees the same time."""
    return spark.sql("SELECT localtimestamp() AS now").first()["now"]


def run_report(spark: SparkSession, tables_root: str, report: str, out: str, as_of: datetime | None = None,
               requests_path: str | None = None, fmt: str = "parquet", options: dict[str, str] | None = None,
               tables_fmt: str = "parquet", tables_options: dict[str, str] | None = None) -> None:
    """Run one report; those over requests read ``requests_path``. Values that
    do not parse are written beside it, to ``<report>_rejects``."""
    tables = LazyTables(spark, tables_root, tables_fmt, **(tables_options or {}))
    if report in REQUEST_REPORTS:
        kind, runner = REQUEST_REPORTS[report]
        requests, tables.rejects[kind] = read_with_rejects(spark, kind, requests_path, fmt, **(options or {}))
        df = runner(tables, requests)
    else:
        df = REPORTS[report](tables, as_of or now(spark))
    write_table(df, f"{out.rstrip('/')}/{report}")
    write_table(tables.all_rejects(), f"{out.rstrip('/')}/{report}_rejects")


def _options(given: list[str] | None) -> dict[str, str]:
    return dict(o.split("=", 1) for o in given or [])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--tables", required=True, help="folder holding one table per state table, or catalog:<database>")
    p.add_argument("--out", required=True, help="new folder for this run's outputs")
    g = p.add_mutually_exclusive_group(required=True)
    g.add_argument("--flow", choices=sorted(FLOWS))
    g.add_argument("--report", choices=sorted({*REPORTS, *REQUEST_REPORTS}))
    p.add_argument("--requests", help="request table of the flow or report")
    p.add_argument("--as-of", help="'YYYY-MM-DD HH:MM:SS'; default: now")
    for what in ("requests", "tables"):
        p.add_argument(f"--{what}-format", default="parquet", choices=["parquet", "csv", "json", "orc"])
        p.add_argument(f"--{what}-option", action="append", metavar="NAME=VALUE", help="reader option, as header=true")
    p.add_argument("--strict", action="store_true", help="refuse a flow whose state tables have rejects")
    args = p.parse_args(argv)
    as_of = datetime.strptime(args.as_of, "%Y-%m-%d %H:%M:%S") if args.as_of else None

    from campusflow.session import get_spark

    spark = get_spark(app=f"campusflow-{args.flow or args.report}")
    sources = {"fmt": args.requests_format, "options": _options(args.requests_option),
               "tables_fmt": args.tables_format, "tables_options": _options(args.tables_option)}
    if args.flow:
        if not args.requests:
            p.error("--flow needs --requests")
        run_flow(spark, args.tables, args.flow, args.requests, args.out, as_of, strict=args.strict, **sources)
    else:
        if args.report in REQUEST_REPORTS and not args.requests:
            p.error("this report needs --requests")
        run_report(spark, args.tables, args.report, args.out, as_of, args.requests, **sources)


if __name__ == "__main__":
    main()
