"""New events and event changes."""

from __future__ import annotations

import logging

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.functions.expr import NEW_EVENT_STATUS, empty_to_null, first_reason, overlaps, parse_date_time
from campusflow.operators.conflicts import event_request_conflicts, with_event_span
from campusflow.operators.overlap import near_probes, overlap_load, overlap_load_before
from campusflow.operators.prefix import running_max
from campusflow.operators.reports import any_upcoming, available_venues
from campusflow.plans.admission import admit_overlapping
from campusflow.plans.common import EMPTY_LIST, checkpoint, decide, order_key, order_ranges

_log = logging.getLogger(__name__)


def _unparsed(date_col: str, time_col: str) -> Column:
    return parse_date_time(date_col, time_col).isNull()


def apply_new_events(
    events: DataFrame, venues: DataFrame, hosts: DataFrame, requests: DataFrame, max_rounds: int | None = None
) -> dict[str, DataFrame]:
    """Schedule new events in batch order.

    Checks: UNPARSEABLE (date or times) → BAD_TIME (end not after start) →
    EMPTY_LIST (no hosts, or no available venue) → INVALID_VENUE (not on
    the available list) → OVER_CAPACITY (max participants above the venue's
    capacity) → CONFLICT (overlaps a stored event at the venue, or an event
    accepted earlier in the batch) → UNKNOWN_HOST (the insert's reference).
    Accepted events are inserted as 'Scheduled'.

    Batch conflicts are decided by ``admit_overlapping`` (requests at the same
    venue with overlapping times compete), busy period by busy period.
    """
    r = with_event_span(requests).withColumn("_ord", order_key())
    open_v = available_venues(venues).select(F.col("id").alias("location_id"), "capacity")
    host_ids = hosts.select(F.col("id").alias("organizer_id"), F.lit(True).alias("_host"))
    stored = event_request_conflicts(r, events).select("request_id", "conflicts")
    r = r.join(open_v, "location_id", "left").join(host_ids, "organizer_id", "left").join(stored, "request_id", "left")
    static = first_reason([
        (_unparsed("date_text", "start_text") | _unparsed("date_text", "end_text"), "UNPARSEABLE"),
        (F.col("end_ts") <= F.col("start_ts"), "BAD_TIME"),
        (~nonempty_col(hosts), EMPTY_LIST),
        (~nonempty_col(open_v), EMPTY_LIST),
        (F.col("capacity").isNull(), "INVALID_VENUE"),
        (F.col("max_participants").isNull() | (F.col("max_participants") > F.col("capacity")), "OVER_CAPACITY"),
        (F.col("conflicts") > 0, "CONFLICT"),
    ])
    # Read twice below: materialize once.
    r = checkpoint(r.withColumn("_static", static))
    # Requests of unknown hosts pass every check but the host's: they are
    # refused for a CONFLICT first, and take nothing.
    live = r.where(F.col("_static").isNull()).select(
        "request_id", "_ord", "location_id", "start_ts", "end_ts", F.lit(1).alias("need"), F.lit(1).alias("cap"),
        F.col("_host").isNotNull().alias("takes"),
    )
    status = admit_overlapping(live, ["location_id"], max_rounds).withColumnRenamed("accepted", "_fits")
    r = r.join(status, "request_id", "left")
    reason = F.coalesce(
        F.col("_static"), first_reason([(~F.col("_fits"), "CONFLICT"), (F.col("_host").isNull(), "UNKNOWN_HOST")])
    )
    d = decide(r, reason, "request_id", "name", "description", "start_ts", "end_ts", "location_id", "organizer_id",
               "max_participants")
    delta = d.where("accepted").select(
        "request_id", "name", "description", F.to_date("start_ts").alias("date"), "start_ts", "end_ts", "location_id",
        "organizer_id", F.lit(NEW_EVENT_STATUS).alias("status"), "max_participants",
    )
    return {"decisions": d.select("request_id", "location_id", "accepted", "reason"), "events_delta": delta}


def nonempty_col(df: DataFrame) -> Column:
    return df.exists()


#: What an earlier accepted change of the event left behind, per field.
_LAST = {"_last_date": "new_date_text", "_last_start": "new_start_text", "_last_end": "new_end_text"}


def _carried(moves: DataFrame) -> DataFrame:
    """``moves`` plus the event's state just before each request: venue and
    span (_loc, _s, _e), and the date and time texts that empty texts keep.

    Per field, the last value given by an accepted earlier change of the event
    (a running maximum of (order, value) along the batch), else the stored one.
    """
    order = F.struct("request_ts", "request_id")
    timed, moved = F.col("_acc") & (F.col("kind") == 2), F.col("_acc") & (F.col("kind") == 3)
    values = {
        out: F.when(timed & empty_to_null(text).isNotNull(), F.struct(F.col("request_ts"), F.col("request_id"), F.col(text).alias("v")))
        for out, text in _LAST.items()
    }
    values["_last_loc"] = F.when(moved, F.struct(F.col("request_ts"), F.col("request_id"), F.col("new_location_id").alias("v")))
    values["_timed"] = F.when(timed, order)
    return _current(running_max(moves, ["event_id"], "_blk", ["request_ts", "request_id"], values, inclusive=False)).drop(*values)


def _unchanged(moves: DataFrame) -> DataFrame:
    """``_carried`` for a batch of which nothing is accepted."""
    order = "request_ts timestamp_ntz, request_id long"
    given = {out: F.lit(None).cast(f"struct<{order}, v: string>") for out in _LAST}
    given["_last_loc"] = F.lit(None).cast(f"struct<{order}, v: long>")
    given["_timed"] = F.lit(None).cast(f"struct<{order}>")
    return _current(moves.withColumns(given)).drop(*given)


def _current(r: DataFrame) -> DataFrame:
    """The event's state from its stored fields and the last values given."""
    date = F.coalesce(F.col("_last_date.v"), F.col("_o_date").cast("string"))
    start = F.coalesce(F.col("_last_start.v"), F.date_format("_o_start", "HH:mm:ss"))
    end = F.coalesce(F.col("_last_end.v"), F.date_format("_o_end", "HH:mm:ss"))
    r = r.withColumns({"_date": date, "_start": start, "_end": end, "_loc": F.coalesce(F.col("_last_loc.v"), F.col("_o_loc"))})
    timed_before = F.col("_timed").isNotNull()
    return r.withColumns({
        "_s": F.when(timed_before, parse_date_time("_date", "_start")).otherwise(F.col("_o_start")),
        "_e": F.when(timed_before, parse_date_time("_date", "_end")).otherwise(F.col("_o_end")),
    })


def _targets(moves: DataFrame) -> DataFrame:
    """Adds the venue and span that each request asks for, (_tl, _ts, _te)."""
    date = F.coalesce(empty_to_null("new_date_text"), F.col("_date"))
    given = moves.withColumns({"_nd": date, "_nst": F.coalesce(empty_to_null("new_start_text"), F.col("_start")),
                               "_net": F.coalesce(empty_to_null("new_end_text"), F.col("_end"))})
    timed = F.col("kind") == 2
    return given.withColumns({
        "_ts": F.when(timed, parse_date_time("_nd", "_nst")).otherwise(F.col("_s")),
        "_te": F.when(timed, parse_date_time("_nd", "_net")).otherwise(F.col("_e")),
        "_tl": F.when(timed, F.col("_loc")).otherwise(F.col("new_location_id")),
    }).drop("_nd", "_nst", "_net")


#: What a stored event that no request can move adds to a load besides 1.
_STAYS = 1 << 32


def _asked(r: DataFrame) -> DataFrame:
    """``_targets`` and why a request is refused whatever the others do (_bad).
    The texts are parsed once, so they are materialized before they are used."""
    bad = first_reason([
        ((F.col("kind") == 2) & (F.col("_ts").isNull() | F.col("_te").isNull()), "UNPARSEABLE"),
        ((F.col("kind") == 2) & (F.col("_te") <= F.col("_ts")), "BAD_TIME"),
    ])
    return checkpoint(_targets(r)).withColumn("_bad", bad)


def _probes(r: DataFrame) -> DataFrame:
    """The spans asked for; an event without a venue conflicts with none."""
    return r.where(F.col("_bad").isNull() & F.col("_tl").isNotNull()).select(
        "request_id", "request_ts", "_oblk", F.col("_tl").alias("location_id"), "_ts", "_te"
    )


def settle_moves(moves: DataFrame, events: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Decide time and venue changes (request_id, reason) as if one by one.

    ``moves``: the requests of kind 2 and 3 that pass every other check, with
    their event's stored fields (_o_*). A request depends on earlier ones only:
    on its own event's accepted changes (the fields that it keeps) and on those
    of other events (an accepted change frees the event's old slot and takes
    the new one). From a guess of all decisions follow the state before each
    request, the log of slots freed and taken, and with them new decisions;
    this is repeated until the decisions stay. Each round settles at least
    every request whose earlier ones are settled, and what stays is the one
    outcome of working them off in order. Counts come from running sums along
    the batch in the cells of the time index, so no pairs are formed; a stored
    event is counted once for each span that is really asked for.

    A stored event that no request asks to move stays where it is: a span that
    meets one is refused whatever the log says, and neither enters the log nor
    is looked up in it. An event all of whose requests are refused like that
    from its stored state on never moves; its requests take no part in the
    rounds.
    """
    columns = moves.columns
    order = ["request_ts", "request_id"]
    span = ["request_id", "location_id", "_ts", "_te"]
    moves = order_ranges(order_ranges(moves, [], order, "_oblk"), ["event_id"], order)

    # Where request ids repeat, a load is no count of events: none is told apart.
    unique = moves.groupBy("request_id").count().where("count > 1").isEmpty()
    stays = _STAYS + 1 if unique else 1
    ids = moves.select(F.col("event_id").alias("id"), F.lit(1).cast("long").alias("_n")).distinct()
    # Every round that asks for new spans reads it.
    stored = checkpoint(events.join(ids, "id", "left").select(
        "location_id", F.col("start_ts").alias("_xs"), F.col("end_ts").alias("_xe"), F.coalesce("_n", F.lit(stays).cast("long")).alias("_n")
    ))

    def counted(probes: DataFrame, among: DataFrame) -> DataFrame:
        found = overlap_load(probes, among, ["location_id"], "request_id", ("_ts", "_te"), ("_xs", "_xe"), "_n", "_stored")
        return checkpoint(found.select(*span, "_stored"))

    met = F.coalesce("_stored", F.lit(0)) >= _STAYS if unique else F.lit(False)
    if unique:
        first = _asked(_unchanged(moves))
        known = counted(_probes(first), stored)
        first = first.join(known.select("request_id", "_stored"), "request_id", "left")
        reason = F.coalesce(F.col("_bad"), F.when(met, F.lit("CONFLICT")))
        first = checkpoint(first.select(*columns, "_blk", "_oblk", reason.alias("_reason")))
    else:
        known = None
        first = moves.withColumn("_reason", F.lit(None).cast("string"))
    movable = checkpoint(first.where(F.col("_reason").isNull()).select("event_id").distinct())
    refused = first.join(movable, "event_id", "left_anti").select("request_id", F.col("_reason").alias("reason"))
    state = checkpoint(first.join(movable, "event_id", "left_semi").select(
        *columns, "_blk", "_oblk", F.col("_reason").isNull().alias("_acc")
    ))
    rounds = 0
    while True:
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError("event changes did not settle")
        _log.info("event changes, round %d", rounds)
        r = _asked(_carried(state))
        probes = _probes(r)
        # Stored events: only for spans that were not asked for a round before.
        fresh = checkpoint(probes if known is None else probes.join(known, span, "left_anti"))
        if not fresh.isEmpty() or known is None:
            near = near_probes(stored, fresh, ["location_id"], ("_xs", "_xe"), ("_ts", "_te"))
            now = counted(fresh, checkpoint(near))
            if known is not None:
                now = now.unionByName(known.join(probes.select(*span), span, "left_semi"))
            known = checkpoint(now)
        settled = known.where(met).select("request_id")
        done = r.where(F.col("_acc") & F.col("_bad").isNull()).join(settled, "request_id", "left_anti")
        log = done.select(*order, "_oblk", F.explode(F.array(
            F.struct(F.col("_loc").alias("location_id"), F.col("_s").alias("_xs"), F.col("_e").alias("_xe"), F.lit(-1).alias("_sign")),
            F.struct(F.col("_tl").alias("location_id"), F.col("_ts").alias("_xs"), F.col("_te").alias("_xe"), F.lit(1).alias("_sign")),
        )).alias("_x")).select(*order, "_oblk", "_x.*")
        moved = overlap_load_before(
            probes.join(settled, "request_id", "left_anti"), log, ["location_id"], "request_id", ("_ts", "_te"), ("_xs", "_xe"), order, "_oblk", "_sign", "_moved"
        )
        r = r.join(known.select("request_id", "_stored"), "request_id", "left").join(moved, "request_id", "left")
        # A new time is not compared with the event itself, a new venue is.
        own = (F.col("kind") == 2) & (F.col("_tl") == F.col("_loc")) & overlaps(F.col("_s"), F.col("_e"), F.col("_ts"), F.col("_te"))
        others = F.coalesce("_stored", F.lit(0)) + F.coalesce("_moved", F.lit(0)) - F.when(own, 1).otherwise(0)
        reason = F.coalesce(F.col("_bad"), F.when(met | (others > 0), F.lit("CONFLICT")))
        r = checkpoint(r.select(*columns, "_blk", "_oblk", "_acc", reason.alias("_reason")))
        changed = r.where(F.col("_acc") != F.col("_reason").isNull()).limit(1).count() > 0
        if not changed:
            return r.select("request_id", F.col("_reason").alias("reason")).unionByName(refused)
        state = r.select(*columns, "_blk", "_oblk", F.col("_reason").isNull().alias("_acc"))


def apply_event_updates(
    events: DataFrame, venues: DataFrame, hosts: DataFrame, requests: DataFrame, as_of: datetime | None = None,
    max_rounds: int | None = None,
) -> dict[str, DataFrame]:
    """Change an event's name/description (kind 1), date and times (kind 2) or
    venue (kind 3), as if the requests were worked off one by one.

    Checks: EMPTY_LIST (no upcoming event at the start of the batch) →
    EVENT_NOT_FOUND (any stored event may be changed, not only listed ones) →
    INVALID_CHOICE, then per kind:

    * 1 — empty texts keep the current values; always accepted;
    * 2 — empty date/time texts keep the current ones; UNPARSEABLE → BAD_TIME →
      CONFLICT with another event at the event's current venue (an event
      without a venue never conflicts);
    * 3 — EMPTY_LIST (no available venue) → INVALID_VENUE → OVER_CAPACITY
      (max participants above the new venue's capacity) → CONFLICT at the
      new venue for the event's current times, the event itself included
      (moving to its own venue conflicts with itself).

    "Current" is what earlier accepted requests of the batch left, of this and
    of all other events: a slot that a change frees can be taken by the next
    request (``settle_moves``). Of each field the last accepted value stays.
    """
    gate = any_upcoming(events, hosts, as_of).exists()
    e = events.select(
        F.col("id").alias("event_id"), F.col("date").alias("_o_date"), F.col("start_ts").alias("_o_start"),
        F.col("end_ts").alias("_o_end"), F.col("location_id").alias("_o_loc"), F.col("max_participants").alias("_o_max"),
        F.lit(True).alias("_found"),
    )
    open_v = available_venues(venues).select(F.col("id").alias("new_location_id"), F.col("capacity").alias("_cap"))
    r = requests.join(e, "event_id", "left").join(open_v, "new_location_id", "left")
    kind = F.col("kind")
    static = first_reason([
        (~gate, EMPTY_LIST),
        (F.col("_found").isNull(), "EVENT_NOT_FOUND"),
        (kind.isNull() | ~kind.isin(1, 2, 3), "INVALID_CHOICE"),
        ((kind == 3) & ~open_v.exists(), EMPTY_LIST),
        ((kind == 3) & F.col("_cap").isNull(), "INVALID_VENUE"),
        ((kind == 3) & (F.col("_o_max") > F.col("_cap")), "OVER_CAPACITY"),
    ])
    r = checkpoint(r.withColumn("_static", static))
    moves = r.where(F.col("_static").isNull() & kind.isin(2, 3)).select(
        "request_id", "request_ts", "event_id", "kind", "new_date_text", "new_start_text", "new_end_text", "new_location_id",
        "_o_date", "_o_start", "_o_end", "_o_loc",
    )
    settled = settle_moves(moves, events, max_rounds).withColumnRenamed("reason", "_moved")
    r = r.join(settled, "request_id", "left")
    d = checkpoint(decide(
        r.withColumn("_ord", order_key()), F.coalesce("_static", "_moved"), "request_id", "event_id", "kind", "_ord",
        "new_name", "new_description", "new_date_text", "new_start_text", "new_end_text", "new_location_id",
    ))
    acc = d.where("accepted")

    def last(kind_no: int, value: str) -> Column:
        given = empty_to_null(value) if value != "new_location_id" else F.col(value)
        return F.max(F.when((F.col("kind") == kind_no) & given.isNotNull(), F.struct("_ord", given.alias("v"))))["v"].alias(value)

    texts = [(1, "new_name"), (1, "new_description"), (2, "new_date_text"), (2, "new_start_text"), (2, "new_end_text"), (3, "new_location_id")]
    changes = acc.groupBy(F.col("event_id").alias("id")).agg(
        *[last(k, c) for k, c in texts], F.max(F.col("kind") == 2).alias("_timed")
    )
    date = F.coalesce("new_date_text", F.col("date").cast("string"))
    start = parse_date_time(date, F.coalesce("new_start_text", F.date_format("start_ts", "HH:mm:ss")))
    end = parse_date_time(date, F.coalesce("new_end_text", F.date_format("end_ts", "HH:mm:ss")))
    timed = F.coalesce("_timed", F.lit(False))
    after = events.join(changes, "id", "left").select(
        "id",
        F.coalesce("new_name", "name").alias("name"),
        F.coalesce("new_description", "description").alias("description"),
        F.when(timed, F.to_date(start)).otherwise(F.col("date")).alias("date"),
        F.when(timed, start).otherwise(F.col("start_ts")).alias("start_ts"),
        F.when(timed, end).otherwise(F.col("end_ts")).alias("end_ts"),
        F.coalesce("new_location_id", "location_id").alias("location_id"),
        "organizer_id", "status", "max_participants",
    )
    return {
        "decisions": d.select("request_id", "event_id", "kind", "accepted", "reason"),
        "events_after": after,
    }
