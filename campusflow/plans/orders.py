"""Ticket orders (buy and register) and cancellations.

Orders are order-dependent: "take the tickets if they still fit, else
refuse" is not a running sum, since a refused request frees its amount for
later ones. No per-event fold is used (a hot event would gather in one
task); instead ``apply_orders`` decides a batch in rounds of grouped passes:

* a request is accepted when it fits under what earlier requests of its ticket
  have taken plus the most that earlier undecided ones can still take, and no
  earlier completed request of its (event, student) pair is undecided;
* it is refused when it does not fit under what earlier ones have taken alone,
  or its pair is registered by an earlier one.

Of the completed requests of one pair at most one is accepted, so repeats of a
request (a double click) count only by what they exceed the first one: all
first clicks of a sale are decided in the first round, their repeats in the
second. The globally earliest undecided request is always decided, so rounds
end. Demand per ticket is a split running sum (``running_sums``), so a hot
ticket or event is spread over many tasks. A round reads the undecided requests
and those accepted in the round before, and is checkpointed once.
"""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.functions.expr import PAYMENT_COMPLETED, first_reason, payment_status
from campusflow.operators.prefix import running_sums
from campusflow.operators.reports import any_upcoming
from campusflow.operators.rules import lowest_ticket
from campusflow.plans.common import EMPTY_LIST, checkpoint, decide, nonempty, order_key, order_ranges

PAIR = ["event_id", "user_id"]
ORDER = ["request_ts", "request_id"]
_log = logging.getLogger(__name__)


def _ticket_lookup(tickets: DataFrame) -> DataFrame:
    return tickets.select(
        F.col("id").alias("ticket_id"), F.col("event_id").alias("_t_event"), F.col("price").alias("_price"),
        F.col("quantity").alias("_q0"),
    )


def order_payment_status(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    """Price and payment state of each order request for a ticket of its event:
    free orders complete at once, paid ones when marked paid, else pending."""
    r = requests.join(_ticket_lookup(tickets), "ticket_id", "inner").where(F.col("_t_event") == F.col("event_id"))
    total = F.col("_price") * F.col("how_many")
    return r.select(
        "request_id", total.alias("total_price"), payment_status(total, "paid").alias("payment_status")
    )


def order_total_text(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    """The total that the payment dialogue shows for each order request for a
    ticket of its event and a given number: dollars with two decimals."""
    r = requests.join(_ticket_lookup(tickets), "ticket_id", "inner").where(F.col("_t_event") == F.col("event_id"))
    total = F.col("_price") * F.col("how_many")
    return r.where(F.col("how_many").isNotNull()).select("request_id", F.when(total.isNotNull(), F.format_string("$%.2f", total)).alias("total"))


def apply_orders(
    tickets: DataFrame, participants: DataFrame, students: DataFrame, events: DataFrame, venues: DataFrame,
    hosts: DataFrame, requests: DataFrame, as_of: datetime | None = None, max_rounds: int | None = None,
) -> dict[str, DataFrame]:
    """Decide order requests in batch order ``(request_ts, request_id)``.

    Checks, in the application's order, against the state when the request
    comes: EMPTY_LIST (no upcoming event at all) → NO_TICKETS (the event has
    no ticket with stock left) → INVALID_TICKET (the ticket is not one of
    those) → NON_POSITIVE → OVER_QUANTITY → EMPTY_LIST (no students) →
    UNKNOWN_STUDENT → ALREADY_REGISTERED (a completed payment for an
    (event, student) pair that is already registered). The event is not
    checked to be upcoming, nor ``max_participants``.

    An accepted request takes ``how_many`` from the ticket's stock, writes
    ``how_many`` order rows, and, when its payment is completed, one
    registration. A pending order takes stock and may repeat.
    ``max_rounds`` is for tests only.
    """
    # The tickets are read by several steps below: derive them once.
    tickets = checkpoint(tickets)
    gate_events = nonempty(any_upcoming(events, hosts, as_of))
    gate_students = nonempty(students)
    known = students.select(F.col("id").alias("user_id"), F.lit(True).alias("_student"))
    reg0 = participants.groupBy(*PAIR).agg(F.lit(True).alias("_reg0"))
    r = (
        requests.join(_ticket_lookup(tickets), "ticket_id", "left")
        .join(known, "user_id", "left")
        .join(reg0, PAIR, "left")
        .withColumn("_ord", order_key())
        .withColumn("_own", F.coalesce(F.col("_t_event") == F.col("event_id"), F.lit(False)))
        .withColumn("_pay", payment_status(F.col("_price") * F.col("how_many"), "paid"))
        .withColumn("_completed", F.col("_pay") == PAYMENT_COMPLETED)
        .withColumn("_gate_e", gate_events)
        .withColumn("_gate_s", gate_students)
        .withColumn("_gates", F.col("_gate_e") & F.col("_gate_s"))
    )
    r = order_ranges(r, ["ticket_id"], ORDER)
    _log.info("order admission: requests joined with state")
    # Refused whatever the state: stock never grows, the gates and student list do not change.
    never = (
        ~F.col("_gates") | ~F.col("_own") | F.col("how_many").isNull() | (F.col("how_many") <= 0)
        | ~F.coalesce(F.col("how_many") <= F.col("_q0"), F.lit(False)) | F.col("_student").isNull()
        | (F.col("_completed") & F.col("_reg0").isNotNull())
    )
    und = r.where(~never).select("request_id", "request_ts", "_ord", "ticket_id", "event_id", "user_id", "how_many",
                                 "_completed", "_blk")
    und = und.join(tickets.select(F.col("id").alias("ticket_id"), F.col("quantity").alias("_left")), "ticket_id")
    und = und.withColumn("_new", F.lit(False))
    took_parts: list[DataFrame] = []

    rounds = 0
    while not und.where("not _new").isEmpty():
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError("order admission did not settle")
        _log.info("order admission round %d", rounds)
        # ``_left`` is the stock that requests accepted up to the round before last left;
        # ``_new`` marks those accepted in the last round.
        done = und.where("_completed")
        pair = done.groupBy(*PAIR).agg(
            F.min(F.when(F.col("_new"), F.col("_ord"))).alias("_reg_at"),
            F.min(F.when(~F.col("_new"), F.col("_ord"))).alias("_open_at"),
        )
        first = done.where("not _new").groupBy("ticket_id", *PAIR).agg(
            F.min(F.struct("_ord", F.col("how_many").alias("n"))).alias("_first")
        )
        repeat = F.col("_completed") & (F.col("_ord") > F.col("_first._ord"))
        counts = (
            F.when(F.col("_new") | (F.col("_completed") & (F.col("_reg_at") < F.col("_ord"))), F.lit(0))
            .when(repeat, F.greatest(F.col("how_many") - F.col("_first.n"), F.lit(0)))
            .otherwise(F.col("how_many"))
        )
        u = und.join(pair, PAIR, "left").join(first, ["ticket_id", *PAIR], "left")
        u = running_sums(
            u.withColumn("_counts", counts).withColumn("_takes", F.when(F.col("_new"), F.col("how_many")).otherwise(0)),
            ["ticket_id"], "_blk", ORDER, {"_may": "_counts", "_took": "_takes"}, inclusive=False,
        )
        free = F.col("_left") - F.col("_took")
        registered = F.col("_completed") & F.coalesce(F.col("_reg_at") < F.col("_ord"), F.lit(False))
        waits = F.col("_completed") & F.coalesce(F.col("_open_at") < F.col("_ord"), F.lit(False))
        take = ~F.col("_new") & ~registered & ~waits & (F.col("how_many") <= free - F.col("_may"))
        refuse = ~F.col("_new") & (registered | (F.col("how_many") > free))
        columns = [c for c in und.columns if c not in ("_left", "_new")]
        u = checkpoint(u.select(*columns, free.alias("_left"), "_new", take.alias("_take"), refuse.alias("_refuse")))
        took_parts.append(u.where("_take").select("request_id"))
        und = u.where("not _new and not _refuse").select(*columns, "_left", F.col("_take").alias("_new"))

    accepted = took_parts[0] if took_parts else und.select("request_id")
    for part in took_parts[1:]:
        accepted = accepted.unionByName(part)
    acc = r.join(accepted.withColumn("_acc", F.lit(True)), "request_id", "left").withColumn(
        "_acc", F.coalesce(F.col("_acc"), F.lit(False))
    )
    _log.info("order admission: %d rounds", rounds)
    # Four outputs derive from the decisions: materialize them once.
    decisions = checkpoint(_reasons(acc, tickets))
    return _order_effects(decisions, tickets)


def _reasons(r: DataFrame, tickets: DataFrame) -> DataFrame:
    """Reason of each request from the state when it came (acceptance known)."""
    # Stock of the request's own ticket just before it: initial minus earlier accepted takes.
    own = r.where(F.col("_own"))
    own = running_sums(
        own, ["ticket_id"], "_blk", ORDER,
        {"_taken_before": F.when(F.col("_acc"), F.col("how_many")).otherwise(0)}, inclusive=False,
    ).withColumn("_stock_at", F.col("_q0") - F.col("_taken_before"))
    own = checkpoint(own.select(
        "request_id", "event_id", "ticket_id", "_ord", "_stock_at",
        (F.col("_acc") & (F.col("_stock_at") - F.col("how_many") == 0)).alias("_sells_out"),
    ))
    # An event has no ticket left once every ticket that started on sale has
    # sold out: per event, the moment of its last sell-out if all did (a
    # grouped pass over the few sell-out rows, no window over the event).
    on_sale0 = tickets.where(F.col("quantity") > 0).groupBy("event_id").agg(F.count(F.lit(1)).alias("_on_sale0"))
    sold = own.where("_sells_out").groupBy("event_id").agg(
        F.count(F.lit(1)).alias("_n_sold"), F.max("_ord").alias("_last_sold")
    )
    ev = on_sale0.join(sold, "event_id", "left").select(
        "event_id", "_on_sale0",
        F.when(F.col("_n_sold") == F.col("_on_sale0"), F.col("_last_sold")).alias("_all_sold_at"),
    )
    r = r.join(own.select("request_id", "_stock_at"), "request_id", "left").join(ev, "event_id", "left")
    no_tickets = F.col("_on_sale0").isNull() | (F.col("_all_sold_at") < F.col("_ord"))
    first_reg = r.where(F.col("_acc") & F.col("_completed")).groupBy(*PAIR).agg(F.min("_ord").alias("_reg_at"))
    r = r.join(first_reg, PAIR, "left")
    reason = first_reason([
        (~F.col("_gate_e"), EMPTY_LIST),
        (no_tickets, "NO_TICKETS"),
        (~F.col("_own") | ~F.coalesce(F.col("_stock_at") > 0, F.lit(False)), "INVALID_TICKET"),
        (F.col("how_many").isNull() | (F.col("how_many") <= 0), "NON_POSITIVE"),
        (F.col("how_many") > F.col("_stock_at"), "OVER_QUANTITY"),
        (~F.col("_gate_s"), EMPTY_LIST),
        (F.col("_student").isNull(), "UNKNOWN_STUDENT"),
        (F.col("_completed") & (F.col("_reg0").isNotNull() | (F.col("_reg_at") < F.col("_ord"))), "ALREADY_REGISTERED"),
    ])
    return r.select(
        "request_id", "request_ts", "event_id", "ticket_id", "user_id", "how_many", F.col("_pay").alias("payment_status"),
        F.col("_price").alias("price"), F.col("_acc").alias("accepted"), reason.alias("reason"),
    )


def _order_effects(d: DataFrame, tickets: DataFrame) -> dict[str, DataFrame]:
    acc = d.where("accepted")
    used = acc.groupBy("ticket_id").agg(F.sum("how_many").alias("_used"))
    stock_after = tickets.join(used.withColumnRenamed("ticket_id", "id"), "id", "left").select(
        "id", "event_id", "ticket_type", "price",
        (F.col("quantity") - F.coalesce(F.col("_used"), F.lit(0))).cast("int").alias("quantity"),
    )
    orders_delta = acc.select(
        "request_id", "ticket_id", "user_id", F.col("request_ts").alias("order_time"), "payment_status",
        F.explode(F.sequence(F.lit(1), F.col("how_many"))).alias("seq"),
    )
    participants_delta = acc.where(F.col("payment_status") == PAYMENT_COMPLETED).select(
        "event_id", "user_id", F.col("request_ts").alias("registration_time"),
        F.lit(None).cast("int").alias("attendance_status"),
    )
    return {
        "decisions": d.select("request_id", "event_id", "ticket_id", "user_id", "how_many", "payment_status",
                              "accepted", "reason"),
        "tickets_after": stock_after,
        "orders_delta": orders_delta,
        "participants_delta": participants_delta,
    }


def apply_cancellations(
    participants: DataFrame, events: DataFrame, tickets: DataFrame, orders: DataFrame, requests: DataFrame,
    as_of: datetime | None = None,
) -> dict[str, DataFrame]:
    """Cancel registrations in batch order.

    Checks: NO_UPCOMING (the student has no upcoming registration left) →
    NOT_REGISTERED. Effect: the registration is deleted, all of the student's
    orders for the event's tickets are deleted, and one ticket goes back to
    the event's lowest ticket id (nothing if the event has no tickets).

    Only the first request per (event, student) can succeed; the gate is the
    student's initial number of upcoming registrations minus the upcoming
    ones cancelled by earlier requests — a split running count per student.
    """
    now = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.localtimestamp()
    up_events = events.where(F.col("end_ts") > now).select(F.col("id").alias("event_id"), F.lit(True).alias("_up"))
    u0 = participants.join(up_events, "event_id", "inner").groupBy("user_id").agg(F.count(F.lit(1)).alias("_u0"))
    reg = participants.groupBy(*PAIR).agg(F.lit(True).alias("_reg"))
    first_req = requests.withColumn("_ord", order_key()).groupBy(*PAIR).agg(F.min("_ord").alias("_first"))
    r = (
        requests.withColumn("_ord", order_key())
        .join(reg, PAIR, "left").join(first_req, PAIR, "left").join(up_events, "event_id", "left")
        .join(u0, "user_id", "left")
        .withColumn("_cand", F.col("_reg").isNotNull() & (F.col("_ord") == F.col("_first")))
    )
    r = running_sums(
        order_ranges(r, ["user_id"], ORDER), ["user_id"], "_blk", ORDER,
        {"_up_before": (F.col("_cand") & F.col("_up").isNotNull()).cast("long")}, inclusive=False,
    )
    reason = first_reason([
        (F.coalesce(F.col("_u0"), F.lit(0)) - F.col("_up_before") <= 0, "NO_UPCOMING"),
        (~F.col("_cand"), "NOT_REGISTERED"),
    ])
    # Five outputs derive from the decisions: materialize them once.
    d = checkpoint(decide(r, reason, "request_id", "user_id", "event_id"))
    done = d.where("accepted").select(*PAIR)
    participants_after = participants.join(done, PAIR, "left_anti")
    ticket_event = tickets.select(F.col("id").alias("ticket_id"), "event_id")
    orders_removed = orders.join(ticket_event, "ticket_id", "inner").join(done, PAIR, "left_semi").drop("event_id")
    refunds = (
        done.groupBy("event_id").agg(F.count(F.lit(1)).alias("refund"))
        .join(lowest_ticket(tickets), "event_id", "inner")
        .select("ticket_id", "event_id", "refund")
    )
    tickets_after = tickets.join(refunds.select(F.col("ticket_id").alias("id"), "refund"), "id", "left").select(
        "id", "event_id", "ticket_type", "price",
        (F.col("quantity") + F.coalesce(F.col("refund"), F.lit(0))).cast("int").alias("quantity"),
    )
    return {
        "decisions": d,
        "participants_after": participants_after,
        "orders_removed": orders_removed,
        "refunds_by_ticket": refunds,
        "tickets_after": tickets_after,
    }
