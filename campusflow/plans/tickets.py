"""Ticket management: new ticket types and price/stock changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions.expr import first_reason
from campusflow.plans.common import decide, last_value_per_key


def apply_ticket_changes(tickets: DataFrame, requests: DataFrame, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """Kind 1 adds a ticket type (no sign checks; with ``events`` given, a type
    for an unknown event is UNKNOWN_EVENT, the insert's reference). Kind 2 sets the price and/or
    the stock of a ticket of the event: a missing or negative value keeps the
    old one, and a request with neither is NO_CHANGE. A change naming a
    ticket of another event matches nothing (``matched`` is false), as an
    UPDATE with both ids would.

    Per ticket and field, the last applicable request wins (``max_by``).
    New tickets (``tickets_delta``) are identified by their request id.
    """
    own = tickets.select(F.col("id").alias("ticket_id"), F.col("event_id").alias("_t_event"))
    r = requests.join(own, "ticket_id", "left")
    if events is not None:
        r = r.join(events.select(F.col("id").alias("event_id"), F.lit(True).alias("_event")), "event_id", "left")
    else:
        r = r.withColumn("_event", F.lit(True))
    price_ok = F.col("new_price").isNotNull() & (F.col("new_price") >= 0)
    qty_ok = F.col("new_quantity").isNotNull() & (F.col("new_quantity") >= 0)
    reason = first_reason([
        (~F.col("kind").isin(1, 2) | F.col("kind").isNull(), "INVALID_CHOICE"),
        ((F.col("kind") == 2) & ~price_ok & ~qty_ok, "NO_CHANGE"),
        ((F.col("kind") == 1) & F.col("_event").isNull(), "UNKNOWN_EVENT"),
    ])
    matched = F.when(F.col("kind") == 2, F.coalesce(F.col("_t_event") == F.col("event_id"), F.lit(False)))
    d = decide(r.withColumn("matched", matched), reason, "request_id", "request_ts", "kind", "event_id", "ticket_id",
               "ticket_type", "price", "quantity", "new_price", "new_quantity", "matched")
    updates = d.where(F.col("accepted") & (F.col("kind") == 2) & F.col("matched"))
    new_price = last_value_per_key(updates, ["ticket_id"], "new_price", price_ok)
    new_qty = last_value_per_key(updates, ["ticket_id"], "new_quantity", qty_ok)
    changed = tickets.withColumnRenamed("id", "ticket_id").join(new_price, "ticket_id", "left").join(
        new_qty, "ticket_id", "left"
    ).select(
        F.col("ticket_id").alias("id"), "event_id", "ticket_type",
        F.coalesce("new_price", "price").alias("price"),
        F.coalesce("new_quantity", "quantity").alias("quantity"),
    )
    added = d.where(F.col("accepted") & (F.col("kind") == 1)).select(
        "request_id", "event_id", "ticket_type", "price", "quantity"
    )
    return {
        "decisions": d.select("request_id", "kind", "ticket_id", "matched", "accepted", "reason"),
        "tickets_after": changed,
        "tickets_delta": added,
    }
