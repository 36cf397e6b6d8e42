"""Streams of request files, decided micro-batch by micro-batch against evolving state.

The application takes one request after another in a loop; here requests
arrive as files and each micro-batch is decided with a batch flow of
``campusflow.plans`` against the state the previous micro-batch left.

State versions: micro-batch ``k`` reads each evolving table at version
``k - 1`` (version ``-1`` is the initial state given by the caller) and
writes version ``k`` plus its outputs under paths keyed by ``k``, in
overwrite mode. A micro-batch replayed after a failure therefore rewrites
exactly its own outputs, and the stream's checkpoint (``checkpointLocation``)
records which files each micro-batch took.

A table that only grows (registrations, bookings) is kept as a base plus the
rows each micro-batch added; every COMPACT micro-batches a new base is written.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from campusflow.plans.bookings import apply_bookings
from campusflow.plans.orders import apply_cancellations, apply_orders
from campusflow.sources.tables import REQUEST_SCHEMAS, STATE_SCHEMAS

State = dict[str, DataFrame]
# step(state, batch) -> (outputs to keep per micro-batch, new versions of the evolving tables;
# for a table of ``growing`` the rows added)
Step = Callable[[State, DataFrame], tuple[dict[str, DataFrame], State]]

#: Micro-batches after which a growing table's base is written anew.
COMPACT = 50


def state_path(state_dir: str, table: str, version: int) -> str:
    return f"{state_dir.rstrip('/')}/{table}/v={version}"


def grown(
    spark: SparkSession, state_dir: str, table: str, batch_id: int, first: DataFrame, compacted: int | None = None
) -> DataFrame:
    """A growing table as micro-batch ``batch_id`` finds it: the last base
    (``first`` before any was written; ``compacted`` is being written now and
    does not count) and the rows added since."""
    schema = STATE_SCHEMAS[table]
    base = batch_id // COMPACT * COMPACT - 1
    if base == compacted:
        base -= COMPACT
    rows = spark.read.schema(schema).parquet(state_path(state_dir, table, base)) if base >= 0 else first
    added = [state_path(state_dir, f"{table}_added", v) for v in range(base + 1, batch_id)]
    return rows.unionByName(spark.read.schema(schema).parquet(*added)) if added else rows


def start_request_stream(
    spark: SparkSession,
    request_kind: str,
    request_dir: str,
    state_dir: str,
    checkpoint_location: str,
    initial: Callable[[], State],
    evolving: tuple[str, ...],
    step: Step,
    files_per_batch: int = 1,
    available_now: bool = True,
    growing: tuple[str, ...] = (),
) -> StreamingQuery:
    """Start a stream of ``request_kind`` files; ``evolving`` names the state
    tables that ``step`` returns new versions of, ``growing`` those that it
    returns added rows of."""
    requests = (
        spark.readStream.schema(REQUEST_SCHEMAS[request_kind])
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(request_dir)
    )

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        state = dict(initial())
        if batch_id > 0:
            for table in evolving:
                state[table] = spark.read.schema(STATE_SCHEMAS[table]).parquet(
                    state_path(state_dir, table, batch_id - 1)
                )
        for table in growing:
            state[table] = grown(spark, state_dir, table, batch_id, state[table])
        outputs, new_state = step(state, batch)
        for name, df in outputs.items():
            df.write.mode("overwrite").parquet(state_path(state_dir, name, batch_id))
        for table in evolving:
            new_state[table].select(*STATE_SCHEMAS[table].fieldNames()).write.mode("overwrite").parquet(
                state_path(state_dir, table, batch_id)
            )
        for table in growing:
            added = new_state[table].select(*STATE_SCHEMAS[table].fieldNames())
            added.write.mode("overwrite").parquet(state_path(state_dir, f"{table}_added", batch_id))
            if (batch_id + 1) % COMPACT == 0:
                whole = grown(spark, state_dir, table, batch_id + 1, initial()[table], compacted=batch_id)
                whole.write.mode("overwrite").parquet(state_path(state_dir, table, batch_id))

    writer = requests.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def order_step(as_of: datetime | None) -> Step:
    """Orders: tickets (stock) and participants (registrations) evolve."""

    def step(state: State, batch: DataFrame) -> tuple[dict[str, DataFrame], State]:
        out = apply_orders(state["tickets"], state["participants"], state["students"], state["events"],
                           state["venues"], state["hosts"], batch, as_of)
        return (
            {"decisions": out["decisions"], "orders_delta": out["orders_delta"]},
            {"tickets": out["tickets_after"], "participants": out["participants_delta"]},
        )

    return step


def booking_step(as_of: datetime | None) -> Step:
    """Bookings: the bookings table evolves (a new booking is identified by its request id)."""

    def step(state: State, batch: DataFrame) -> tuple[dict[str, DataFrame], State]:
        out = apply_bookings(state["events"], state["venues"], state["hosts"], state["resources"], state["bookings"],
                             state["maintenance"], batch, as_of)
        added = out["bookings_delta"].withColumnRenamed("request_id", "id")
        return {"decisions": out["decisions"]}, {"bookings": added}

    return step


def cancel_step(as_of: datetime | None) -> Step:
    """Cancellations: registrations, ticket stock (refunds) and orders evolve."""

    def step(state: State, batch: DataFrame) -> tuple[dict[str, DataFrame], State]:
        out = apply_cancellations(state["participants"], state["events"], state["tickets"], state["orders"], batch,
                                  as_of)
        removed = out["orders_removed"].select("order_id")
        return (
            {"decisions": out["decisions"], "refunds_by_ticket": out["refunds_by_ticket"]},
            {"participants": out["participants_after"], "tickets": out["tickets_after"],
             "orders": state["orders"].join(removed, "order_id", "left_anti")},
        )

    return step


def start_cancel_stream(
    spark: SparkSession, request_dir: str, state_dir: str, checkpoint_location: str,
    initial: Callable[[], State], as_of: datetime | None = None, files_per_batch: int = 1,
    available_now: bool = True,
) -> StreamingQuery:
    return start_request_stream(spark, "cancel_requests", request_dir, state_dir, checkpoint_location, initial,
                                ("participants", "tickets", "orders"), cancel_step(as_of), files_per_batch,
                                available_now)


def start_order_stream(
    spark: SparkSession, request_dir: str, state_dir: str, checkpoint_location: str,
    initial: Callable[[], State], as_of: datetime | None = None, files_per_batch: int = 1,
    available_now: bool = True,
) -> StreamingQuery:
    return start_request_stream(spark, "order_requests", request_dir, state_dir, checkpoint_location, initial,
                                ("tickets",), order_step(as_of), files_per_batch, available_now,
                                growing=("participants",))


def start_booking_stream(
    spark: SparkSession, request_dir: str, state_dir: str, checkpoint_location: str,
    initial: Callable[[], State], as_of: datetime | None = None, files_per_batch: int = 1,
    available_now: bool = True,
) -> StreamingQuery:
    return start_request_stream(spark, "booking_requests", request_dir, state_dir, checkpoint_location, initial,
                                (), booking_step(as_of), files_per_batch, available_now, growing=("bookings",))


def read_decisions(spark: SparkSession, state_dir: str) -> DataFrame:
    """All decisions written so far, with the micro-batch id as column ``v``."""
    return spark.read.parquet(f"{state_dir.rstrip('/')}/decisions").withColumn("v", F.col("v").cast("int"))
