"""Stand-in domain tables derived from the driver's test tables.

These views only give rows in the domain schema (with planted flaws: unknown
ids, bad texts, duplicates, orphans). They do none of the operators' work,
and no operator relies on how they are made. The same derivations are written
in DuckDB SQL in ``oracle/views.py`` for the correctness check.

Notation: ``ev`` is ``floor(event_id / 20)``, the domain event an activity
row of the ``events`` test table is about.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campusflow.functions.expr import add_minutes

# "Now" of every fixture report: fixed, so results are deterministic.
AS_OF = datetime(1998, 6, 1, 12, 0, 0)

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)

E = F.expr


def _typed(text: Column, loose: int, odd: int) -> Column:
    """A datetime text as typed by some: every ``loose``-th without leading
    zeros and with two blanks, every ``odd``-th with a trailing blank."""
    short = F.regexp_replace(F.regexp_replace(text, "([- :])0", "$1"), " ", "  ")
    return F.when(E(f"event_id % {loose} = 0"), short).when(E(f"event_id % {odd} = 0"), F.concat(text, F.lit(" "))).otherwise(text)


class FixtureTables:
    """Lazily built domain tables over one scale-factor folder.

    Nothing is cached: a query that reads a table derives it from the test
    tables, so its work is all its own.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---------------------------------------------------------------- state
    @cached_property
    def venues(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("building"),
            (F.col("p_size") * 10).cast("int").alias("capacity"),
            E("case when p_partkey % 4 <> 3 then 1 else 0 end").cast("int").alias("is_available"),
        )

    @cached_property
    def hosts(self) -> DataFrame:
        s = self.raw("supplier")
        n = self.raw("nation")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            E("concat('h', cast(s_suppkey - s_suppkey % 7 as int), '@example.org')").alias("email"),
            E("case when s_suppkey % 3 = 0 then null else concat('555', cast(s_suppkey as int)) end").alias("phone"),
            F.col("n_name").alias("department"),
            E("case when s_suppkey % 2 = 0 then 'Professor' else 'Staff' end").alias("role"),
        )

    @cached_property
    def students(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("srn"),
            E("concat(c_mktsegment, ' ', cast(c_custkey as int))").alias("name"),
            E("cast(c_custkey % 10 as int)").alias("semester"),
            E("substr('ABCDEF', cast(c_custkey % 6 as int) + 1, 1)").alias("section"),
        )

    @cached_property
    def events(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("id"),
            E("concat('Event ', cast(o_orderkey % 300 as int))").alias("name"),
            F.col("o_orderpriority").alias("description"),
            F.col("o_orderdate").cast("date").alias("date"),
            add_minutes("o_orderdate", E("480 + (o_orderkey * 37) % 600")).alias("start_ts"),
            add_minutes("o_orderdate", E("510 + (o_orderkey * 37) % 600 + (o_orderkey * 53) % 180")).alias("end_ts"),
            E("case when o_orderkey % 50 = 0 then null else (o_orderkey * 7) % 40 end").alias("location_id"),
            E("case when o_orderkey % 97 = 0 then 999999999 else o_custkey % 10 end").cast("bigint").alias("organizer_id"),
            F.col("o_orderstatus").alias("status"),
            E("cast(20 + o_orderkey % 400 as int)").alias("max_participants"),
        )

    @cached_property
    def _li(self) -> DataFrame:
        # (l_orderkey, l_linenumber) is not unique in the test data: ``copy``
        # numbers the lines that share a pair, so that each has an id of its own.
        used = ("l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
        same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*used)
        return self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", *used, (F.row_number().over(same) - 1).alias("copy")
        ).withColumn("line_id", E("l_orderkey * 10 + l_linenumber + copy * 100000000000L"))

    @cached_property
    def tickets(self) -> DataFrame:
        return self._li.select(
            F.col("line_id").alias("id"),
            F.col("l_orderkey").alias("event_id"),
            F.col("l_returnflag").alias("ticket_type"),
            E("case when l_linenumber = 1 then 0.0 else l_extendedprice end").cast("double").alias("price"),
            E("cast(l_quantity as int) - 1").alias("quantity"),
        )

    @cached_property
    def tickets_unset(self) -> DataFrame:
        """The tickets, of which some have no stock set."""
        return self.tickets.withColumn("quantity", E("case when event_id % 11 = 3 and id % 10 = 5 then null else quantity end"))

    @cached_property
    def bookings(self) -> DataFrame:
        li = self._li.where("l_linenumber <> 7 or l_returnflag <> 'R'")
        start = add_minutes("l_shipdate", E("480 + (l_orderkey * 37 + l_linenumber * 11) % 600"))
        return li.select(
            F.col("line_id").alias("id"),
            F.col("l_orderkey").alias("event_id"),
            F.col("l_suppkey").alias("resource_id"),
            E("cast(l_quantity as int) % 5 + 1").alias("quantity_booked"),
            start.alias("booking_start"),
            add_minutes(start, E("30 + (l_orderkey * 53) % 2880")).alias("booking_end"),
        )

    @cached_property
    def maintenance(self) -> DataFrame:
        li = self._li.where("l_linenumber = 7 and l_returnflag = 'R'")
        return li.select(
            F.col("line_id").alias("id"),
            F.col("l_suppkey").alias("resource_id"),
            F.col("l_shipdate").alias("maintenance_start"),
            add_minutes("l_shipdate", E("60 + (l_orderkey * 53) % 4320")).alias("maintenance_end"),
            F.col("l_returnflag").alias("description"),
        )

    @cached_property
    def resources(self) -> DataFrame:
        status = E(
            "case when s_suppkey % 9 = 0 then 'Under Maintenance' "
            "when s_suppkey % 9 = 1 then 'AVAILABLE' else 'Available' end"
        )
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            E("case when s_suppkey % 2 = 0 then 'AV Equipment' else 'Furniture' end").alias("type"),
            E("cast(4 + s_suppkey % 5 as int)").alias("quantity"),
            E("concat('Resource ', cast(s_suppkey as int))").alias("description"),
            E("case when s_suppkey % 9 = 0 then 0 else 1 end").cast("int").alias("is_available"),
            status.alias("maintenance_status"),
        )

    @cached_property
    def _activity(self) -> DataFrame:
        """Activity rows with the domain event id and the (possibly orphaned) user id."""
        return self.raw("events").select(
            "*",
            E("cast(floor(event_id / 20) as bigint)").alias("ev"),
            E("case when event_id % 101 = 0 then user_id + 1000000000 else user_id end").alias("user_ref"),
        )

    @cached_property
    def participants(self) -> DataFrame:
        # A third of the pairs is not registered yet: their order requests can be.
        a = self._activity.where("event_type <> 'error' and (ev + user_ref) % 3 <> 0")
        first = Window.partitionBy("ev", "user_ref").orderBy("ts", "event_id")
        return (
            a.withColumn("_rn", F.row_number().over(first))
            .where("_rn = 1")
            .select(
                F.col("ev").alias("event_id"),
                F.col("user_ref").alias("user_id"),
                F.col("ts").alias("registration_time"),
                E(
                    "case when event_id % 13 = 0 then null when event_type in ('view', 'signup') then 0 else 1 end"
                ).cast("int").alias("attendance_status"),
            )
        )

    @cached_property
    def feedback(self) -> DataFrame:
        a = self._activity.where("event_type in ('view', 'click', 'signup')")
        return a.select(
            F.col("event_id").alias("id"),
            F.col("ev").alias("event_id"),
            F.col("user_id"),
            E("cast(floor(value) as int) % 6").alias("rating"),
            E("case when event_id % 3 = 0 then null else props end").alias("comments"),
            F.col("ts").alias("submitted_at"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        a = self._activity.where("event_type in ('purchase', 'click')")
        return a.select(
            F.col("event_id").alias("order_id"),
            E("ev * 10 + 1 + event_id % 7").alias("ticket_id"),
            F.col("user_id"),
            F.col("ts").alias("order_time"),
            E("case when event_type = 'purchase' then 'Completed' else 'Pending' end").alias("payment_status"),
        )

    # ------------------------------------------------------------- requests
    def _req(self, types: str) -> DataFrame:
        return self._activity.where(f"event_type in ({types})").withColumn("request_id", F.col("event_id")).withColumn(
            "request_ts", F.col("ts")
        )

    @cached_property
    def order_requests(self) -> DataFrame:
        once = self._activity.select(
            F.col("event_id").alias("request_id"),
            F.col("ts").alias("request_ts"),
            F.col("user_ref").alias("user_id"),
            F.col("ev").alias("event_id"),
            E("ev * 10 + 1 + event_id % 7").alias("ticket_id"),
            E("cast(case when event_id % 83 = 0 then 0 else 1 + event_id % 6 end as int)").alias("how_many"),
            E("case when event_type = 'error' then 0 else 1 end").cast("int").alias("paid"),
        )
        # Some buyers click twice.
        again = once.where("request_id % 5 = 0").withColumns({
            "request_id": E("request_id + 1000000000"), "request_ts": add_minutes("request_ts", F.lit(1)),
        })
        return once.unionByName(again)

    @cached_property
    def order_request_texts(self) -> DataFrame:
        """The order requests as typed: amounts and the paid answer as text."""
        return self.order_requests.withColumns({
            "how_many": E(
                "case when request_id % 43 = 0 then 'two' when request_id % 41 = 0 then '1.5' when request_id % 37 = 0 then '' "
                "when request_id % 31 = 0 then null when request_id % 29 = 0 then concat(' ', how_many, ' ') "
                "else cast(how_many as string) end"
            ),
            "paid": E("case when paid = 0 then 'n' when request_id % 3 = 0 then ' Y ' else 'y' end"),
        })

    @cached_property
    def cancel_requests(self) -> DataFrame:
        return self._req("'purchase'").select(
            "request_id", "request_ts",
            E("case when event_id % 89 = 0 then user_id + 500000000 else user_id end").alias("user_id"),
            F.col("ev").alias("event_id"),
        )

    @cached_property
    def event_requests(self) -> DataFrame:
        r = self._req("'signup'").withColumn("_sm", E("480 + (event_id * 37) % 600")).withColumn(
            "_em", E("case when event_id % 17 = 0 then _sm - 30 else _sm + 30 + (event_id * 53) % 180 end")
        )
        return r.select(
            "request_id",
            "request_ts",
            E("concat('Proposal ', cast(event_id as string))").alias("name"),
            F.col("props").alias("description"),
            E("cast(date_add(date'1998-06-01', cast(event_id % 30 as int)) as string)").alias("date_text"),
            E(
                "case when event_id % 53 = 0 then '25:61:00' else concat(lpad(cast(floor(_sm / 60) as int), 2, '0'), ':', "
                "lpad(cast(_sm % 60 as int), 2, '0'), ':00') end"
            ).alias("start_text"),
            E(
                "case when event_id % 31 = 0 then concat(' ', cast(floor(_em / 60) as int), ':', cast(_em % 60 as int), ':0') "
                "else concat(lpad(cast(floor(_em / 60) as int), 2, '0'), ':', lpad(cast(_em % 60 as int), 2, '0'), ':00') end"
            ).alias("end_text"),
            E("case when event_id % 29 = 0 then 999999999 else user_id % 10 end").cast("bigint").alias("organizer_id"),
            E("(user_id * 3 + event_id) % 40").alias("location_id"),
            E("cast(10 + (event_id * 13) % 500 as int)").alias("max_participants"),
        )

    @cached_property
    def event_update_requests(self) -> DataFrame:
        r = self._req("'click'").withColumn("_sm", E("480 + (event_id * 41) % 600")).withColumn(
            "_em", E("case when event_id % 19 = 0 then _sm else _sm + 30 + (event_id * 29) % 180 end")
        )
        hhmm = "concat(lpad(cast(floor({m} / 60) as int), 2, '0'), ':', lpad(cast({m} % 60 as int), 2, '0'), ':00')"
        return r.select(
            "request_id",
            "request_ts",
            E("case when event_id % 67 = 0 then ev + 1000000000 else ev end").alias("event_id"),
            E("cast(case when event_id % 61 = 0 then 9 else 1 + event_id % 3 end as int)").alias("kind"),
            E("case when event_id % 4 = 0 then '' else concat('Renamed ', cast(event_id as string)) end").alias("new_name"),
            E("case when event_id % 5 = 0 then '' else props end").alias("new_description"),
            E(
                "case when event_id % 6 = 0 then '' "
                "else cast(date_add(date'1998-06-01', cast(event_id % 30 as int)) as string) end"
            ).alias("new_date_text"),
            E(
                "case when event_id % 47 = 0 then 'noon' when event_id % 23 = 0 then "
                f"concat(cast(floor(_sm / 60) as int), ':', cast(_sm % 60 as int), ':0') else {hhmm.format(m='_sm')} end"
            ).alias("new_start_text"),
            E(hhmm.format(m="_em")).alias("new_end_text"),
            E("(user_id * 11) % 40").alias("new_location_id"),
        )

    @cached_property
    def booking_requests(self) -> DataFrame:
        r = self._req("'view'").withColumn(
            "_st", add_minutes(E("timestamp_ntz'1997-06-01 00:00:00'"), E("(event_id % 60) * 1440 + (event_id * 41) % 1440"))
        )
        end = F.when(F.expr("event_id % 19 = 0"), F.col("_st")).otherwise(add_minutes("_st", E("30 + (event_id * 53) % 2880")))
        return r.select(
            "request_id",
            "request_ts",
            E("case when event_id % 71 = 0 then ev + 1000000000 else ev end").alias("event_id"),
            F.col("user_id").alias("resource_id"),
            E("cast(floor(value) as int) % 9 - 1").alias("quantity"),
            _typed(F.col("_st").cast("string"), 37, 41).alias("start_text"),
            F.when(F.expr("event_id % 47 = 0"), F.lit("soon")).otherwise(end.cast("string")).alias("end_text"),
        )

    @cached_property
    def maintenance_requests(self) -> DataFrame:
        r = self._req("'error'").withColumn(
            "_st", add_minutes(E("timestamp_ntz'1997-06-01 00:00:00'"), E("(event_id % 60) * 1440 + (event_id * 29) % 1440"))
        )
        end = F.when(F.expr("event_id % 23 = 0"), add_minutes("_st", F.lit(-60))).otherwise(
            add_minutes("_st", E("60 + (event_id * 31) % 4320"))
        )
        return r.select(
            "request_id",
            "request_ts",
            F.col("user_id").alias("resource_id"),
            F.when(F.expr("event_id % 59 = 0"), F.lit("1997-13-45 00:00:00")).otherwise(
                _typed(F.col("_st").cast("string"), 37, 41)
            ).alias("start_text"),
            end.cast("string").alias("end_text"),
            F.col("props").alias("description"),
        )

    @cached_property
    def ticket_requests(self) -> DataFrame:
        r = self._req("'click'")
        return r.select(
            "request_id",
            "request_ts",
            E("case when event_id % 4 = 0 then 1 else 2 end").cast("int").alias("kind"),
            F.col("ev").alias("event_id"),
            E(
                "case when event_id % 4 = 0 then null when event_id % 13 = 0 then (ev + 1) * 10 + 1 "
                "else ev * 10 + 1 + event_id % 8 end"
            ).alias("ticket_id"),
            E("case when event_id % 4 = 0 then 'Early Bird' else null end").alias("ticket_type"),
            E("case when event_id % 4 = 0 then value else null end").cast("double").alias("price"),
            E("case when event_id % 4 = 0 then cast(floor(value) as int) % 50 else null end").cast("int").alias("quantity"),
            E("case when event_id % 3 = 0 then null when event_id % 3 = 1 then value else -1.0 end").cast("double").alias(
                "new_price"
            ),
            E("case when event_id % 5 = 0 then null else cast(floor(value) as int) % 60 - 5 end").cast("int").alias(
                "new_quantity"
            ),
        )

    @cached_property
    def attendance_requests(self) -> DataFrame:
        return self._req("'view'").select(
            "request_id", "request_ts", E("case when event_id % 53 = 0 then ev + 1000 else ev end").alias("event_id"), "user_id"
        )

    @cached_property
    def venue_flag_requests(self) -> DataFrame:
        return self._req("'purchase'").select(
            "request_id",
            "request_ts",
            E("user_id * 20").alias("venue_id"),
            E("cast(event_id % 3 as int)").alias("new_status"),
        )

    @cached_property
    def resource_status_requests(self) -> DataFrame:
        return self._req("'click'").select(
            "request_id",
            "request_ts",
            F.col("user_id").alias("resource_id"),
            E(
                "case event_id % 5 when 0 then 'Available' when 1 then 'available' when 2 then 'Under Maintenance' "
                "when 3 then 'Damaged' else 'AVAILABLE ' end"
            ).alias("new_status"),
        )

    @cached_property
    def student_requests(self) -> DataFrame:
        return self._req("'signup'").select(
            "request_id",
            "request_ts",
            E(
                "case when event_id % 9 = 0 then concat('Customer#', lpad(cast(user_id as string), 9, '0')) "
                "else concat('SRN', cast((event_id * 7) % 1000 as string)) end"
            ).alias("srn"),
            E("concat('Student ', cast(event_id as string))").alias("name"),
            E("cast(event_id % 10 as int)").alias("semester"),
            F.lit("A").alias("section"),
        )

    @cached_property
    def host_requests(self) -> DataFrame:
        return self._req("'error'").select(
            "request_id",
            "request_ts",
            E("concat('Host ', cast(event_id as string))").alias("name"),
            E("concat('h', cast(user_id % 30 as string), '@example.org')").alias("email"),
            E("case when event_id % 4 = 0 then '' else concat('555', cast(user_id % 50 + 90 as string)) end").alias("phone"),
            E("case when event_id % 2 = 0 then 'Professor' else 'Staff' end").alias("role"),
            E("case when event_id % 5 = 0 then '' else 'CSE' end").alias("department"),
        )

    @cached_property
    def resource_requests(self) -> DataFrame:
        return self._req("'signup'").select(
            "request_id",
            "request_ts",
            E("concat('Projector ', cast(event_id as string))").alias("name"),
            F.lit("AV Equipment").alias("type"),
            E("cast(floor(value) as int) % 12 - 2").alias("quantity"),
            F.col("props").alias("description"),
        )

    @cached_property
    def feedback_requests(self) -> DataFrame:
        return self._req("'purchase', 'click'").select(
            "request_id",
            "request_ts",
            "user_id",
            F.col("ev").alias("event_id"),
            E("cast(floor(value) as int) % 7").alias("rating"),
            E("case when event_id % 4 = 0 then '' else props end").alias("comments"),
        )

    def as_dict(self) -> dict[str, DataFrame]:
        names = (
            "venues hosts students events tickets bookings maintenance resources participants feedback orders"
        ).split()
        return {n: getattr(self, n) for n in names}


def fixture_tables(spark: SparkSession, sf_dir: str) -> FixtureTables:
    return FixtureTables(spark, sf_dir)
