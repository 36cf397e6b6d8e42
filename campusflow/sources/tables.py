"""Domain schemas, table readers and sinks.

The data model has eleven state tables (students, hosts, venues, events,
tickets, orders, participants, feedback, resources, maintenance, bookings)
and one request table per kind of change. Times of day are folded into
``start_ts``/``end_ts`` TIMESTAMP_NTZ columns at load, since Spark has no
TIME type by default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusflow.functions.expr import is_yes, parse_date_time

_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
_TS, _DT, _B = T.TimestampNTZType(), T.DateType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


STATE_SCHEMAS: dict[str, T.StructType] = {
    "students": _schema(("id", _L), ("srn", _S), ("name", _S), ("semester", _I), ("section", _S)),
    "hosts": _schema(("id", _L), ("name", _S), ("email", _S), ("phone", _S), ("department", _S), ("role", _S)),
    "venues": _schema(("id", _L), ("name", _S), ("building", _S), ("capacity", _I), ("is_available", _I)),
    "events": _schema(
        ("id", _L), ("name", _S), ("description", _S), ("date", _DT), ("start_ts", _TS), ("end_ts", _TS),
        ("location_id", _L), ("organizer_id", _L), ("status", _S), ("max_participants", _I),
    ),
    "tickets": _schema(("id", _L), ("event_id", _L), ("ticket_type", _S), ("price", _D), ("quantity", _I)),
    "orders": _schema(
        ("order_id", _L), ("ticket_id", _L), ("user_id", _L), ("order_time", _TS), ("payment_status", _S)
    ),
    "participants": _schema(
        ("event_id", _L), ("user_id", _L), ("registration_time", _TS), ("attendance_status", _I)
    ),
    "feedback": _schema(
        ("id", _L), ("event_id", _L), ("user_id", _L), ("rating", _I), ("comments", _S), ("submitted_at", _TS)
    ),
    "resources": _schema(
        ("id", _L), ("name", _S), ("type", _S), ("quantity", _I), ("description", _S),
        ("is_available", _I), ("maintenance_status", _S),
    ),
    "maintenance": _schema(
        ("id", _L), ("resource_id", _L), ("maintenance_start", _TS), ("maintenance_end", _TS), ("description", _S)
    ),
    "bookings": _schema(
        ("id", _L), ("event_id", _L), ("resource_id", _L), ("quantity_booked", _I),
        ("booking_start", _TS), ("booking_end", _TS),
    ),
}

# Every request row carries request_id and request_ts; the processing order of
# a batch is (request_ts, request_id).
_REQ = (("request_id", _L), ("request_ts", _TS))
REQUEST_SCHEMAS: dict[str, T.StructType] = {
    "order_requests": _schema(*_REQ, ("user_id", _L), ("event_id", _L), ("ticket_id", _L), ("how_many", _I), ("paid", _I)),
    "cancel_requests": _schema(*_REQ, ("user_id", _L), ("event_id", _L)),
    "event_requests": _schema(
        *_REQ, ("name", _S), ("description", _S), ("date_text", _S), ("start_text", _S), ("end_text", _S),
        ("organizer_id", _L), ("location_id", _L), ("max_participants", _I),
    ),
    "event_update_requests": _schema(
        *_REQ, ("event_id", _L), ("kind", _I), ("new_name", _S), ("new_description", _S), ("new_date_text", _S),
        ("new_start_text", _S), ("new_end_text", _S), ("new_location_id", _L),
    ),
    "booking_requests": _schema(
        *_REQ, ("event_id", _L), ("resource_id", _L), ("quantity", _I), ("start_text", _S), ("end_text", _S)
    ),
    "maintenance_requests": _schema(*_REQ, ("resource_id", _L), ("start_text", _S), ("end_text", _S), ("description", _S)),
    "ticket_requests": _schema(
        *_REQ, ("kind", _I), ("event_id", _L), ("ticket_id", _L), ("ticket_type", _S), ("price", _D),
        ("quantity", _I), ("new_price", _D), ("new_quantity", _I),
    ),
    "attendance_requests": _schema(*_REQ, ("event_id", _L), ("user_id", _L)),
    "venue_flag_requests": _schema(*_REQ, ("venue_id", _L), ("new_status", _I)),
    "resource_status_requests": _schema(*_REQ, ("resource_id", _L), ("new_status", _S)),
    "student_requests": _schema(*_REQ, ("srn", _S), ("name", _S), ("semester", _I), ("section", _S)),
    "host_requests": _schema(*_REQ, ("name", _S), ("email", _S), ("phone", _S), ("role", _S), ("department", _S)),
    "resource_requests": _schema(*_REQ, ("name", _S), ("type", _S), ("quantity", _I), ("description", _S)),
    "feedback_requests": _schema(*_REQ, ("user_id", _L), ("event_id", _L), ("rating", _I), ("comments", _S)),
}


def schema_of(name: str) -> T.StructType:
    return STATE_SCHEMAS.get(name) or REQUEST_SCHEMAS[name]


def shaped(name: str, df: DataFrame) -> DataFrame:
    """``df`` with the columns that its application shape lacks: an event's
    start and end built from its date and times, as the application stores
    them. A declared column that is then still absent is an error."""
    if name == "events" and "start_ts" not in df.columns and {"date", "start_time", "end_time"} <= set(df.columns):
        day = F.col("date").cast("string")
        df = df.withColumns({
            "start_ts": parse_date_time(day, F.col("start_time").cast("string")),
            "end_ts": parse_date_time(day, F.col("end_time").cast("string")),
        })
    absent = [f.name for f in schema_of(name).fields if f.name not in df.columns]
    if absent:
        raise ValueError(f"{name}: the source lacks the columns {', '.join(absent)}")
    return df


#: Column of a text source that holds a line which could not be read.
CORRUPT = "_corrupt_record"


def typed_rows(
    name: str, df: DataFrame, answers: tuple[str, ...] = (), observed: Observation | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows in the declared types, and the rejected values.

    Values are cast with ``try_cast``; ``answers`` are typed yes/no columns. A
    row with a given value that does not parse is left out of the rows and
    gives one reject (key, column, value) for each such value; the key is the
    table's first declared column, as text in the rejects unless it is valid. A
    line of a text source that could not be read (CORRUPT) is one reject with
    its raw text. ``observed`` gets the numbers of rows read and rejected when
    the rejects are computed, in the same pass.
    """
    schema, df = schema_of(name), shaped(name, df)
    values = {
        f.name: is_yes(f.name) if f.name in answers else F.col(f.name).try_cast(f.dataType) for f in schema.fields
    }
    bad = {c: F.col(c).isNotNull() & v.isNull() for c, v in values.items() if c not in answers}
    broken = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    any_bad = broken
    for b in bad.values():
        any_bad = any_bad | b
    rows = df.where(~any_bad).select(*[v.alias(c) for c, v in values.items()])
    key = schema.fields[0].name

    def reject(column: str, value: Column) -> Column:
        return F.struct(F.lit(column).alias("column"), value.cast("string").alias("value"))

    wrong = F.array_compact(F.array(*[F.when(b, reject(c, F.col(c))) for c, b in bad.items()]))
    if CORRUPT in df.columns:
        wrong = F.when(broken, F.array(reject(CORRUPT, F.col(CORRUPT)))).otherwise(wrong)
    if observed is not None:
        df = df.observe(observed, F.count(F.lit(1)).alias("read"), F.count_if(any_bad).alias("rejected"))
    rejects = df.where(any_bad).select(values[key].alias(key), F.explode(wrong).alias("w")).select(key, "w.column", "w.value")
    return rows, rejects


#: Columns of the application's own shape of a table, built into declared ones.
SOURCE_COLUMNS = {"events": ("start_time", "end_time")}


def _text_fields(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])


def read_with_rejects(
    spark: SparkSession, name: str, path: str, fmt: str = "parquet", observed: Observation | None = None, **options: str
) -> tuple[DataFrame, DataFrame]:
    """One stored state or request table in its declared types, and its
    rejected values (see ``typed_rows``).

    CSV and JSON are read as text, so that a malformed number is a reject and
    not a NULL; so is a JSON line that does not parse and a CSV line with more
    or fewer fields than columns. Parquet and ORC carry their own types, which
    are cast where they differ.
    """
    reader = spark.read.options(**options)
    declared = schema_of(name).fieldNames()
    if fmt in ("csv", "json"):
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    if fmt == "csv":
        header = options.get("header", "false").lower() == "true"
        names = spark.read.options(**options).csv(path).columns if header else declared
        df = reader.schema(_text_fields(names)).csv(path)
    elif fmt == "json":
        extra = SOURCE_COLUMNS.get(name, ())
        df = reader.schema(_text_fields([*declared, *extra])).json(path)
        if extra:
            built = zip(("start_ts", "end_ts"), extra)
            df = df.withColumns({c: F.coalesce(c, parse_date_time("date", t).cast("string")) for c, t in built})
    else:
        df = reader.format(fmt).load(path)
    return typed_rows(name, df, observed=observed)


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """The well-formed rows of ``read_with_rejects``."""
    return read_with_rejects(spark, name, path, fmt, **options)[0]


def read_jdbc_table(
    spark: SparkSession,
    name: str,
    url: str,
    table: str,
    properties: dict[str, str],
    partition_column: str | None = None,
    num_partitions: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """A table straight from the operational database, and its rejects.

    With a ``partition_column`` the read is split into ``num_partitions`` range
    queries between that column's measured bounds, so that a large table does
    not come through one connection; tables without a number column are read
    through one. Needs the database's JDBC driver on the classpath.
    """
    split = {}
    if partition_column:
        bounds = f"(SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}) b"
        lo, hi = spark.read.jdbc(url=url, table=bounds, properties=properties).first()
        if lo is not None:
            split = {"column": partition_column, "lowerBound": lo, "upperBound": hi + 1, "numPartitions": num_partitions}
    return typed_rows(name, spark.read.jdbc(url=url, table=table, properties=properties, **split))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Write a delta or a new table state to its own (new, versioned) path.

    Parquet tables have no row-level UPDATE/DELETE, and a table cannot be
    overwritten while it is being read, so every new state goes to a new path
    and the caller switches to it (``state.StateTable`` does so by partition).
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
