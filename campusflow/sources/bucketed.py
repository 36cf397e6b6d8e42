"""State tables bucketed by the key that flows and reports join them on.

A bucketed table is stored in one file a bucket, by the hash of its key and
sorted by it. Joins and aggregations on that key read the buckets as they are:
the stored rows are neither shuffled nor sorted, only the (smaller) other side
moves. Tables with the same number of buckets join without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The key of each table: what requests and other tables are joined to it on.
KEYS = {
    "students": "id", "hosts": "id", "venues": "id", "events": "id", "resources": "id",
    "tickets": "event_id", "orders": "ticket_id", "participants": "event_id", "feedback": "event_id",
    "bookings": "resource_id", "maintenance": "resource_id",
}


def save_bucketed(df: DataFrame, database: str, name: str, buckets: int, key: str | None = None) -> str:
    """Write a state table as ``<database>.<name>``; returns that name. A table
    of that name must not exist: a new state is a new database or name."""
    key = key or KEYS[name]
    # The rows of a bucket come from one task, so it is one sorted file.
    parted = df.repartition(buckets, key)
    parted.write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(f"{database}.{name}")
    return f"{database}.{name}"


def bucketed_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The state tables of a database, by name."""
    found = {t.name for t in spark.catalog.listTables(database)}
    return {name: spark.table(f"{database}.{name}") for name in KEYS if name in found}
