"""Shared pieces of the request flows.

A flow takes the current state tables and a table of requests, and returns
``{"decisions": ..., "<table>_delta"/"<table>_after": ...}``. A decision row
holds ``request_id``, ``accepted`` and ``reason`` (the first failing check in
the application's order, NULL when accepted). Nothing is written: the caller
stores deltas or new states at new paths (``sources.tables.write_table``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.session import ensure_checkpoint_dir

EMPTY_LIST = "EMPTY_LIST"


def nonempty(df: DataFrame) -> Column:
    """TRUE when ``df`` has a row: an EXISTS subquery run once, not a join."""
    return df.exists()


def order_key() -> Column:
    """Position of a request in its batch, comparable as one value."""
    return F.struct(F.col("request_ts"), F.col("request_id"))


def decide(df: DataFrame, reason: Column, *keep: str) -> DataFrame:
    """Add ``reason`` and ``accepted`` (reason is NULL)."""
    return df.select(*keep, reason.alias("reason")).withColumn("accepted", F.col("reason").isNull())


def last_value_per_key(
    requests: DataFrame, keys: Sequence[str], value: str, applies: Column, out: str | None = None
) -> DataFrame:
    """Per key, the ``value`` of the last request (in batch order) for which
    ``applies`` holds: what a sequence of UPDATEs leaves behind.

    ``max_by`` is a partial aggregate, so a hot key is pre-aggregated on the
    map side and never gathered in one task.
    """
    return (
        requests.where(F.coalesce(applies, F.lit(False)))
        .groupBy(*keys)
        .agg(F.max_by(F.col(value), order_key()).alias(out or value))
    )


def order_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str = "_blk") -> DataFrame:
    """``df`` materialized in measured ranges of (keys, order), numbered by
    ``block``: the blocks of ``running_sums``. A key with very many rows, also
    with one timestamp, spans as many ranges as its share of the rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(n, *keys, *order).withColumn(block, F.spark_partition_id()))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialize a step: cuts the lineage of an iterative round, or keeps a
    result that is read several times from being recomputed (a reliable
    checkpoint in the session's shared checkpoint folder, which survives the
    loss of an executor). Its files go with the last reference to it (the
    session cleans checkpoints, see ``session.get_spark``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def group_changes(rows: pd.DataFrame, group: Sequence[str]) -> np.ndarray:
    """Where a row belongs to another group than the row before."""
    keys = rows[list(group)]
    return ((keys != keys.shift()) & ~(keys.isna() & keys.shift().isna())).any(axis=1).to_numpy() | (np.arange(len(rows)) == 0)


def whole_groups(batches: Iterator[pd.DataFrame], group: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The batches of a partition that is sorted by ``group``, cut so that no
    group is spread over two: one group and one batch are held at a time."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        whole = int(np.flatnonzero(group_changes(held, group))[-1]) if len(held) else 0
        if whole:
            yield held[:whole].reset_index(drop=True)
            held = held[whole:].reset_index(drop=True)
    if held is not None and len(held):
        yield held
