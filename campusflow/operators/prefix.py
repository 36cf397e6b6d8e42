"""Running sums and maxima that do not put one hot key into one task.

A plain ``sum().over(Window.partitionBy(key).orderBy(...))`` sends every row
of a key to one task. Here the rows of a key are cut into blocks by a coarse
column that grows with the order (for example the hour of a timestamp):

1. block totals — a partial aggregate per (key, block), so the shuffle
   carries one row per block and map task, not the rows;
2. block offsets — running sum of block totals over the blocks of a key
   (one small row per block, so this window stays small), and the running
   sum inside each (key, block), one window partitioned by (key, block);
3. each row's running sum plus its block's offset (an equi join on
   (key, block), so the big side keeps its partitioning and only the small
   offsets side moves).

A key with a third of all rows is spread over as many tasks as it has blocks.
Blocks by the clock (``time_block``) do not cut the rows of one moment; measured
ranges of the order (``plans.common.order_ranges``) do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusflow.plans.common import checkpoint


def _filler(dtype: T.DataType) -> Column:
    """A non-NULL stand-in value of a column's type (used with an is-NULL flag)."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit(datetime(1, 1, 1)).cast(dtype)
    if isinstance(dtype, T.DateType):
        return F.lit(date(1, 1, 1))
    return F.lit(0).cast(dtype)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str | Column],
    values: dict[str, str | Column],
    inclusive: bool = True,
) -> DataFrame:
    """Add, for each ``out: value`` pair, the sum of ``value`` over the rows of
    the same ``keys`` that come before the row in ``order`` (and the row itself
    when ``inclusive``).

    ``block`` must be non-decreasing along ``order`` within a key (ascending
    order, NULLs first), and ``order`` must be a total order within a key.
    NULL keys form their own groups, as in a window's PARTITION BY.
    """

    def added(before: Column, inner: Column) -> Column:
        return F.coalesce(before, F.lit(0)) + F.coalesce(inner, F.lit(0))

    return _running(df, keys, block, order, values, inclusive, F.sum, added)


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str | Column],
    values: dict[str, str | Column],
    inclusive: bool = True,
) -> DataFrame:
    """As ``running_sums`` with the largest non-NULL value instead of the sum
    (NULL where there is none). With struct(order, x) as value it gives the
    last x so far."""
    return _running(df, keys, block, order, values, inclusive, F.max, F.greatest)


def _running(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str | Column],
    values: dict[str, str | Column],
    inclusive: bool,
    agg: Callable[..., Column],
    joined: Callable[[Column, Column], Column],
) -> DataFrame:
    keys = list(keys)
    types = {f.name: f.dataType for f in df.schema.fields}
    vals = {out: (F.col(v) if isinstance(v, str) else v) for out, v in values.items()}
    # Join-safe grouping columns: a NULL key becomes (filler, flag); a NULL
    # block becomes the smallest block, where NULL orders sort anyway.
    gk: list[str] = []
    extra: list[Column] = []
    for i, k in enumerate(keys):
        extra += [F.coalesce(F.col(k), _filler(types[k])).alias(f"_gk{i}"), F.col(k).isNull().alias(f"_gn{i}")]
        gk += [f"_gk{i}", f"_gn{i}"]
    extra.append(F.coalesce(F.col(block), _filler(types[block])).alias("_gb"))
    staged = df.select("*", *extra, *[v.alias(f"_v_{out}") for out, v in vals.items()])

    # Block totals: a partial aggregate, so only one row per block and map
    # task is shuffled (not the rows themselves).
    totals = staged.groupBy(*gk, "_gb").agg(*[agg(f"_v_{out}").alias(f"_t_{out}") for out in vals])
    before_block = Window.partitionBy(*gk).orderBy("_gb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*gk, "_gb", *[agg(f"_t_{out}").over(before_block).alias(f"_o_{out}") for out in vals])
    # Rows: the one big shuffle, by (key, block); the join below keeps that
    # partitioning and moves only the offsets.
    upto = Window.partitionBy(*gk, "_gb").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = staged.select(*df.columns, *gk, "_gb", *[agg(f"_v_{out}").over(upto).alias(f"_i_{out}") for out in vals])
    return inner.join(offsets, [*gk, "_gb"], "inner").select(
        *df.columns, *[joined(F.col(f"_o_{out}"), F.col(f"_i_{out}")).alias(out) for out in vals]
    )


def time_block(ts: str | Column, unit: str = "HOUR") -> Column:
    """Coarse block of a TIMESTAMP_NTZ column, non-decreasing with it."""
    return F.date_trunc(unit, F.col(ts) if isinstance(ts, str) else ts)


def placed(ordered: DataFrame, out: str = "position") -> DataFrame:
    """The rows of a sorted DataFrame with their places (1, 2, ...) in it.

    Sorting leaves the rows in range partitions; a row's place is that in its
    partition plus the sizes of the partitions before, one number each.
    """
    rows = checkpoint(ordered.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    upto = F.sum("_size").over(Window.orderBy("_range"))
    before = sizes.select("_range", (upto - F.col("_size")).alias("_before"))
    return rows.join(before, "_range").select(*ordered.columns, (F.col("_before") + F.col("_at") + 1).alias(out))
