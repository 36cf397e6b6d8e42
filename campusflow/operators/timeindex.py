"""A hierarchical time index over half-open spans, for joins on overlap.

A moment has a 64-bit *address* that grows with it (``address``): minutes
since 1970, then 6 bits of seconds, then 20 bits of microseconds. The cells
of level ``l`` are the addresses with the same bits above the lowest ``l``,
so a cell holds the two cells below it, and spans that begin and end on whole
minutes or seconds need no cells below those.

* ``cover`` cuts a span [lo, hi) into the largest cells inside it: disjoint,
  exactly the span, at most two a level, so about 2 log2(length) rows however
  long the span is (a span to the year 9999 makes less than 80).
* ``stab`` gives the cells that hold a moment, one a level. A moment lies in
  a span if and only if exactly one of these is in the span's cover: an equi
  join on (level, cell), no comparison of times.
* ``scaled`` puts a span into the two or three cells of its own scale that
  touch it: fewer rows, but a match has to be compared.

Two valid spans overlap when one of them begins inside the other:
``a.start ∈ [b.start, b.end)`` or ``b.start ∈ (a.start, a.end)``, never both.
So pairs, counts, sums and minima over overlapping spans are equi joins on
cells: rows grow with the number of spans, not with their length, and a key
that holds a third of all spans is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits below the minutes; the highest level is that of the whole time line.
SECOND_BITS, MINUTE_BITS = 20, 26
TOP = 62
ROLE, LEVEL, CELL = "_role", "_level", "_cell"


def address(ts: str | Column) -> Column:
    """Address of a TIMESTAMP_NTZ column (the session time zone is UTC)."""
    micros = F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
    within = F.pmod(micros, F.lit(60_000_000))
    minutes = F.floor((micros - within) / 60_000_000 + 0.5)  # whole: the half only mends a rounded quotient
    seconds = F.floor(within / 1_000_000)
    return F.shiftleft(minutes, MINUTE_BITS) + F.shiftleft(seconds, SECOND_BITS) + within % 1_000_000


def _trailing_zeros(x: Column) -> Column:
    return F.when(x == 0, F.lit(TOP)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


def _magnitude(n: Column) -> Column:
    """A level whose cells are at least n long (n >= 1)."""
    return F.ceil(F.log2(n.cast("double"))).cast("int")


def _shift(x: Column, level: Column) -> Column:
    """The cell of a level that holds an address."""
    return F.call_function("shiftright", x, level)


def cover_levels(lo: str, hi: str) -> tuple[Column, Column]:
    """Lowest and highest level that the cover of [lo, hi) can use."""
    a, b = F.col(lo), F.col(hi)
    return F.least(_trailing_zeros(a), _trailing_zeros(b)), F.least(_magnitude(b - a), F.lit(TOP))


def cover(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """One row per cell (LEVEL, CELL) of the exact cover of [lo, hi); rows with
    lo >= hi or a NULL bound give none."""
    low, high = cover_levels(lo, hi)
    levels = df.where(F.col(lo) < F.col(hi)).withColumn(LEVEL, F.explode(F.sequence(low.cast("int"), high)))
    # Cells of this level inside the span: first .. last-1. Those that are not
    # half of a cell above that lies inside too are the cover's.
    first = _shift(F.col(lo) + F.call_function("shiftleft", F.lit(1).cast("long"), F.col(LEVEL)) - 1, F.col(LEVEL))
    last = _shift(F.col(hi), F.col(LEVEL))
    levels = levels.withColumn("_first", first).withColumn("_last", last).where("_first < _last")
    left = F.when(F.col("_first") % 2 != 0, F.col("_first"))
    after = F.col("_first") + (F.col("_first") % 2 != 0).cast("long")
    right = F.when((F.col("_last") % 2 != 0) & (after < F.col("_last")), F.col("_last") - 1)
    cells = levels.withColumn(CELL, F.explode(F.array(left, right))).where(F.col(CELL).isNotNull())
    return cells.drop("_first", "_last")


def cover_range(df: DataFrame, lo: str, hi: str) -> Column:
    """The levels that the covers of a (materialized) table use."""
    low, high = cover_levels(lo, hi)
    first, last = df.where(F.col(lo) < F.col(hi)).agg(F.min(low), F.max(high)).first()
    return F.array(*map(F.lit, range(first, last + 1) if first is not None else ())).cast("array<int>")


def stab(df: DataFrame, moment: str, levels: Column) -> DataFrame:
    """One row per cell (LEVEL, CELL) of ``levels`` that holds the moment."""
    out = df.where(F.col(moment).isNotNull()).withColumn(LEVEL, F.explode(levels))
    return out.withColumn(CELL, _shift(F.col(moment), F.col(LEVEL)))


def scale(lo: str, hi: str) -> Column:
    """The level of a valid span's own scale: cells at least as long as it."""
    return F.least(F.greatest(_magnitude(F.col(hi) - F.col(lo)), F.lit(MINUTE_BITS)), F.lit(TOP))


def scales(df: DataFrame, lo: str, hi: str) -> Column:
    """The scales of a (materialized) table's valid spans: at most 37."""
    found = df.where(F.col(lo) < F.col(hi)).agg(F.collect_set(scale(lo, hi))).first()[0]
    return F.array(*map(F.lit, sorted(found))).cast("array<int>")


def own_cells(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """One row (LEVEL, CELL) for each cell of the span's own scale that touches
    it: at most three. A reversed span has none."""
    own = scale(lo, hi)
    out = df.where(F.col(lo) < F.col(hi)).withColumns({LEVEL: own, "_i": F.explode(F.array(*map(F.lit, range(3))))})
    out = out.withColumn(CELL, _shift(F.col(lo), own) + F.col("_i"))
    return out.where(F.col(CELL) <= _shift(F.col(hi) - 1, own)).drop("_i")


def every_scale() -> Column:
    """All levels that a span's own scale can be."""
    return F.sequence(F.lit(MINUTE_BITS), F.lit(TOP))


def in_roles(df: DataFrame, lo: str, hi: str, span_role: int, moment_role: int, levels: Column) -> DataFrame:
    """One row (ROLE, LEVEL, CELL) for each cell of the span's own scale that
    touches it, in ``span_role``, and for each cell of ``levels`` that holds
    its start, in ``moment_role``. A reversed span has only the latter."""
    # A level, or -1, -2, -3 for the cells of the span's own scale.
    out = df.withColumn("_at", F.explode(F.concat(F.coalesce(levels, F.array().cast("array<int>")), F.array(*map(F.lit, (-1, -2, -3))))))
    own, at = scale(lo, hi), F.col("_at")
    cell = F.when(at < 0, _shift(F.col(lo), own) - at - 1).otherwise(_shift(F.col(lo), at))
    out = out.withColumns({
        ROLE: F.when(at < 0, span_role).otherwise(moment_role), LEVEL: F.when(at < 0, own).otherwise(at), CELL: cell,
    })
    touches = (F.col(lo) < F.col(hi)) & (F.col(CELL) <= _shift(F.col(hi) - 1, own))
    return out.where((at >= 0) | touches).drop("_at")


def min_over_overlapping(
    probes: DataFrame, stored: DataFrame, keys: Sequence[str], probe_id: str, value: str, lo: str = "_lo", hi: str = "_hi"
) -> DataFrame:
    """For each probe the smallest ``value`` of the stored spans with the same
    keys that overlap it: (probe_id, value), no row where none does.

    Both tables have addresses ``lo`` and ``hi``. Every cell carries the
    minimum of its spans, so a probe meets at most one row a cell of its own:
    the cells above its start (spans that hold the start), and its own cover
    without the start (spans that begin later inside it). Only valid spans
    count on either side.
    """
    keys = list(keys)
    cell = [*keys, LEVEL, CELL]
    probes = probes.where(F.col(lo) < F.col(hi)).select(probe_id, *keys, lo, hi)
    stored = stored.where(F.col(lo) < F.col(hi)).select(*keys, lo, hi, value)
    rest = probes.withColumn("_after", F.col(lo) + 1)
    smallest = F.min(value).alias(value)
    holding = cover(stored, lo, hi).groupBy(*cell).agg(smallest)
    starting = stab(stored, lo, cover_range(rest, "_after", hi)).groupBy(*cell).agg(smallest)
    above = stab(probes, lo, cover_range(stored, lo, hi)).select(probe_id, *cell)
    inside = cover(rest, "_after", hi).select(probe_id, *cell)
    found = above.join(holding, cell).select(probe_id, value).unionByName(inside.join(starting, cell).select(probe_id, value))
    return found.groupBy(probe_id).agg(smallest)
