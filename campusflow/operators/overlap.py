"""Interval overlap on a shared key (venue, resource): pairs, counts and loads.

Overlap is half-open: ``a.start < b.end AND a.end > b.start``.

Three shapes:

* ``overlapping_pairs`` — when the result *is* the pairs (conflict reports).
  Two spans overlap when one begins inside the other, so each span gives the
  cells of its own scale that it touches and, for every scale of the other
  side, the one cell that holds its start (``timeindex``): a handful of rows
  however long it is. The join key is (key, scale, cell), so a busy venue or
  resource is cut into many small join keys; a pair meets once.
* ``first_overlapping`` — when one stored span per probe is needed (the first
  conflict): minima over the cells of the time index, no pairs.
* ``overlap_load`` — when only the number or the summed weight of overlapping
  stored intervals per probe is needed (conflict tests, booked quantity). No
  pairs are formed at all: for valid stored intervals

      Σ w [b.start < p.end AND b.end > p.start]
        = Σ w [b.start < p.end] − Σ w [b.end <= p.start]

  and both terms are running sums over the endpoints sorted per key, which
  ``running_sums`` computes without a hot key landing in one task.
  ``overlap_load_before`` counts only what comes before the probe in a batch
  order: running sums along the order inside each cell of the time index.

Stored intervals with end <= start (possible in bad data) overlap what holds
both their ends inside. They are few, and where the identities above do not
hold they are matched with ``overlapping_pairs`` instead (AQE removes that
join at run time when there are none).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.functions.expr import overlaps
from campusflow.operators import timeindex as T
from campusflow.operators.prefix import running_sums, time_block
from campusflow.plans.common import checkpoint


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def overlapping_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    extra: Column | None = None,
) -> DataFrame:
    """All (left, right) row pairs with equal ``keys`` and overlapping spans, once each.

    Column names of the two sides must differ except for ``keys``. NULL keys
    and bounds match nothing; a reversed span (end <= start) overlaps the
    spans that hold both its ends inside.
    """
    keys = list(keys)
    ls, le = left_span
    rs, re_ = right_span
    lb = left.where(F.col(ls).isNotNull() & F.col(le).isNotNull()).withColumns({"_llo": T.address(ls), "_lhi": T.address(le)})
    rb = right.where(F.col(rs).isNotNull() & F.col(re_).isNotNull()).withColumns({"_rlo": T.address(rs), "_rhi": T.address(re_)})
    # Each side is read for its scales and for its rows: materialize both once.
    lb, rb = checkpoint(lb), checkpoint(rb)
    left_scales, right_scales = T.scales(lb, "_llo", "_lhi"), T.scales(rb, "_rlo", "_rhi")
    lb = _near(lb, ("_llo", "_lhi"), rb, ("_rlo", "_rhi"), keys)
    # Role 1: the left span holds the right one's start; role 2: the other way round.
    left_cells = T.in_roles(lb, "_llo", "_lhi", 1, 2, right_scales).drop("_llo", "_lhi")
    right_cells = T.in_roles(rb, "_rlo", "_rhi", 2, 1, left_scales).drop("_rlo", "_rhi")
    # Equal starts: the pair counts in role 2 only, unless the left span is reversed.
    once = F.when(F.col(T.ROLE) == 1, F.col(rs) > F.col(ls)).otherwise(F.col(ls) >= F.col(rs))
    cond = overlaps(F.col(ls), F.col(le), F.col(rs), F.col(re_)) & once
    if extra is not None:
        cond = cond & extra
    cell = [T.ROLE, T.LEVEL, T.CELL]
    return left_cells.join(right_cells, [*keys, *cell], "inner").where(cond).drop(*cell)


def _near(left: DataFrame, left_span: tuple[str, str], right: DataFrame, right_span: tuple[str, str], keys: list[str]) -> DataFrame:
    """The rows of ``left`` that a right span can overlap, before each makes
    its cells: in cells as long as the longest span of either side, what
    overlaps a left span lies in the cell of its start or in the next one."""
    llo, lhi = left_span
    rlo, rhi = right_span
    longest = [
        df.where(F.col(lo) < F.col(hi)).agg(F.max(T.scale(lo, hi))).first()[0] or 0
        for df, (lo, hi) in ((left, left_span), (right, right_span))
    ]
    level = F.lit(int(max(longest)))
    first, last = T._shift(F.col(rlo), level) - 1, T._shift(F.greatest(F.col(rhi) - 1, F.col(rlo)), level)
    held = right.select(*keys, F.explode(F.sequence(first, last)).alias("_near")).distinct()
    return left.withColumn("_near", T._shift(F.col(llo), level)).join(held, [*keys, "_near"], "left_semi").drop("_near")


def near_probes(
    stored: DataFrame, probes: DataFrame, keys: Sequence[str], stored_span: tuple[str, str], probe_span: tuple[str, str]
) -> DataFrame:
    """The rows of ``stored`` in the cells around a valid probe span, for few
    (materialized) probes: no other can overlap one. Rows with a reversed span stay."""
    (ss, se), (ps, pe) = stored_span, probe_span
    pr = probes.where(F.col(ps) < F.col(pe)).select(*keys, T.address(ps).alias("_plo"), T.address(pe).alias("_phi"))
    st = stored.withColumns({"_lo": T.address(ss), "_hi": T.address(se)})
    near = _near(st.where("_lo < _hi"), ("_lo", "_hi"), pr, ("_plo", "_phi"), list(keys))
    return near.unionByName(st.where("_lo >= _hi")).select(*stored.columns)


def inside_probes(
    stored: DataFrame, probes: DataFrame, keys: Sequence[str], stored_span: tuple[str, str], probe_span: tuple[str, str]
) -> DataFrame:
    """The rows of ``stored`` inside their key's envelope of valid probe spans:
    no other can overlap a probe."""
    (ss, se), (ps, pe) = stored_span, probe_span
    pr = probes.where(F.col(ps) < F.col(pe)).select(*keys, F.col(ps).alias("_ps"), F.col(pe).alias("_pe"))
    st = stored.withColumns({"_s": F.col(ss), "_e": F.col(se)})
    return _inside_envelope(pr, st, list(keys)).select(*stored.columns)


def overlapping_pairs_within(df: DataFrame, keys: Sequence[str], row_id: str, span: tuple[str, str], out: tuple[str, str]) -> DataFrame:
    """(keys, smaller id, larger id) of all pairs of rows of one table with
    equal ``keys`` and overlapping spans, once each; ``row_id`` is unique.

    The row that begins later (of equal ones that with the larger id) begins
    inside the other, so one side gives its start and the other its span.
    """
    keys = list(keys)
    ss, se = span
    rows = df.where(F.col(ss).isNotNull() & F.col(se).isNotNull()).select(
        *keys, F.col(row_id).alias("_id"), F.col(ss).alias("_s"), F.col(se).alias("_e"), T.address(ss).alias("_lo"), T.address(se).alias("_hi")
    )
    rows = checkpoint(rows)
    later = T.stab(rows, "_lo", T.scales(rows, "_lo", "_hi")).drop("_lo", "_hi")
    held = T.own_cells(rows, "_lo", "_hi").select(
        *keys, T.LEVEL, T.CELL, F.col("_id").alias("_hid"), F.col("_s").alias("_hs"), F.col("_e").alias("_he")
    )
    after = (F.col("_s") > F.col("_hs")) | ((F.col("_s") == F.col("_hs")) & ((F.col("_id") > F.col("_hid")) | (F.col("_e") <= F.col("_s"))))
    pairs = later.join(held, [*keys, T.LEVEL, T.CELL]).where(after & overlaps(F.col("_s"), F.col("_e"), F.col("_hs"), F.col("_he")))
    return pairs.select(*keys, F.least("_id", "_hid").alias(out[0]), F.greatest("_id", "_hid").alias(out[1]))


def first_overlapping(
    probes: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    probe_id: str,
    probe_span: tuple[str, str],
    stored_span: tuple[str, str],
    value: str,
) -> DataFrame:
    """(probe_id, value): the smallest ``value`` of the ``stored`` rows with the
    same keys whose span overlaps the probe's valid span; no row where none does."""
    keys = list(keys)
    ps, pe = probe_span
    ss, se = stored_span
    pr = checkpoint(probes.where(F.col(ps) < F.col(pe)).select(probe_id, *keys, F.col(ps).alias("_ps"), F.col(pe).alias("_pe")))
    st = stored.select(*keys, F.col(ss).alias("_s"), F.col(se).alias("_e"), value)
    # Both sides are read several times below: materialize what is left of them.
    near = checkpoint(_inside_envelope(pr, st, keys))
    found = T.min_over_overlapping(
        pr.withColumns({"_lo": T.address("_ps"), "_hi": T.address("_pe")}),
        near.where("_s < _e").withColumns({"_lo": T.address("_s"), "_hi": T.address("_e")}),
        keys, probe_id, value,
    )
    reversed_ = _around_reversed(pr, near.where("_s >= _e"), keys).select(probe_id, value)
    return found.unionByName(reversed_).groupBy(probe_id).agg(F.min(value).alias(value))


def _around_reversed(pr: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of probes (_ps, _pe) and reversed spans (_s, _e) that lie inside them."""
    cells = T.own_cells(pr.withColumns({"_lo": T.address("_ps"), "_hi": T.address("_pe")}), "_lo", "_hi").drop("_lo", "_hi")
    points = T.stab(bad.withColumn("_lo", T.address("_s")), "_lo", T.every_scale()).drop("_lo")
    pairs = cells.join(points, [*keys, T.LEVEL, T.CELL])
    return pairs.where(overlaps(F.col("_s"), F.col("_e"), F.col("_ps"), F.col("_pe"))).drop(T.LEVEL, T.CELL)


def _inside_envelope(pr: DataFrame, st: DataFrame, keys: list[str]) -> DataFrame:
    """Stored spans (_s, _e) inside a key's probe envelope [min start, max
    end): no other can overlap a probe. The envelope is one row per key;
    history outside it is dropped before anything is shuffled by time."""
    envelope = pr.groupBy(*keys).agg(F.min("_ps").alias("_lo"), F.max("_pe").alias("_hi"))
    near = st.join(envelope, keys, "inner")
    return near.where((F.col("_e") > F.col("_lo")) & (F.col("_s") < F.col("_hi"))).drop("_lo", "_hi")


def overlap_load(
    probes: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    probe_id: str,
    probe_span: tuple[str, str],
    stored_span: tuple[str, str],
    weight: str | Column | None = None,
    out: str = "load",
    block_unit: str = "HOUR",
) -> DataFrame:
    """``probes`` plus column ``out``: Σ weight (or count) of ``stored`` rows with
    the same keys whose span overlaps the probe's span.

    ``probe_id`` must identify a probe. Probes with a NULL or non-positive
    span get NULL (flows refuse those before asking); a probe with a NULL key
    gets 0, as an equality on NULL matches nothing.
    """
    keys = list(keys)
    ps, pe = probe_span
    ss, se = stored_span
    w = F.lit(1).cast("long") if weight is None else _c(weight).cast("long")
    key_ok = F.lit(True)
    for k in keys:
        key_ok = key_ok & F.col(k).isNotNull()

    st = stored.where(key_ok).select(*keys, F.col(ss).alias("_s"), F.col(se).alias("_e"), w.alias("_w"))
    pr = probes.where(key_ok & (F.col(ps) < F.col(pe))).select(
        *keys, F.col(probe_id).alias("_pid"), F.col(ps).alias("_ps"), F.col(pe).alias("_pe")
    )
    # Stored spans outside the envelope change no load: one that ends by the
    # earliest probe start is in both running sums, one that starts at or after
    # the latest probe end in neither.
    good = _inside_envelope(pr, st.where("_s < _e"), keys)

    zero = F.lit(0).cast("long")
    no_id = F.lit(None).cast(probes.schema[probe_id].dataType)
    no_flag = F.lit(None).cast("boolean")

    def point(t: Column, kind: int, ws: Column, we: Column, pid: Column, at_end: Column) -> Column:
        return F.struct(t.alias("_t"), F.lit(kind).alias("_k"), ws.alias("_ws"), we.alias("_we"), pid.alias("_pid"),
                        at_end.alias("_at_end"))

    # kind orders equal times: stored ends (0) < probe points (1) < stored starts (2),
    # so "start < probe end" is strict and "end <= probe start" is not.
    # Each side is read once; its two endpoints come out of one explode.
    stored_pts = good.select(*keys, F.explode(F.array(
        point(F.col("_e"), 0, zero, F.col("_w"), no_id, no_flag),
        point(F.col("_s"), 2, F.col("_w"), zero, no_id, no_flag),
    )).alias("_p"))
    probe_pts = pr.select(*keys, F.explode(F.array(
        point(F.col("_pe"), 1, zero, zero, F.col("_pid"), F.lit(True)),
        point(F.col("_ps"), 1, zero, zero, F.col("_pid"), F.lit(False)),
    )).alias("_p"))
    points = stored_pts.unionByName(probe_pts).select(*keys, "_p.*").withColumn("_blk", time_block("_t", block_unit))
    summed = running_sums(points, keys, "_blk", ["_t", "_k", "_pid"], {"_S": "_ws", "_E": "_we"})
    loads = (
        summed.where(F.col("_pid").isNotNull())
        .groupBy("_pid")
        .agg(
            (
                F.sum(F.when(F.col("_at_end"), F.col("_S")).otherwise(0))
                - F.sum(F.when(~F.col("_at_end"), F.col("_E")).otherwise(0))
            ).alias("_load")
        )
    )
    # Reversed stored spans (end <= start, bad data): exact pair matching.
    # When there are none, AQE sees the empty side and drops this join.
    rev_pairs = _around_reversed(pr, st.where("_s >= _e"), keys).groupBy("_pid").agg(F.sum("_w").alias("_load"))
    loads = loads.unionByName(rev_pairs).groupBy("_pid").agg(F.sum("_load").alias("_load"))

    valid_probe = F.col(ps).isNotNull() & F.col(pe).isNotNull() & (F.col(ps) < F.col(pe))
    return (
        probes.join(loads, probes[probe_id] == loads["_pid"], "left")
        .withColumn(out, F.when(valid_probe, F.coalesce(F.col("_load"), zero)))
        .drop("_pid", "_load")
    )


def overlap_load_before(
    probes: DataFrame,
    entries: DataFrame,
    keys: Sequence[str],
    probe_id: str,
    probe_span: tuple[str, str],
    entry_span: tuple[str, str],
    order: Sequence[str],
    block: str,
    weight: str,
    out: str = "load",
) -> DataFrame:
    """(probe_id, out): Σ ``weight`` of the entries that come before the probe
    in ``order``, share its keys and overlap its span; no row for 0 entries met.

    Weights may be negative (a span that is taken back). ``order`` names the
    columns of the order on both sides, and ``block`` one that does not
    decrease along it: the entries of a cell are summed block by block, so no
    cell's rows have to fit a task. No pairs are formed; an entry or probe
    makes about 2 log2(length) rows.
    """
    keys = list(keys)
    ps, pe = probe_span
    es, ee = entry_span
    # Running sums would put NULL keys together; an equality on NULL matches nothing.
    for k in keys:
        probes, entries = probes.where(F.col(k).isNotNull()), entries.where(F.col(k).isNotNull())
    pr = probes.where(F.col(ps) < F.col(pe)).select(
        F.col(probe_id).alias("_pid"), *keys, *order, block, T.address(ps).alias("_lo"), T.address(pe).alias("_hi"),
        (T.address(ps) + 1).alias("_after"), F.lit(0).cast("long").alias("_w"), F.col(ps).alias("_ps"), F.col(pe).alias("_pe"),
    )
    no_id = F.lit(None).cast(probes.schema[probe_id].dataType)
    given = entries.where(F.col(es).isNotNull() & F.col(ee).isNotNull())
    en = given.where(F.col(es) < F.col(ee)).select(
        no_id.alias("_pid"), *keys, *order, block, T.address(es).alias("_lo"), T.address(ee).alias("_hi"),
        F.col(weight).cast("long").alias("_w"),
    )
    cells = ["_pid", *keys, *order, block, "_w", T.ROLE, T.LEVEL, T.CELL]

    def role(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn(T.ROLE, F.lit(n)).select(*cells)

    rows = (
        role(T.cover(en, "_lo", "_hi"), 1)
        .unionByName(role(T.stab(pr, "_lo", T.cover_range(en, "_lo", "_hi")), 1))
        .unionByName(role(T.stab(en, "_lo", T.cover_range(pr, "_after", "_hi")), 2))
        .unionByName(role(T.cover(pr, "_after", "_hi"), 2))
    )
    # At one place in the order the probe comes first: what it adds itself is later.
    rows = rows.withColumn("_entry", F.col("_pid").isNull())
    summed = running_sums(rows, [*keys, T.ROLE, T.LEVEL, T.CELL], block, [*order, "_entry", "_pid"], {"_sum": "_w"})
    loads = summed.where("_pid is not null").select("_pid", "_sum")
    bad = given.where(F.col(es) >= F.col(ee)).select(
        *keys, F.struct(*order).alias("_at"), F.col(es).alias("_s"), F.col(ee).alias("_e"), F.col(weight).cast("long").alias("_sum")
    )
    earlier = _around_reversed(pr.select("_pid", *keys, *order, "_ps", "_pe"), bad, keys).where(F.col("_at") < F.struct(*order))
    return loads.unionByName(earlier.select("_pid", "_sum")).groupBy(F.col("_pid").alias(probe_id)).agg(F.sum("_sum").alias(out))
