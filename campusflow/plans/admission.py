"""Order-dependent admission under a capacity, decided by conflict components.

Request ``b`` is accepted when ``need_b <= cap_b - Σ need_a`` over the
accepted requests ``a`` that come before it in the batch and compete with it
(same venue or resource and overlapping time). Refused requests take nothing.

Requests can only influence each other within a *busy period*: a stretch of
time of one key without a gap between spans. Busy periods come from a running
maximum of the ends along the starts, cut into measured ranges, so a key with
very many requests is no single task. Then

* a period whose needs all fit together is accepted as it is;
* a period of at most FOLD requests is decided one request after the other:
  the rows are sorted by (key, period, batch order) inside their partitions
  and a task holds one period at a time. A chain of requests, each waiting on
  the one before, takes one pass however long it is;
* larger periods are worked off in rounds. A request that fits even if every
  request overlapping it were accepted is accepted (and taken off the caps of
  those after it). Of the others the first FOLD in batch order compete with
  nothing undecided before them but each other, so they are decided one after
  the other; what they take is taken off the caps of the rest, and requests
  that no longer fit are refused. The rest falls into new, smaller periods.

No pairs of requests are formed anywhere. Each round is checkpointed.
"""

from __future__ import annotations

import logging

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.operators.overlap import overlap_load, overlap_load_before
from campusflow.operators.prefix import running_max, running_sums
from campusflow.plans.common import checkpoint, group_changes, order_ranges, whole_groups

_log = logging.getLogger(__name__)

#: Requests of a busy period that one task decides one after the other.
FOLD = 10_000


def busy_periods(spans: DataFrame, keys: Sequence[str], span_id: str) -> DataFrame:
    """``spans`` (valid start_ts, end_ts) plus ``_period``: the start of the
    busy period that the span belongs to. Touching spans are apart."""
    keys, order = list(keys), ["start_ts", span_id]
    placed = order_ranges(spans, keys, order)
    held = running_max(placed, keys, "_blk", order, {"_busy": "end_ts"}, inclusive=False)
    opens = F.col("_busy").isNull() | (F.col("_busy") <= F.col("start_ts"))
    held = running_max(held, keys, "_blk", order, {"_period": F.when(opens, F.col("start_ts"))})
    return held.drop("_blk", "_busy")


def _decide_one_by_one(rows: pd.DataFrame) -> pd.DataFrame:
    """Decide the requests of whole periods, sorted by period and batch order."""
    start, end = (rows[c].to_numpy().astype("datetime64[us]").astype(np.int64) for c in ("start_ts", "end_ts"))
    need, cap, takes = rows["need"].to_numpy(np.int64), rows["cap"].to_numpy(np.int64), rows["takes"].to_numpy(bool)
    bounds = np.flatnonzero(np.append(group_changes(rows, _group_of(rows)), True))
    held, accepted = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    for first, last in zip(bounds[:-1], bounds[1:]):
        for i in range(first, last):
            before = slice(first, i)
            load = held[before][(start[before] < end[i]) & (end[before] > start[i])].sum()
            if need[i] <= cap[i] - load:
                accepted[i] = True
                held[i] = need[i] if takes[i] else 0
    return pd.DataFrame({"request_id": rows["request_id"], "accepted": accepted})


def _group_of(rows: pd.DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith("_g")]


def _fold(batches: Iterator[pd.DataFrame], group: Sequence[str]) -> Iterator[pd.DataFrame]:
    for rows in whole_groups(batches, group):
        yield _decide_one_by_one(rows)


def decide_periods(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(request_id, accepted) of periods of bounded size."""
    group = [*keys, "_period"]
    names = [f"_g{i}" for i in range(len(group))]
    named = [F.col(c).alias(n) for c, n in zip(group, names)]
    parted = rows.repartition(*group).sortWithinPartitions(*group, "_ord")
    sent = parted.select("request_id", *named, "start_ts", "end_ts", F.col("need").cast("long"), F.col("cap").cast("long"), "takes")
    kind = rows.schema["request_id"].dataType.simpleString()
    return sent.mapInPandas(lambda batches: _fold(batches, names), f"request_id {kind}, accepted boolean")


def _load(probes: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(request_id, _held): the need of the takers in ``stored`` that overlap a probe."""
    taken = stored.where("takes").select(*keys, F.col("start_ts").alias("_s"), F.col("end_ts").alias("_e"), "need")
    return overlap_load(
        probes.select("request_id", *keys, "start_ts", "end_ts"), taken, keys, "request_id", ("start_ts", "end_ts"),
        ("_s", "_e"), weight="need", out="_held",
    ).select("request_id", "_held")


def _large_round(large: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round over large periods: the undecided requests with their caps
    reduced, and (request_id, accepted) of the decided ones."""
    columns = large.columns
    crowd = _load(large, large, keys)
    # The crowd holds a taker's own need, and not that of one that only asks.
    every = F.col("_held") + F.when(F.col("takes"), F.lit(0)).otherwise(F.col("need"))
    large = order_ranges(large.join(crowd, "request_id").withColumn("_free", every <= F.col("cap")), [], ["_ord"], "_oblk")
    free = large.where("_free")
    before = overlap_load_before(
        large.where("not _free"), free.where("takes"), keys, "request_id", ("start_ts", "end_ts"), ("start_ts", "end_ts"),
        ["_ord"], "_oblk", "need", "_before",
    )
    rest = large.where("not _free").drop("_oblk").join(before, "request_id", "left")
    rest = rest.withColumn("cap", F.col("cap") - F.coalesce("_before", F.lit(0))).select(columns)
    group = [*keys, "_period"]
    ranked = running_sums(order_ranges(rest, group, ["_ord"]), group, "_blk", ["_ord"], {"_rank": F.lit(1)})
    ranked = checkpoint(ranked.select(*columns, (F.col("_rank") <= FOLD).alias("_head")))
    heads = checkpoint(decide_periods(ranked.where("_head"), keys))
    taken = ranked.join(heads.where("accepted"), "request_id", "left_semi")
    rest = ranked.where("not _head").select(columns)
    rest = rest.join(_load(rest, taken, keys), "request_id")
    rest = checkpoint(rest.withColumn("cap", F.col("cap") - F.coalesce("_held", F.lit(0))).select(columns))
    fits = F.col("need") <= F.col("cap")
    decided = (
        free.select("request_id", F.lit(True).alias("accepted"))
        .unionByName(heads)
        .unionByName(rest.where(~fits).select("request_id", F.lit(False).alias("accepted")))
    )
    return rest.where(fits), decided


def admit_overlapping(live: DataFrame, keys: Sequence[str], max_rounds: int | None = None) -> DataFrame:
    """(request_id, accepted) of requests that compete when they share ``keys``
    and their [start_ts, end_ts) spans overlap.

    ``live``: request_id, _ord (batch order), keys (not NULL), start_ts <
    end_ts, need, cap, and optionally ``takes``: FALSE for requests that only
    ask whether they would fit and take nothing. ``max_rounds`` is for tests.
    """
    keys = list(keys)
    takes = F.col("takes") if "takes" in live.columns else F.lit(True)
    columns = ["request_id", "_ord", *keys, "start_ts", "end_ts", "need", "cap"]
    und, done, rounds = live.select(*columns, takes.alias("takes")), [], 0
    while True:
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError("admission did not settle")
        placed = checkpoint(busy_periods(und, keys, "request_id"))
        group = [*keys, "_period"]
        sizes = placed.groupBy(*group).agg(
            F.count(F.lit(1)).alias("_n"), (F.sum("need") <= F.min("cap")).alias("_all"), F.max(F.col("need") > F.col("cap")).alias("_none")
        )
        alone = F.when(F.col("_all"), F.lit(True)).when((F.col("_n") == 1) & F.col("_none"), F.lit(False))
        placed = placed.join(sizes.select(*group, "_n", alone.alias("_alone")), group)
        large = sizes.where((F.col("_n") > FOLD) & ~F.col("_all")).select(*group).limit(1).count() > 0
        if large:
            placed = checkpoint(placed)
        done.append(placed.where("_alone is not null").select("request_id", F.col("_alone").alias("accepted")))
        done.append(decide_periods(placed.where(F.col("_alone").isNull() & (F.col("_n") <= FOLD)), keys))
        if not large:
            break
        _log.info("admission: large busy periods, round %d", rounds)
        und, decided = _large_round(placed.where(F.col("_alone").isNull() & (F.col("_n") > FOLD)).drop("_n", "_alone"), keys)
        done.append(decided)
        und = und.drop("_period")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
