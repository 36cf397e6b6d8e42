"""Plan guards: no registered query plans a cartesian product or a nested-loop
join, in the plan it returns or in any step it materializes on the way."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from tests.conftest import SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode="formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_product(spark, name, monkeypatch):
    plans = []
    materialize = DataFrame.checkpoint

    def watched(df, eager=True):
        plans.append(plan_of(df))
        return materialize(df, eager)

    monkeypatch.setattr(DataFrame, "checkpoint", watched)
    plans.append(plan_of(entry.queries()[name](spark, SMALL)))
    for plan in plans:
        assert not [op for op in FORBIDDEN if op in plan], plan[:2000]


def test_checkpoints_of_finished_flows_are_removed(spark):
    """A flow's checkpoint files go once nothing refers to its outputs."""
    import gc
    import os
    import time

    from campusflow.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(2)
    before = set(os.listdir(folder))
    entry.queries()["order_decisions"](spark, SMALL).count()
    made = set(os.listdir(folder)) - before
    assert made
    for _ in range(10):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)
        if not made & set(os.listdir(folder)):
            break
    assert not made & set(os.listdir(folder))
