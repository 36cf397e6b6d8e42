"""The pipeline's stages against brute force, on whole tables."""

from __future__ import annotations

from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import documents_of

import __spark_entry__
import corpus_pipeline
from campusflow.llm.common import Shared


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_registered():
    assert "pipeline" in __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in __spark_entry__.queries()}


def test_stages(spark):
    shared, stages = Shared(spark, "test"), dict(corpus_pipeline.STAGES)
    docs = documents_of(spark, SMALL)

    def step(name, before):
        return shared.table(stages[name](spark, before, SMALL))

    spoken = step("language_id", docs)
    extra = spark.createDataFrame([(90_001, "1234 !!", None, None, 7), (90_002, None, None, None, None)], docs.schema)
    assert sorted(rows(step("language_id", docs.unionByName(extra)))) == sorted(rows(spoken)) == sorted(rows(docs))

    near = step("minhash_near_dedup", spoken)
    groups = brute.near_components(rows(spoken.select("doc_id", "text")), 5)
    assert sorted(rows(near)) == sorted(r for r in rows(spoken) if groups[r[0]][1] == r[0])

    clean = step("benchmark_decontamination", near)
    items = [t for (t,) in rows(spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text"))]
    gone = {r[0] for r in rows(near)} - {r[0] for r in rows(clean)}
    assert {r[0] for r in rows(near) if any(t in r[1] for t in items)} <= gone
    assert len(gone) < 0.2 * near.count()

    masked = {r[0]: r for r in rows(step("secret_scans", clean))}
    for r in rows(clean):
        text, merged = r[1], []
        for a, _, b in brute.secrets(text):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            text = text[:a] + "[SECRET]" + text[b:]
        assert masked[r[0]][1] == text and (not merged or masked[r[0]][4] == len(text))

    packed = stages["best_fit_packing"](spark, clean, SMALL)
    assert {r[0] for r in rows(packed.select("doc_id"))} == {r[0] for r in rows(clean)}


def test_stages_on_edge_cases(spark, edge_docs, no_docs):
    shared = Shared(spark, "test")
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = shared.table(stage(spark, docs, SMALL))
            assert after.columns == docs.columns
            docs = after
        shared.table(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL))
