"""Texts that repeat one form very often: no stack, no quadratic time."""

from __future__ import annotations

import re
import time

import pytest
from tests.llm import brute

import corpus_pipeline
from campusflow.llm import licenses, pii, secret_scan

FORMS = ["aB/", "a.", "a-", "1.2.", "Aa1+/_=-", "token=abcdef1 ", "x@y.z ", "12 "]


def texts(spark, size):
    rows = [(i, "Released under the MIT License\n" + form * (size // len(form)) + "0123456789", "en", "s", size) for i, form in enumerate(FORMS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_secret_scan_takes_hostile_texts(spark):
    out = {r.doc_id: r for r in secret_scan.report(texts(spark, 1 << 20)).collect()}
    assert len(out) == len(FORMS)
    assert out[FORMS.index("token=abcdef1 ")].n_assign == (1 << 20) // 14


def test_license_scan_takes_hostile_texts(spark):
    out = licenses.scan(spark, texts(spark, 1 << 20)).collect()
    assert {r.doc_id for r in out if r.family == "mit"} == set(range(len(FORMS)))


def test_many_matches_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "token=abcdef1 " * n)], "doc_id long, text string")
        began = time.time()
        row = secret_scan.report(df).first()
        assert row.n_assign == n
        return time.time() - began, row

    seconds(10)
    few, _ = seconds(8_000)
    many, row = seconds(32_000)
    assert many < 5 * few + 3
    assert row.base_sha256 == brute.sha(brute.secrets("token=abcdef1 " * 32_000), secret_scan.KINDS)


@pytest.mark.parametrize("kept", [True, False])
def test_entropy_spans_that_reach_beyond_a_base_span_count_whole(spark, kept):
    key = "Zq8XvT2LmP0a1b2c3d4e5f60718293a4b5c6d78fWx7KpQ9RtYu3" if kept else "0a1b2c3d4e5f60718293a4b5c6d78f"
    df = spark.createDataFrame([(1, f"my {key} end")], "doc_id long, text string")
    masked = secret_scan.redact(df).first().text
    assert masked == "my [SECRET] end"


def test_pipeline_judges_rows_with_null_or_repeated_ids_by_their_text(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil strange green potions tonight"
    spark.createDataFrame([(10, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(
        [(None, f"so {item} yes"), (3, f"and {item} too"), (3, "a clean text of its own with nothing copied in it"), (None, None), (4, None)],
        "doc_id long, text string",
    )
    left = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text is None) for r in left) == [(0, True), (3, False), (4, True)]
    near = corpus_pipeline.minhash_near_dedup(spark, docs, str(tmp_path)).collect()
    assert len([r for r in near if r.doc_id == 3]) == 2


def test_pii_takes_hostile_texts(spark):
    out = {r.doc_id: r for r in pii.report(spark, texts(spark, 1 << 14)).collect()}
    assert len(out) == len(FORMS) and out[FORMS.index("x@y.z ")].n_email == len(re.findall("x@y.z", "x@y.z " * ((1 << 14) // 6)))
