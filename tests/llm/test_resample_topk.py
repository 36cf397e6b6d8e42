"""Importance resampling and exact top-k search against plain Python."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import documents_of

from campusflow.llm import resample, topk
from campusflow.llm.queries import QUERIES, SQL


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def texts(spark):
    return rows(documents_of(spark, SMALL).select("doc_id", "text"))


# --- 12 importance resampling


def drawn(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in df.collect()}


@pytest.mark.parametrize("runs,buckets,percent", [(1, 10_000, 10), (2, 500, 35), (3, 64, 100)])
def test_resampling_of_a_whole_table(spark, texts, runs, buckets, percent):
    target = [t for _, t in rows(spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text"))]
    out = drawn(resample.resample(spark, documents_of(spark, SMALL).repartition(7), spark.read.parquet(f"{SMALL}/benchmark.parquet"), runs, buckets, percent))
    assert out == brute.resampled(texts, target, runs, buckets, percent)


def test_resampling_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    want = con.execute(f"select {', '.join(names)} from ({SQL['op12_importance_resampling']})").fetchall()
    assert sorted(rows(QUERIES["op12_importance_resampling"](spark, SMALL).select(*names)), key=str) == sorted([(*r[:4], r[4] and int(r[4])) for r in want], key=str)


def test_head_does_not_change_results(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    before = drawn(resample.resample(spark, df, df.limit(20), runs=2))
    monkeypatch.setattr(resample, "HEAD", 3)
    monkeypatch.setattr(resample, "HELD", 10)
    monkeypatch.setattr(resample, "PIECE", 50)
    assert drawn(resample.resample(spark, df, df.limit(20), runs=2)) == before


def test_pieces_hold_every_run_once(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 7)
    text = b"one two three  four!five six 7 seven eight nine ten"
    plain = resample.Vocabulary([], [], 1000)
    for runs in (1, 2, 3, 4):
        total, words = np.zeros(1000, int), 0
        for found, again, n in resample.text_features(text, plain, runs):
            np.add.at(total, found, 1)
            if again is not None:
                np.subtract.at(total, again, 1)
            words += n
        want = np.bincount([zlib.crc32(f.encode()) % 1000 for f in brute.run_features(text.decode(), runs)[1]], minlength=1000)
        assert words == 11 and (total == want).all()


def test_bounded_counts_keep_the_frequent():
    counts = resample.Counter({f"rare{k}": 1 for k in range(100)})
    counts.update({"often": 60, "more": 70})
    resample._counted(counts, 5)
    assert set(counts) >= {"often", "more"} and len(counts) <= 5


def test_resampling_edge_cases(spark, edge_docs, no_docs):
    out = rows(resample.resample(spark, edge_docs, edge_docs, percent=100))
    assert len(out) == edge_docs.count()
    by_id = {r[0]: r for r in out if r[0] != 5}
    assert by_id[None][3] is None and by_id[None][4] is None
    assert by_id[1][1:3] == (0, 0) and by_id[2][1:3] == (0, 0)
    assert sorted(r[4] for r in out if r[4] is not None) == [1, 2]
    assert {r[0] for r in out if r[4]} == {6, 7}
    assert rows(resample.resample(spark, no_docs, edge_docs)) == []
    assert len(rows(resample.resample(spark, edge_docs, no_docs))) == edge_docs.count()


# --- 13 exact top-k


VECTORS = "vec_id long, embedding array<float>, query string, score int"


def test_top_k_of_a_whole_table(spark):
    vectors = rows(spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding"))
    out = QUERIES["op13_exact_top_k"](spark, SMALL)
    names = ["query_id", "rank", "vec_id", "score"]
    assert sorted(rows(out.select(*names))) == sorted(brute.top_scores(vectors, 10))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    assert sorted(rows(out.select(*names))) == sorted(con.execute(f"select {', '.join(names)} from ({SQL['op13_exact_top_k']})").fetchall())


@pytest.mark.parametrize("kind", ["normal", "ties", "hot", "large", "few"])
def test_top_k_of_hard_vectors(spark, monkeypatch, kind):
    rng = np.random.default_rng(len(kind))
    n, d = (4, 3) if kind == "few" else (300, 6)
    x = rng.normal(size=(n, d))
    if kind == "ties":
        x = rng.integers(-1, 2, (n, d)).astype(float)
    if kind == "hot":
        x[::3] = x[0]
    if kind == "large":
        x *= 2.0 ** rng.integers(-4, 19, (n, d))
    vectors = [(int(i), [float(np.float32(v)) for v in row]) for i, row in zip(rng.permutation(n), x)]
    df = spark.createDataFrame([(i, v, "q", 1) for i, v in vectors], VECTORS).repartition(3)
    monkeypatch.setattr(topk, "QUERY_BYTES", 1000)  # several blocks of queries
    out = topk.top_k(spark, df, df.where("vec_id % 20 = 0"), k=5)
    assert sorted(rows(out)) == sorted(brute.top_scores(vectors, 5, every=20))


def test_search_reads_only_as_far_as_it_must(monkeypatch):
    rng = np.random.default_rng(2)
    vectors = np.floor(1024 * rng.normal(size=(2000, 8)) / 3)
    vectors[:20] *= 3
    depths = []
    advance = topk.Reading.advance
    monkeypatch.setattr(topk.Reading, "advance", lambda self, depth: (depths.append(depth), advance(self, depth)))
    queries, own = vectors[:5], np.zeros((5, 2000), bool)
    exact = queries @ vectors.T
    limit = np.sort(exact, axis=1)[:, -10]
    q, i, score = topk.search(queries, own, topk.Lists(vectors), limit, 10)
    assert max(depths) < 2000 / 2
    assert (score == exact[q, i]).all()
    assert {(a, b) for a, b in zip(q.tolist(), i.tolist())} == {(a, b) for a, b in np.argwhere(exact >= limit[:, None]).tolist()}


def test_top_k_edge_cases(spark):
    nan = float("nan")
    data = [
        (0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [nan, 1.0]), (400, []), (500, [3.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]),
        (None, [1.0, 2.0]), (7, [float("inf"), 0.0]), (8, [1e30, 1e30]), (9, [-1e30, 0.0]), (600, [1e30, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, "q", 1) for i, v in data], VECTORS)
    out = rows(topk.top_k(spark, df, df.where("vec_id % 100 = 0"), k=3))
    assert {r[0] for r in out} == {0, 400, 500, 600}
    big, least = (1 << 63) - 1, -(1 << 63)
    assert [r[1:] for r in sorted(out) if r[0] == 0] == [(1, 8, big), (2, 600, big), (3, 1, 5 * 1024 * 1024)]
    assert [r[1:] for r in sorted(out) if r[0] == 400] == [(1, 0, 0), (2, 1, 0), (3, 1, 0)]
    all_of = sorted(r[1:] for r in rows(topk.top_k(spark, df, df.where("vec_id = 0"), k=50)))
    assert [r[1] for r in all_of] == [8, 600, 1, 1, None, 500, 400, 9] and all_of[-1][2] == least
    none = df.limit(0)
    assert rows(topk.top_k(spark, none, none)) == rows(topk.top_k(spark, df, none)) == rows(topk.top_k(spark, none, df.where("vec_id = 0"))) == []
