"""Cross-tokenizer alignment against plain loops on whole small tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import documents_of

from campusflow.llm import alignment
from campusflow.llm.common import Shared
from campusflow.llm.queries import QUERIES

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = ["", None, "x" * 3000, "<|endoftext|> a <s> b </s> <unk>", "a\x00b", "▁x ▁ y", "  two  spaces \n\n new\tx ", "é漢字\U0001f600 x", "end ", " ", "ab  cd"]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.ByteLevel(PATHS[0]), alignment.Pieces(PATHS[1])


def expected(docs, tokenizers):
    a, b = tokenizers
    found = {}
    for i, t in docs:
        if t:
            found[i] = brute.alignment(t, a.encode([t])[0], b.encode([t])[0], a.bytes, b.bytes)
    counts = Counter(link for f in found.values() if f for link in f[1])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = {}
    for i, t in docs:
        if not found.get(i):
            out[i] = (0, 0, 0, 0, 0, 0, "")
            continue
        groups, links = found[i]
        sides = [g.split("|") for g in groups.split(";")]
        out[i] = (
            sum(len(x.split(",")) for x, _ in sides), sum(len(y.split(",")) for _, y in sides), len(sides), len(links),
            sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(groups.encode()).hexdigest(),
        )
    return out


def result(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_alignment_of_a_whole_table(spark, tokenizers):
    docs = [tuple(r) for r in documents_of(spark, SMALL).select("doc_id", "text").collect()]
    short = [(i, t) for i, t in docs if len(t or "") < 3000]
    out = result(alignment.report(spark, spark.createDataFrame(short, "doc_id long, text string").repartition(5), *PATHS))
    assert out == expected(short, tokenizers)
    whole = result(QUERIES["op11_tokenizer_alignment"](spark, SMALL))
    assert set(whole) == {i for i, _ in docs}
    assert all((whole[i][:4], whole[i][6]) == (out[i][:4], out[i][6]) for i in out)


def test_alignment_of_odd_texts(spark, tokenizers, monkeypatch):
    docs = list(enumerate(ODD))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = expected(docs, tokenizers)
    assert result(alignment.report(spark, df, *PATHS)) == want
    assert want[1][0] == 0 and want[5][0] == 0 and want[3][0] > 0
    # The same with several broadcast blocks.
    monkeypatch.setattr(alignment, "PAIR_BLOCK", 20)
    assert result(alignment.report(spark, df, *PATHS)) == want


def test_alignment_forgets_windows(tokenizers, monkeypatch):
    texts = [f"some words number {k} and the same end".encode() for k in range(50)]
    once = alignment.Aligner(*tokenizers)
    remembered = [once.align([t])[0] for t in texts]
    monkeypatch.setattr(alignment, "MEMORY", 5)
    small = alignment.Aligner(*tokenizers)
    for t, x in zip(texts, remembered):
        (y,) = small.align([t])
        assert x[:4] == y[:4] and x[4].tolist() == y[4].tolist() and x[5].tolist() == y[5].tolist()
    assert len(small.number) < 30 < len(once.number)
    assert alignment.Aligner(*tokenizers).align([b"\xff bad", None])[0][0] == 0


def test_alignment_gives_its_groups(spark, tokenizers):
    df = spark.createDataFrame([(1, "unbelievable words here")], "doc_id long, text string")
    row = alignment.align(df, *PATHS).first()
    a, b = tokenizers
    sides = [[[int(i) for i in s.split(",")] for s in g.split("|")] for g in row.groups.split(";")]
    for x, y in sides:
        assert b"".join(map(a.bytes.__getitem__, x)) == b"".join(map(b.bytes.__getitem__, y))
    assert b"".join(a.bytes[i] for x, _ in sides for i in x) == b" unbelievable words here"
    pairs = alignment.pair_counts(alignment.align(df, *PATHS).drop("groups"), len(b.bytes))
    assert pairs.count() == len(row.pairs) and sum(row.times) == row.n_links


def test_alignment_edge_cases(spark, edge_docs, no_docs):
    out = alignment.report(spark, edge_docs, *PATHS)
    assert out.count() == edge_docs.count()
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[1].groups_sha256 == "" and by_id[2].n_links == 0
    assert by_id[6].n_a == by_id[7].n_a > 0 and by_id[8].n_a > 0
    assert alignment.report(spark, no_docs, *PATHS).collect() == []
    assert alignment.score_links(Shared(spark, "t"), alignment.align(no_docs, *PATHS), alignment.pair_counts(alignment.align(no_docs, *PATHS), 10)).collect() == []
