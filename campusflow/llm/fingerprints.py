"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases level by level. On each level
runs of a symbol become one symbol, deterministic coin tossing labels every
symbol by the lowest bit in which it differs from its left neighbour (three
rounds bring the labels below 8, and neighbours never share one), and phrases
begin at the local maxima of the labels. A phrase's name is a hash of its
symbols; the names are the next level's symbols. Where a phrase begins depends
on a few neighbouring symbols only, so equal substrings get equal names in
their interior, whatever their offset.

The fingerprint is a minhash of the names of level DEPTH and above (texts too
short for that: of their last name); the likeness of two is the share of equal
components, an estimate of the Jaccard similarity of the name sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.llm.common import Shared
from campusflow.llm.wordhash import BASE, U, mix, powers

DEPTH = 3
COMPONENTS = 64
#: Code points fingerprinted at a time.
CHUNK = 1 << 20

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_FACTORS = mix(np.arange(1, COMPONENTS + 1, dtype=U) * U(BASE)) | U(1)


def _coin(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 * (lowest bit that differs from the left neighbour) + its value; the
    first symbol of a text counts as differing in bit 0."""
    one = labels.dtype.type(1)
    differ = np.empty_like(labels)
    differ[1:] = labels[1:] ^ labels[:-1]
    differ[first] = one
    bit = np.bitwise_count((differ & (~differ + one)) - one)
    value = (labels >> bit.astype(labels.dtype)) & one
    return (bit * np.uint8(2) + value.astype(np.uint8)).astype(np.uint8)


def parse(symbols: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One level: the phrase names of several texts laid end to end, and where
    each text's first phrase is (``first`` marks the first symbols)."""
    head = np.ones(len(symbols), bool)
    head[1:] = (symbols[1:] != symbols[:-1]) | first[1:]
    at = np.flatnonzero(head)
    runs = np.diff(at, append=len(symbols)).astype(U)
    symbols = np.where(runs > U(1), mix(symbols[at] ^ (runs * U(BASE))), symbols[at])
    first = first[at]
    # Two different runs never get the same symbol but by a hash collision;
    # a collision only makes a coin of bit 0.
    labels = _coin(symbols, first)
    labels = _coin(_coin(labels, first), first)
    start = first.copy()
    peak = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    peak &= ~first[2:] & ~first[1:-1] & ~first[:-2]
    start[1:-1] |= peak
    begin = np.flatnonzero(start)
    sizes = np.diff(begin, append=len(symbols))
    place = np.arange(len(symbols)) - np.repeat(begin, sizes)
    total = np.add.reduceat(mix(symbols) * powers(BASE, int(sizes.max()))[place], begin)
    return mix(total + sizes.astype(U) + U(level * 0xD6E8FEB86659FD93 % (1 << 64))), first[begin]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of COMPONENTS minhash components (uint16) per text."""
    out = np.zeros((len(texts), COMPONENTS), np.uint16)
    index = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(index):
        return out
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    symbols = np.frombuffer(data, "<u4").astype(U)
    sizes = np.array([len(texts[i]) for i in index])
    first = np.zeros(len(symbols), bool)
    first[np.cumsum(sizes) - sizes] = True
    least = np.full((len(index), COMPONENTS), np.iinfo(np.uint64).max, U)
    owners, level = np.arange(len(index)), 0
    while True:
        level += 1
        symbols, first = parse(symbols, first, level)
        begin = np.flatnonzero(first)
        sizes = np.diff(begin, append=len(symbols))
        counts = (sizes == 1) | (level >= DEPTH)
        if counts.any():
            taken = np.repeat(counts, sizes)
            names, starts = symbols[taken], np.cumsum(sizes[counts]) - sizes[counts]
            for k, f in enumerate(_FACTORS):
                found = np.minimum.reduceat(names * f, starts)
                least[owners[counts], k] = np.minimum(least[owners[counts], k], found)
        more = sizes > 1
        if not more.any():
            break
        keep = np.repeat(more, sizes)
        symbols, first, owners = symbols[keep], first[keep], owners[more]
    out[index] = (mix(least) >> U(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _hex(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def _rows(ids: list, texts: list[str], ahead: str) -> list[tuple]:
    """Results of consecutive documents; ``ahead`` follows the last one."""
    following = [*texts[1:], ahead]
    changed = [edited(t, n) for t, n in zip(texts, following)]
    prints = fingerprints([*texts, ahead, *changed])
    own, after, other = prints[: len(texts)], prints[1 : len(texts) + 1], prints[len(texts) + 1 :]
    near_edited, near_next = likeness(own, other), likeness(own, after)
    return [
        (i, len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), _hex(a), _hex(b), float(e), float(n))
        for i, t, c, a, b, e, n in zip(ids, texts, changed, own, other, near_edited, near_next)
    ]


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema
    )


def fingerprint(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row of ``docs`` (doc_id, text). The edited
    text has its last half replaced by the first code points of the next row's
    (ascending doc_id, null first, repeated ids by text; the last row's next is
    the first).

    Null texts count as empty, whose fingerprint is all zeros; an empty table
    gives an empty result; other columns are ignored. Rows are sorted in range
    partitions; only the first and last row of each partition meet in a join.
    """
    import pyarrow as pa

    result = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])
    staged = result.append(pa.field("task", pa.int64())).append(pa.field("edge", pa.string())).append(pa.field("raw", pa.string()))

    def run(tables):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        seen, size = False, 0
        for table in tables:
            for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()):
                if not seen:
                    seen = True
                    yield _batch([(doc_id, *[None] * 6, task, "first", text)], staged)
                if size > CHUNK:
                    yield _batch([(*r, task, None, None) for r in _rows(ids, texts, text)], staged)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if len(ids) > 1:
            yield _batch([(*r, task, None, None) for r in _rows(ids[:-1], texts[:-1], texts[-1])], staged)
        if ids:
            yield _batch([(ids[-1], *[None] * 6, task, "last", texts[-1])], staged)

    def close(tables):
        for table in tables:
            rows = []
            for doc_id, text, ahead in zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "ahead"))):
                rows += _rows([doc_id], [text], ahead)
            if rows:
                yield _batch(rows, result)

    shared = Shared(spark, "fingerprints")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = shared.table(ordered.mapInArrow(run, RESULT + ", task long, edge string, raw string"))
    # One number per range partition: the partition that comes after it.
    heads = parts.where("edge = 'first'").select("task", "doc_id").collect()
    tasks = [r["task"] for r in sorted(heads, key=lambda r: (r["doc_id"] is not None, r["doc_id"]))]
    after = spark.createDataFrame(list(zip(tasks, [*tasks[1:], *tasks[:1]])), "task long, next_task long")
    ahead = parts.where("edge = 'first'").select(F.col("task").alias("next_task"), F.col("raw").alias("ahead"))
    last = parts.where("edge = 'last'").select("task", "doc_id", F.col("raw").alias("text"))
    closing = last.join(after, "task").join(ahead, "next_task").select("doc_id", "text", "ahead").mapInArrow(close, RESULT)
    return parts.where("edge is null").drop("task", "edge", "raw").unionByName(closing)
