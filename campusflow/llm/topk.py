"""Exact top-k inner-product search by no-random-access aggregation.

Every task takes the candidates of its partition in blocks and keeps, for each
block, one sorted list per dimension. The lists are read from the end that is
good for a query (the top for a positive component, the bottom for a negative
one), a slice of every list at a time, and the reads are shared by all queries:

* an entry read is known; an entry not read yet is at most the last value read
  of its list, and at least the list's last value. So each candidate has an
  upper and a lower bound of its score under each query;
* the threshold of a query is the k-th best score it has for certain: from
  earlier blocks of the task, or the k-th best lower bound in this one;
* a query stops when a candidate of which nothing was read could not reach
  the threshold any more. The candidates whose upper bound reaches it get
  their final scores; the others cannot be among the k best.

Depths at which no query can stop are read without computing bounds. The k
best of each task meet in a window per query, at most k rows a task and query.

Queries are answered in blocks of bounded bytes: each is broadcast and costs
one pass over the candidates, so nothing that grows with the table is held by
one task or the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campusflow.llm.common import Shared

SCALE = 1024
#: Bytes of a broadcast block of queries; candidates whose lists are held at once.
QUERY_BYTES = 16 << 20
FIRST, BLOCK = 256, 4096
#: Slices in which a list is read, and how many a query without a threshold
#: reads between lower bounds; queries whose bounds are held at once.
SLICES, RAISED = 32, 4
AT_ONCE = 256
#: Final scores computed at once.
RESOLVED = 1 << 16
#: Sums of integers below this are exact in doubles.
EXACT = float(1 << 53)
LONG = np.iinfo(np.int64)

FOUND = "query long, query_id long, vec_id long, score long"


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part (neither null nor with a null or non-finite
    component) and floor(1024 * component) of theirs as doubles. Shorter
    vectors are filled up with zeros."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), 0)
    values = column.flatten()
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(SCALE * values.cast(pa.float64()).to_numpy(zero_copy_only=False))
    held = np.maximum(sizes, 0)
    row = np.repeat(np.arange(len(sizes)), held)
    out = np.zeros((len(sizes), width))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)] = flat
    good = np.flatnonzero((sizes >= 0) & np.isfinite(out).all(axis=1))
    return good, out[good]


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _kind(queries: np.ndarray, vectors: np.ndarray):
    """Doubles where every sum is exact in them, else Python integers."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(queries.shape[1], 1)
    return float if most < EXACT else object


def _as(x: np.ndarray, kind) -> np.ndarray:
    if kind is float:
        return x
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _clamp(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, LONG.min, LONG.max) if scores.dtype == object else scores


class Lists:
    """The sorted lists of a block of candidates, one a dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        by_dimension = np.ascontiguousarray(vectors.astype(float).T)
        order = np.argsort(by_dimension, axis=1, kind="stable")[:, ::-1]
        self.order = np.ascontiguousarray(order.T)
        self.values = np.take_along_axis(vectors, self.order, axis=0)
        self.depths = np.unique(np.linspace(0, len(vectors), SLICES + 1).round().astype(int))[1:]

    def frontier(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The last value read of each list, from the top and the bottom."""
        return self.values[depth - 1], self.values[len(self.values) - depth]


class Reading:
    """How far the lists have been read, from both ends."""

    def __init__(self, lists: Lists):
        self.lists, self.depth = lists, 0
        self.top_seen, self.bottom_seen = np.zeros(lists.vectors.shape, bool), np.zeros(lists.vectors.shape, bool)

    def advance(self, depth: int) -> None:
        order = self.lists.order
        m, dimensions = order.shape
        cols = np.arange(dimensions)
        self.top_seen[order[self.depth : depth], cols] = True
        self.bottom_seen[order[m - depth : m - self.depth], cols] = True
        self.depth = depth

    def bound(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """Score of every candidate under every query with the values read,
        and the lists' values at ``depth`` in place of those not read."""
        top, bottom = self.lists.frontier(depth)
        positive = np.where(self.top_seen, self.lists.vectors, top)
        negative = np.where(self.bottom_seen, self.lists.vectors, bottom)
        return np.maximum(queries, 0) @ positive.T + np.minimum(queries, 0) @ negative.T

    def upper(self, queries: np.ndarray) -> np.ndarray:
        return _clamp(self.bound(queries, self.depth))

    def lower(self, queries: np.ndarray) -> np.ndarray:
        return _clamp(self.bound(queries, len(self.lists.vectors)))


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf for fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf, scores.dtype)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def search(queries: np.ndarray, own: np.ndarray, lists: Lists, threshold: np.ndarray, k: int):
    """Candidates that may be among the k best of each query, with their final
    scores: arrays (query, candidate, score). ``own[q, i]``: candidate i is not
    one of query q. ``threshold``: a score that k results reach already, -inf
    if there are none."""
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    reading, active, limit, out = Reading(lists), np.arange(len(queries)), threshold.copy(), []
    for step, depth in enumerate(lists.depths):
        top, bottom = lists.frontier(depth)
        outsider = _clamp(positive[active] @ top + negative[active] @ bottom)
        last = depth == len(lists.vectors)
        fresh = limit[active] == -np.inf
        stops = outsider < limit[active]
        reading.advance(depth)
        if fresh.any() and (last or step % RAISED == RAISED - 1):
            # Without a threshold the lower bounds have to give one.
            lower = reading.lower(queries[active[fresh]]).astype(limit.dtype)
            lower[own[active[fresh]]] = -np.inf
            raised = kth_best(lower, k)
            enough = outsider[fresh] < raised
            limit[active[fresh]] = np.where(enough | last, raised, -np.inf)
            stops[fresh] = enough
        stopped = active if last else active[stops]
        if len(stopped):
            q, i = np.nonzero((reading.upper(queries[stopped]) >= limit[stopped][:, None]) & ~own[stopped])
            for a in range(0, len(q), RESOLVED):
                x, y = stopped[q[a : a + RESOLVED]], i[a : a + RESOLVED]
                score = _clamp((queries[x] * lists.vectors[y]).sum(axis=1))
                hit = score >= limit[x]
                out.append((x[hit], y[hit], score[hit]))
            active = np.setdiff1d(active, stopped, assume_unique=True)
        if not len(active):
            break
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0, queries.dtype)
    return tuple(np.concatenate(x) for x in zip(*out))


class Best:
    """The k best of each query so far: by score, then the smaller id, null ids last."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.key, self.null, self.score = np.empty(0, int), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
        self.threshold = np.full(queries, -np.inf, object)

    def add(self, query, key, null, score) -> None:
        if not len(query):
            return
        q, i, n = np.concatenate([self.query, query]), np.concatenate([self.key, key]), np.concatenate([self.null, null])
        s = np.concatenate([self.score, score.astype(np.int64)])
        order = np.lexsort((i, n, ~s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[place < self.k]
        self.query, self.key, self.null, self.score = q[place < self.k], i[keep], n[keep], s[keep]
        full = place == self.k - 1
        self.threshold[q[full]] = s[order[full]].astype(object)


def scan(batches, block, k: int):
    """The k best candidates of a partition for each query of a block."""
    ids, queries = block
    best = Best(len(ids), k)

    def take(keys, nulls, vectors):
        width = max(queries.shape[1], vectors.shape[1])
        kind = _kind(queries, vectors)
        asked, lists = _as(_wide(queries, width), kind), Lists(_as(_wide(vectors, width), kind))
        for a in range(0, len(ids), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            own = (ids[part][:, None] == keys[None]) & ~nulls[None]
            q, i, score = search(asked[part], own, lists, best.threshold[part].astype(kind), k)
            best.add(q + a, keys[i], nulls[i], score)

    # Small blocks first: they give the thresholds that spare later reads.
    held, size, wanted = [], 0, FIRST
    for batch in batches:
        good, vectors = integers(batch.column("embedding"))
        column = batch.column("vec_id").take(pa.array(good))
        held.append((column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False), vectors))
        size += len(good)
        while size >= wanted:
            keys, nulls, vectors = _joined(held)
            take(keys[:wanted], nulls[:wanted], vectors[:wanted])
            held, size = [(keys[wanted:], nulls[wanted:], vectors[wanted:])], size - wanted
            wanted = min(2 * wanted, BLOCK)
    if size:
        take(*_joined(held))
    for a in range(0, len(best.query), BLOCK):
        part = slice(a, a + BLOCK)
        yield pa.record_batch(
            [
                pa.array(best.query[part], pa.int64()),
                pa.array(ids[best.query[part]], pa.int64()),
                pa.array(best.key[part], pa.int64(), mask=best.null[part]),
                pa.array([int(s) for s in best.score[part]], pa.int64()),
            ],
            names=["query", "query_id", "vec_id", "score"],
        )


def _joined(held):
    width = max(v.shape[1] for _, _, v in held)
    return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([_wide(h[2], width) for h in held])


def query_block(rows: list[pa.RecordBatch] | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = rows.combine_chunks()
    column = table.column("embedding")
    column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    good, vectors = integers(column)
    return table.column("vec_id").to_numpy()[good].astype(np.int64), vectors


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best candidates of each query by the inner product of
    floor(1024 * component), best first, ties to the smaller vec_id.

    ``vectors`` and ``queries`` have vec_id and embedding; the candidates of a
    query are all rows of ``vectors`` but those with its vec_id. Returns
    query_id, rank (from 1), vec_id, score.

    Vectors that are null or hold a null or non-finite component take no part;
    a vector without components scores 0, and of vectors of different lengths
    the shorter counts as filled up with zeros. A candidate whose vec_id is
    null takes part and comes last among ties; queries without an id are not
    asked. Rows that repeat are candidates each, and a query that repeats is
    answered each time. Scores beyond 64 bits count as the nearest long. Empty tables give no rows; other columns are ignored.
    """
    shared = Shared(spark, "topk")
    columns = [F.col("vec_id").cast("long").alias("vec_id"), "embedding"]
    asked = shared.table(queries.select(*columns).where("vec_id is not null and embedding is not null").withColumn("row", F.monotonically_increasing_id()))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, math.ceil(n * (width + 1) * 8 / QUERY_BYTES))
    candidates = vectors.select(*columns)
    found = []
    for b in range(blocks):
        # Row numbers of a stored table: the blocks are the same whenever read.
        block = spark.sparkContext.broadcast(query_block(asked.where(F.col("row") % blocks == b).drop("row").toArrow()))
        part = candidates.mapInArrow(lambda batches, block=block: scan(batches, block.value, k), FOUND)
        part = _ranked(part, k)
        found.append(part if blocks == 1 else shared.table(part))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
