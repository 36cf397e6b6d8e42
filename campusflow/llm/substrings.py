"""Suffix-array deduplication: removal of byte strings that an earlier
document has too.

1. Anchors. Every WINDOW-byte string holds the smallest hash of its K-byte
   strings, so equal strings hold equal anchors; about one byte in 14 is one.
   Anchors are dealt by hash, sorted, and those of a single document go.
2. Contexts. Each occurrence of a shared anchor carries the bytes around it
   that WINDOW-byte strings with it can cover.
3. Suffix sort. The suffixes of the contexts of one anchor that begin with it
   are sorted by a mergesort that compares their bytes, many pairs at a time,
   and so are the reversed prefixes that end with it. Runs of neighbours whose
   common extensions reach both ends of a WINDOW-byte string share it: they
   form a class, and the strings of a class are removed in all documents but the smallest one. In
   groups of at most PAIRED different contexts the extensions to both sides of
   the anchor are searched for two contexts at a time instead.
   Anchors with more than HOT occurrences (the ends of a passage that very
   many documents share) are decided by a partial minimum over their strings
   instead, so no group is gathered in one task.
4. The removed runs of a document are united and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.llm.common import Shared
from campusflow.llm.wordhash import BASE, BASE_INV, BYTE_VALUE, U, batches, mix, powers, prefix_hashes

WINDOW = 50
K = 24
SPAN = WINDOW - K + 1
SIDE = WINDOW - K
WIDTH = 2 * SIDE + K
#: Bytes of text whose anchors are searched at a time, in the cache.
PIECE = 1 << 17
#: Occurrences of an anchor from which it is split by strings.
HOT = 50_000
#: Context rows sorted at a time.
CHUNK = 20_000
#: Pairs of context rows compared at a time.
PART = 1 << 13
#: Groups of at most so many different contexts are compared two by two.
PAIRED = 24


def _slide(values: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every n consecutive values."""
    out, width = values, 1
    while 2 * width <= n:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[: len(values) - n + 1], out[n - width :]) if n > width else out


def anchors(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of the anchors of several texts. All anchors of
    every WINDOW-byte string of a text are among them."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    parts = [none]
    for a, b in batches(blobs, PIECE):
        row, at, found = _anchors(blobs[a:b])
        parts.append((row + a, at, found))
    row, at, found = (np.concatenate(x) for x in zip(*parts))
    return row, at, found


def _anchors(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in blobs], np.int64)
    data = np.frombuffer(b"".join(blobs), np.uint8)
    if len(data) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    prefix = prefix_hashes(data)
    count = len(data) - K + 1
    hashes = mix((prefix[K:] - prefix[:-K]) * powers(BASE_INV, len(prefix))[:count])
    hashes |= U(1)
    least = _slide(hashes, SPAN, np.minimum)
    wide = np.concatenate([np.zeros(SPAN - 1, U), least, np.zeros(SPAN - 1, U)])
    at = np.flatnonzero(_slide(wide, SPAN, np.maximum)[:count] == hashes)
    ends = np.cumsum(sizes)
    row = np.searchsorted(ends, at, side="right")
    inside = (at + K <= ends[row]) & (sizes[row] >= WINDOW)
    row, at = row[inside], at[inside]
    return row, at - (ends - sizes)[row], hashes[at]


def _shared_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, nth) of the anchors that more than one row has; nth
    counts an anchor's rows."""
    import pyarrow as pa

    def find(tables):
        for table in tables:
            ids = np.array(table.column("doc_id").to_pylist(), np.int64)
            blobs = table.column("body").to_pylist()
            for a, b in batches(blobs, 2 << 20):
                # Copies within the batch are left to the first one.
                own: dict[bytes, int] = {}
                for k in np.argsort(ids[a:b], kind="stable") + a:
                    own.setdefault(blobs[k], int(k))
                kept = sorted(own.values())
                row, _, found = anchors([blobs[k] for k in kept])
                # Rows ascend, so that a text's equal anchors become neighbours.
                order = np.argsort(found, kind="stable")
                row, found = row[order], found[order]
                new = np.ones(len(row), bool)
                new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
                doc = ids[np.array(kept, np.int64)[row[new]]]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(found[new].view(np.int64))], names=["doc_id", "hash"])

    def share(tables):
        pending, last, length = None, None, 0
        for table in tables:
            doc, found = table.column("doc_id").to_numpy(), table.column("hash").to_numpy()
            if not len(found):
                continue
            if pending is not None:
                doc, found = np.append(pending[0], doc), np.append(pending[1], found)
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            begin = np.flatnonzero(new)
            nth = np.arange(len(found)) - np.repeat(begin, np.diff(begin, append=len(found)))
            if last is not None and found[0] == last:
                nth[: begin[1] if len(begin) > 1 else len(found)] += length
            several = ~new | np.append(~new[1:], False) | (nth > 0)
            # The last row waits for its successor.
            out = several[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[:-1][out]), pa.array(found[:-1][out]), pa.array(nth[:-1][out])], names=["doc_id", "hash", "nth"]
            )
            pending, last, length = (doc[-1:], found[-1:]), found[-1], int(nth[-1])
        if pending is not None and length:
            yield pa.RecordBatch.from_arrays([pa.array(pending[0]), pa.array(pending[1]), pa.array([length])], names=["doc_id", "hash", "nth"])

    found = docs.mapInArrow(find, "doc_id long, hash long")
    return found.repartition("hash").sortWithinPartitions("hash").mapInArrow(share, "doc_id long, hash long, nth long")


def _short(hashes: np.ndarray) -> np.ndarray:
    """The part of the hashes that travels with the documents; the whole ones
    tell contexts apart later."""
    return (hashes & U(0x7FFFFFFF)).astype(np.int32)


def _contexts(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, row, at, left, right, context) of the occurrences
    of the anchors in ``hashes``; left and right tell how many bytes of the
    sides are there, the rest is zero."""
    import pyarrow as pa

    names = ["hash", "doc_id", "row", "at", "left", "right", "context"]

    def run(tables):
        for table in tables:
            ids, keys = table.column("doc_id").to_numpy(), table.column("row").to_numpy()
            blobs, hashes = table.column("body").to_pylist(), table.column("hashes")
            for a, b in batches(blobs, 2 << 20):
                which, at, found = anchors(blobs[a:b])
                wanted = np.unique(np.concatenate([hashes[k].values.to_numpy() for k in range(a, b)]))
                hit = np.isin(_short(found), wanted)
                which, at, found = which[hit], at[hit], found[hit]
                sizes = np.array([len(x) for x in blobs[a:b]], np.int64)
                # Every place of the texts as one value of WIDTH bytes.
                data = b"".join([bytes(SIDE), *blobs[a:b], bytes(WIDTH)])
                wide = np.ndarray(len(data) - WIDTH + 1, f"V{WIDTH}", data, strides=(1,))
                left, right = np.minimum(at, SIDE), np.minimum(sizes[which] - at - K, SIDE)
                place = (np.cumsum(sizes) - sizes)[which] + at
                for lo in range(0, len(which), 1 << 14):
                    part = slice(lo, lo + (1 << 14))
                    body = wide[place[part]].view(np.uint8).reshape(-1, WIDTH)
                    edge = np.flatnonzero((left[part] < SIDE) | (right[part] < SIDE))
                    column = np.arange(WIDTH)
                    outside = (column < (SIDE - left[part][edge])[:, None]) | (column >= (SIDE + K + right[part][edge])[:, None])
                    body[edge] = np.where(outside, 0, body[edge])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found[part].view(np.int64)), pa.array(ids[a:b][which[part]]), pa.array(keys[a:b][which[part]]),
                            pa.array(at[part]), pa.array(left[part].astype(np.int32)), pa.array(right[part].astype(np.int32)),
                            pa.FixedSizeBinaryArray.from_buffers(
                                pa.binary(WIDTH), len(body), [None, pa.py_buffer(np.ascontiguousarray(body))]
                            ).cast(pa.binary()),
                        ],
                        names=names,
                    )

    return docs.mapInArrow(run, "hash long, doc_id long, row long, at long, left int, right int, context binary")


class Suffixes:
    """Suffixes of byte rows, compared byte by byte, many pairs at a time."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def _differ(self, x: np.ndarray, y: np.ndarray):
        """(pairs, where their bytes differ) of rows x and y, in parts that
        stay in the cache."""
        for k in range(0, len(x), PART):
            part = slice(k, k + PART)
            yield part, np.take(self.rows, x[part], axis=0) != np.take(self.rows, y[part], axis=0)

    def extension(self, x: np.ndarray, y: np.ndarray, begin: np.ndarray, most: int = WINDOW) -> np.ndarray:
        """The common extension of rows x and y from ``begin`` on, up to ``most``."""
        out = np.empty(len(x), np.int64)
        column = np.arange(self.rows.shape[1])
        for part, differ in self._differ(x, y):
            differ &= column >= begin[part, None]
            differ[:, -1] |= ~differ.any(axis=1)
            end = differ.argmax(axis=1)
            # The last byte may be set above: it is looked at itself.
            end += self.rows[x[part], end] == self.rows[y[part], end]
            out[part] = np.minimum(end - begin[part], most)
        return out

    def around(self, x: np.ndarray, y: np.ndarray, middle: int) -> tuple[np.ndarray, np.ndarray]:
        """The common extensions of rows x and y to the left and to the right
        of ``middle``."""
        left, right = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for part, differ in self._differ(x, y):
            ends = np.ones((len(differ), 1), bool)
            left[part] = np.concatenate([differ[:, middle - 1 :: -1], ends], axis=1).argmax(axis=1)
            right[part] = np.concatenate([differ[:, middle:], ends], axis=1).argmax(axis=1)
        return left, right

    def before(self, x: np.ndarray, y: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the first WINDOW bytes of x sort before, with or after y's."""
        n = self.extension(x, y, begin)
        at = np.minimum(begin + n, self.rows.shape[1] - 1)
        sign = np.sign(self.rows[x, at].astype(np.int64) - self.rows[y, at].astype(np.int64))
        return np.where(n >= WINDOW, 0, sign)

    def sort(self, row: np.ndarray, begin: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The order that sorts the suffixes of each segment (equal adjacent
        numbers), by a bottom-up mergesort of all segments at once."""
        order = np.arange(len(row))
        starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        sizes = np.diff(starts, append=len(row))
        first = np.repeat(starts, sizes)
        last = first + np.repeat(sizes, sizes)
        width, largest = 1, int(sizes.max())
        while width < largest:
            place = np.arange(len(row))
            run = first + (place - first) // width * width
            odd = ((place - first) // width) % 2 == 1
            other = np.where(odd, run - width, run + width)
            other_end = np.minimum(other + width, last)
            paired = np.flatnonzero(other < last)
            low, high = other[paired].copy(), other_end[paired].copy()
            me, late = order[paired], odd[paired]
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                them = order[middle]
                sign = self.before(row[them], row[me[open_]], begin[them])
                # Equal ones of the left run stay in front.
                goes = (sign < 0) | ((sign == 0) & late[open_])
                low[open_[goes]] = middle[goes] + 1
                high[open_[~goes]] = middle[~goes]
            target = place.copy()
            base = np.minimum(run[paired], other[paired])
            target[paired] = base + (place[paired] - run[paired]) + (low - other[paired])
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, 2 * width
        return order


def repeats(group: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, begin) of every WINDOW-byte string of the contexts (sorted by
    group) that a context of the same group from a smaller document has."""
    columns = np.arange(SIDE + 1)
    inside = (columns >= (SIDE - left)[:, None]) & (columns + WINDOW <= (SIDE + K + right)[:, None])
    # Equal contexts of a group count once, for their smallest document.
    whole = (BYTE_VALUE[rows] * powers(BASE, WIDTH)).sum(axis=1, dtype=U)
    whole = whole * U(BASE) + (left * 64 + right).astype(U)
    order = np.lexsort((doc, whole, group))
    new = np.append(True, (group[order][1:] != group[order][:-1]) | (whole[order][1:] != whole[order][:-1]))
    heads = order[new]
    head = np.empty(len(rows), np.int64)
    head[order] = np.repeat(heads, np.diff(np.flatnonzero(new), append=len(order)))
    if (rows != rows[head]).any() or (left != left[head]).any() or (right != right[head]).any():
        return _by_bytes(group, doc, inside, rows)
    removed = np.zeros(inside.shape, bool)
    removed[heads] = _distinct_repeats(group[heads], doc[heads], inside[heads], rows[heads])
    copies = np.flatnonzero(head != np.arange(len(rows)))
    later = (doc[copies] > doc[head[copies]])[:, None]
    removed[copies] = np.where(later, inside[copies], removed[head[copies]])
    return np.nonzero(removed)


def _distinct_repeats(group: np.ndarray, doc: np.ndarray, inside: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The strings (a row's column) of different contexts, sorted by group,
    that a context of the same group from a smaller document has."""
    found = Suffixes(rows)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(starts, append=len(group))
    size = np.repeat(sizes, sizes)
    removed = _paired_repeats(found, np.where(size <= PAIRED, np.repeat(np.arange(len(starts)), sizes), -1), doc, inside)
    x = np.flatnonzero(size > PAIRED)
    if len(x):
        removed[x] = _class_repeats(group[x], doc[x], inside[x], rows[x])
    return removed


def _ranked(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of each group by their bytes from SIDE on, and
    the common extension of each with the one before (-1: the first)."""
    found, begin = Suffixes(rows), np.full(len(rows), SIDE)
    order = found.sort(np.arange(len(rows)), begin, group)
    common = np.full(len(rows), -1)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    common[near] = found.extension(order[near], order[near - 1], begin[near])
    return order, common


def _class_repeats(group: np.ndarray, doc: np.ndarray, inside: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The same for groups of any size: a string is shared by the contexts
    that agree from the anchor to its end and, read backwards, to its begin."""
    after, ahead = _ranked(rows, group)
    before, back = _ranked(np.ascontiguousarray(rows[:, ::-1]), group)
    removed = np.zeros(inside.shape, bool)
    right, left = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for o in range(SIDE + 1):
        x = np.flatnonzero(inside[:, o])
        if not len(x):
            continue
        right[after] = np.cumsum(ahead < K + o)
        left[before] = np.cumsum(back < WINDOW - o)
        key = left[x] * (len(rows) + 1) + right[x]
        order = np.argsort(key)
        x, key = x[order], key[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        smallest = np.repeat(np.minimum.reduceat(doc[x], heads), np.diff(heads, append=len(x)))
        removed[x, o] = doc[x] > smallest
    return removed


def _paired_repeats(found: Suffixes, group: np.ndarray, doc: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The same for small groups (others have group -1): the common extensions
    of two contexts to the left and right of the anchor give all the strings
    that they share."""
    rows = found.rows
    marks = np.zeros((len(rows), SIDE + 2), np.int32)
    least, most, some = inside.argmax(axis=1), SIDE - inside[:, ::-1].argmax(axis=1), inside.any(axis=1)
    for d in range(1, PAIRED):
        x = np.flatnonzero((group[d:] == group[:-d]) & (group[d:] >= 0))
        if not len(x):
            break
        y = x + d
        x, y = np.where(doc[x] > doc[y], x, y), np.where(doc[x] > doc[y], y, x)
        x, y = x[doc[x] > doc[y]], y[doc[x] > doc[y]]
        left, right = found.around(x, y, SIDE)
        first, last = SIDE - left, right + SIDE - WINDOW
        hit = np.flatnonzero(first <= last)
        x, y, first, last = x[hit], y[hit], first[hit], last[hit]
        # Padding never counts: a string must lie inside both contexts.
        low = np.maximum(first, np.maximum(least[x], least[y]))
        high = np.minimum(last, np.minimum(most[x], most[y]))
        good = (low <= high) & some[x] & some[y]
        np.add.at(marks, (x[good], low[good]), 1)
        np.add.at(marks, (x[good], high[good] + 1), -1)
    return marks[:, :-1].cumsum(axis=1) > 0


def _by_bytes(group, doc, inside, rows) -> tuple[np.ndarray, np.ndarray]:
    """``repeats`` without hashes, for a chunk in which two collided."""
    first: dict = {}
    places = list(zip(*np.nonzero(inside)))
    for x, o in places:
        key = (group[x], o, rows[x, o : o + WINDOW].tobytes())
        first[key] = min(first.get(key, doc[x]), doc[x])
    late = [(int(x), int(o)) for x, o in places if doc[x] > first[group[x], o, rows[x, o : o + WINDOW].tobytes()]]
    return np.array([x for x, _ in late], np.int64), np.array([o for _, o in late], np.int64)


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted intervals with those that touch joined."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    heads = np.flatnonzero(new)
    return begin[heads], end[np.append(heads[1:], len(end)) - 1]


def _bytes_of(contexts) -> np.ndarray:
    """The rows of a binary column whose values all have WIDTH bytes."""
    data = np.frombuffer(contexts.buffers()[2], np.uint8) if len(contexts) else np.empty(0, np.uint8)
    begin = np.frombuffer(contexts.buffers()[1], np.int32)[contexts.offset] if len(contexts) else 0
    return data[begin : begin + len(contexts) * WIDTH].reshape(-1, WIDTH)


def _sorted_repeats(contexts: DataFrame) -> DataFrame:
    """(doc_id, row, begin, end) of removed bytes, from the contexts."""
    import pyarrow as pa

    def emit(columns):
        group, doc, key, at, left, right, body = columns
        rows = body
        for lo, hi in _chunks(group):
            part = slice(lo, hi)
            x, o = repeats(group[part], doc[part], left[part], right[part], rows[part])
            if not len(x):
                continue
            # Neighbouring strings of one context overlap: one interval each run.
            new = np.append(True, (x[1:] != x[:-1]) | (o[1:] - o[:-1] > WINDOW))
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(x)) - 1
            place = at[part][x[heads]] - SIDE
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[part][x[heads]]), pa.array(key[part][x[heads]]), pa.array(place + o[heads]), pa.array(place + o[tails] + WINDOW)],
                names=["doc_id", "row", "begin", "end"],
            )

    def _chunks(group):
        starts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        lo = 0
        for k in range(1, len(starts)):
            if starts[k] - lo >= CHUNK or k == len(starts) - 1:
                yield lo, starts[k]
                lo = starts[k]

    def read(table):
        return [
            *(table.column(c).to_numpy() for c in ("hash", "doc_id", "row", "at", "left", "right")),
            _bytes_of(table.column("context")),
        ]

    def join(parts):
        return [np.concatenate(columns) for columns in zip(*parts)]

    def run(tables):
        waiting, count = [], 0
        for table in tables:
            if not table.num_rows:
                continue
            waiting.append(read(table))
            count += table.num_rows
            if count < CHUNK or waiting[0][0][0] == waiting[-1][0][-1]:
                continue
            whole = join(waiting)
            group = whole[0]
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1
            yield from emit([c[:cut] for c in whole])
            waiting, count = [[c[cut:].copy() for c in whole]], len(group) - cut
        if waiting:
            yield from emit(join(waiting))

    dealt = contexts.repartition("hash").sortWithinPartitions("hash", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, row long, begin long, end long")


def _hot_repeats(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many occurrences: the smallest document
    of every string by a partial minimum, joined back."""
    begins = F.sequence(SIDE - F.col("left"), K + F.col("right") - (WINDOW - SIDE))
    strings = contexts.where(F.col("left") + F.col("right") >= SIDE).withColumn("o", F.explode(begins))
    strings = strings.withColumn("string", F.substring("context", F.col("o") + 1, F.lit(WINDOW))).drop("context")
    least = strings.groupBy("hash", "o", "string").agg(F.min("doc_id").alias("least"))
    late = strings.join(least, ["hash", "o", "string"]).where("doc_id > least")
    return late.select("doc_id", "row", (F.col("at") - SIDE + F.col("o")).alias("begin"), (F.col("at") - SIDE + F.col("o") + WINDOW).alias("end"))


def _cut(docs: DataFrame) -> DataFrame:
    """(doc_id, body_hash, n_removed, n_spans, kept_sha256) of documents
    (doc_id, body_hash, body, spans)."""
    import pyarrow as pa

    def run(tables):
        for table in tables:
            if not table.num_rows:
                continue
            bodies, spans = table.column("body").to_pylist(), table.column("spans")
            sizes = np.array([len(x) for x in bodies], np.int64)
            # Places of all texts one after the other, with a gap.
            wide = int(sizes.max(initial=0)) + 1
            which = np.repeat(np.arange(len(bodies)), np.diff(spans.offsets.to_numpy()))
            begin, end = (x.to_numpy() + which * wide for x in spans.flatten().flatten())
            begin, end = _runs(begin, end)
            row = begin // wide
            bound = np.searchsorted(row, np.arange(len(bodies) + 1))
            total = np.append(0, np.cumsum(end - begin))
            removed, runs = total[bound[1:]] - total[bound[:-1]], np.diff(bound)
            edges, digests = np.stack([begin - row * wide, end - row * wide], axis=1).ravel().tolist(), []
            for body, lo, hi in zip(bodies, bound[:-1].tolist(), bound[1:].tolist()):
                kept = [0, *edges[2 * lo : 2 * hi], len(body)]
                digest = hashlib.sha256()
                for a, b in zip(kept[::2], kept[1::2]):
                    digest.update(body[a:b])
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id"), table.column("body_hash"),
                    pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()),
                ],
                names=["doc_id", "body_hash", "n_removed", "n_spans", "kept_sha256"],
            )

    return docs.mapInArrow(run, "doc_id long, body_hash long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of
    ``docs`` (doc_id, text as UTF-8 bytes): removed is each byte covered by a
    WINDOW-byte string that also starts in a row with a smaller doc_id.

    Null texts are empty; a null doc_id removes nothing and has nothing
    removed; rows that repeat a doc_id are not smaller than each other; texts
    shorter than WINDOW bytes stay whole; an empty table gives an empty result.
    """
    shared = Shared(spark, "substrings")
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    docs = docs.withColumn("body_hash", F.xxhash64("body"))

    # Copies of a text need no search: all but the first go entirely. They
    # are told apart by two hashes and the size of the text.
    rows = docs.select("doc_id", "body_hash", F.sha2("body", 256).alias("sha"), F.length("body").cast("long").alias("n_bytes"))
    rows = shared.table(rows)
    firsts = rows.where(f"doc_id is not null and n_bytes >= {WINDOW}").groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("least"))
    status = rows.join(firsts, ["sha", "n_bytes"], "left")
    searched = docs.where(F.col("doc_id").isNotNull() & (F.length("body") >= WINDOW))
    several, several_path = shared.write(_shared_anchors(searched.select("doc_id", "body")))
    hot = shared.table(several.where(F.col("nth") == HOT).select("hash"))
    short = F.col("hash").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    wanted = several.groupBy("doc_id").agg(F.collect_list(short).alias("hashes"))
    single = status.where("doc_id = least").select("doc_id", "body_hash").distinct()
    wanted = wanted.join(single, "doc_id")
    places = searched.join(wanted, ["doc_id", "body_hash"])
    places = shared.table(places.withColumn("row", F.monotonically_increasing_id()))
    shared.drop(several_path)
    found, found_path = _contexts(places), None
    if hot.isEmpty():
        spans = _sorted_repeats(found)
    else:
        found, found_path = shared.write(found)
        spans = _sorted_repeats(found.join(hot, "hash", "left_anti")).unionByName(_hot_repeats(found.join(hot, "hash")))
    # Written before the texts are dealt again: what the contexts shuffled goes first.
    spans = shared.table(spans.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    if found_path:
        shared.drop(found_path)
    cut = places.select("row", "doc_id", "body_hash", "body").join(spans, "row")
    cut = _cut(cut).dropDuplicates(["doc_id", "body_hash"])

    out = status.join(cut, ["doc_id", "body_hash"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
