"""Best-fit packing of tokenised documents into fixed-length sequences.

Large-item matching: pieces above a third of the capacity go at most two to a
sequence and are matched greedily, smaller ones best-fit the remaining gaps.

The packing is decided on the *histogram* of piece lengths (at most
``capacity`` numbers, whatever the corpus size): the plan says, for the ranks
r0..r1 among the pieces of one length, which sequences and offsets they take.
Every piece then looks its place up from its rank among equals, so no piece
list ever passes through one task. Ranks come from per-(length, salt) row
numbers plus the totals of the salts before; the number of salts follows the
number of pieces, so a length shared by a third of all pieces is split too.
"""

from __future__ import annotations

import itertools
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campusflow.llm.common import Shared
from campusflow.llm.wordhash import batches

CAPACITY = 2048
#: Pieces per salt of one length: what one window group holds at most, on average.
PER_SALT = 100_000
MIN_SALTS = 256
#: Distinct words whose ids a worker remembers.
MEMORY = 500_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long"


class _Numbers(dict):
    """Numbers words by first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _grown(array: np.ndarray, least: int) -> np.ndarray:
    while len(array) < least:
        array = np.concatenate([array, np.zeros_like(array)])
    return array


class WordTokenizer:
    """Token ids of whole texts, remembering the ids of each blank-separated
    word. Valid for tokenizers that lower-case, drop white space and keep
    letters apart from punctuation, as word_bpe_49k does.

    Words are kept as bytes with A-Z lower-cased; texts with a ``<|``, which
    may begin a special token, are encoded as they are. The words beyond
    MEMORY are encoded together for each batch and then forgotten.
    """

    JOINED = 500
    STOPS = (b".", b",")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.number = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 1
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.number[b""]  # word 0 is the closing id of a document
        self.size[0] = 1
        self._learn(list(self.STOPS))

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The tokenizer of this worker process, which remembers its words
        from task to task."""
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def _store(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.flat = _grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin, self.size = _grown(self.begin, len(self.number)), _grown(self.size, len(self.number))
        self.begin[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.used += len(ids)

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words, one after the other, and their ends."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.begin[numbers] - (ends - sizes), sizes) + np.arange(total)], ends

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids."""
        if any("<|" in w for w in words) or not unicodedata.is_normalized("NFC", "".join(words)):
            found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            return np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], "<u4")
        groups = [words[k : k + self.JOINED] for k in range(0, len(words), self.JOINED)]
        sizes, ids = [], []
        for group in groups:
            e = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            at = np.array(e.word_ids, np.int64)
            if not all(map(str.isalpha, group)) or at[-1] != len(group) - 1:
                ends = np.cumsum([len(w) + 1 for w in group])
                at = np.searchsorted(ends, np.array([o[0] for o in e.offsets], np.int64), side="right")
            sizes.append(np.bincount(at, minlength=len(group)))
            ids.append(np.array(e.ids, "<u4"))
        return np.concatenate(sizes), np.concatenate(ids)

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode new words; a word and its closing stop are encoded apart."""
        number, whole, stopped = self.number, {}, []
        for word in fresh:
            text = word.decode("utf-8", "replace")
            if word[-1:] in self.STOPS and text[:-1].isalpha():
                known = len(number)
                stem = number[word[:-1]]
                if stem == known:
                    whole[stem] = text[:-1]
                stopped.append((number[word], stem, number[word[-1:]]))
            else:
                whole[number[word]] = text
        letters = [(n, w) for n, w in whole.items() if w.isalpha()]
        others = [(n, w) for n, w in whole.items() if not w.isalpha()]
        for part in (letters, others):
            if part:
                self._store(np.array([n for n, _ in part]), *self._encode([w for _, w in part]))
        if stopped:
            both = np.array(stopped, np.int64)
            ids, ends = self.ids_of(both[:, 1:].ravel())
            self._store(both[:, 0], self.size[both[:, 1]] + self.size[both[:, 2]], ids)

    def batch(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, a 0 after each text's, and the bounds of the texts."""
        words, counts = [], []
        for text in texts:
            before = len(words)
            if text is not None:
                words += [text] if b"<|" in text else text.lower().split()
            words.append(b"")
            counts.append(len(words) - before)
        known = len(self.number)
        at = np.array(list(map(self.number.__getitem__, words)), np.int64)
        fresh = list(itertools.islice(self.number, known, None)) if len(self.number) > known else []
        kept = known, self.used
        if fresh:
            self._learn(fresh)
        ids, ends = self.ids_of(at)
        bound = np.concatenate([[0], ends[np.cumsum(counts) - 1]]) if counts else np.zeros(1, np.int64)
        if len(self.number) > MEMORY:
            for word in list(itertools.islice(self.number, kept[0], None)):
                del self.number[word]
            self.used = kept[1]
        return ids, bound


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids
    and a closing 0, cut every ``capacity`` tokens. A null text counts as
    empty and gives the closing 0 alone; each repeated row gives its pieces."""

    def run(tables):
        import pyarrow as pa

        words = WordTokenizer.of(tokenizer or tokenizer_path())
        for table in tables:
            texts = table.column("text").to_pylist()
            for a, b in batches(texts):
                ids, bound = words.batch(texts[a:b])
                sizes = bound[1:] - bound[:-1]
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                first = bound[row] + start
                crc = [zlib.crc32(ids[i : i + n]) for i, n in zip(first.tolist(), length.tolist())]
                doc_id = table.column("doc_id").slice(a, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, PIECE)


class _Bins:
    """Open sequences by the gap left in them, as ranges of sequence numbers."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_gap: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.count = [0] * (capacity + 1)
        self.made = 0

    def new(self, n: int) -> tuple[int, int]:
        self.made += n
        return self.made - n, n

    def put(self, gap: int, first: int, n: int) -> None:
        self.by_gap[gap].append((first, n))
        self.count[gap] += n

    def take(self, gap: int, most: int) -> tuple[int, int]:
        first, n = self.by_gap[gap].pop()
        if n > most:
            self.by_gap[gap].append((first + most, n - most))
            n = most
        self.count[gap] -= n
        return first, n

    def fitting(self, length: int) -> int:
        """The smallest gap of an open sequence that is long enough, or 0."""
        for gap in range(length, self.capacity + 1):
            if self.count[gap]:
                return gap
        return 0


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first sequence, pieces per sequence, offset)
    that place every rank of every length, and the number of sequences."""
    left = {int(k): int(n) for k, n in histogram.items() if n}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = _Bins(capacity)

    def place(length: int, n: int, first: int, each: int, gap: int) -> None:
        """n pieces of one length into sequences from ``first`` on."""
        runs.append((length, rank[length], first, each, capacity - gap))
        rank[length] += n
        left[length] -= n

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    # The longest pieces take the longest partner above a third that fits.
    for a in (k for k in large if 2 * k > capacity):
        for b in (k for k in large if 2 * k <= capacity and k <= capacity - a):
            if n := min(left[a], left[b]):
                first, _ = bins.new(n)
                place(a, n, first, 1, capacity)
                place(b, n, first, 1, capacity - a)
                bins.put(capacity - a - b, first, n)
        if n := left[a]:
            first, _ = bins.new(n)
            place(a, n, first, 1, capacity)
            bins.put(capacity - a, first, n)
    # Those between a third and a half that are left go two by two.
    odd = None
    for b in (k for k in large if 2 * k <= capacity):
        if odd is not None and left[b]:
            first, gap = odd
            place(b, 1, first, 1, gap)
            bins.put(gap - b, first, 1)
            odd = None
        if n := left[b] // 2:
            first, _ = bins.new(n)
            place(b, 2 * n, first, 2, capacity)
            bins.put(capacity - 2 * b, first, n)
        if left[b]:
            first, _ = bins.new(1)
            place(b, 1, first, 1, capacity)
            odd = (first, capacity - b)
    if odd is not None:
        bins.put(odd[1], odd[0], 1)
    # Best fit of the small ones, longest first.
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            gap = bins.fitting(s)
            if not gap:
                each = capacity // s
                first, n = bins.new(-(-left[s] // each))
                bins.put(capacity, first, n)
                gap = capacity
            each = min(gap // s, left[s])
            first, n = bins.take(gap, left[s] // each)
            place(s, n * each, first, each, gap)
            bins.put(gap - each * s, first, n)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), bins.made


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most
    ``capacity`` tokens: one row per piece with its sequence and offset.

    Null text counts as empty, repeated rows are packed each, an empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    shared = Shared(spark, "packing")
    pieces = shared.table(tokenized_pieces(docs, tokenizer, capacity))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _ = plan(histogram, capacity)
    salts = max(MIN_SALTS, sum(histogram.values()) // PER_SALT)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(
        "length", "salt",
        (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches):
        key = (runs[:, 0] << 44) | runs[:, 1]
        for b in batches:
            at = np.searchsorted(key, (b.length.to_numpy() << 44) | b["rank"].to_numpy(), side="right") - 1
            nth = b["rank"].to_numpy() - runs[at, 1]
            b["sequence_id"] = runs[at, 2] + nth // runs[at, 3]
            b["offset"] = runs[at, 4] + nth % runs[at, 3] * b.length.to_numpy()
            yield b.drop(columns="rank").astype({"doc_id": "Int64"})

    return ranked.mapInPandas(run, PLACED)
