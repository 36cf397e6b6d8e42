"""Importance resampling of documents towards a target distribution.

Documents are described by hashed runs of words: every run of 1 to ``runs``
words falls into the bucket crc32(run) modulo ``buckets``. A bucket that is
more frequent in the target texts than in the corpus has a positive gain, and
a document weighs the sum of its features' gains. Gumbel noise from a hash of
its id turns the weights into a draw without replacement.

Three passes over the texts, each one scan without a shuffle of words:

1. the head of the vocabulary: the words of each task are counted in a bounded
   table (a word above 1/HELD of the task's words cannot be lost), the tables
   are added up and the HEAD most frequent words stay; the same for pairs;
2. bucket totals: the head's words carry their CRC state (the CRC of a longer
   run goes on from it) and the head's pairs their bucket in a broadcast table
   of bounded size; any other feature takes its CRC directly. Both count into
   the same exact totals, a fixed number of sums a task;
3. weights: the same look-ups sum up the gains of each document.

The head only saves time: every feature has the same bucket with any head.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campusflow.llm.common import Shared

#: Frequent words and pairs that are broadcast; longer ones are left to the tail.
HEAD = 1 << 16
HEAD_BYTES = 40
#: Words or pairs that a task counts at once.
HELD = 1 << 17
#: Bytes of a text whose words are held at once.
PIECE = 4 << 20
SEED = 2024
MIN_WORDS = 20

# A-Z are lower-cased; the rest of ASCII but digits and letters separates words.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLD = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS, bytes(range(97, 123)) + b" " * len(_SEPARATORS))


class Vocabulary:
    """The head: CRC state by word, bucket by pair; other features by CRC."""

    def __init__(self, words: list[bytes], pairs: list[bytes], buckets: int):
        self.buckets = buckets
        self.state = _States((w, zlib.crc32(w)) for w in words)
        self.pair = _Pairs({}, buckets)
        for pair in pairs:
            first, _, second = pair.partition(b" ")
            self.pair[first, second] = zlib.crc32(pair) % buckets

    def features(self, words: list[bytes], runs: int) -> np.ndarray:
        """Bucket of every run of 1 to ``runs`` words."""
        if not words:
            return np.empty(0, np.int64)
        state = list(map(self.state.__getitem__, words))
        out = [np.array(state, np.int64) % self.buckets]
        if runs >= 2:
            out.append(np.array(list(map(self.pair.__getitem__, zip(words, words[1:]))), np.int64))
        if runs >= 3:
            state = [zlib.crc32(b" " + w, s) for s, w in zip(state, words[1:])]
        for n in range(3, runs + 1):
            state = [zlib.crc32(b" " + w, s) for s, w in zip(state, words[n - 1 :])]
            out.append(np.array(state, np.int64) % self.buckets)
        return np.concatenate(out)


class _States(dict):
    """CRC states; words of the tail are computed and not kept."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class _Pairs(dict):
    def __init__(self, known: dict, buckets: int):
        super().__init__(known)
        self.buckets = buckets

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return zlib.crc32(b" ".join(pair)) % self.buckets


def pieces(text: bytes | None, overlap: int):
    """Lists of a text's words that hold every run of at most ``overlap`` + 1
    words once: (words, how many of them the list before ended with)."""
    if not text:
        return
    if len(text) <= PIECE:
        yield text.translate(FOLD).split(), 0
        return
    folded, at, kept = text.translate(FOLD), 0, []
    while at < len(folded):
        cut = folded.find(b" ", at + PIECE)
        cut = len(folded) if cut < 0 else cut
        words = folded[at:cut].split()
        yield kept + words, len(kept)
        kept = (kept + words)[-overlap:] if overlap else []
        at = cut


def text_features(text: bytes | None, vocabulary: Vocabulary, runs: int):
    """Buckets of a text's features, piece by piece, and the words of each piece."""
    for words, old in pieces(text, runs - 1):
        found = vocabulary.features(words, runs)
        if old:
            # Runs inside the words kept from the piece before are counted there.
            again = vocabulary.features(words[:old], runs)
            yield found, again, len(words) - old
        else:
            yield found, None, len(words)


def _counted(counts: Counter, most: int) -> None:
    """Take the same amount from all counts so that at most ``most`` stay."""
    if len(counts) > 2 * most:
        cut = np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - most - 1)[len(counts) - most - 1]
        left = {w: n - int(cut) for w, n in counts.items() if n > cut}
        counts.clear()
        counts.update(left)


def frequent(batches, runs: int):
    """The frequent words and pairs of a partition with (under)counts."""
    words_seen, pairs_seen = Counter(), Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for words, old in pieces(text, 1):
                words_seen.update(words[old:])
                _counted(words_seen, HELD)
                if runs >= 2:
                    pairs_seen.update(zip(words, words[1:]))
                    _counted(pairs_seen, HELD)
    for pair, seen in ((False, words_seen), (True, pairs_seen)):
        items = seen.most_common(HELD)
        for a in range(0, len(items), 10_000):
            part = items[a : a + 10_000]
            keys = [b" ".join(x) if pair else x for x, _ in part]
            yield pa.record_batch([pa.array([pair] * len(part)), pa.array(keys, pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["pair", "run", "n"])


def totals(batches, vocabulary: Vocabulary, runs: int):
    """How many features of a partition fall into each bucket."""
    seen = np.zeros(vocabulary.buckets, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for found, again, _ in text_features(text, vocabulary, runs):
                seen += np.bincount(found, minlength=vocabulary.buckets)
                if again is not None:
                    seen -= np.bincount(again, minlength=vocabulary.buckets)
    at = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["bucket", "n"])


def weights(batches, vocabulary: Vocabulary, gains: np.ndarray, runs: int):
    """Number of words and features and the summed gain of every text."""
    for batch in batches:
        out = np.zeros((3, batch.num_rows), np.int64)
        for k, text in enumerate(batch.column(1).to_pylist()):
            for found, again, words in text_features(text, vocabulary, runs):
                out[:, k] += (words, len(found), gains[found].sum())
                if again is not None:
                    out[1:, k] -= (len(again), gains[again].sum())
        yield pa.record_batch([batch.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("text").cast("string").cast("binary").alias("text"))


def vocabulary_of(shared: Shared, docs: DataFrame, runs: int, buckets: int) -> Vocabulary:
    """The HEAD most frequent words, and pairs, of all texts."""
    seen = _texts(docs).mapInArrow(lambda batches: frequent(batches, runs), "pair boolean, run binary, n long")
    summed = seen.where(F.octet_length("run") <= HEAD_BYTES).groupBy("pair", "run").agg(F.sum("n").alias("n"))
    if runs >= 2:
        summed = shared.table(summed)

    def head(pair: bool) -> list[bytes]:
        rows = summed.where(F.col("pair") == pair).orderBy(F.desc("n"), "run").limit(HEAD)
        return [bytes(x) for x in rows.select("run").toArrow().column(0).to_pylist()]

    return Vocabulary(head(False), head(True) if runs >= 2 else [], buckets)


def bucket_totals(texts: DataFrame, shared_vocabulary, runs: int, buckets: int) -> np.ndarray:
    counted = _texts(texts).mapInArrow(lambda batches: totals(batches, shared_vocabulary.value, runs), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket, with one more in every bucket."""
    buckets, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((float(y) + 1) * (s + buckets) / ((float(x) + 1) * (t + buckets)))) for x, y in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000, percent: int = 10) -> DataFrame:
    """Weight, score and place in the draw of every document.

    ``docs`` has doc_id and text, ``target`` has text. Returns doc_id,
    n_features, weight, score, rank: of the N documents with at least 20 words
    the floor(percent * N / 100) best scores have a rank (1, 2, ...; ties to
    the smaller doc_id), the others none.

    Null and empty texts have no features and weight 0. Rows that repeat are
    documents each (equal ones tie, in any order). A document without doc_id
    has no noise: its features count, its score and rank are null, and it is
    not one of the N. Empty tables give gains of 0 or no rows; other columns
    are ignored. A text is handled in pieces of 4 MB, so a very long one costs
    its own bytes in memory and no more.
    """
    shared = Shared(spark, "resample")
    vocabulary = spark.sparkContext.broadcast(vocabulary_of(shared, docs, runs, buckets))
    corpus, wanted = (bucket_totals(df, vocabulary, runs, buckets) for df in (docs, target))
    gains = spark.sparkContext.broadcast(gains_of(corpus, wanted))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    weighed = rows.mapInArrow(
        lambda batches: weights(batches, vocabulary.value, gains.value, runs),
        "doc_id long, n_words long, n_features long, weight long",
    )
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    scored = shared.table(weighed.withColumn("score", F.col("weight") + gumbel))
    return ranked(shared, scored, percent)


def ranked(shared: Shared, scored: DataFrame, percent: int) -> DataFrame:
    """Adds the rank of the documents drawn. The documents that may be drawn
    are sorted in range partitions; a row's rank is its place in the partition
    plus the rows of the partitions before, so no task sees them all."""
    eligible = (F.col("n_words") >= MIN_WORDS) & F.col("score").isNotNull()
    few = scored.where(eligible).count() * percent // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = scored.where(eligible).repartitionByRange(*order).sortWithinPartitions(*order).select(*columns, F.monotonically_increasing_id().alias("at"))
    placed = shared.table(placed.select(*columns, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("before"))
    rank = F.col("place") + F.col("before") + 1
    drawn = placed.join(before, "part").select(*columns, F.when(rank <= few, rank).alias("rank"))
    return drawn.unionByName(scored.where(~eligible).select(*columns, F.lit(None).cast("long").alias("rank")))
