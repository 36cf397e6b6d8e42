"""Benchmark decontamination: n-gram seeds, then Smith-Waterman.

1. Seeds are the SEED-word n-grams of the benchmark items. The items are dealt
   into blocks of about SEED_BLOCK seeds, and one scan of the corpus per block
   finds every occurrence of any seed (sorted hashes), so what a task holds is
   bounded however large the benchmark is.
2. Occurrences on nearby diagonals make one candidate (document, item, region).
   No seed is dropped, however many documents hold it: a copy may have kept
   only seeds that are common in the corpus. Candidates are made and judged
   inside the scan, so frequent seeds cost alignments but no rows.
3. A score needs its matches: a region that holds too few of the item's words
   for THRESHOLD is passed over without an alignment, which loses nothing.
4. The item is aligned with the region's words (match 2, mismatch -1, gap -1).
   score is the alignment score over that of a full match; pairs from
   THRESHOLD on are contaminated, so edited and paraphrased copies count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.llm.common import Shared
from campusflow.llm.wordhash import batches, ngrams, text_words

SEED = 4
SEED_BLOCK = 1_000_000
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells (pairs x window words) aligned at a time; seed occurrences x items
#: expanded at a time.
CELLS = 1 << 20

HIT = "doc_id long, item_id long, score double, seeds long, doc_start long, doc_end long"


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words, words) of the items that have a seed."""

    def run(frames):
        for f in frames:
            hashes, bound = text_words(f.text.tolist())
            sizes = bound[1:] - bound[:-1]
            out = pd.DataFrame({
                "item_id": f.item_id,
                "n_words": sizes,
                "words": [hashes[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:])],
            })
            yield out[sizes >= SEED]

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.where("item_id is not null").mapInPandas(run, "item_id long, n_words long, words binary")


class Block:
    """Items (item_id, words) with the places of their seeds: ``items`` and
    ``places`` from first[k] to first[k + 1] are those of the k-th seed."""

    def __init__(self, item_ids, words: list[bytes]):
        arrays = [np.frombuffer(w, np.uint64) for w in words]
        self.item_ids = np.asarray(item_ids, np.int64)
        self.words = np.concatenate(arrays)
        self.bound = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
        grams = [ngrams(x, SEED) for x in arrays]
        counts = [len(g) for g in grams]
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        self.seeds, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.items = np.repeat(np.arange(len(grams), dtype=np.int32), counts)[order]
        self.places = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])[order]

    def sizes(self, items: np.ndarray) -> np.ndarray:
        return self.bound[items + 1] - self.bound[items]

    def candidates(self, hashes: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, region, seeds) of the regions of several texts (their
        words' hashes and bounds) with any seed, and how many are there."""
        grams = ngrams(hashes, SEED)
        at = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[at] == grams)
        row = np.searchsorted(bound, hit, side="right") - 1
        inside = hit + SEED <= bound[row + 1]
        hit, row = hit[inside], row[inside]
        at = at[hit]
        regions = int((bound[1:] - bound[:-1]).max()) + 2
        times = self.first[at + 1] - self.first[at]
        done = np.cumsum(times)
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        begin = 0
        while begin < len(hit):
            end = max(begin + 1, int(np.searchsorted(done, done[begin] - times[begin] + CELLS, side="right")))
            n = times[begin:end]
            from_seed = np.repeat(self.first[at[begin:end]], n)
            entry = from_seed + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, text = self.items[entry].astype(np.int64), np.repeat(row[begin:end], n)
            diagonal = np.repeat(hit[begin:end], n) - bound[text] - self.places[entry]
            # A diagonal begins at most one item's length before the text.
            region = diagonal // self.sizes(item) + 1
            keys, back = np.unique(np.concatenate([keys, (text * len(self.item_ids) + item) * regions + region]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, np.ones(len(text), np.int64)]), len(keys)).astype(np.int64)
            begin = end
        pair, region = keys // regions, keys % regions - 1
        return pair // len(self.item_ids), pair % len(self.item_ids), region, counts


def padded(words: np.ndarray, start: np.ndarray, end: np.ndarray, fill: int, back: bool = False) -> np.ndarray:
    """words[start:end] (``back``: last first) as rows, filled up to one width."""
    at = np.arange(int((end - start).max()))
    place = end[:, None] - 1 - at if back else start[:, None] + at
    inside = at < (end - start)[:, None]
    return np.where(inside, words[np.where(inside, place, 0)], np.uint64(fill))


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair and the window index at which
    it ends (the first one, on ties)."""
    n, most, width = len(items), max(map(len, items)), max(map(len, windows))
    x, y = np.zeros((n, most), np.uint64), np.ones((n, width), np.uint64)
    for k, (i, w) in enumerate(zip(items, windows)):
        x[k, : len(i)] = i
        y[k, : len(w)] = w
    return _align(x, y)


def _align(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``align`` of the rows of x (items, filled up with 0) and y (1)."""
    (n, most), width = x.shape, y.shape[1]
    lost = -GAP * np.arange(width, dtype=np.int32)
    h = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for k in range(most):
        step = np.where(y == x[:, k : k + 1], MATCH, MISMATCH).astype(np.int32)
        top = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] + GAP), 0)
        h[:, 1:] = np.maximum.accumulate(top + lost, axis=1) - lost
        row = h[:, 1:].max(axis=1)
        better = row > best
        end[better] = h[better, 1:].argmax(axis=1)
        best = np.maximum(best, row)
    return best, end


def possible(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether as many words of each item are in its window as THRESHOLD needs
    matches (never false when they are: words are told apart by some bits)."""
    slots = 1 << (8 * y.shape[1]).bit_length()
    there = np.zeros((len(y), slots), bool)
    row = np.arange(len(y))[:, None]
    there[row, (y & np.uint64(slots - 1)).astype(np.int64)] = True
    shared = there[row, (x & np.uint64(slots - 1)).astype(np.int64)] & (np.arange(x.shape[1]) < sizes[:, None])
    return shared.sum(axis=1) >= THRESHOLD * sizes


def _aligned(block: Block, hashes: np.ndarray, bound: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(text, item, score, seeds, doc_start, doc_end) of the candidates of
    several texts that reach THRESHOLD, in parts."""
    text, item, region, seeds = block.candidates(hashes, bound)
    sizes = block.sizes(item)
    start = bound[text] + np.maximum(0, (region - 1) * sizes)
    end = np.minimum(bound[text + 1], bound[text] + (region + 3) * sizes)
    order = np.flatnonzero(start < end)
    order = order[np.argsort(sizes[order], kind="stable")]
    out, at = [], 0
    while at < len(order):
        ahead = order[at : at + CELLS // (4 * int(sizes[order[at]])) + 1]
        fit = int(np.searchsorted(np.arange(1, len(ahead) + 1) * 4 * sizes[ahead], CELLS, side="right"))
        part = ahead[: max(1, fit)]
        at += len(part)
        x = padded(block.words, block.bound[item[part]], block.bound[item[part] + 1], 0)
        y = padded(hashes, start[part], end[part], 1)
        good = possible(x, y, sizes[part])
        if not good.any():
            continue
        part, x, y = part[good], x[good], y[good]
        best, last = _align(x, y)
        share = best / (MATCH * sizes[part])
        good = share >= THRESHOLD
        if not good.any():
            continue
        part, share, last = part[good], share[good], last[good]
        # The copy begins where the alignment of both read backwards ends.
        x = padded(block.words, block.bound[item[part]], block.bound[item[part] + 1], 0, back=True)
        y = padded(hashes, start[part], start[part] + last + 1, 1, back=True)
        back = _align(x, y)[1]
        begin = start[part] - bound[text[part]]
        out.append((text[part], item[part], share, seeds[part], begin + last - back, begin + last + 1))
    return out


def copies(docs: DataFrame, block: Block) -> DataFrame:
    """The copies of a block's items in every row of ``docs``."""

    def run(frames):
        for f in frames:
            texts = f.text.tolist()
            for a, b in batches(texts):
                hashes, bound = text_words(texts[a:b])
                for text, item, *found in _aligned(block, hashes, bound):
                    yield pd.DataFrame(dict(zip(
                        ["doc_id", "item_id", "score", "seeds", "doc_start", "doc_end"],
                        [f.doc_id.to_numpy()[a:b][text], block.item_ids[item], *found],
                    )))

    return docs.mapInPandas(run, HIT)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, seeds, doc_start, doc_end): every document that
    holds a copy of a benchmark item, with the best copy's score (THRESHOLD to
    1), the seeds found there and its place in words (end exclusive).

    Null and empty texts hold and are nothing; items of fewer than SEED words
    are no evidence and are not searched; rows with a null id are left out;
    rows that repeat a doc_id or item_id give one row per pair of ids. Empty
    tables give an empty result.
    """
    shared = Shared(spark, "decontaminate")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id is not null and text is not null")
    items = shared.table(item_words(benchmark))
    total = items.agg(F.sum(F.col("n_words") - SEED + 1)).first()[0] or 0
    blocks = max(1, -(-total // SEED_BLOCK))
    hits = spark.createDataFrame([], HIT)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "words").toPandas()
        if len(part):
            hits = hits.unionByName(copies(docs, Block(part.item_id, part.words.tolist())))
    best = F.max(F.struct("score", "seeds", "doc_start", "doc_end"))
    return hits.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
