"""Alignment of two tokenizers over whole texts.

Each text is encoded by a byte-level BPE (A, which is given a space before the
text) and by a sentencepiece model (B, which adds that space). Where the tokens
of both spell the same bytes, their byte offsets can be compared: offsets where
both end cut the text into groups, and an A and a B token whose bytes overlap
are linked.

Texts are cut at anchors, offsets where a token of A and one of B that both
begin with a space start, so both tokenizers end a token there. What lies
between two anchors, usually one word, is a window named by its tuples of ids.
Its alignment depends on nothing else and is remembered by the worker; a window
met again costs one look-up, and new ones are aligned together from the sorted
union of both sides' ends.

Encoding remembers words in the same way: both tokenizers begin a new token at
a space between two words, so a text's ids are those of its words.

The links of each text are stored as distinct id pairs with multiplicities;
their corpus counts are one partial aggregation. The counts come back to the
texts as broadcast blocks of a fixed number of pairs, so no link is shuffled
and neither the broadcast nor the driver grows with the corpus: more pairs make
more blocks, each added to the sums of the blocks before.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campusflow.llm.common import Shared
from campusflow.llm.wordhash import batches as batches_of

#: Words and windows, and bytes of them, that a worker remembers.
MEMORY = 250_000
MEMORY_BYTES = 16 << 20
#: Characters encoded at once.
AT_ONCE = 1 << 20
#: Pairs of a broadcast block (17 bytes each).
PAIR_BLOCK = 1 << 21

SPACE = b" "
MARK = "▁"

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<long>"
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string, pairs array<long>, times array<long>"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE writes for bytes: printable Latin-1
    stands for itself, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


#: A space where both tokenizers begin a new token whatever stands around it:
#: between a byte that is no space and a printable ASCII one. The pre-tokenizer
#: of a byte-level BPE begins a piece at the last space before a visible
#: character, and sentencepiece has no piece with a space after another letter.
CUT = re.compile(rb"(?<=[^ ]) (?=[!-~])")


class ByteLevel:
    """Tokenizer A: ids of texts with a space before, and each id's bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        described = json.loads(self.tokenizer.to_str())
        pre = described["pre_tokenizer"] or {}
        self.cuttable = not described["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Tokenizer B: ids of texts, to which it adds a space, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [(k, self.model.id_to_piece(k)) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(k) else p.replace(MARK, " ").encode() for k, p in names]
        self.cuttable = not any(MARK in p.lstrip(MARK) for _, p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Numbers(dict):
    """Numbers keys by first use and counts the uses."""

    def __init__(self, keys=()):
        super().__init__((k, n) for n, k in enumerate(keys))
        self.uses = np.zeros(len(self), np.int64)

    def __missing__(self, key):
        n = self[key] = len(self)
        return n

    def used(self, numbers: np.ndarray) -> None:
        uses = np.bincount(numbers, minlength=len(self))
        uses[: len(self.uses)] += self.uses
        self.uses = uses

    def often(self) -> np.ndarray:
        """Numbers of the most used keys, half the memory at most, in order."""
        repeated = np.flatnonzero(self.uses > 1)
        return np.sort(repeated[np.argsort(-self.uses[repeated], kind="stable")[: MEMORY // 2]])

    def only(self, numbers: np.ndarray) -> _Numbers:
        keys = list(self)
        return _Numbers(keys[k] for k in numbers.tolist())


class _Rows:
    """Rows of integers, one after the other, by number."""

    def __init__(self):
        self.flat, self.used, self.n = np.zeros(1 << 12, np.int64), 0, 0
        self.begin, self.size = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = _grown(self.flat, flat, self.used)
        self.begin = _grown(self.begin, self.used + np.cumsum(sizes) - sizes, self.n)
        self.size = _grown(self.size, sizes, self.n)
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def only(self, numbers: np.ndarray) -> _Rows:
        out = _Rows()
        out.add(*self.of(numbers))
        return out

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some numbers joined, and their sizes."""
        sizes = self.size[numbers]
        return self.flat[_runs(self.begin[numbers], sizes)], sizes


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0]+size[0]-1, begin[1] .. and so on."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _grown(array: np.ndarray, more: np.ndarray, used: int) -> np.ndarray:
    while len(array) < used + len(more):
        array = np.concatenate([array, np.zeros(max(len(array), 1 << 10), array.dtype)])
    array[used : used + len(more)] = more
    return array


def _sizes(tokens: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in tokens], np.int64)


class Encoder:
    """Ids of whole texts by both tokenizers, remembering those of each word.

    A text's ids are those of its words (``CUT``) one after the other; new
    words are encoded joined, and their ids told apart by the bytes they spell.
    """

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.sizes = _sizes(a.bytes), _sizes(b.bytes)
        self.cuttable = a.cuttable and b.cuttable
        self.number, self.held = _Numbers(), 0
        self.ids, self.spelt = (_Rows(), _Rows()), np.zeros(1 << 10, np.int64)

    def forget(self) -> None:
        """Keep only the words used most, if there are too many."""
        if len(self.number) > MEMORY or self.held > MEMORY_BYTES:
            often = self.number.often()
            self.number = self.number.only(often)
            self.ids, self.spelt = tuple(rows.only(often) for rows in self.ids), self.spelt[often]
            self.held = sum(map(len, self.number))

    def _ids(self, side: int, text: bytes) -> np.ndarray:
        """Ids of a text that begins with a space."""
        (found,) = (self.a, self.b)[side].encode([text[1:].decode()])
        return np.array(found, np.int64)

    def _joined_ids(self, side: int, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words one after the other, how many each has, and whether
        they spell the word."""
        text, ends = b"".join(words), np.cumsum(_sizes(words))
        ids = self._ids(side, text)
        spelt = b"".join(map((self.a, self.b)[side].bytes.__getitem__, ids.tolist())) == text
        if spelt or len(words) == 1:
            token_ends = np.cumsum(self.sizes[side][ids])
            cuts = np.searchsorted(token_ends, ends) + 1 if spelt else np.array([len(ids)])
            return ids, np.diff(np.append(0, cuts)), np.full(len(words), int(spelt))
        half = len(words) // 2
        parts = self._joined_ids(side, words[:half]), self._joined_ids(side, words[half:])
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words. A word that begins a text may begin with more than
        one space or one that is no cut: those are encoded by themselves."""
        alone = np.array([not SPACE < w[1:2] <= b"~" for w in words]) | (not self.cuttable)
        groups = [[k] for k in np.flatnonzero(alone).tolist()]
        if not alone.all():
            groups.append(np.flatnonzero(~alone).tolist())
        spelt = np.ones(len(words), np.int64)
        for side in (0, 1):
            sizes, found = np.zeros(len(words), np.int64), []
            for group in groups:
                ids, many, whole = self._joined_ids(side, [words[k] for k in group])
                sizes[group] = many
                spelt[group] &= whole
                found.append((group, ids))
            begin, flat = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.int64)
            for group, ids in found:
                flat[_runs(begin[group], sizes[group])] = ids
            self.ids[side].add(flat, sizes)
        self.spelt = _grown(self.spelt, spelt, len(self.number) - len(words))

    def encode(self, texts: list[bytes]):
        """Texts (not empty, UTF-8) -> which of them both tokenizers spell
        back, and of these the ids of both sides and how many each has."""
        self.forget()
        known, numbers, bounds = len(self.number), [], [0]
        for text in texts:
            words = CUT.split(SPACE + text) if self.cuttable else [SPACE + text]
            words[1:] = [SPACE + w for w in words[1:]]
            numbers += map(self.number.__getitem__, words)
            bounds.append(len(numbers))
        fresh = list(itertools.islice(self.number, known, None))
        if fresh:
            self.held += sum(map(len, fresh))
            self._learn(fresh)
        numbers, bounds = np.array(numbers, np.int64), np.array(bounds)
        self.number.used(numbers)
        bad = np.concatenate([[0], np.cumsum(1 - self.spelt[numbers])])
        good = bad[bounds[1:]] == bad[bounds[:-1]]
        kept = np.repeat(good, np.diff(bounds))
        text_of = np.repeat(np.cumsum(good) - 1, np.diff(bounds))[kept]
        out = []
        for rows in self.ids:
            ids, sizes = rows.of(numbers[kept])
            out += [ids, np.bincount(text_of, sizes, int(good.sum())).astype(np.int64)]
        return np.flatnonzero(good), *out


class Aligner:
    """Aligns texts; remembers words and windows between calls."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.encoder = Encoder(a, b)
        self.size_a, self.size_b = self.encoder.sizes
        self.space_a, self.space_b = (np.array([x[:1] == SPACE for x in t.bytes]) for t in (a, b))
        # What a token adds to a text of groups: inside a side, and at its end.
        named = [[str(k) + end for k in range(len(t.bytes))] for t, ends in ((a, ",|"), (b, ",;")) for end in ends]
        self.named = [x for part in named for x in part]
        self.named_size = _sizes(self.named)
        self.number, self.held = _Numbers(), 0
        self.text: list[str] = []
        self.groups, self.links = np.zeros(1 << 10, np.int64), _Rows()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        """The aligner of this worker process."""
        if (a_path, b_path) not in _aligners:
            _aligners[a_path, b_path] = cls(ByteLevel(a_path), Pieces(b_path))
        return _aligners[a_path, b_path]

    def forget(self) -> None:
        """Keep only the windows used most, if there are too many."""
        if len(self.number) > MEMORY or self.held > MEMORY_BYTES:
            often = self.number.often()
            self.number = self.number.only(often)
            self.text = [self.text[k] for k in often.tolist()]
            self.groups, self.links = self.groups[often], self.links.only(often)
            self.held = sum(map(len, self.number))

    def _learn(self, a: np.ndarray, b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray) -> None:
        """Align new windows: their ids joined, and how many each has."""
        n = len(many_a)
        window_a = np.repeat(np.arange(n), many_a)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # Every stretch between ends belongs to one token of each side.
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.links.add(a[at_a] * len(self.size_b) + b[at_b], np.bincount(window_a[at_a], minlength=n))
        shared_a, shared_b = np.isin(ends_a, ends_b), np.isin(ends_b, ends_a)
        self.groups = _grown(self.groups, np.bincount(window_a[shared_a], minlength=n), len(self.text))
        # Texts of all windows in one: the tokens in the order of their groups.
        group_a = np.cumsum(shared_a) - shared_a
        group_b = np.cumsum(shared_b) - shared_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        size_a, size_b = len(self.size_a), len(self.size_b)
        names = np.empty(len(a) + len(b), np.int64)
        names[place_a] = a + size_a * shared_a
        names[place_b] = 2 * size_a + b + size_b * shared_b
        text = "".join(map(self.named.__getitem__, names.tolist()))
        cuts = np.concatenate([[0], np.cumsum(self.named_size[names])[np.cumsum(many_a + many_b) - 1]]).tolist()
        self.text += [text[x : y - 1] for x, y in zip(cuts, cuts[1:])]

    def windows(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> np.ndarray:
        """Numbers of the windows that begin at token positions of both sides,
        the first at the first tokens."""
        self.forget()
        many_a, many_b = np.diff(np.append(first_a, len(a))), np.diff(np.append(first_b, len(b)))
        # A window's key: the ids of both sides, and -1 between them.
        size = many_a + many_b + 1
        starts = np.cumsum(size) - size
        joined = np.full(int(size.sum()), -1, "<i4")
        joined[_runs(starts, many_a)] = a
        joined[_runs(starts + many_a + 1, many_b)] = b
        buffer, cuts = joined.tobytes(), np.append(4 * starts, 4 * len(joined)).tolist()
        known = len(self.number)
        found = np.array([self.number[buffer[x:y]] for x, y in zip(cuts, cuts[1:])], np.int64)
        self.number.used(found)
        # New numbers in order, and where each was met first.
        later = np.flatnonzero(found >= known)
        new = later[np.unique(found[later], return_index=True)[1]]
        if len(new):
            self.held += 4 * int(size[new].sum())
            self._learn(a[_runs(first_a[new], many_a[new])], b[_runs(first_b[new], many_b[new])], many_a[new], many_b[new])
        return found

    def align(self, texts: list[bytes | None]):
        """For each text: (n_a, n_b, n_groups, groups, pairs, times), zeros and
        empty for those without tokens. A pair is a * (number of B ids) + b."""
        empty = np.empty(0, np.int64)
        out = [(0, 0, 0, "", empty, empty)] * len(texts)
        given = [k for k, t in enumerate(texts) if t and _is_utf8(t)]
        good, a, n_a, b, n_b = self.encoder.encode([texts[k] for k in given])
        if not len(good):
            return out
        start_a, start_b = np.cumsum(self.size_a[a]) - self.size_a[a], np.cumsum(self.size_b[b]) - self.size_b[b]
        spaced_a, spaced_b = np.flatnonzero(self.space_a[a]), np.flatnonzero(self.space_b[b])
        # Anchors: both sides begin a token with a space here, so both end one.
        # A text begins with a space in both, so it begins a window.
        _, x, y = np.intersect1d(start_a[spaced_a], start_b[spaced_b], assume_unique=True, return_indices=True)
        first_a, first_b = spaced_a[x], spaced_b[y]
        window = self.windows(a, b, first_a, first_b)
        text_of = np.searchsorted(np.cumsum(n_a), first_a, side="right")
        groups = np.bincount(text_of, self.groups[window], len(good)).astype(np.int64)
        bounds = np.searchsorted(text_of, np.arange(len(good) + 1)).tolist()
        linked, size = self.links.of(window)
        codes = len(self.size_a) * len(self.size_b)
        keys = np.sort(np.repeat(text_of, size) * codes + linked)
        changes = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times, keys = np.diff(np.append(changes, len(keys))), keys[changes]
        pair_bounds = np.searchsorted(keys, np.arange(len(good) + 1) * codes)
        numbers, remembered = window.tolist(), self.text.__getitem__
        for n, k in enumerate(good.tolist()):
            text = ";".join(map(remembered, numbers[bounds[n] : bounds[n + 1]]))
            part = slice(pair_bounds[n], pair_bounds[n + 1])
            out[given[k]] = (int(n_a[n]), int(n_b[n]), int(groups[n]), text, keys[part] - n * codes, times[part])
        return out


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


_aligners: dict[tuple[str, str], Aligner] = {}


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _aligned(batches, a_path: str, b_path: str, texts: bool):
    aligner = Aligner.of(a_path, b_path)
    for batch in batches:
        data = batch.column(1).to_pylist()
        for i, j in batches_of(data, AT_ONCE):
            found = aligner.align(data[i:j])
            counts = [pa.array([f[c] for f in found], pa.int64()) for c in range(3)]
            n_links = pa.array([int(f[5].sum()) for f in found], pa.int64())
            hashed = pa.array([hashlib.sha256(f[3].encode()).hexdigest() if f[3] else "" for f in found], pa.string())
            groups = pa.array([f[3] if texts else None for f in found], pa.string())
            yield pa.record_batch(
                [batch.column(0).slice(i, j - i), *counts, n_links, hashed, groups, _lists([f[4] for f in found]), _lists([f[5] for f in found])],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"],
            )


def align(docs: DataFrame, a_path: str, b_path: str, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, groups (``a1,a2|b1;a3|b2``; null unless ``texts``), and its
    distinct linked pairs with how often it links them.

    Null and empty texts, and those that either tokenizer does not spell back
    byte by byte, have no tokens: zeros and ''. Rows that repeat and null ids
    are rows like others; an empty table gives none; other columns are
    ignored. A very long text is encoded whole and costs some 100 times its
    bytes in the task's memory; one without spaces is one window.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(lambda batches: _aligned(batches, a_path, b_path, texts), ALIGNED)


def pair_counts(aligned: DataFrame, b_ids: int) -> DataFrame:
    """pair, n (links that hold it in all texts), best (n is the highest of its B id)."""
    links = aligned.select(F.inline(F.arrays_zip("pairs", "times")))
    counted = links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    of_b = W.partitionBy(F.col("pair") % b_ids)
    return counted.withColumn("best", F.col("n") == F.max("n").over(of_b))


def _scored(batches, block):
    """Adds a block's share to n_best and count_sum."""
    pairs, n, best = block
    for batch in batches:
        column = batch.column("pairs")
        sizes = np.diff(column.offsets.to_numpy())
        codes, times = column.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
        at = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
        held = np.where(pairs[at] == codes, times, 0) if len(pairs) else np.zeros(len(codes), np.int64)
        sums = [np.concatenate([[0], np.cumsum(held * x[at])]) if len(pairs) else np.zeros(len(codes) + 1, np.int64) for x in (best, n)]
        ends = np.cumsum(sizes)
        added = {name: pa.array(s[ends] - s[ends - sizes] + batch.column(name).to_numpy(), pa.int64()) for name, s in zip(("n_best", "count_sum"), sums)}
        names = batch.schema.names
        yield pa.record_batch([added.get(c, batch.column(c)) for c in names], names=names)


def score_links(shared: Shared, aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds to a stored alignment n_best (links whose pair is the best of its B
    id) and count_sum (the sum of its links' counts)."""
    spark = shared.spark
    pairs = shared.table(pairs)
    blocks = max(1, math.ceil(pairs.count() / PAIR_BLOCK))
    columns = [c.split()[0] for c in SCORED.split(", ")]
    out = aligned.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long")).select(*columns)
    for k in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k).toArrow()
        pair = rows.column("pair").to_numpy()
        order = np.argsort(pair)
        block = spark.sparkContext.broadcast((pair[order], rows.column("n").to_numpy()[order], rows.column("best").to_numpy()[order].astype(np.int64)))
        out = out.mapInArrow(lambda batches, block=block: _scored(batches, block.value), SCORED)
        if k + 1 < blocks:
            out = shared.table(out)
    return out


def report(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The alignment of every document with its links' corpus counts: doc_id,
    n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see ``align``
    for the defined cases)."""
    shared = Shared(spark, "alignment")
    aligned = shared.table(align(docs, a_path, b_path, texts=False))
    scored = score_links(shared, aligned, pair_counts(aligned, len(Pieces(b_path).bytes)))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
