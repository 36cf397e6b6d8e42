"""Language identification with string kernels.

A text is the set of its letter n-grams of 1 to MAX_N code points (blended
spectrum, presence only); the kernel of two texts is the size of the common
set over the root of the product of the sizes. Nyström: LANDMARKS texts of the
training sample span the feature space, K_nm K_mm^(-1/2); a one-versus-rest
kernel ridge regression is solved there. Since presence kernels are products
of presence rows, the landmark matrix and the ridge weights multiply out to
one n-gram by language matrix, and a batch of texts is scored by one product
of its sparse presence rows with it.

The fit takes at most SAMPLE labelled texts of each language (chosen by a hash
of doc_id from all of them) and runs on the driver; every text is scored whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.llm.common import prepare
from campusflow.llm.wordhash import batches

MAX_N = 3
#: Training texts of each language, and landmarks over all languages.
SAMPLE = 300
LANDMARKS = 160
RIDGE = 1e-2
UNKNOWN = "und"
#: A best one-versus-rest value below this is no language's text.
REJECT_BELOW = 0.3

_known = np.zeros(0x110000 + 1, bool)
_letter = np.zeros(0x110000 + 1, np.int64)
#: Letters proper; combining marks are part of words but no letters.
_alone = np.zeros(0x110000 + 1, bool)
BLANK = 1


def _learn_letters(points: np.ndarray) -> None:
    for p in points:
        c = chr(p)
        low = c.lower()
        if unicodedata.category(c)[0] in "LM":
            _letter[p] = ord(low) + 1 if len(low) == 1 else p + 1
        else:
            _letter[p] = BLANK
        _alone[p] = unicodedata.category(c)[0] == "L"
        _known[p] = True


def ngram_sets(texts) -> list[np.ndarray | None]:
    """Sorted codes of each text's distinct letter n-grams (None without a
    letter). Letters are lower-cased; what is between words is one blank."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") if isinstance(t, str) else np.empty(0, "<u4") for t in texts]
    blank = np.full(1, 32, "<u4")
    flat = np.concatenate([x for p in parts for x in (blank, p, blank)])
    seen = np.flatnonzero(np.bincount(flat))
    if len(new := seen[~_known[seen]]):
        _learn_letters(new)
    codes = _letter[flat]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK)
    ends = np.cumsum([len(p) + 2 for p in parts])
    keep[np.concatenate([[0], ends[:-1]])] = True
    bound = np.concatenate([[0], np.cumsum(keep)[ends - 1]])
    codes = codes[keep]
    triples = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    out: list[np.ndarray | None] = []
    lettered = np.logical_or.reduceat(_alone[flat], np.concatenate([[0], ends[:-1]])) if parts else ()
    for a, b, any_letter in zip(bound[:-1], bound[1:], lettered):
        if b - a < 3 or not any_letter:
            out.append(None)
            continue
        grams = np.unique(triples[a : b - 2])
        pairs = np.unique(np.append(grams >> 21, grams & ((1 << 42) - 1)))
        single = np.unique(np.append(pairs >> 21, pairs & ((1 << 21) - 1)))
        out.append(np.concatenate([single, pairs, grams]))
    return out


class Model:
    def __init__(self, languages: list[str], vocabulary: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.vocabulary, self.weights, self.bias = languages, vocabulary, weights, bias

    def decisions(self, sets: list[np.ndarray]) -> np.ndarray:
        """One-versus-rest values, a row per (non-empty) n-gram set."""
        flat = np.concatenate(sets)
        sizes = np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        rows = np.where((self.vocabulary[at] == flat)[:, None], self.weights[at], 0.0)
        return np.add.reduceat(rows, starts, axis=0) / np.sqrt(sizes)[:, None] + self.bias

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; und and 0 without a letter
        or without any learned language."""
        sets = ngram_sets(texts)
        have = [i for i, s in enumerate(sets) if s is not None]
        names, scores = [UNKNOWN] * len(sets), np.zeros(len(sets))
        if have and self.languages:
            values = self.decisions([sets[i] for i in have])
            best = values.argmax(axis=1)
            scores[have] = np.clip((1 + values[np.arange(len(best)), best]) / 2, 0, 1)
            for i, k in zip(have, best):
                names[i] = self.languages[k]
        return names, scores


def fit(texts: list[str], labels: list[str]) -> Model:
    sets = ngram_sets(texts) if texts else []
    rows = [(s, lab) for s, lab in zip(sets, labels) if s is not None]
    languages = sorted({lab for _, lab in rows})
    if not languages:
        return Model([], np.empty(0, np.int64), np.empty((0, 0)), np.empty(0))
    marks: list[np.ndarray] = []
    for lang in languages:
        own = [s for s, lab in rows if lab == lang]
        marks += own[: max(1, LANDMARKS // len(languages))]
    vocabulary = np.unique(np.concatenate(marks))
    presence = np.zeros((len(vocabulary), len(marks)))
    for k, s in enumerate(marks):
        presence[np.searchsorted(vocabulary, s), k] = 1 / np.sqrt(len(s))
    kernel = np.empty((len(rows), len(marks)))
    for i, (s, _) in enumerate(rows):
        at = np.minimum(np.searchsorted(vocabulary, s), len(vocabulary) - 1)
        kernel[i] = presence[at[vocabulary[at] == s]].sum(axis=0) / np.sqrt(len(s))
    values, vectors = np.linalg.eigh(presence.T @ presence)
    good = values > 1e-9 * values.max()
    root = vectors[:, good] / np.sqrt(values[good]) @ vectors[:, good].T
    features = np.hstack([kernel @ root, np.ones((len(rows), 1))])
    target = np.array([[1.0 if lab == lang else -1.0 for lang in languages] for _, lab in rows])
    if len(languages) == 1:
        target[:] = 1.0
    # Languages count alike, however many texts each has.
    share = np.array([1 / sum(lab == other for _, other in rows) for _, lab in rows])
    share = share / share.mean()
    gram = features.T @ (features * share[:, None]) + RIDGE * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, features.T @ (target * share[:, None]))
    return Model(languages, vocabulary, presence @ (root @ beta[:-1]), beta[-1])


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, learn: Column | None = None) -> Model:
    """Fit on at most SAMPLE texts of each language among the rows that
    ``learn`` allows (null lang, text or doc_id: not learned from)."""
    rows = docs.where("doc_id is not null and lang is not null and text is not null")
    rows = rows.where(learn) if learn is not None else rows
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([], [])
    scale = 1 << 30
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, min(scale, int(1.5 * SAMPLE / n * scale) + 1)).otherwise(limit)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    sample = rows.where(order < limit).select("lang", "text", order.alias("at")).limit(3 * SAMPLE * len(counts))
    kept: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["at"], r["text"])):
        texts = kept.setdefault(r["lang"], [])
        if len(texts) < SAMPLE:
            texts.append(r["text"])
    return fit([t for ts in kept.values() for t in ts], [lab for lab, ts in kept.items() for _ in ts])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``docs`` (its columns ``keep`` and text) with lang_pred and score."""
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    extra = [] if "text" in keep else ["text"]

    def run(tables):
        import pyarrow as pa

        for table in tables:
            texts = table.column("text").to_pylist()
            names, scores = [], []
            for a, b in batches(texts, 2 << 20):
                n, s = model.predict(texts[a:b])
                names += n
                scores.append(s)
            columns = [table.column(c) for c in keep] + [
                pa.array(names, pa.string()),
                pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, *extra).mapInArrow(run, schema)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row: a model learned from
    the rows that are not held out (crc32 of doc_id as text, modulo 3, is 1)
    predicts every whole text. Null texts and texts without a letter give und
    and 0; a null doc_id is neither held out nor learned from; an empty table
    gives an empty result."""
    prepare(spark)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    model = train(docs, ~held_out())
    out = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def rejected() -> Column:
    """Rows of ``predict`` in no learned language."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("score") < REJECT_BELOW)
