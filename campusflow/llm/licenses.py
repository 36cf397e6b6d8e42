"""License scans: a trained paragraph classifier, confirmed by templates.

A notice may be wrapped: what is classified are the windows of consecutive
lines that are not blank, up to LONGEST words before the last line, joined.
Of overlapping windows the one that holds most of its template counts, then
the shortest; licence lines that touch it belong to its paragraph. A sparse logistic regression over word
1- and 2-grams (presence) has a class per licence family and one for other
text. It is fitted by Spark on the notices in TEMPLATES, thinned out at random,
and on every line of the corpus that is no licence line as other text, lines
with the same n-grams as one weighted row. A licence paragraph is one that the
model puts in any family rather than in other text. Its family counts only if
its probability reaches the calibrated threshold and a template of the family
confirms it (its 2-grams are found in the paragraph to CONTAINED); else the
paragraph is an ``unknown`` licence. The corpus is processed by built-in
functions only; the broadcast tables hold the model's n-grams, whose number is
bounded by the templates.
"""

from __future__ import annotations

import re

from collections import Counter

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.llm.common import Shared

UNKNOWN, OTHER = "unknown", "other"

# The usual short notices of each licence family.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1 or later"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("bsd", "Released under the BSD 3-Clause License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work. Published under CC0 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Copyright. All rights reserved. No part may be reproduced without prior written permission"),
]

VARIANTS = 40
EPOCHS = 60
CONTAINED = 0.6
#: Words whose weight for a family is this much above that for other text, and
#: which at most COMMON of the other lines hold, open a paragraph
#: to the classifier.
MARK = 0.5
COMMON = 0.02
#: Words of a window before its last line: twice those of the longest template.
LONGEST = 2 * max(len(t.split()) for _, t in TEMPLATES)
#: A line without a word: blank, or comment signs only.
BLANK = r"(?i)^[^\p{L}\p{N}]*(?:(?:dnl|rem)[^\p{L}\p{N}]*)?$"
PREFIX = r"(?i)^\s*(?:dnl|rem)\s"
# Possessive, so that a very long word neither recurses nor retries.
WORD = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"


def grams_of(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def _grams(paragraph: Column) -> Column:
    words = F.regexp_extract_all(F.lower(paragraph), F.lit(WORD), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit(""))))
    return F.array_distinct(F.concat(words, pairs))


class Model:
    def __init__(self, families: list[str], vocabulary: list[str], weights: np.ndarray, bias: np.ndarray, least: float, common: np.ndarray):
        self.families, self.vocabulary, self.weights, self.bias, self.least = families, vocabulary, weights, bias, least
        self.common = common

    def markers(self) -> list[str]:
        """Single words that speak for a family against other text."""
        gain = (self.weights[:, 1:] - self.weights[:, :1]).max(axis=1)
        return [v for v, g, c in zip(self.vocabulary, gain, self.common) if g >= MARK and c <= COMMON and " " not in v and len(v) > 1]

    def gate(self) -> str:
        """A pattern of the texts to look at: the markers, and for templates
        that CONTAINED could be reached of without one as many of the other
        2-grams as make that impossible."""
        marks, parts = set(self.markers()), []
        rare = dict(zip(self.vocabulary, self.common))
        for _, text in TEMPLATES:
            pairs = [g for g in grams_of(text) if " " in g]
            spare = int((1 - CONTAINED) * len(pairs) + 1e-9) + 1
            bare = sorted((g for g in pairs if not marks & set(g.split())), key=lambda g: rare[g])
            parts += bare[: max(0, spare - (len(pairs) - len(bare)))]
        words = [re.escape(m) for m in sorted(marks, key=len, reverse=True)]
        words += sorted({"[^A-Za-z0-9]+".join(map(re.escape, g.split())) for g in parts})
        return r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(words) + r")(?![A-Za-z0-9])"

    def probabilities(self, texts: list[str]) -> np.ndarray:
        index = {v: k for k, v in enumerate(self.vocabulary)}
        z = np.array([self.bias + self.weights[[index[g] for g in grams_of(t) if g in index]].sum(axis=0) for t in texts])
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


#: Words of a licence line that holds no template.
LICENCE = r"(?i)licen[cs]e|copyright|rights reserved|\bcc[- ]?(by|0)|gnu|public domain"


def variants(seed: int = 7) -> list[tuple[str, str]]:
    """(family, text): the templates, thinned out at random."""
    rng = np.random.default_rng(seed)
    out = []
    for family, text in TEMPLATES:
        words = text.split()
        for k in range(VARIANTS):
            drop = 0.0 if k % 4 == 0 or len(words) < 5 else 0.15
            out.append((family, " ".join([w for w in words if rng.random() >= drop] or words)))
    return out


def vocabulary_of() -> list[str]:
    return sorted({g for _, t in TEMPLATES for g in grams_of(t)})


def other_lines(shared: Shared, docs: DataFrame) -> DataFrame:
    """(grams, n): the n-grams of the templates that the corpus's other lines
    hold, and how many of all its lines hold just those. Other lines have a
    word and are no licence lines."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where((F.trim("line") != "") & ~F.col("line").rlike(LICENCE))
    known = vocabulary_of()
    single = [g for g in known if " " not in g]
    # Words of no template can be in no n-gram: they become one that is in none.
    words = lines.select(F.transform(F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0)), lambda w: F.when(w.isin(single), w)).alias("words"))
    after = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    grams = words.select(F.array_compact("words").alias("words"), F.array_compact(F.zip_with("words", after, lambda a, b: F.concat(a, F.lit(" "), b))).alias("pairs"))
    held = F.array_sort(F.array_distinct(F.concat("words", F.filter("pairs", lambda g: g.isin(known)))))
    # Written, or the filter below would be pushed under the groups: every line
    # would be held against every template, its n-grams made anew each time.
    groups = shared.table(grams.groupBy(held.alias("grams")).agg(F.count(F.lit(1)).alias("n")))
    notice = F.lit(False)
    for _, text in TEMPLATES:
        pairs = [g for g in grams_of(text) if " " in g]
        notice = notice | (F.size(F.array_intersect("grams", F.lit(pairs))) >= CONTAINED * len(pairs))
    return groups.where(~notice)


def train(shared: Shared, docs: DataFrame) -> Model:
    """Softmax regression on the variants and every other line of the corpus,
    each class of the same weight in all; the threshold keeps 99% of held-out
    variants in their family."""
    spark = shared.spark
    families = [OTHER, *dict.fromkeys(f for f, _ in TEMPLATES)]
    vocabulary = vocabulary_of()
    lines = shared.table(other_lines(shared, docs))
    total = lines.agg(F.sum("n")).first()[0]
    if not total:
        lines, total = spark.createDataFrame([([], 1)], lines.schema), 1
    texts = variants()
    given = [(grams_of(t), families.index(f)) for i, (f, t) in enumerate(texts) if i % 5]
    share = Counter(k for _, k in given)
    notices = spark.createDataFrame([(g, float(k), 1.0 / share[k]) for g, k in given], "grams array<string>, label double, weight double")
    rows = lines.select("grams", F.lit(0.0).alias("label"), (F.col("n") / float(total)).alias("weight")).unionByName(notices)
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="x", binary=True)
    fitted = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=1e-4, standardization=False, maxIter=EPOCHS
    ).fit(vectors.transform(rows))
    # Rounded: tasks are summed up in no fixed order, which moves the last bits.
    weights, bias = np.round(fitted.coefficientMatrix.toArray().T, 6), np.round(fitted.interceptVector.toArray(), 6)
    held = lines.select(F.explode("grams").alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = {r["gram"]: r["n"] for r in held}
    model = Model(families, vocabulary, weights, bias, 0.0, np.array([counts.get(v, 0) / total for v in vocabulary]))
    kept = texts[::5]
    p = model.probabilities([t for _, t in kept])[np.arange(len(kept)), [families.index(f) for f, _ in kept]]
    model.least = float(np.sort(p)[int(0.01 * len(kept))])
    return model


def _windows(lines: Column, gate: str) -> Column:
    """(i, j, line): the windows from line i to line j that pass the gate."""
    kind = "array<struct<i:int,j:int,line:string>>"

    def step(acc: Column, x: Column, i: Column) -> Column:
        going = acc["going"] & (acc["words"] < LONGEST) & ~x.rlike(BLANK)
        line = F.concat(acc["line"], F.lit(" "), F.regexp_replace(x, PREFIX, ""))
        found = F.array(F.struct(i.alias("i"), acc["j"].alias("j"), line.alias("line"))).cast(kind)
        return F.struct(
            (acc["j"] + 1).alias("j"), going.alias("going"),
            F.when(going, acc["words"] + F.greatest(F.size(F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))), F.lit(1))).otherwise(acc["words"]).alias("words"),
            F.when(going, line).otherwise(acc["line"]).alias("line"),
            F.when(going & line.rlike(gate), F.concat(acc["out"], found)).otherwise(acc["out"]).cast(kind).alias("out"),
        )

    def start(i: Column) -> Column:
        first = F.struct(i.alias("j"), F.lit(True).alias("going"), F.lit(0).alias("words"), F.lit("").alias("line"), F.array().cast(kind).alias("out"))
        return F.aggregate(F.slice(lines, i + 1, LONGEST), first, lambda acc, x: step(acc, x, i), lambda acc: acc["out"])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), start))


def _paragraphs(windows: Column) -> Column:
    """Of windows (sorted best first) those that overlap no better one, with
    unsure ones joined to what they touch."""
    free = F.aggregate(
        windows, F.slice(windows, 1, 0),
        lambda acc, w: F.when(F.exists(acc, lambda o: (o["i"] <= w["j"]) & (w["i"] <= o["j"])), acc).otherwise(F.concat(acc, F.array(w))),
    )
    placed = F.array_sort(F.transform(free, lambda w: F.struct(*[w[c].alias(c) for c in ("i", "j", "unsure", "family", "probability", "template", "contained")])))

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        touch = F.coalesce(last["j"] + 1 == w["i"], F.lit(False))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return (
            F.when(touch & w["unsure"], F.concat(head, F.array(last.withField("j", w["j"]))))
            .when(touch & last["unsure"], F.concat(head, F.array(w.withField("i", last["i"]))))
            .otherwise(F.concat(acc, F.array(w)))
        )

    return F.aggregate(placed, F.slice(placed, 1, 0), step)


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, start, end, family, probability, template,
    contained) of every licence paragraph of every row of ``docs`` (doc_id,
    text): the number of its first line, its code points, its family or ``unknown``,
    the model's probability that it is a licence at all, and its best template
    with the share of the template's 2-grams found.

    Null texts have no paragraphs; repeated rows give rows each; a null doc_id
    is kept; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = Shared(spark, "licenses")
    model = train(shared, docs)
    gate = model.gate()
    # Rows are told apart by a key of their own: doc_id may repeat.
    near = docs.where(F.col("text").rlike(gate)).withColumn("doc", F.monotonically_increasing_id())
    near = shared.table(near.select("doc", "doc_id", F.split("text", "\n", -1).alias("lines")))
    hit = near.select("doc", F.explode(_windows(F.col("lines"), gate)).alias("w")).select("doc", "w.*")
    hit = shared.table(hit.withColumn("row", F.monotonically_increasing_id()))
    grams = hit.select("row", F.explode(_grams(F.col("line"))).alias("gram"))

    classes = range(len(model.families))
    weights = spark.createDataFrame(
        [(v, *map(float, w)) for v, w in zip(model.vocabulary, model.weights)],
        "gram string, " + ", ".join(f"w{k} double" for k in classes),
    )
    z = grams.join(F.broadcast(weights), "gram").groupBy("row").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in classes])
    logits = F.array(*[F.col(f"w{k}") + float(model.bias[k]) for k in classes])
    z = z.select("row", logits.alias("z")).withColumn("top", F.array_max("z"))
    z = z.withColumn("e", F.transform("z", lambda v: F.exp(v - F.col("top"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    z = z.select("row", F.transform("e", lambda v: v / total).alias("p"))
    best = F.array_max(F.slice("p", 2, len(model.families) - 1))
    names = F.array(*[F.lit(f) for f in model.families])
    z = z.select(
        "row", (1 - F.get("p", F.lit(0))).alias("probability"), best.alias("best"),
        F.get(names, F.array_position(F.slice("p", 2, len(model.families) - 1), best).cast("int")).alias("guess"),
    ).where(F.col("probability") >= 0.5)

    parts = []
    for k, (family, text) in enumerate(TEMPLATES):
        pairs = [g for g in grams_of(text) if " " in g]
        parts += [(g, k, family, len(pairs)) for g in pairs]
    templates = spark.createDataFrame(parts, "gram string, template int, guess string, n int")
    found = grams.join(F.broadcast(templates), "gram").groupBy("row", "template", "guess").agg((F.count(F.lit(1)) / F.first("n")).alias("contained"))
    found = found.groupBy("row", "guess").agg(F.max(F.struct("contained", (-F.col("template")).alias("t"))).alias("b"))
    out = hit.join(z, "row").join(found, ["row", "guess"], "left")
    contained = F.coalesce("b.contained", F.lit(0.0))
    sure = (F.col("best") >= model.least) & (contained >= CONTAINED)
    sure = F.coalesce(sure, F.lit(False))
    # Single licence lines may stay unknown; longer windows need a template.
    out = out.where(sure | (F.col("i") == F.col("j"))).select("doc", F.struct(
        (~sure).alias("unsure"), (-contained).alias("rank"), (F.col("j") - F.col("i")).alias("size"), "i", "j",
        F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability",
        (-F.col("b.t")).alias("template"), contained.alias("contained"),
    ).alias("w"))
    out = out.groupBy("doc").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    out = out.select("doc", F.explode(_paragraphs(F.col("ws"))).alias("p")).select("doc", "p.*").join(near, "doc")

    def length(first: Column, count: Column) -> Column:
        return F.aggregate(F.slice("lines", first, count), F.lit(0), lambda a, x: a + F.length(x) + 1)

    start = length(F.lit(1), F.col("i"))
    return out.select(
        "doc_id", F.col("i").alias("paragraph"), start.alias("start"), (start + length(F.col("i") + 1, F.col("j") - F.col("i") + 1) - 1).alias("end"),
        "family", "probability", "template", "contained",
    )
