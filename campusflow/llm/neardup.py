"""MinHash near-duplicates by a chosen-path set similarity join.

Every document is its set of distinct word shingles, sketched by POSITIONS
minwise tokens. Equal sets collapse to one representative first. Then TREES
independent trees branch the representatives: a node sends each member to the
children named by the member's minwise token at one position, or with
probability 1/4 two, that the node's own hash selects (1.25 = 1 / 0.8 in the
mean). Two sets of similarity 0.8 share a child with probability 0.84, so all
TREES first levels miss such a pair with a probability of 4e-7, and more
similar pairs with less. Nodes with the same members count once.

* Two members are a candidate pair; it goes if the sketches put it five
  standard deviations or more below the threshold.
* A node whose sets fit one task (MEMBERS, SHINGLES) is compared exhaustively
  there on the full sets. Only links between different components are looked
  for, so a task gives a spanning forest and not all pairs of a group.
* A larger node is compared with its smallest member first (linear), and it is
  closed if all members are connected then. Else it branches further; after
  LEVELS levels what is left is compared in blocks that fit a task.

The trees run in PHASES; nodes that verified links of earlier phases have
connected are closed without any comparison.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.llm.bloom import only_likely
from campusflow.llm.common import Shared
from campusflow.llm.components import merge, no_labels
from campusflow.llm.wordhash import BASE, batches, mix, shingle_sets

POSITIONS = 64
TREES = 8
#: Trees from which on a new phase begins.
PHASES = (0, 2)
LEVELS = 3
#: What one task compares exhaustively: members and shingles of a node.
MEMBERS = 4000
SHINGLES = 2_000_000
#: Standard deviations of the sketched similarity below the threshold.
SLACK = 5.0

#: What tells two nodes' sets of members apart.
MARKS = ["n", "total", "leader", "last", "mark", "mark2"]

SKETCH = "doc_id long, n_shingles long, set_lo long, set_hi long, tokens array<int>"


def sketch(sets: list[np.ndarray], positions: int = POSITIONS) -> np.ndarray:
    """One row of minwise tokens (int32) per non-empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    factors = mix(np.arange(1, positions + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    out = np.empty((len(sets), positions), np.int32)
    for k, f in enumerate(factors):
        least = np.minimum.reduceat(flat * f, starts)
        out[:, k] = (mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_lo, set_hi, tokens) of every document; set_lo
    and set_hi identify the set (null for an empty one)."""

    def run(frames):
        for frame in frames:
            texts = frame.text.tolist()
            for a, b in batches(texts):
                sets = shingle_sets(texts[a:b], words)
                full = [s for s in sets if len(s)]
                tokens = iter(sketch(full)) if full else iter(())
                rows = []
                for doc_id, s in zip(frame.doc_id[a:b], sets):
                    if len(s):
                        lo = int(s.sum(dtype=np.uint64).view(np.int64))
                        hi = int(mix(s ^ np.uint64(BASE)).sum(dtype=np.uint64).view(np.int64))
                        rows.append((doc_id, len(s), lo, hi, next(tokens)))
                    else:
                        rows.append((doc_id, 0, None, None, None))
                out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_lo", "set_hi", "tokens"])
                yield out.astype({"doc_id": "Int64", "set_lo": "Int64", "set_hi": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SKETCH)


def _children(members: DataFrame) -> DataFrame:
    """Members (tree, node, rep, n_shingles, tokens) sent to the children of
    their node: the node's hash selects one or two positions, the token there
    names the child."""

    def at(k: int):
        return F.pmod(F.xxhash64("node", F.lit(k)), F.lit(POSITIONS)).cast("int")

    two = F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(4)) == 0
    positions = F.when(two, F.array_distinct(F.array(at(0), at(1)))).otherwise(F.array(at(0)))
    return members.select("tree", "node", "rep", "n_shingles", "tokens", F.explode(positions).alias("at")).select(
        "tree", F.xxhash64("node", "at", F.element_at("tokens", F.col("at") + 1)).alias("node"), "rep", "n_shingles"
    )


def _packed(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of sorted shingle hashes: enough to tell the shingles
    of two texts apart, and a quarter less to move."""
    top = np.unique(shingles >> np.uint64(16))
    return top.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def _set_blobs(docs: DataFrame, words: int) -> DataFrame:
    def run(frames):
        for frame in frames:
            texts = frame.text.tolist()
            for a, b in batches(texts):
                blobs = [_packed(s) for s in shingle_sets(texts[a:b], words)]
                yield pd.DataFrame({"rep": frame.rep.iloc[a:b].to_numpy(), "shingles": blobs})

    return docs.mapInPandas(run, "rep long, shingles binary")


def forest(reps: list[int], roots: list[int], blobs: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links (a < b) between members whose full sets reach the similarity:
    enough of them to connect all that are linked, given the members of a
    root as connected."""
    order = sorted(range(len(reps)), key=lambda k: reps[k])
    sets = [_unpacked(blobs[k]) for k in order]
    ids, parent = [reps[k] for k in order], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    group = [roots[k] for k in order]
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flags = np.zeros(len(values), np.int32)
    links = []
    for i in range(len(sets) - 1):
        mine = find(group[i])
        other = np.array([find(g) != mine for g in group[i + 1 :]])
        if not other.any():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        flags[own] = 1
        both = np.add.reduceat(flags[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        flags[own] = 0
        near = other & (100 * both >= percent * (sizes[i] + sizes[i + 1 :] - both))
        for j in np.flatnonzero(near) + i + 1:
            if find(group[i]) != find(group[j]) and ids[i] != ids[j]:
                links.append((ids[i], ids[j]))
                parent[find(group[j])] = find(group[i])
    return links


def _confirmed(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found by exhaustive comparison of nodes (node, rep, root)."""

    def links_of(rows) -> list[tuple[int, int]]:
        reps, roots, blobs = zip(*rows)
        return forest(list(reps), list(roots), list(blobs), percent) if len(set(roots)) > 1 else []

    def run(tables):
        import pyarrow as pa

        node, rows = None, []
        for table in tables:
            found = []
            for n, *row in zip(*(table.column(c).to_pylist() for c in ("node", "rep", "root", "shingles"))):
                if n != node and rows:
                    found += links_of(rows)
                    rows = []
                node = n
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = links_of(rows) if rows else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    # Sets are as large as the texts: sorted and merged at every size.
    with_sets = members.join(sets.hint("merge"), "rep").select("node", "rep", "root", "shingles")
    return with_sets.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long").distinct()


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) that the sketches don't rule out."""
    least = _least(percent)
    left = reps.select(F.col("rep").alias("a"), F.col("tokens").alias("left"))
    right = reps.select(F.col("rep").alias("b"), F.col("tokens").alias("right"))
    equal = F.size(F.filter(F.zip_with("left", "right", lambda x, y: x == y), lambda same: same))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(equal >= least).select("a", "b").distinct()


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    found = labels.select(F.col("id").alias("rep"), F.col("root"))
    return members.join(found, "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The nodes whose members are in several components."""
    ends = rows.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return ends.where("lo <> hi").select("node")


def _fits():
    return (F.col("n") <= MEMBERS) & (F.col("total") <= SHINGLES)


def _nodes(shared: Shared, children: DataFrame, reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (node, rep, ...) and statistics of the nodes with three members
    or more, and the plausible pairs (tree, a, b) of those with two."""
    children, path = shared.write(children)
    sizes = children.groupBy("node").agg(
        F.min("tree").alias("tree"), F.count(F.lit(1)).alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b")
    )
    sizes = shared.table(sizes.where("n > 1 and a <> b"))
    two = sizes.where("n = 2").select("tree", "a", "b")
    pairs = shared.table(two.join(_plausible(two, reps, percent), ["a", "b"]).select("tree", "a", "b"))
    more = children.join(sizes.where("n > 2").select("node", "n"), "node")
    few = more.where(F.col("n") <= MEMBERS).drop("n").join(reps.select("rep", "tokens").hint("merge"), "rep")
    members = shared.table(_partnered(few, percent).unionByName(more.where(F.col("n") > MEMBERS).drop("n")))
    shared.drop(path)
    stats = members.groupBy("node").agg(
        F.min("tree").alias("tree"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"),
        F.min("rep").alias("leader"), F.max("rep").alias("last"),
        F.bit_xor(F.xxhash64("rep")).alias("mark"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("mark2"),
    )
    return members, shared.table(stats), pairs


def _least(percent: int) -> int:
    """Equal positions from which on a pair is plausible."""
    s = percent / 100
    return int(POSITIONS * (s - SLACK * (s * (1 - s) / POSITIONS) ** 0.5))


def _partnered(members: DataFrame, percent: int) -> DataFrame:
    """The members of nodes that a task holds (MEMBERS at most) with another
    plausible one in their node."""
    least = _least(percent)

    def kept(rows: list[tuple]) -> list[tuple]:
        tokens = np.array([r[4] for r in rows], np.int32)
        out = []
        for i, r in enumerate(rows):
            equal = np.count_nonzero(tokens == tokens[i], axis=1)
            equal[i] = 0
            if equal.max() >= least:
                out.append(r[:4])
        return out

    def run(tables):
        import pyarrow as pa

        def batch(found):
            columns = zip(*found) if found else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        names = ["tree", "node", "rep", "n_shingles"]
        node, rows = None, []
        for table in tables:
            found = []
            tokens = table.column("tokens")
            flat = tokens.flatten().to_numpy().reshape(-1, POSITIONS) if len(tokens) else ()
            for *row, t in zip(*(table.column(c).to_pylist() for c in names), flat):
                if row[1] != node and rows:
                    found += kept(rows)
                    rows = []
                node = row[1]
                rows.append((*row, t.copy()))
            yield batch(found)
        yield batch(kept(rows) if rows else [])

    dealt = members.select("tree", "node", "rep", "n_shingles", "tokens").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, "tree long, node long, rep long, n_shingles long")


def _distinct(stats: DataFrame) -> DataFrame:
    """One node for each set of members."""
    return stats.groupBy(*MARKS).agg(F.min("node").alias("node")).select("node")


def _blocks(large: DataFrame) -> DataFrame:
    """The members of large nodes in blocks, such that any two meet in one."""
    blocks = F.greatest(F.ceil(2 * F.col("n") / MEMBERS), F.ceil(2 * F.col("total") / SHINGLES)).cast("int")
    dealt = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")),
    )
    met = dealt.select("node", "rep", "root", F.explode(meets).alias("m"))
    return met.select(F.xxhash64("node", "m.x", "m.y").alias("node"), "rep", "root")


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``
    (doc_id, text): documents are linked when the Jaccard similarity of their
    distinct ``words``-word shingles is at least ``percent`` / 100.

    Words are runs without ASCII blanks, with A-Z lower-cased; a text of
    fewer words is one shingle, null and blank texts have none and are linked
    with nothing. component_id is the smallest doc_id reachable. Rows that
    repeat a doc_id count as one vertex; a null doc_id is linked with nothing
    and not kept. An empty table gives an empty result.
    """
    shared = Shared(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = shared.table(sketches(docs, words))
    usable = sketched.where("doc_id is not null and set_lo is not null")
    reps = shared.table(
        usable.groupBy("set_lo", "set_hi").agg(
            F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("tokens").alias("tokens")
        )
    )

    trees = F.explode(F.array(*[F.lit(k).cast("long") for k in range(TREES)]))
    roots = reps.select(trees.alias("tree"), "rep", "n_shingles", "tokens").withColumn("node", F.col("tree"))
    members, stats, pairs = _nodes(shared, _children(roots), reps, percent)
    # All later comparisons are among these.
    needed = shared.table(pairs.selectExpr("explode(array(a, b)) as rep").union(members.select("rep")).distinct())
    texts = only_likely(docs.withColumnRenamed("doc_id", "rep"), "rep", needed).join(needed.hint("merge"), "rep", "left_semi")
    sets = shared.table(_set_blobs(texts, words))
    labels = no_labels(shared)
    for level in range(LEVELS):
        for first, end in zip(PHASES, [*PHASES[1:], TREES]):
            part = F.col("tree").between(first, end - 1)
            two = pairs.where(part).groupBy("a", "b").agg(F.min("tree")).select("a", "b")
            if first:
                two = two.join(pairs.where(f"tree < {first}").select("a", "b"), ["a", "b"], "left_anti")
            two = two.withColumn("node", F.xxhash64("a", "b")).selectExpr("node", "explode(array(a, b)) as rep")
            new = stats.where(part & _fits())
            if first:
                new = new.join(stats.where(f"tree < {first}").select(*MARKS).distinct(), MARKS, "left_anti")
            few = members.join(_distinct(new), "node").select("node", "rep")
            star = members.join(stats.where(part & ~_fits()).select("node", "leader"), "node")
            star = star.where("rep <> leader").select(F.xxhash64("rep", "leader").alias("node"), F.expr("explode(array(rep, leader)) as rep"))
            rows = _labelled(two.unionByName(few).unionByName(star.distinct()), labels)
            if first or level:
                rows = rows.join(_mixed(rows), "node")
            labels = merge(shared, labels, shared.table(_confirmed(rows, sets, percent)))
        large = _labelled(members.join(stats.where(~_fits()).select("node", "n", "total"), "node").select("tree", "node", "rep", "n_shingles", "n", "total"), labels)
        large = shared.table(large.join(_mixed(large), "node"))
        if large.isEmpty():
            break
        if level < LEVELS - 1:
            down = large.join(reps.select("rep", "tokens"), "rep")
            members, stats, pairs = _nodes(shared, _children(down), reps, percent)
        else:
            labels = merge(shared, labels, shared.table(_confirmed(_blocks(large), sets, percent)))

    grouped = _labelled(reps.select("set_lo", "set_hi", "rep"), labels).select("set_lo", "set_hi", F.col("root").alias("group"))
    out = sketched.drop("tokens").join(grouped, ["set_lo", "set_hi"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
