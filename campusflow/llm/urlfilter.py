"""URL filters by a Bloom filter cascade.

A list of keys (host suffix + path prefix) is encoded over the complete key
universe of the corpus: level 1 is a Bloom filter of the listed keys, level 2
one of the unlisted keys of the universe that pass level 1, level 3 one of the
listed keys that pass level 2, and so on until nothing passes wrongly. A key
of the universe is listed if the first level that refuses it is an even one,
or the last level that there is is an odd one. Each level is a binary literal
in the query, so urls are judged without a join; built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.llm.bloom import Level, bloom_level
from campusflow.llm.common import Shared

LEVELS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that decide exactly, for every ``key`` of ``universe`` and every
    listed one, whether it is listed. The driver receives the bits of the
    levels only, at most LITERAL_BYTES each."""
    inside = listed.select("key").distinct()
    outside = universe.select("key").distinct().join(inside, "key", "left_anti")
    levels: list[Level] = []
    while len(levels) < LEVELS:
        count = inside.count()
        if not count:
            return levels
        level = bloom_level(inside, count, len(levels))
        levels.append(level)
        inside, outside = outside.where(level.passes(F.col("key"))), inside
    raise RuntimeError("the cascade does not end; the same key is on both sides")


def is_listed(levels: list[Level], key: Column) -> Column:
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.passes(key), F.lit(level.number % 2 == 1)).otherwise(out)
    return out


def listed_by_join(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key is listed, for lists beyond a literal."""
    return keys.join(listed.select("key").distinct(), "key", "left_semi")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a url; both
    empty for null and without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every domain suffix of the host with every path prefix of the given
    lengths: all the rules that could fit."""
    labels = F.split(host, "[.]", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull()
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when((host != "") | (path != ""), keys).otherwise(F.array().cast("array<string>"))


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id,
    url). ``rules`` (action, host, path): a rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest fitting
    rule decides (block before allow if both list it), and a url that none
    fits, whose keys the cascades all refuse, is allowed with a null rule.

    Null urls have empty host and path; repeated rows give a row each; rules
    with a null column are left out; without rules everything is allowed.
    """
    shared = Shared(spark, "urlfilter")
    rules = rules.where("action is not null and host is not null and path is not null").select(
        "action", F.concat("host", "path").alias("key"), F.length("path").alias("n")
    )
    lengths = sorted(r["n"] for r in rules.select("n").distinct().collect())
    host, path = split_url(F.col("url").cast("string"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = split.withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths))
    if not lengths:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    universe = shared.table(keyed.select(F.explode("keys").alias("key")).distinct())
    block = cascade(rules.where("action = 'block'"), universe)
    allow = cascade(rules.where("action = 'allow'"), universe)
    fitting = F.concat(
        F.transform(F.filter("keys", lambda k: is_listed(allow, k)), lambda k: F.struct(F.length(k).alias("n"), F.lit("allow").alias("verdict"), k.alias("rule"))),
        F.transform(F.filter("keys", lambda k: is_listed(block, k)), lambda k: F.struct(F.length(k).alias("n"), F.lit("block").alias("verdict"), k.alias("rule"))),
    )
    best = keyed.withColumn("best", F.array_max(fitting))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")
    )
