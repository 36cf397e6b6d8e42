"""Secret scans: base patterns plus sliding-window Shannon entropy.

Candidate strings (runs of CANDIDATE characters) are classed by the characters
they use; per class, a window of WINDOW characters slides over the string with
incremental symbol counts, so each step changes one sum by the terms of the
entering and the leaving symbol. A string whose best window reaches its class's
entropy is a secret, unless the allow list knows its form. Built-in functions
only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm import spans as S

# The base patterns of the task.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: (class, the strings that belong to it, bits per character its window needs);
#: the first that matches counts, other strings are none.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("alphanumeric", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$", 3.6),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.9),
)
#: Forms that are no secrets: UUIDs, dates and versions in slugs, placeholders.
#: Repeated groups are possessive: the search neither recurses nor retries.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|changeme|dummy|your[-_]?(key|token|secret)",
    r"(?i)0123456789|1234567890|abcdefghij|qwertyuiop",
    r"^[A-Za-z]++(?:[/_=+-]++[A-Za-z]++)*+(?:[/_=+-]++[0-9]{1,8})*+[/_=+-]*+$",
    r"^(.)\1+$",
)


def window_entropy(string: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits per character) of the windows of a
    string over ALPHABET that is at least ``window`` long."""
    term = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    state = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).cast("double").alias("sum"), F.lit(0.0).cast("double").alias("best")
    )
    # Each symbol once, then the one that enters and the one that leaves by place.
    symbols = F.transform(F.regexp_extract_all(string, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = S.bound(symbols, lambda a: F.transform(a, lambda x, i: F.struct(
        x.alias("enters"),
        F.when(i >= window, F.get(a, i - window)).otherwise(0).alias("leaves"),
        (i >= window - 1).alias("full"),
    )))

    def step(acc: Column, p: Column) -> Column:
        before = F.coalesce(F.get(acc["counts"], p["enters"] - 1), F.lit(0))
        gone = F.coalesce(F.get(acc["counts"], p["leaves"] - 1), F.lit(0)) + (p["enters"] == p["leaves"]).cast("int")
        counts = F.transform(
            acc["counts"],
            lambda c, j: c + (j + 1 == p["enters"]).cast("int") - (j + 1 == p["leaves"]).cast("int"),
        )
        added = acc["sum"] + term[before + 1] - term[before]
        now = F.when(p["leaves"] > 0, added + term[F.greatest(gone - 1, F.lit(0))] - term[gone]).otherwise(added)
        bits = F.when(p["full"], math.log2(window) - now / window).otherwise(0.0)
        return F.struct(counts.alias("counts"), now.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

    return F.aggregate(pairs, state, step, lambda acc: acc["best"])


def _entropic(string: Column) -> Column:
    least = F.lit(None).cast("double")
    for _, form, bits in reversed(CLASSES):
        least = F.when(string.rlike(form), F.lit(bits)).otherwise(least)
    allowed = F.lit(False)
    for form in ALLOW:
        allowed = allowed | string.rlike(form)
    return least.isNotNull() & ~allowed & F.when(least.isNotNull() & ~allowed, window_entropy(string) >= least).otherwise(False)


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the columns ``keep``, the
    counts n_assign, n_access, n_hex, n_entropy and ``found``, all spans as
    sorted (start, kind, end). An entropy span inside a base span is left to
    it; one that reaches beyond counts whole, so no end of a secret stays. Null
    texts count as empty; repeated rows give a row each; an empty table gives
    none; other columns are ignored. A very long text costs its length times
    the logarithm of its number of matches."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(
        F.col("doc_id"), *[F.col(c) for c in keep if c != "doc_id"],
        S.matches(text, ASSIGN, 2, lambda _, value: F.length(value) >= ASSIGN_LEAST).alias("_assign"),
        S.matches(text, ACCESS, 0, lambda hit, _: F.length(hit) >= ACCESS_LEAST).alias("_access"),
        S.matches(text, HEX).alias("_hex"),
        S.matches(text, CANDIDATE, 0, lambda hit, _: _entropic(hit)).alias("_strings"),
    )
    base = F.array_sort(F.concat(S.tagged(F.col("_assign"), 0), S.tagged(F.col("_access"), 1), S.tagged(F.col("_hex"), 2)))
    out = out.withColumn("base", base).withColumn("_more", S.tagged(S.not_inside(F.col("_strings"), F.col("base")), 3))
    return out.select(
        "doc_id", *[c for c in keep if c != "doc_id"],
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.size("_more").cast("long").alias("n_entropy"),
        "base", F.array_sort(F.concat("base", "_more")).alias("found"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_sha256 (of the base spans' digest), spans (the
    digest of all spans) and n_entropy per row; see ``scan`` for nulls, repeats,
    empty tables and long texts."""
    return scan(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(S.digest(F.col("base"), KINDS), 256).alias("base_sha256"),
        S.digest(F.col("found"), KINDS).alias("spans"),
        "n_entropy",
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of text replaced by ``mask`` (overlapping
    spans by one) and, where there is one, n_chars following the new text."""
    columns = docs.columns
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*columns).alias("row"))
    found = scan(rows, ("text", "row")).select("row", "text", S.merged(F.col("found")).alias("spans"))
    text = F.when(F.col("text").isNotNull(), S.redacted(F.col("text"), F.col("spans"), mask))
    found = found.select("row", "spans", text.alias("text"))
    values = {c: F.col("row")[c] for c in columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(F.size("spans") > 0, counted).otherwise(values["n_chars"])
    return found.select(*[values[c].alias(c) for c in columns])
