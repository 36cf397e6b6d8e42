"""Spans of regular expressions in whole texts, with built-in functions only.

Positions are code points from 0, ends exclusive. The pieces between matches
(``split``) and the matches (``regexp_extract_all``) follow from the same
leftmost non-overlapping search, so a running sum of their lengths gives every
match's place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string,part:string>>"


def empty() -> Column:
    return F.array().cast(SPAN)


#: Elements that are combined one after the other; levels of such blocks.
SHORT, LEVELS = 128, 4


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each element of an array, all elements up to it combined (by an
    associative function). Blocks of SHORT elements are worked off one by one,
    and their last values again by blocks, so the time follows the length."""

    def short(a: Column) -> Column:
        later = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
        return F.aggregate(later, F.slice(a, 1, 1), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def joined(blocks: Column) -> Column:
        lasts = running(F.transform(blocks, lambda b: F.element_at(b, -1)), combine, levels - 1)
        return bound(lasts, lambda before: F.flatten(F.transform(
            blocks, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: combine(F.get(before, k - 1), x))))))

    def split(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(SHORT))
        blocks = F.transform(starts, lambda s: short(F.slice(a, s, SHORT)))
        return F.when(F.size(a) == 0, a).otherwise(bound(blocks, joined) if levels > 1 else F.flatten(blocks))

    return bound(values, split)


def matches(text: Column, pattern: str, part: int = 0, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """All matches as (start, end, hit, part) for which ``keep`` (of hit and
    part) holds; part is the given group. A running sum of the lengths of gaps
    and matches gives the places, so n matches cost n log n steps."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    hits, parts = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(part))

    def placed(hits: Column) -> Column:
        both = F.zip_with(gaps, hits, lambda g, h: g + F.coalesce(F.length(h), F.lit(0)))
        return bound(running(both, lambda x, y: x + y), lambda ends: F.zip_with(
            F.transform(hits, lambda h, i: F.struct(
                (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("hit"))),
            parts, lambda s, x: s.withField("part", x),
        ))

    found = bound(hits, placed)
    if keep:
        found = F.filter(found, lambda s: F.coalesce(keep(s["hit"], s["part"]), F.lit(False)))
    return F.when(text.rlike(pattern), found.cast(SPAN)).otherwise(empty())


def tagged(spans: Column, order: int) -> Column:
    """Spans as (start, kind order, end), for sorting across kinds."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end")))


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of sorted tagged spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _with_marks(spans: Column, others: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the sorted (start, end, other) of both and, for each, the
    largest end of the ``others`` up to it (-1 without any)."""
    kind = "array<struct<start:int,first:int,end:int,other:boolean>>"

    def marked(a: Column, other: bool) -> Column:
        # At one start the others come first.
        return F.transform(a, lambda s: F.struct(
            s["start"].alias("start"), F.lit(0 if other else 1).alias("first"), s["end"].alias("end"), F.lit(other).alias("other"))).cast(kind)

    both = F.array_sort(F.concat(marked(spans, False), marked(others, True)))

    def ends(a: Column) -> Column:
        return running(F.transform(a, lambda s: F.when(s["other"], s["end"]).otherwise(-1)), lambda x, y: F.greatest(x, y))

    return bound(both, lambda a: bound(ends(a), lambda e: use(a, e)))


def not_inside(spans: Column, others: Column) -> Column:
    """The (start, end) of the spans that lie in none of ``others``, sorted."""
    return F.when(F.size(others) == 0, F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(
        _with_marks(spans, others, lambda a, e: F.transform(
            F.filter(F.transform(a, lambda s, i: F.struct(s.alias("s"), F.get(e, i).alias("e"))), lambda x: ~x["s"]["other"] & (x["e"] < x["s"]["end"])),
            lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end")),
        ))
    )


def merged(spans: Column) -> Column:
    """Sorted (start, end) spans with overlapping ones joined."""

    def joined(a: Column, e: Column) -> Column:
        # A span opens a new one if all before it have ended.
        opens = F.transform(a, lambda s, i: (i == 0) | (F.get(e, i - 1) <= s["start"]))
        firsts = bound(opens, lambda o: F.filter(F.transform(a, lambda s, i: F.when(F.get(o, i), i)), lambda i: i.isNotNull()))
        return bound(firsts, lambda f: F.transform(f, lambda i, k: F.struct(
            F.get(a, i)["start"].alias("start"),
            F.get(e, F.coalesce(F.get(f, k + 1), F.size(a)) - 1).alias("end"),
        )))

    pairs = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return bound(pairs, lambda a: bound(
        running(F.transform(a, lambda s: s["end"]), lambda x, y: F.greatest(x, y)), lambda e: joined(a, e)
    ))


def redacted(text: Column, spans: Column, mask: str) -> Column:
    """The text with each of the merged spans replaced by ``mask``."""
    edges = F.concat(
        F.array(F.lit(0)), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))), F.array(F.length(text))
    )
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(text, edges[2 * i] + 1, edges[2 * i + 1] - edges[2 * i]),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, mask))
