"""Places of regular-expression matches in code points, by column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pullwise.llm.common import let, running_totals

SPAN = "array<struct<start:bigint,end:bigint,match:string>>"


def _has(text: Column, pattern: str, guard: str | None) -> Column:
    return text.rlike(pattern) if guard is None else text.rlike(guard) & text.rlike(pattern)


def matches(text: Column, pattern: str, guard: str | None = None) -> Column:
    """(start, end, match) of the leftmost matches that don't overlap; end exclusive, both in code points.

    What stands between matches comes from a split, so places are running sums of lengths; texts without a match cost one search.
    guard: a cheap pattern that every text with a match has."""
    def place(gaps: Column, found: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(
            F.length(g).cast("long").alias("gap"), m.alias("match"), F.length(m).cast("long").alias("n")))
        return let(pairs, lambda ps: let(running_totals(F.transform(ps, lambda p: p["gap"] + p["n"])), lambda before: F.transform(
            ps, lambda p, i: F.struct((F.get(before, i) + p["gap"]).alias("start"), (F.get(before, i) + p["gap"] + p["n"]).alias("end"), p["match"].alias("match")))))

    return F.when(_has(text, pattern, guard), let(F.split(text, pattern, -1), lambda gaps: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: place(gaps, found)))).otherwise(F.array().cast(SPAN))


def replaced(text: Column, pattern: str, new: Callable[[Column], Column], guard: str | None = None) -> Column:
    """The text with new(match) in place of every match."""
    def rebuild(gaps: Column, found: Column) -> Column:
        tail = F.concat(F.transform(found, new), F.array(F.lit("")))
        return F.array_join(F.zip_with(gaps, tail, lambda g, m: F.concat(g, m)), "")

    return F.when(_has(text, pattern, guard), let(F.split(text, pattern, -1), lambda gaps: rebuild(
        gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))).otherwise(text)
