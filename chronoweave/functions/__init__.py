"""Column functions: predicates, time parsing, relations and membership; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Granularities of durations and the make_interval argument each sets.
GRANULARITIES = ("second", "minute", "hour", "day", "week", "month", "year")


def concept_is(concept: Column, name: str) -> Column:
    """Exact concept match after trimming and lower-casing both sides."""
    return F.lower(F.trim(concept)) == name.strip().lower()


def concept_like(concept: Column, pattern: str) -> Column:
    """SQL LIKE match, case-insensitive; ``_`` and ``%`` are wildcards."""
    return concept.ilike(pattern)


def in_years(ts: Column, first: int, last: int) -> Column:
    """Half-open range of whole years; plain bounds on the column, so it is pushed to the scan."""
    return (ts >= F.lit(f"{first:04d}-01-01").cast("timestamp_ntz")) & (ts < F.lit(f"{last:04d}-01-01").cast("timestamp_ntz"))


def parse_timestamp(text: Column) -> Column:
    """``y-M-d`` with an optional ``H:m[:s[.fraction]]``; null for anything else."""
    t = F.trim(text)
    parsed = F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-M-d H:m[:s[.SSSSSS]]")), F.try_to_timestamp(t, F.lit("yyyy-M-d H:m:s.SSS")), F.try_to_timestamp(t, F.lit("yyyy-M-d")))
    return parsed.cast("timestamp_ntz")


def duration(value: int | float | str | Column, granularity: str) -> Column:
    """A calendar interval (months and years clamp to the month's end); an empty value is zero."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}")
    if isinstance(value, str):
        value = int(value or 0)
    v = value if isinstance(value, Column) else F.lit(value)
    return F.make_interval(**{{"second": "secs", "minute": "mins"}.get(granularity, granularity + "s"): v})


def seconds(value: float, granularity: str) -> float:
    """The length of a duration in seconds, months and years on average."""
    return value * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2629746, "year": 31556952}[granularity]


def compare(left: Column, operator: str, right: float | str) -> Column:
    """A rule's comparison: numeric with a number, else trimmed and case-insensitive text."""
    if isinstance(right, str):
        try:
            number = float(right)
        except ValueError:
            text = F.lower(F.trim(left)) == right.strip().lower()
            if operator != "equal":
                raise ValueError(f"{operator} compares numbers, not {right!r}") from None
            return text
        if operator == "equal":
            return F.coalesce(F.trim(left).try_cast("double") == number, F.lit(False)) | (F.lower(F.trim(left)) == right.strip().lower())
        right = number
    x = left.try_cast("double")
    return {"equal": x == right, "bigger": x > right, "bigger-equal": x >= right, "smaller": x < right, "smaller-equal": x <= right}[operator]


def relation_three(a_start, a_end, b_start, b_end) -> Column:
    """Before (b), overlaps (o) or contains (c) for A not after B in (start, end) order; total, points too."""
    return F.when(a_start == b_start, "c").when(b_start >= a_end, "b").when(b_end > a_end, "o").otherwise("c")


def relation_seven(a_start, a_end, b_start, b_end) -> Column:
    """Allen's relations of A to B for A not after B: equal, starts, before, meets, overlaps, finished-by, contains."""
    return (F.when((a_start == b_start) & (a_end == b_end), "=").when(a_start == b_start, "s").when(b_start > a_end, "<")
            .when(b_start == a_end, "m").when(b_end > a_end, "o").when(b_end == a_end, "f").otherwise("c"))


RELATIONS = {"Three": relation_three, "Seven": relation_seven}


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Membership that rises from a to b, is 1 to c and falls to d; ramps of no width are steps."""
    out = F.when(x < a, 0.0)
    if b > a:
        out = out.when(x < b, (x - a) / (b - a))
    out = out.when(x <= c, 1.0)
    if d > c:
        out = out.when(x < d, (d - x) / (d - c))
    return out.when(x.isNull(), None).otherwise(0.0)
