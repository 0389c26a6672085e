"""Evaluates a rule catalog over events, level by level.

Concepts of one kind share a plan wherever they can: raw concepts one dictionary join, states of a single
source one pass over the intervals, trends one window.  Each level is written to the shared folder before
the next reads it, so plans stay small however deep the rules go.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compare, duration, trapezoid
from ..operators import abstraction as A
from ..operators import intervals as I
from ..session import staged
from .catalog import Catalog, Concept, Test


def _condition(test: Test) -> Column:
    """A single-source test as a condition on the row's value."""
    if test.parts:
        parts = [_condition(p) for p in test.parts]
        return reduce(lambda a, b: a & b if test.operator == "and" else a | b, parts)
    return F.coalesce(compare(F.col("value"), test.operator, test.right), F.lit(False))


def _of(rows: DataFrame, concept: str) -> DataFrame:
    return rows.where(F.col("concept") == concept)


def _raw(concepts: list[Concept], events: DataFrame) -> DataFrame | None:
    """Raw concepts and events: names become ids, values are checked; one join with the dictionary."""
    if not concepts:
        return None
    spark = events.sparkSession
    dictionary = spark.createDataFrame([(c.name.strip().lower(), c.id, c.kind, *(c.range or (None, None)), [d.lower() for d in c.domain]) for c in concepts], "name string, id string, kind string, low double, high double, domain array<string>")
    rows = events.join(F.broadcast(dictionary), F.lower(F.trim("concept")) == F.col("name"))  # as small as the catalog
    fine = F.when(F.col("kind") == "numeric-raw-concept", F.col("value_num").isNotNull() & (F.col("low").isNull() | F.col("value_num").between(F.col("low"), F.col("high"))))
    fine = fine.when(F.col("kind") == "nominal-raw-concept", (F.size("domain") == 0) | F.array_contains("domain", F.lower(F.trim("value")))).otherwise(True)
    return rows.where(fine).select("patient_id", F.col("id").alias("concept"), "start_ts", "end_ts", "value", "value_num")


def _states(concepts: list[Concept], rows: DataFrame) -> DataFrame | None:
    """States of one source: all of them in one pass, each row giving as many states as apply."""
    if not concepts:
        return None
    made = []
    for c in concepts:
        (source,) = {s for _, _, t in c.cases for s in t.sources()}
        value = F.lit(None).cast("string")
        for _, name, test in reversed(c.cases):
            value = F.when(_condition(test), name).otherwise(value)
        made.append(F.when(F.col("concept") == source, F.struct(F.lit(c.id).alias("c"), value.alias("v"))))
    sources = sorted({s for c in concepts for _, _, t in c.cases for s in t.sources()})
    out = rows.where(F.col("concept").isin(sources)).withColumn("_s", F.explode(F.filter(F.array(*made), lambda s: s["v"].isNotNull())))
    return out.select("patient_id", F.col("_s.c").alias("concept"), "start_ts", "end_ts", F.col("_s.v").alias("value"), F.col("_s.v").try_cast("double").alias("value_num"))


def _branches(test: Test, rows: DataFrame, concept: str, value: str) -> DataFrame:
    """A test over several sources: and is the overlap of its parts, or their union."""
    if not test.parts:
        return _of(rows, test.concept).where(_condition(test))
    parts = [_branches(p, rows, concept, value) for p in test.parts]
    return (I.intersect if test.operator == "and" else I.union)(parts, concept, value)


def _state(c: Concept, rows: DataFrame) -> DataFrame:
    """A state of several sources; of its values the first by order wins where they hold alike."""
    made = [_branches(t, rows, c.id, v).select("patient_id", F.lit(c.id).alias("concept"), "start_ts", "end_ts", F.lit(v).alias("value"), F.lit(v).try_cast("double").alias("value_num"), F.lit(k).alias("_k")) for k, v, t in c.cases]
    out = reduce(DataFrame.unionByName, made)
    return out.groupBy("patient_id", "concept", "start_ts", "end_ts").agg(F.min_by("value", "_k").alias("value"), F.min_by("value_num", "_k").alias("value_num")).select(*I.COLUMNS)


def _trends(concepts: list[Concept], rows: DataFrame) -> DataFrame | None:
    if not concepts:
        return None
    spark = rows.sparkSession
    units = {"year": (12, 0, 0), "month": (1, 0, 0), "week": (0, 7, 0), "day": (0, 1, 0), "hour": (0, 0, 3600), "minute": (0, 0, 60), "second": (0, 0, 1)}
    steady = {c.id: [c.steady[0] * u for u in units[c.steady[1]]] for c in concepts}
    table = spark.createDataFrame([(c.sources[0], c.id, c.variation, *steady[c.id]) for c in concepts if c.sources], "source string, trend string, sv double, months int, days int, secs int")
    used = rows.join(F.broadcast(table), F.col("concept") == F.col("source"))  # as small as the catalog
    return A.trend(used.withColumn("concept", F.col("trend")), F.col("trend"), F.col("sv"), F.make_interval(months="months", days="days", secs=F.col("secs").cast("decimal(18,6)")))


def _context(c: Concept, rows: DataFrame) -> DataFrame:
    made = [A.induce(A.constrained(_of(rows, i.concept), list(i.constraints)), c.id, A.boundary(*i.start), A.boundary(*i.end)) for i in c.inducers]
    out = reduce(DataFrame.unionByName, made)
    if c.clippers:
        points = [A.constrained(_of(rows, i.concept), list(i.constraints)).select("patient_id", A.boundary(*i.start).alias("clip_ts")) for i in c.clippers]
        out = A.clip(out, reduce(DataFrame.unionByName, points))
    return out


def _pattern(c: Concept, rows: DataFrame, as_of: datetime | None) -> DataFrame:
    """A pattern's matches: components joined by patient and constraints, or gathered near an anchor."""
    parts = {k.alias: A.constrained(_of(rows, k.concept), list(k.constraints)) for k in c.components}
    if c.periodic is not None:
        at_least, period, anchor = c.periodic
        anchors = next((parts[k.alias] for k in c.components if k.concept == anchor), None)
        if anchors is None:
            anchors = _of(rows, anchor)
        others = [parts[k.alias] for k in c.components if k.concept != anchor or c.relation == "any"]
        near = reduce(DataFrame.unionByName, others) if others else anchors
        if c.output[:1] == ("sum",):
            return A.any_sum(anchors, near, period, c.id, at_least)
        hits = A.near_anchor(anchors, near, period)
        kept = hits.groupBy("patient_id", "anchor_start", "anchor_end").agg(F.count("*").alias("n"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum(F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts")).alias("held")).where(F.col("n") >= at_least)
        value = trapezoid(F.col("held") / 3600.0, *c.output[1:]).cast("string") if c.output[:1] == ("trapezoid",) else F.lit("true")
        return kept.select("patient_id", F.lit(c.id).alias("concept"), "start_ts", "end_ts", value.alias("value"), value.try_cast("double").alias("value_num"))
    first, *rest = c.components
    start = {first.alias: 0}
    out = parts[first.alias].select("patient_id", *_named(first.alias))
    for k in rest:
        rule = next((p for p in c.pairwise if {p.i, p.j} <= {*start, k.alias} and k.alias in (p.i, p.j)), None)
        if rule is not None and rule.j == k.alias and rule.operator != "equal":
            anchor = out.select("patient_id", F.struct("*").alias("_row"), F.col(f"{rule.i}_start").alias("start_ts"), F.col(f"{rule.i}_end").alias("end_ts"))
            anchor = anchor.withColumns({"concept": F.lit(c.id), "value": F.lit(None).cast("string"), "value_num": F.lit(None).cast("double")})
            got = A.last_before(anchor, parts[k.alias], rule.operator == "bigger", rule.max_duration)
            out = got.select("_row.*", F.col("sample_ts").alias(f"{k.alias}_start"), F.col("sample_ts").alias(f"{k.alias}_end"), F.col("sample_value").alias(f"{k.alias}_value"))
        else:
            out = out.join(parts[k.alias].select("patient_id", *_named(k.alias)), "patient_id")
            if rule is not None:
                i, j = F.col(f"{rule.i}_start"), F.col(f"{rule.j}_start")
                out = out.where({"bigger": i > j, "bigger-equal": i >= j, "equal": i == j}[rule.operator])
                if rule.max_duration:
                    out = out.where(j + duration(*rule.max_duration) >= i)
            else:  # no order given: components must hold together
                out = out.where((F.col(f"{first.alias}_start") <= F.col(f"{k.alias}_end")) & (F.col(f"{k.alias}_start") <= F.col(f"{first.alias}_end")))
        start[k.alias] = len(start)
    names = [k.alias for k in c.components]

    def operand(ref: str) -> Column:
        if ref == "current-time":
            if as_of is None:
                raise ValueError(f"{c.name} needs as_of")
            return F.lit(float(as_of.year))
        own = [k.alias for k in c.components if k.concept == ref]
        return F.col(f"{own[0] if own else names[int(ref) - 1]}_value").try_cast("double")

    value: Column = F.lit("true")
    if c.output[:1] in (("abs",), ("minus",)):
        left, right = operand(c.output[1]), operand(c.output[2])
        value = (F.abs(left) if c.output[0] == "abs" else left - right).cast("string")
    bound = {side: F.col(ref.replace(".", "_")) + duration(*shift) for side, ref, shift in c.bounds if ref.split(".")[0] in names}
    lo = bound.get("start", F.least(*[F.col(f"{n}_start") for n in names]) if len(names) > 1 else F.col(f"{names[0]}_start"))
    hi = bound.get("end", F.greatest(*[F.col(f"{n}_end") for n in names]) if len(names) > 1 else F.col(f"{names[0]}_end"))
    made = out.select("patient_id", F.lit(c.id).alias("concept"), lo.alias("start_ts"), hi.alias("end_ts"), value.alias("value"), value.try_cast("double").alias("value_num")).distinct()
    return made.where("value IS NOT NULL") if c.range is None else made.where(F.col("value_num").between(*c.range))


def _named(alias: str) -> list[Column]:
    return [F.col("start_ts").alias(f"{alias}_start"), F.col("end_ts").alias(f"{alias}_end"), F.col("value").alias(f"{alias}_value")]


def _persisted(made: DataFrame, concepts: list[Concept]) -> DataFrame:
    """Local persistence by concept, then concatenation of the concepts that allow it."""
    out = []
    groups: dict[tuple, list[str]] = {}
    for c in concepts:
        groups.setdefault((c.before, c.after, c.concatenable, c.bridge), []).append(c.id)
    for (before, after, join, bridge), ids in groups.items():
        rows = made.where(F.col("concept").isin(ids))
        if before[0] or after[0]:
            rows = I.persist(rows, before, after)
        if join:
            rows = I.concatenate(rows)
        elif bridge:
            rows = I.concatenate(rows, duration(*bridge))
        out.append(rows.select(*I.COLUMNS))
    return reduce(DataFrame.unionByName, out)


def evaluate(catalog: Catalog, events: DataFrame, as_of: datetime | None = None, stage: bool = True, external: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All intervals that the catalog derives from events; ``concept`` holds the concept's id.

    Trends are computed on samples, states and contexts on persisted intervals.  ``as_of`` stands for the
    current time, so results do not depend on when they are computed.  ``external`` replaces the rule of a
    concept by a function of the intervals known so far (vectorised UDFs have their place there)."""
    external = external or {}
    known = samples = None
    for every in catalog.levels:
        concepts = [c for c in every if c.id not in external]
        made = [
            *[external[c.id](events if known is None else known).select(*I.COLUMNS) for c in every if c.id in external],
            _raw([c for c in concepts if c.kind in ("numeric-raw-concept", "nominal-raw-concept", "event")], events),
            *([] if known is None else [
                _states([c for c in concepts if c.kind == "state" and len({s for _, _, t in c.cases for s in t.sources()}) == 1], known),
                *[_state(c, known) for c in concepts if c.kind == "state" and len({s for _, _, t in c.cases for s in t.sources()}) > 1],
                _trends([c for c in concepts if c.kind == "trend"], samples),
                *[_context(c, known) for c in concepts if c.kind == "context" and c.inducers],
                *[_pattern(c, known, as_of) for c in concepts if c.kind == "pattern" and c.components],
            ]),
        ]
        made = [m for m in made if m is not None]
        if not made:
            continue
        rows = reduce(DataFrame.unionByName, made)
        if stage:  # read once for each kind of persistence, and again by trends
            rows = staged(rows, "made")
        kept = _persisted(rows, every)
        if stage:
            kept = staged(kept, "level")
        samples = rows if samples is None else samples.unionByName(rows)
        known = kept if known is None else known.unionByName(kept)
    if known is None:
        return events.sparkSession.createDataFrame([], "patient_id string, concept string, start_ts timestamp_ntz, end_ts timestamp_ntz, value string, value_num double")
    return known
