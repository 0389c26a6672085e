"""Temporal abstraction: states, trends, contexts and patterns as DataFrame plans.

Looking back or ahead along a patient's time line is done by one sorted window over the union of both
sides (an as-of join), never by joining all pairs of a patient's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare, duration, seconds
from .intervals import COLUMNS


def state(df: DataFrame, concept: str, cases: list[tuple[str, Column]]) -> DataFrame:
    """The first case whose condition holds gives the value; rows without one are dropped."""
    value = F.lit(None).cast("string")
    for name, test in reversed(cases):
        value = F.when(test, name).otherwise(value)
    out = df.withColumn("_v", value).where("_v IS NOT NULL")
    return out.select("patient_id", F.lit(concept).alias("concept"), "start_ts", "end_ts", F.col("_v").alias("value"), F.col("_v").try_cast("double").alias("value_num"))


def trend(df: DataFrame, concept: str, variation: float | Column, steady: int | Column) -> DataFrame:
    """Between consecutive samples no further apart than the steady time (days, or a column of intervals):
    Increasing, Decreasing or Stable.

    Values that are no numbers give nothing."""
    own = Window.partitionBy("patient_id", "concept").orderBy("start_ts", "value_num")
    pairs = df.where("value_num IS NOT NULL").withColumn("_t", F.lag("start_ts").over(own)).withColumn("_d", F.col("value_num") - F.lag("value_num").over(own))
    near = F.col("start_ts") <= F.col("_t") + (F.make_interval(days=F.lit(steady)) if isinstance(steady, int) else steady)
    v = F.lit(variation) if isinstance(variation, (int, float)) else variation
    value = F.when(F.col("_d") >= v, "Increasing").when(F.col("_d") <= -v, "Decreasing").otherwise("Stable")
    return pairs.where(near).select("patient_id", (F.lit(concept) if isinstance(concept, str) else concept).alias("concept"), F.col("_t").alias("start_ts"), F.col("start_ts").alias("end_ts"), value.alias("value"), F.lit(None).cast("double").alias("value_num"))


def boundary(point: str, gap: tuple[int, str]) -> Column:
    return F.col(f"{point}_ts") + duration(*gap)


def induce(df: DataFrame, concept: str, start: Column, end: Column, constraint: Column | None = None) -> DataFrame:
    """Context intervals [start, end] of the inducer rows that meet the constraint; empty ones go."""
    rows = df if constraint is None else df.where(constraint)
    rows = rows.select("patient_id", start.alias("start_ts"), end.alias("end_ts")).where("start_ts <= end_ts")
    return rows.select("patient_id", F.lit(concept).alias("concept"), "start_ts", "end_ts", F.lit("True").alias("value"), F.lit(None).cast("double").alias("value_num"))


def clip(contexts: DataFrame, clippers: DataFrame) -> DataFrame:
    """End each context at the first clip point (patient_id, clip_ts) after its start; earlier ones do
    not touch it."""
    both = contexts.select(*COLUMNS, F.col("start_ts").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("timestamp_ntz").alias("_clip"))
    points = clippers.select("patient_id", *[F.lit(None).cast(contexts.schema[c].dataType).alias(c) for c in COLUMNS[1:]], F.col("clip_ts").alias("_at"), F.lit(0).alias("_side"), F.col("clip_ts").alias("_clip"))
    ahead = Window.partitionBy("patient_id").orderBy(F.col("_at").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.unionByName(points).withColumn("_next", F.last("_clip", ignorenulls=True).over(ahead)).where("_side = 1")
    return both.withColumn("end_ts", F.least("end_ts", "_next")).where("start_ts < end_ts OR _next IS NULL").select(*COLUMNS)


def last_before(anchors: DataFrame, samples: DataFrame, strict: bool = True, within: tuple[int, str] | None = None) -> DataFrame:
    """Each anchor with the latest sample before its start (or at it, unless strict) within a duration.

    Adds sample_ts, sample_value and sample_num; anchors without such a sample go.  A column ``_row`` of
    the anchors, if there is one, is carried along."""
    side = 0 if strict else 2  # at equal times anchors look at what sorts before them
    carried = [f for f in anchors.schema if f.name == "_row"]
    left = anchors.select(*COLUMNS, *(f.name for f in carried), F.lit(1).alias("_side"), F.lit(None).cast("struct<t:timestamp_ntz,v:string,n:double>").alias("_s"))
    right = samples.select("patient_id", F.lit(None).cast("string").alias("concept"), "start_ts", F.lit(None).cast("timestamp_ntz").alias("end_ts"), F.lit(None).cast("string").alias("value"), F.col("value_num"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in carried), F.lit(2 - side).alias("_side"), F.struct(F.col("start_ts").alias("t"), F.col("value").alias("v"), F.col("value_num").alias("n")).alias("_s"))
    past = Window.partitionBy("patient_id").orderBy("start_ts", "_side", F.when(F.col("_s").isNotNull(), F.col("value_num"))).rowsBetween(Window.unboundedPreceding, -1)
    both = left.unionByName(right).withColumn("_last", F.last("_s", ignorenulls=True).over(past)).where("_side = 1 AND _last IS NOT NULL")
    if within is not None:
        both = both.where(F.col("_last.t") + duration(*within) >= F.col("start_ts"))
    return both.select(*COLUMNS, *(f.name for f in carried), F.col("_last.t").alias("sample_ts"), F.col("_last.v").alias("sample_value"), F.col("_last.n").alias("sample_num"))


def near_anchor(anchors: DataFrame, rows: DataFrame, period: tuple[int, str]) -> DataFrame:
    """Rows that start in [anchor start, anchor start + period), with the anchor's bounds.

    Both sides are cut into time cells as long as the period, so a row meets anchors of two cells only."""
    cell = max(1.0, seconds(*period) * 1.04)  # calendar months and years can be longer than their mean
    a = anchors.select("patient_id", F.col("start_ts").alias("anchor_start"), F.col("end_ts").alias("anchor_end")).distinct()
    a = a.withColumn("_cell", F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.floor(F.unix_timestamp("anchor_start") / cell) + k)))
    r = rows.withColumn("_cell", F.floor(F.unix_timestamp("start_ts") / cell))
    return r.join(a, ["patient_id", "_cell"]).where((F.col("start_ts") >= F.col("anchor_start")) & (F.col("start_ts") < F.col("anchor_start") + duration(*period))).drop("_cell")


def periodic(anchors: DataFrame, rows: DataFrame, period: tuple[int, str], at_least: int) -> DataFrame:
    """Anchors with at least so many rows in the period after their start: patient_id, anchor_start, anchor_end, n."""
    near = near_anchor(anchors, rows, period).groupBy("patient_id", "anchor_start", "anchor_end").agg(F.count("*").alias("n"))
    return near.where(F.col("n") >= at_least)


def any_sum(anchors: DataFrame, rows: DataFrame, period: tuple[int, str], concept: str, at_least: int = 1) -> DataFrame:
    """The sum of the values near each anchor, where there are enough of them."""
    near = near_anchor(anchors, rows, period).groupBy("patient_id", "anchor_start", "anchor_end").agg(F.sum("value_num").alias("value_num"), F.count("*").alias("n")).where(F.col("n") >= at_least)
    return near.select("patient_id", F.lit(concept).alias("concept"), F.col("anchor_start").alias("start_ts"), F.col("anchor_end").alias("end_ts"), F.col("value_num").cast("string").alias("value"), "value_num")


def event_attributes(events: DataFrame, attributes: DataFrame) -> DataFrame:
    """Events with a map from concept to value of the attribute rows of the same patient and start; of
    several values of a concept the largest counts, and events without attributes get an empty map."""
    one = attributes.groupBy("patient_id", "start_ts", F.col("concept").alias("_c")).agg(F.max("value").alias("_v"))
    own = one.groupBy("patient_id", "start_ts").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_c", "_v")))).alias("attributes"))
    out = events.join(own, ["patient_id", "start_ts"], "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    return out.select(*COLUMNS, "attributes")


def constrained(df: DataFrame, constraints: list[tuple[str, str]]) -> DataFrame:
    """Rows that meet all (operator, value) constraints; several equal ones are alternatives."""
    equal = [v for op, v in constraints if op == "equal"]
    out = df
    for op, v in constraints:
        if op != "equal":
            out = out.where(compare(F.col("value"), op, float(v) if v.replace(".", "", 1).replace("-", "", 1).isdigit() else v))
    if equal:
        test = F.lit(False)
        for v in equal:
            test = test | compare(F.col("value"), "equal", v)
        out = out.where(test)
    return out
