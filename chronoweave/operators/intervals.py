"""The interval kernel over intervals(patient_id, concept, start_ts, end_ts, value, value_num).

Every operator is a window or an equi join on the patient; none compares a patient's rows pairwise
unless the result itself is pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import duration

COLUMNS = ("patient_id", "concept", "start_ts", "end_ts", "value", "value_num")


def numeric_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """Rows whose value is a number in [low, high]."""
    return df.where(F.col("value_num").between(low, high))


def nominal_domain(df: DataFrame, domain: list[str]) -> DataFrame:
    """Rows whose trimmed value is in the domain, whatever its case."""
    return df.where(F.lower(F.trim("value")).isin([d.strip().lower() for d in domain]))


def _times() -> list:
    """The order of a time line: by start and end, rows without a time last."""
    return [F.asc_nulls_last("start_ts"), F.asc_nulls_last("end_ts")]


def persist(df: DataFrame, before: tuple[int, str], after: tuple[int, str], truncate: bool = True) -> DataFrame:
    """[start - before, end + after]; with ``truncate`` the end stops where the next sample of the
    patient's concept starts, but not before the sample's own end."""
    end = F.col("end_ts") + duration(*after)
    if truncate:
        following = F.lead("start_ts").over(Window.partitionBy("patient_id", "concept").orderBy(*_times(), F.asc_nulls_last("value")))
        end = F.when(following.isNull(), end).otherwise(F.greatest(F.least(end, following), F.col("end_ts")))
    return df.withColumn("_end", end).withColumn("start_ts", F.col("start_ts") - duration(*before)).withColumn("end_ts", F.col("_end")).drop("_end")


def concatenate(df: DataFrame, limit: Column | None = None) -> DataFrame:
    """Merge a concept's neighbouring intervals of equal value with gaps up to ``limit`` (30 days);
    another value in between keeps them apart."""
    limit = duration(30, "day") if limit is None else limit
    own = Window.partitionBy("patient_id", "concept").orderBy(*_times(), F.asc_nulls_last("value"))
    runs = df.withColumn("_run", F.sum(F.when(F.lag("value").over(own).eqNullSafe(F.col("value")), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("patient_id", "concept", "_run").orderBy(*_times())
    reach = F.max("end_ts").over(run.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("_new", F.when(F.col("start_ts") <= reach + limit, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("patient_id", "concept", "_run", "_island").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.first("value").alias("value"), F.min("value_num").alias("value_num"))
    return out.select(*COLUMNS)


def intersect(parts: list[DataFrame], concept: str, value: str) -> DataFrame:
    """Where all parts hold at once: the overlaps of one interval of each, points included."""
    first = parts[0].select("patient_id", F.col("start_ts").alias("s"), F.col("end_ts").alias("e"))
    for p in parts[1:]:
        other = p.select("patient_id", F.col("start_ts").alias("s2"), F.col("end_ts").alias("e2"))
        first = first.join(other, "patient_id").where((F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e"))).select("patient_id", F.greatest("s", "s2").alias("s"), F.least("e", "e2").alias("e"))
    return first.distinct().select("patient_id", F.lit(concept).alias("concept"), F.col("s").alias("start_ts"), F.col("e").alias("end_ts"), F.lit(value).alias("value"), F.lit(value).try_cast("double").alias("value_num"))


def union(parts: list[DataFrame], concept: str, value: str) -> DataFrame:
    """Where any part holds: the union of intervals, overlapping and touching ones merged."""
    rows = reduce(DataFrame.unionByName, [p.select("patient_id", "start_ts", "end_ts") for p in parts])
    order = Window.partitionBy("patient_id").orderBy("start_ts", "end_ts")
    reach = F.max("end_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("start_ts") <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("patient_id", "_island").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    return out.select("patient_id", F.lit(concept).alias("concept"), "start_ts", "end_ts", F.lit(value).alias("value"), F.lit(value).try_cast("double").alias("value_num"))
