"""Windows, cohorts and labels over events(patient_id, concept, start_ts, end_ts, value, value_num)."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import concept_is, concept_like, in_years


@dataclass(frozen=True)
class Years:
    """An observation window [k_start, k_end) and its outcome window [k_end, y_end), in years."""

    k_start: int
    k_end: int
    y_start: int | None = None
    y_end: int | None = None

    @property
    def name(self) -> str:
        return f"{self.k_start}-{self.k_end}"


def windows(k: int, step: int, start: int, end: int, y: int | None = None) -> list[Years]:
    """Windows that advance by ``step`` while the last year used stays within ``end``."""
    out, s = [], start
    while s + k + (y or 0) <= end:
        out.append(Years(s, s + k, s + k if y else None, s + k + y if y else None))
        s += step
    return out


def select_windows(all_: list[Years], index: int | None = None, k_start: int | None = None, k_end: int | None = None) -> list[Years]:
    """All windows, the one at a 1-based index, or those with the given observation years."""
    if index is not None:
        if not 1 <= index <= len(all_):
            raise ValueError(f"window {index} of {len(all_)}")
        return [all_[index - 1]]
    return [w for w in all_ if k_start in (None, w.k_start) and k_end in (None, w.k_end)]


def window_frame(spark: SparkSession, ws: list[Years]) -> DataFrame:
    """One row a window: a table as small as the configuration that it came from."""
    schema = "k_start int, k_end int, y_start int, y_end int"
    return spark.createDataFrame([(w.k_start, w.k_end, w.y_start, w.y_end) for w in ws], schema)


def _having(events: DataFrame, outcome: str, like: bool) -> DataFrame:
    return events.where((concept_like if like else concept_is)(F.col("concept"), outcome))


def yes_cohort(events: DataFrame, outcome: str, w: Years, like: bool = False) -> DataFrame:
    """Ids with the outcome in the outcome window, earlier ones included; each once."""
    return _having(events, outcome, like).where(in_years(F.col("start_ts"), w.y_start, w.y_end)).select("patient_id").distinct()


def never_pool(events: DataFrame, outcome: str, like: bool = False, dated_only: bool = True) -> DataFrame:
    """Ids that never have the outcome, at any time.  With ``dated_only`` an outcome without a usable
    time does not count."""
    had = _having(events, outcome, like)
    had = had.where("start_ts IS NOT NULL") if dated_only else had
    return events.select("patient_id").distinct().join(had.select("patient_id").distinct(), "patient_id", "left_anti")


def all_cohort(events: DataFrame, w: Years) -> DataFrame:
    """Ids with any record in the observation window."""
    return events.where(in_years(F.col("start_ts"), w.k_start, w.k_end)).select("patient_id").distinct()


def ordered(ids: DataFrame) -> DataFrame:
    """Ids by length and then text."""
    return ids.orderBy(F.length("patient_id"), "patient_id")


def control_sample(pool: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """The first ``n`` of the pool in md5(id|seed) order for every row of ``sizes(<keys>, n)``; all if
    fewer.  The same order serves all rows, so equal sizes give equal samples.

    No global sort: ids are counted by the first four digits of their digest (65,536 groups at most),
    whole groups are taken up to the size, and only the group at the cut is ranked."""
    keys = [c for c in sizes.columns if c != "n"]
    digest = pool.select("patient_id", F.md5(F.concat_ws("|", "patient_id", F.lit(str(seed)))).alias("h")).withColumn("g", F.substring("h", 1, 4))
    groups = digest.groupBy("g").count()
    groups = groups.withColumn("before", F.sum("count").over(Window.orderBy("g")) - F.col("count"))
    ranked = digest.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h", "patient_id"))).join(groups.select("g", "before"), "g")
    return ranked.join(F.broadcast(sizes), F.col("before") + F.col("r") <= F.col("n")).select(*keys, "patient_id")  # sizes: one row a window


def random_sample(pool: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n ids in random order, another draw each time unless seeded."""
    return pool.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n)


def control_sample_seeded(pool: DataFrame, n: int, seed: int) -> list[str]:
    """The sample that a seeded standard-library generator draws from the ids in (length, text) order;
    it gathers the pool on the driver, so it serves comparisons on small data only."""
    ids = [r[0] for r in ordered(pool).collect()]
    return random.Random(seed).sample(ids, min(n, len(ids)))


def window_labels(events: DataFrame, outcome: str, ws: list[Years], ratio: int = 3, seed: int = 42, like: bool = False) -> DataFrame:
    """``k_start, label, patient_id`` of all windows in one plan.

    YES: the outcome falls in the outcome window.  NO: ``ratio`` times as many of the ids that never
    have it.  A window without YES ids has no rows at all."""
    spark = events.sparkSession
    frame = F.broadcast(window_frame(spark, ws))
    had = _having(events, outcome, like).where("start_ts IS NOT NULL").select("patient_id", F.year("start_ts").alias("year"))
    yes = had.join(frame, (F.col("year") >= F.col("y_start")) & (F.col("year") < F.col("y_end"))).select("k_start", "patient_id").distinct()
    sizes = yes.groupBy("k_start").agg((F.count("*") * ratio).alias("n"))
    no = control_sample(never_pool(events, outcome, like), sizes, seed)
    return yes.withColumn("label", F.lit("YES")).unionByName(no.withColumn("label", F.lit("NO"))).select("k_start", "label", "patient_id")


def restrict(events: DataFrame, cohort: DataFrame) -> DataFrame:
    """Rows whose trimmed id is in the cohort, as they are; the planner broadcasts a cohort that is small."""
    ids = cohort.select(F.trim("patient_id").alias("_id")).distinct()
    return events.join(ids, F.trim(events.patient_id) == ids._id, "left_semi")


def in_window(events: DataFrame, w: Years) -> DataFrame:
    return events.where(in_years(F.col("start_ts"), w.k_start, w.k_end))


def exact_dedup(raw: DataFrame) -> DataFrame:
    """Rows that are equal in every column, once."""
    return raw.dropDuplicates()


def folds(ids: DataFrame, k: int) -> DataFrame:
    """A stable fold from 0 to k - 1 for each id; one fold is no split."""
    return ids.withColumn("fold", F.pmod(F.conv(F.substring(F.md5("patient_id"), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))
