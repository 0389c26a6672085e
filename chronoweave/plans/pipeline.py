"""The pipelines: windows, cohorts, abstraction, mining, results, as one plan a window and label.

YES/NO pipelines label by an outcome after each window; the others take everyone with a record in the
window, or a fixed list of ids.  A window without YES ids is skipped whole; an empty NO cohort skips only
its own leg.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..config import Config
from ..operators import cohort as C
from ..operators import mining as M
from ..session import staged
from .catalog import Catalog
from .executor import evaluate

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Leg:
    """A cohort of one window under one label."""

    window: C.Years
    label: str
    cohort: DataFrame
    size: int


def yes_no_legs(events: DataFrame, config: Config, ws: list[C.Years], prefix: str = "") -> Iterator[Leg]:
    """YES and NO legs of every window (labels with a prefix such as MORTALITY_)."""
    labels = staged(C.window_labels(events, config.outcome, ws, config.ratio, config.seed), "labels")
    sizes = {(r["k_start"], r["label"]): r["n"] for r in labels.groupBy("k_start", "label").agg(F.count("*").alias("n")).collect()}  # two rows a window
    for w in ws:
        if not sizes.get((w.k_start, "YES")):
            log.info("window %s: no outcome, skipped", w.name)
            continue
        for label in ("YES", "NO"):
            if n := sizes.get((w.k_start, label)):
                yield Leg(w, prefix + label, labels.where((F.col("k_start") == w.k_start) & (F.col("label") == label)).select("patient_id"), n)


def all_legs(events: DataFrame, ws: list[C.Years]) -> Iterator[Leg]:
    for w in ws:
        ids = staged(C.all_cohort(events, w), "cohort")
        if n := ids.count():
            yield Leg(w, "ALL", ids, n)


def list_legs(ids: DataFrame, name: str, ws: list[C.Years]) -> Iterator[Leg]:
    ids = staged(ids.select("patient_id").distinct(), "cohort")
    n = ids.count()
    for w in ws if n else ():
        yield Leg(w, name, ids, n)


def run_leg(events: DataFrame, leg: Leg, config: Config, catalog: Catalog | None = None, derive: Callable[[DataFrame], DataFrame] | None = None, history: bool = False) -> DataFrame:
    """``window, label, patient_id, level, pattern, horizontal`` of one leg.

    Abstraction reads deduplicated rows of the cohort that start in the window (with ``history`` earlier
    ones too).  Without a catalog, ``derive`` makes the intervals; without either, events are mined."""
    rows = C.restrict(events, leg.cohort)
    rows = rows.where(F.col("start_ts") < F.lit(f"{leg.window.k_end:04d}-01-01").cast("timestamp_ntz")) if history else C.in_window(rows, leg.window)
    once = C.exact_dedup(rows)
    if catalog is not None:
        made = evaluate(catalog, once, datetime(leg.window.k_end, 1, 1))
        if config.mining.concepts is None:  # every concept: raw rows are symbols as well
            known = {c.name.lower() for c in catalog.concepts.values()}
            made = made.unionByName(rows.where(~F.lower("concept").isin(sorted(known))))
    else:
        made = derive(once) if derive else rows
    m = config.mining
    gap = (m.max_gap, m.unit) if m.max_gap else None
    found = M.mine(made.where("start_ts IS NOT NULL AND end_ts IS NOT NULL"), leg.size, m.support, m.max_level, m.relations, gap, m.adjacency, list(m.concepts) if m.concepts else None)
    return found.select(F.lit(leg.window.name).alias("window"), F.lit(leg.label).alias("label"), "patient_id", "level", "pattern", "horizontal")


def run(events: DataFrame, config: Config, out: str, mode: str = "yes-no", catalog: Catalog | None = None, ids: DataFrame | None = None, name: str = "LIST", prefix: str = "", only: dict | None = None, csv: bool = True) -> list[str]:
    """Run the pipeline and write its results; the paths written."""
    w = config.window
    ws = C.select_windows(C.windows(w.k, w.step, w.start_year, w.end_year, w.y if mode == "yes-no" else None), **(only or {}))
    legs = {"yes-no": lambda: yes_no_legs(events, config, ws, prefix), "all": lambda: all_legs(events, ws), "list": lambda: list_legs(ids, name, ws)}[mode]()
    paths = []
    for leg in legs:
        found = staged(run_leg(events, leg, config, catalog), "patterns")
        sources.write_long(found, f"{out}/long")
        if csv:
            rows, names = M.matrix(found, leg.cohort)
            paths.append(sources.write_matrix(M.wide(rows, names), out, leg.window.k_start, leg.window.k_end, leg.label, config.mining.domain))
        log.info("window %s %s: %d ids", leg.window.name, leg.label, leg.size)
    return paths
