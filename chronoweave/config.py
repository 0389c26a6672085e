"""Pipeline configuration from JSON with comments; connection secrets never live in these files."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from pathlib import Path


def strip_comments(text: str) -> str:
    """Remove // comments outside of quoted strings, and a byte-order mark."""
    out, quoted, i = [], False, 0
    text = text.lstrip("﻿")
    while i < len(text):
        c = text[i]
        if quoted and c == "\\":
            out.append(text[i: i + 2])
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        if not quoted and text.startswith("//", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
            continue
        out.append(c)
        i += 1
    return "".join(out)


def read_jsonc(path: str | os.PathLike) -> dict:
    return json.loads(strip_comments(Path(path).read_text(encoding="utf-8")))


def public(values: dict) -> dict:
    """Without the keys that begin with an underscore (notes)."""
    return {k: v for k, v in values.items() if not k.startswith("_")}


@dataclass(frozen=True)
class Windowing:
    k: int = 2
    y: int | None = 1
    step: int = 1
    start_year: int = 2010
    end_year: int = 2024


@dataclass(frozen=True)
class Mining:
    support: float = 0.2
    domain: str = "generic"
    concepts: tuple[str, ...] | None = None  # None: all
    max_gap: int | None = None  # in ``unit``; None: no limit
    unit: str = "day"
    relations: str = "Three"
    max_level: int = 7
    adjacency: bool = True


@dataclass(frozen=True)
class Config:
    window: Windowing = Windowing()
    outcome: str = ""
    ratio: int = 3
    seed: int = 42
    mining: Mining = Mining()
    project: int | None = None
    data_dir: str = "data"
    extra: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def from_file(path: str | os.PathLike) -> Config:
        """Keys window{K,Y,STEP,START_YEAR,END_DATE}, cohort, project, data and a section with MVS; all optional.

        A maxGap of 0 means no limit; of END_DATE only the year counts."""
        raw = read_jsonc(path)
        w, c = (public(raw.get(k, {})) for k in ("window", "cohort"))
        m = next((public(v) for v in raw.values() if isinstance(v, dict) and "MVS" in v), {})
        concepts = str(m.get("concepts", "*"))
        return Config(
            Windowing(w.get("K", 2), w.get("Y"), w.get("STEP", 1), w.get("START_YEAR", 2010), int(str(w.get("END_DATE", "2024"))[:4])),
            next((str(v) for k, v in c.items() if k.endswith("CONCEPT")), ""), c.get("NO_RATIO", 3), c.get("SEED", 42),
            Mining(m.get("MVS", 0.2), m.get("domain_name", "generic"), None if concepts.strip() == "*" else tuple(x.strip() for x in concepts.split(",") if x.strip()), m.get("maxGap") or None, str(m.get("timeUnit", "Days")).lower().rstrip("s")),
            public(raw.get("project", {})).get("PROJECT_ID"), public(raw.get("data", {})).get("data_dir", "data"), raw)

    def to_mining_json(self, entities: list[str] | None = None) -> str:
        """The miner's settings as one JSON object."""
        m = self.mining
        return json.dumps({"domain_name": m.domain, "concepts": "*" if m.concepts is None else ",".join(m.concepts), "maxGap": m.max_gap or 0, "timeUnit": m.unit.capitalize() + "s", "statistics_type_name": "HorizontalSupport", "projectId": self.project, "entities": entities or [], "mvs": m.support}, sort_keys=True)

    def with_support(self, support: float) -> Config:
        return replace(self, mining=replace(self.mining, support=support))


def write_json(path: str | os.PathLike, text: str) -> None:
    """Write, flush to disk, and read back to be sure."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    if json.loads(Path(path).read_text(encoding="utf-8")) != json.loads(text):
        raise OSError(f"{path} does not hold what was written")
