"""Command line: ``python -m chronoweave --config c.json --events path --out path [--mode yes-no|all|list]``."""

from __future__ import annotations

import argparse
from pathlib import Path

from . import sources
from .config import Config
from .plans.catalog import Catalog
from .plans.pipeline import run
from .session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="chronoweave", description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--events", help="CSV folder or file, or Parquet with the event columns; default: the config's folder")
    p.add_argument("--rules", help="folder of rule files")
    p.add_argument("--ids", help="file of ids, for --mode list")
    p.add_argument("--out", required=True)
    p.add_argument("--mode", choices=("yes-no", "all", "list"), default="yes-no")
    p.add_argument("--prefix", default="", help="label prefix, such as MORTALITY_")
    p.add_argument("--window", type=int, help="1-based index of the only window to run")
    p.add_argument("--k-start", type=int)
    p.add_argument("--k-end", type=int)
    a = p.parse_args(argv)
    spark = session()
    config = Config.from_file(a.config)
    path = a.events or f"{config.data_dir}/raw_events.csv"
    try:
        if not sources.exists(spark, path):
            raise FileNotFoundError(path)
        events = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else sources.events(sources.raw_csv(spark, path))
        ids = sources.id_list(spark, a.ids) if a.ids else None
    except FileNotFoundError as e:
        print(f"missing input: {e}")
        return 2
    only = {"index": a.window} if a.window else {"k_start": a.k_start, "k_end": a.k_end}
    for path in run(events, config, a.out, a.mode, Catalog.read(a.rules) if a.rules else None, ids, Path(a.ids).stem if a.ids else "LIST", a.prefix, only):
        print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
