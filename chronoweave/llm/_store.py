"""Shared-folder staging and size-checked joins used by the training-data operators.

Lineage is cut by writing Parquet below the folder named in ``spark.checkpoint.dir``; only where the
session names none (tests on one machine) is a folder below the warehouse used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if rows x width stays below this; beyond it the join shuffles both sides.
BROADCAST_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, else a folder in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
    return root.rstrip("/")


class Stage:
    """A run's private folder in the shared store; ``put`` writes a table and reads it back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        """Read with the schema known, so that an empty table reads as one."""
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete staged tables that no later step reads."""
        sc = self.spark.sparkContext
        for n in names or ("",):
            p = sc._jvm.org.apache.hadoop.fs.Path(self.path(n) if n else self.root)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, width: int, bound: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table of ``width`` bytes a row is below the broadcast bound (reads at most the bound)."""
    most = max(1, bound // max(1, width))
    return df.limit(most + 1).count() <= most


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", width: int = 24) -> DataFrame:
    """``left`` joined with ``right``, which is broadcast only if its checked size allows; else both shuffle.
    In the hash table that is sent a row takes about four times its width, so tables stay below 64 MB."""
    return left.join(F.broadcast(right) if small(right, width) else right, on, how)


def restrict(docs: DataFrame, ids: DataFrame, key: str, width: int = 24) -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids`` (one distinct column), by a size-checked semi join."""
    return join_checked(docs, ids, key, "left_semi", width)


def plain_docs(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text, null texts as empty; other columns are dropped unless named."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
