"""Scans and sinks: raw events (CSV, JDBC, Parquet, adapters), id lists, dictionaries and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse_timestamp

RAW = "PatientID string, ConceptName string, StartTime string, EndTime string, Value string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def data_dir(spark: SparkSession, wanted: str, fallback: str) -> tuple[str, str | None]:
    """The wanted folder if it exists; else the fallback and the name of the missing one."""
    return (wanted, None) if exists(spark, wanted) else (fallback, wanted)


def require(spark: SparkSession, folder: str, fallback: str, needed: str = "raw_events.csv", others: tuple[str, ...] = ("projects.csv", "knowledge_table.csv")) -> dict[str, str | None]:
    """Where each input is: the events file must be in the folder, dictionaries may come from the fallback."""
    if not exists(spark, f"{folder}/{needed}"):
        raise FileNotFoundError(f"{folder}/{needed}")
    return {needed: f"{folder}/{needed}"} | {n: next((f"{d}/{n}" for d in (folder, fallback) if exists(spark, f"{d}/{n}")), None) for n in others}


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """The five text columns as written.  The header is skipped whatever it says (a byte-order mark
    included); rows with fewer than three columns or a blank id are dropped."""
    df = spark.read.schema(RAW + ", _bad string").option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    commas = F.regexp_count(F.regexp_replace("_bad", F.lit('"(?:[^"]|"")*"'), F.lit("")), F.lit(","))  # outside quotes
    return df.where(F.col("_bad").isNull() | F.col("StartTime").isNotNull() | (commas >= 2)).where(F.trim("PatientID") != "").drop("_bad")


def events(raw: DataFrame) -> DataFrame:
    """Typed events ``patient_id, concept, start_ts, end_ts, value, value_num`` from the text columns; a
    missing end is the start, unparseable times are null."""
    start = parse_timestamp(F.col("StartTime"))
    return raw.select(F.trim("PatientID").alias("patient_id"), F.trim("ConceptName").alias("concept"), start.alias("start_ts"), F.coalesce(parse_timestamp(F.col("EndTime")), start).alias("end_ts"), F.col("Value").alias("value"), F.trim("Value").try_cast("double").alias("value_num"))


def jdbc(spark: SparkSession, table: str, partition: str | None = None, bounds: tuple | None = None, parts: int = 32) -> DataFrame:
    """A table over JDBC.  URL, user and password come from spark.chronoweave.jdbc.{url,user,password};
    filters and columns are pushed to the server, and a numeric column splits the read."""
    get = lambda k: spark.conf.get(f"spark.chronoweave.jdbc.{k}", None)
    options = {k: get(k) for k in ("url", "user", "password", "driver") if get(k)} | {"dbtable": table, "fetchsize": "10000"}
    if partition and bounds:
        options |= {"partitionColumn": partition, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()


def from_orders(orders: DataFrame) -> DataFrame:
    """Orders as events: customer, priority, date, date, price."""
    t = F.col("o_orderdate").cast("timestamp_ntz")
    return orders.select(F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderpriority").alias("concept"), t.alias("start_ts"), t.alias("end_ts"), F.col("o_totalprice").cast("string").alias("value"), F.col("o_totalprice").alias("value_num"))


def from_events(table: DataFrame) -> DataFrame:
    """The event stream as point events: user, type, time, time, value."""
    t = F.col("ts").cast("timestamp_ntz")
    return table.select(F.col("user_id").cast("string").alias("patient_id"), F.col("event_type").alias("concept"), t.alias("start_ts"), t.alias("end_ts"), F.col("value").cast("string").alias("value"), F.col("value").alias("value_num"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one a line or comma-separated; trimmed, blanks dropped, once each."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path).select(F.explode(F.split(F.regexp_replace("value", "﻿", ""), ",")).alias("p")).select(F.trim("p").alias("patient_id")).where("patient_id <> ''").distinct()


def write_id_list(ids: DataFrame, path: str) -> None:
    """Ids one a line, by length and then text; every task writes its own part."""
    ids.select(F.col("patient_id").cast("string")).orderBy(F.length("patient_id"), "patient_id").write.mode("overwrite").text(path)


def projects(spark: SparkSession, path: str) -> dict[int, int]:
    """Project id to rule-base id (a dictionary of a few rows)."""
    rows = spark.read.option("header", True).schema("ProjectID int, ProjectName string, Kb_ID int").csv(path).collect()
    return {r["ProjectID"]: r["Kb_ID"] for r in rows}


def result_name(first: int, last: int, label: str) -> str:
    return f"{first}-{last}_{label}_patterns"


def write_long(patterns: DataFrame, root: str) -> None:
    """The canonical result, one folder a window and label; reruns replace only what they recompute."""
    patterns.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window", "label").parquet(root)


def write_matrix(matrix: DataFrame, root: str, first: int, last: int, label: str, domain: str) -> str:
    """The wide CSV ``id,<pattern>,...`` of one window and label; returns its folder."""
    path = f"{root}/{result_name(first, last, label)}/{domain}/generic/results.csv"
    matrix.write.mode("overwrite").option("header", True).csv(path)
    return path


def results(spark: SparkSession, root: str) -> list[str]:
    """The results.csv folders below a root."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*/generic/results.csv")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in found or [])


def peek(df: DataFrame, n: int = 100, order: tuple[str, ...] = ("patient_id", "concept", "start_ts")) -> DataFrame:
    """The first n rows in a fixed order."""
    return df.orderBy(*order).limit(n)
