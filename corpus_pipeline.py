"""Corpus preparation: toxicity, line dedup, near-duplicate join, decontamination, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents`` (the last one the
pieces of the packed sequences).  Near-duplicates are judged on the texts that line dedup left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontam, jaccard, line_templates, packing, queries, toxicity
from chronoweave.llm._store import Stage, join_checked


def _without(spark: SparkSession, docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows whose doc_id is not in ``ids``; rows without one stay."""
    ids = Stage(spark, name).put(ids.select("doc_id").distinct(), "ids")
    return join_checked(docs, ids, "doc_id", "left_anti", 16)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; labels are read for training only."""
    model = toxicity.fit(toxicity.plain_docs(docs), queries.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, *[c for c in docs.columns if c != "doc_id"]).where("score < 0.5").select(docs.columns)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document that had no other lines goes with them."""
    out = line_templates.drop_lines(docs).where("n_dropped = 0 OR n_dropped < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays."""
    return _without(spark, docs, jaccard.jaccard_components(docs).where("component_id <> doc_id"), "near")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a test item or more go."""
    return _without(spark, docs, decontam.contaminated(docs, queries.table(spark, sf_dir, "benchmark")), "leaks")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_template_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: Training, shingle hashing and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again by the next."""
    stage = Stage(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = stage.put(f(spark, docs, sf_dir), f"{k}-{name}")
    return docs
