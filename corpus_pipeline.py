"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of documents. Each works on everything its predecessor kept. Columns beyond those of documents stay as
they are, whatever their names; only the last stage replaces those that have the names it adds.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import checkpoint_dir, cut, row_key, table
from cohortlab.llm.decontaminate import without_contaminated
from cohortlab.llm.jaccard import near_duplicates
from cohortlab.llm.mixing import mix_sources
from cohortlab.llm.pii import personal_data
from cohortlab.llm.quality import quality_rules

#: No SQL can express the similarity join and the learned patterns.
ORACLE_SQL = None


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def beside(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with other columns than those of documents put aside in one, so that their names don't meet the stage's."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in OWN]
        if not more:
            return stage(spark, docs, sf_dir)
        quoted = lambda c: F.col(f"`{c}`")
        out = stage(spark, docs.select(*[c for c in docs.columns if c in OWN], F.struct(*[quoted(c) for c in more]).alias("_beside")), sf_dir)
        added = [c for c in out.columns if c not in OWN and c != "_beside"]
        return out.select(*[quoted(c) if c in OWN else F.col("_beside").getField(c).alias(c) for c in docs.columns if c not in added], *added)

    return run


@beside
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; null and empty texts fail the base rule. Repeated rows, and
    rows without a doc_id, are judged by their texts alone. An empty table stays empty."""
    return quality_rules(docs, labels=table(spark, sf_dir, "labels")).filter("kept").select(docs.columns)


@beside
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least doc_id stays, of equal rows with that
    doc_id one. Null and empty texts and rows without a doc_id have no links and stay; texts that
    share the least doc_id stay with it. An empty table stays empty."""
    others = near_duplicates(docs).filter("class_id <> doc_id").select("doc_id")
    kept = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    again = cut(docs.filter("doc_id is not null").groupBy(row_key().alias("_key")).agg(F.count("*").alias("c")).filter("c > 1").select("_key"))
    if not again.limit(1).count():
        return kept
    keyed = kept.withColumn("_key", row_key())
    return keyed.join(again, "_key", "left_anti").unionByName(keyed.join(again, "_key", "left_semi").dropDuplicates(["_key"])).select(docs.columns)


@beside
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, each row judged by its own text; null and empty
    texts have none. Empty tables remove nothing."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@beside
def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows. Null texts stay null, every
    row stays, repeated rows are treated alike. An empty table stays empty."""
    out = personal_data(docs)
    return out.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@beside
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is used, each document at least once, those with a null or
    shared doc_id, a null source or no words too. An empty table stays empty."""
    return mix_sources(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontaminate_stage),
    ("personal data", personal_data_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
