"""From raw documents to shards of a training mix: each stage reads all that the one before kept.

Quality rules drop what the fitted rules find to be poor; one document of each group of near copies stays;
documents with a benchmark's words go; sources are mixed to target weights, so documents stay away or repeat;
each row gets its shard. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import decontam, mixing, ngram_join, quality, sharding
from sluiceway.llm.common import cut, identified, of_row, table

SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the caller's columns pass as one struct, so that none is taken for a verdict, and the text is written once
    rows = docs.select(F.struct(*docs.columns).alias("__row"))
    return quality.with_verdicts(rows, "__row.text").where("kept").select("__row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows have identities of their own: keys may be null or repeated
    rows = identified(docs)
    named = rows.select(F.concat_ws("/", "__f", "__i").alias("at"), of_row("text").alias("text"))
    found = decontam.contamination(named, table(spark, sf_dir, "benchmark"), key="at").where("contaminated")
    gone = found.select(F.split("at", "/").alias("r")).select(F.col("r")[0].cast("bigint").alias("__f"), F.col("r")[1].cast("bigint").alias("__i"))
    return rows.join(gone, ["__f", "__i"], "left_anti").select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def rendezvous_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs, SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", rendezvous_sharding),
]

#: The rounding and the shards rest on hashes that SQL engines don't share; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
