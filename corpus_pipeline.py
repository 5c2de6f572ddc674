"""A corpus pipeline of five of the operators; each stage reads what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from blockweave.llm.decontaminate import drop_contaminated
from blockweave.llm.mixing import mixed_rows
from blockweave.llm.ngram_join import drop_linked
from blockweave.llm.quality_rules import judge, learn
from blockweave.llm.sharding import shard
from blockweave.llm.textkit import drop, drop_at_exit, packed, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go.

    Null and empty texts have under 50 words and go; very long texts are counted
    whole; repeated rows are judged alike. All columns come back as they were,
    whatever their names; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, back = packed(docs)
    return judge(rows, learn(docs, labels)).where("kept").select(*back)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows whose texts are linked one stays; see drop_linked for nulls, ties and repeated rows."""
    return drop_linked(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; see drop_contaminated for nulls, empty texts and clashing names."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; see mix_sources for nulls, texts without words and clashing names."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot, ready to be written by shard; see shard for nulls, repeated rows and clashing names."""
    return shard(docs, texts=True)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", ngram_jaccard_join), ("benchmark decontamination", benchmark_decontamination), ("mixing sources to target weights", mixing_sources), ("sharding", sharding)]

#: The learned rules and the iterated balance are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again. A stage's table goes once the next is written, the last when the driver's Python ends."""
    docs, top = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    drop_at_exit(spark, top)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
        if i:
            drop(spark, f"{top}/{i - 1}")
    return docs
