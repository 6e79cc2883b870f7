"""A corpus pipeline: five operators one after the other, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame with the columns of ``documents``, the last one the packed pieces.  Stages
take any rows: NULLs in any column, empty and very long texts, repeated rows and
an empty table go through each as the operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_spark.llm.common import read
from retail_spark.llm.mixing import mix_sources
from retail_spark.llm.ngram_join import ngram_jaccard_join
from retail_spark.llm.packing import pack
from retail_spark.llm.quality_rules import quality_rules
from retail_spark.llm.toxicity import fit_toxicity
from retail_spark.sources.scratch import stage


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep, each row judged for itself."""
    return quality_rules(docs, docs.columns).where("kept").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a model of the labelled ones among them, each row judged for itself."""
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return model.score(docs, docs.columns).where("score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones: the one with the smallest id, of repeated ids one; rows with an id go before others."""
    # Written, so that a row keeps its number.
    keyed = stage(docs.withColumn("__key", F.monotonically_increasing_id()), "rows")
    found = ngram_jaccard_join(keyed.select(F.col("__key").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")
    named = found.join(keyed.select("doc_id", "__key"), F.col("__row") == F.col("__key"))
    kept = named.groupBy("component_id").agg(F.min(order).alias("least")).select(F.col("least.__key").alias("__kept"))
    return keyed.join(kept, F.col("__key") == F.col("__kept"), "left_semi").drop("__key")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix of their sources has them."""
    return mix_sources(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return pack(docs)


STAGES = [
    ("quality rules", drop_low_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: No SQL: trees, sketches and dynamic programming; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
