"""The operators of this subpackage as named queries over a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retail_spark.llm.common import read
from retail_spark.llm import centroids, collocations as phrases
from retail_spark.llm import license_scan as licenses
from retail_spark.llm import quality_rules as rules
from retail_spark.llm.centroids import cluster_vectors
from retail_spark.llm.collocations import collocations
from retail_spark.llm.nearest import nearest_neighbours
from retail_spark.llm.ngram_join import ngram_jaccard_join
from retail_spark.llm.html_text import extract
from retail_spark.llm.license_scan import license_scan
from retail_spark.llm.mixing import mix_sources
from retail_spark.llm.packing import pack
from retail_spark.llm.personal_data import find_personal_data, span_digest
from retail_spark.llm.pseudo_likelihood import pseudo_likelihood
from retail_spark.llm.quality_rules import quality_rules
from retail_spark.llm.toxicity import toxicity
from retail_spark.llm.weak_quality import quality_classifier

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_tokens", "mix_position")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(read(spark, sf_dir, "documents"))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(read(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(find_personal_data(read(spark, sf_dir, "documents")))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings")).drop("centroid")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents")).drop("cut")


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_temperature_mixing": op2_temperature_mixing,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_license_scan": op4_license_scan,
        "op5_weak_quality": op5_weak_quality,
        "op6_pseudo_likelihood": op6_pseudo_likelihood,
        "op7_html_text": op7_html_text,
        "op8_toxicity": op8_toxicity,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_packing": op10_packing,
        "op11_personal_data": op11_personal_data,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": rules.ORACLE_SQL,
        "op4_license_scan": licenses.ORACLE_SQL,
        "op12_centroid_clustering": centroids.ORACLE_SQL,
        "op13_collocations": phrases.ORACLE_SQL,
    }
