"""Registered queries of the numbered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import (
    centroids,
    embedding_dedup,
    fingerprints,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    pii,
    quality_rules,
    runs,
    token_counts,
    token_files,
    toxicity,
)
from assayer.llm.common import read_table, work_folder

#: The end id of files without index, the vocabulary's own mark.
FLAT_END = 49407


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = toxicity.classify(docs, read_table(spark, sf_dir, "labels"))
    return rated.drop("text").withColumnRenamed("rejected", "toxic")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of flat files written from all documents."""
    docs = read_table(spark, sf_dir, "documents")
    files = token_counts.write_flat(docs, work_folder(spark, "flat"), FLAT_END)
    return token_counts.token_counts(files, FLAT_END)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.host_rules(read_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_files.read_token_files(token_files.write_token_files(docs, work_folder(spark, "tokens")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(read_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_ngram_join,
        op3_toxicity,
        op4_pii,
        op5_token_counts,
        op6_quality_rules,
        op7_token_files,
        op8_packing,
        op9_embedding_dedup,
        op10_mixing,
        op11_fingerprints,
        op12_runs,
        op13_centroids,
    )
}
