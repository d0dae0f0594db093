"""A training corpus from the documents table: toxicity, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import line_dedup, mixing, ngram_join, packing, toxicity
from assayer.llm.common import materialize, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, trained on the labelled ones among them, does not reject."""
    rated = toxicity.classify(docs, read_table(spark, sf_dir, "labels"))
    return rated.where("NOT rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in an earlier document; every document stays."""
    cut = line_dedup.remove_repeated(docs)
    return cut.selectExpr("doc_id", "text", "lang", "source", "CASE WHEN removed_lines > 0 THEN length(text) ELSE n_chars END AS n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared runs of five words (Jaccard 0.8), the one with the smallest id; all unlinked ones."""
    linked = ngram_join.linked_documents(docs, words=5, percent=80)
    gone = linked.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.emit(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all copies, each with its sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Toxicity is a trained model and packing needs a tokenizer: SQL has neither. Tests hold each stage and the chain to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
