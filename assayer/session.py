"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Spark 4.1 takes a union of equally partitioned inputs as partitioned too, but an input that changes its join at
# run time breaks that after the shuffle behind the union was left out. Without the setting a shuffle is planned.
SAFE_UNIONS = ("spark.sql.unionOutputPartitioning", "false")


def guard(spark: SparkSession) -> SparkSession:
    """Session settings that results depend on; to be called once on any session that runs these jobs."""
    spark.conf.set(*SAFE_UNIONS)
    return spark


def build_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(master)
        .appName("assayer")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config(*SAFE_UNIONS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables.

    It lies below the cluster's ``spark.checkpoint.dir`` so that every executor sees it and it outlives
    lost executors. Only a session without that setting (tests, local benches) gets a local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/assayer/{purpose}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for intermediate tables")
    return tempfile.mkdtemp(prefix=f"assayer-{purpose}-")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several later steps read, so that it is worked out once and survives lost executors."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
