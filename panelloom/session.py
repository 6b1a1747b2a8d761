"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, **conf) -> SparkSession:
    """Create a session with the library defaults; a cluster sets its own master."""
    builder = SparkSession.builder.appName("panelloom")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, *parts: str) -> str:
    """Folder every executor can reach, taken from the session's checkpoint setting.

    Only a local master without the setting falls back to a fresh temporary folder;
    on a cluster an unset folder is an error rather than a machine-local path.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="panelloom-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return "/".join([root.rstrip("/"), *parts])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a reliable checkpoint so that later stages survive executor loss."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "lineage"))
    return df.checkpoint()


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back as a plain Parquet scan."""
    spark = df.sparkSession
    path = shared_folder(spark, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
