"""Session helper and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(
    app_name: str = "cribado", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with the settings the operators rely on; `conf` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local session without the setting gets a folder of its own; on a cluster a
    machine-local folder would lose the tables with the machine, so that is an error.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, never used before."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Used after model calls and before several passes over one result: the rows survive the
    loss of executors and later stages never repeat the work above them.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
