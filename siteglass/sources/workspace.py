"""Where intermediate and exported files go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder, reachable by all executors, that the session names.

    Only a local session, where driver and executors share one machine, may go
    without the setting and use a temporary folder.
    """
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors reach")
    return tempfile.mkdtemp(prefix="siteglass-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def new_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    ensure_checkpoint_dir(spark)
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
