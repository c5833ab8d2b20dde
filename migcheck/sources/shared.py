"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only where all runs in one local process and the session names no shared folder.
LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; on a cluster that must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_DEFAULT
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
