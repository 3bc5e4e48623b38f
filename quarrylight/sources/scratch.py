"""Where streaming checkpoints and sinks go: the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without that setting gets one under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/quarrylight"
    return f"{folder.rstrip('/')}/quarrylight"


def shared(spark: SparkSession, name: str) -> str:
    """A new folder there."""
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"
