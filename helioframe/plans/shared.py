"""A folder all executors can see, for queries that write and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's `spark.checkpoint.dir`.

    Only where the session names none and runs on one machine, as in tests, it
    lies in the local temporary folder; a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/helioframe-{purpose}-{uuid.uuid4().hex}"
