"""Landed register reads and host samples, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helioframe import schemas


def read_registers(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Landed register reads. Best partitioned by day and clustered by device."""
    return spark.read.schema(schemas.REGISTER_READS).format(format).load(path)


def stream_registers(spark: SparkSession, path: str, format: str = "parquet",
                     max_files: int | None = None) -> DataFrame:
    """The same as a stream; `max_files` bounds a micro-batch while catching up."""
    reader = spark.readStream.schema(schemas.REGISTER_READS).format(format)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_host_samples(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.HOST_SAMPLES).format(format).load(path)
