"""Metrics of the logging hosts themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.functions import host as h
from helioframe.functions import tags
from helioframe.operators.lookup import lookup_join


def cpu_serial(lines: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Serial per host from its hardware lines: eight characters of the last serial line.

    With `hosts`, a host that has no lines at all counts as unreadable.
    """
    text = F.when(F.col("line").startswith("Serial"), F.substring("line", 19, 8))
    order = F.when(F.col("line").startswith("Serial"), F.col("line_no"))
    serials = lines.groupBy("host").agg(
        F.coalesce(F.max_by(text, order), F.lit(h.UNKNOWN_SERIAL)).alias("serial"))
    if hosts is None:
        return serials
    return (hosts.join(serials, "host", "left")
            .withColumn("serial", F.coalesce("serial", F.lit(h.UNREADABLE_SERIAL))))


def host_metrics(samples: DataFrame, serials: DataFrame, device_name: str = "LOGGER") -> DataFrame:
    """Host samples as records.

    The load averages over 1, 5 and 15 minutes are named 5, 10 and 15 minutes;
    the names are kept for those who already read them. `device_name` is the
    constant name under which downstream tables know the host. A sample without
    a readable temperature gives no record: see `unusable_samples`.
    """
    usable = samples.where(h.cpu_temp(F.col("cpu_temp_raw")).isNotNull())
    return lookup_join(usable, serials, ["host"], "ts", how="left").select(
        F.lit(device_name).alias("Device_Name"),
        h.cpu_temp(F.col("cpu_temp_raw")).alias("CPU_Temp"),
        F.col("cpu_usage").alias("CPU_Usage"),
        F.col("load1").alias("SystemLoad_5mins"),
        F.col("load5").alias("SystemLoad_10mins"),
        F.col("load15").alias("SystemLoad_15mins"),
        h.to_mib(F.col("ram_cached")).alias("RAM_Cached"),
        h.to_mib(F.col("ram_used")).alias("RAM_Used"),
        h.to_mib(F.col("ram_free")).alias("RAM_Free"),
        h.to_mib(F.col("ram_available")).alias("RAM_Available"),
        F.col("ram_percent").alias("RAM_Percent"),
        h.to_gib(F.col("disk_total")).alias("DISK_Total"),
        h.to_gib(F.col("disk_used")).alias("DISK_Used"),
        h.to_gib(F.col("disk_free")).alias("DISK_Free"),
        F.col("disk_percent").alias("DISK_Percent"),
        tags.utc_minute(F.col("ts")).alias("Date"),
        F.coalesce("serial", F.lit(h.UNREADABLE_SERIAL)).alias("Device_Serial"))


def unusable_samples(samples: DataFrame) -> DataFrame:
    """Samples whose CPU temperature is no number, kept as rejects."""
    return samples.where(h.cpu_temp(F.col("cpu_temp_raw")).isNull())


def union_records(*frames: DataFrame) -> DataFrame:
    """Records of different shapes in one table; keys a record lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
