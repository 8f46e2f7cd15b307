"""Registry filters, listings and the match of devices with drivers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.catalog import CATALOG, Catalog
from helioframe.functions import tags


def _lacking(entries: DataFrame) -> Column:
    """Whether an entry lacks what it is known by."""
    return reduce(or_, [F.col(c).isNull() for c in ("name", "driver", "topic") if c in entries.columns], F.lit(False))


def enabled(entries: DataFrame) -> DataFrame:
    """Entries switched on and whole; for the others that lack something see `unusable_entries`."""
    return entries.where("enabled").where(~_lacking(entries))


def unusable_entries(entries: DataFrame) -> DataFrame:
    """Entries without an on/off switch, a name and driver, or a topic: rejects, while the others go on."""
    return entries.where(F.col("enabled").isNull() | _lacking(entries))


def device_listing(devices: DataFrame) -> DataFrame:
    """One readable line per device, in registry order."""
    line = F.concat_ws(" <--> ", "name", "driver", "ip_address", "port", "slave_id")
    return devices.select("config", "position", line.alias("line")).orderBy("config", "position")


def unknown_drivers(devices: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """Enabled devices whose driver is not in the catalogue."""
    known = catalog.versions_frame(devices.sparkSession).select("driver")
    return enabled(devices).join(F.broadcast(known), "driver", "left_anti")


def with_driver_version(devices: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """Devices with the version text of their driver."""
    versions = catalog.versions_frame(devices.sparkSession)
    return (devices.join(F.broadcast(versions), "driver")
            .withColumn("driver_version", tags.driver_version(F.col("label"), F.col("version"))))


def versioned(entries: DataFrame, at: str = "read_ts") -> DataFrame:
    """Registry entries of many readings, each with the time from which and until which it holds.

    A configuration is replaced as a whole: its entries of one time hold until its next time,
    listed there again or not. Adds valid_from and valid_to (null for the latest).
    """
    times = entries.select("config", F.col(at).alias("valid_from")).distinct()
    turn = Window.partitionBy("config").orderBy("valid_from")
    times = times.withColumn("valid_to", F.lead("valid_from").over(turn))
    return (entries.withColumnRenamed(at, "valid_from").join(times, ["config", "valid_from"]))
