"""Records to snapshot files, one JSON array per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.functions import tags
from helioframe.functions.host import UNKNOWN_SERIAL

HOST_POSITION = 2_147_483_647  # after every registry position
RUN = ["serial", "config", "minute", "file_name"]


def snapshot_entries(records: DataFrame, runs: DataFrame, prefix: str, zone: str = "UTC") -> DataFrame:
    """The records of every run: `RUN` columns, position, poll_id and record.

    `records` has config, position, poll_ts, poll_id and record (see
    `decode.records`). Where it also has serial, a record belongs to the run of
    that logger; otherwise to every run of its configuration and minute. A run
    without records has one row, whose record is NULL. Records of no listed run
    go under the serial of an unknown host.
    """
    key = ["serial", "config", "minute"]
    stamped = records.withColumn("minute", tags.minute(F.col("poll_ts")))
    if "serial" not in records.columns:
        stamped = stamped.join(runs.select(*key).distinct(), ["config", "minute"], "left")
    found = stamped.select(F.coalesce("serial", F.lit(UNKNOWN_SERIAL)).alias("serial"), "config", "minute",
                           "position", "poll_id", "record")
    name = tags.file_name(prefix, F.col("serial"), F.col("config"), F.col("minute"), zone)
    return (found.unionByName(runs.select(*key).distinct(), allowMissingColumns=True)
            .select(*key, name.alias("file_name"), "position", "poll_id", "record"))


def package_snapshots(records: DataFrame, runs: DataFrame, prefix: str, zone: str = "UTC") -> DataFrame:
    """One row per run: its file name and all its records as a JSON array.

    Records stand in registry order, the host record (position `HOST_POSITION`)
    last. A run without records gives `[]`. A run's records are held as one
    array: for runs too large for that, `sinks.write_snapshot_files` writes the
    entries one after the other.
    """
    entry = F.when(F.col("record").isNotNull(), F.struct("position", "poll_id", "record"))
    packed = (snapshot_entries(records, runs, prefix, zone).groupBy(*RUN)
              .agg(F.array_sort(F.collect_list(entry)).alias("entries")))
    payload = F.concat(F.lit("["), F.array_join(F.col("entries.record"), ","), F.lit("]"))
    return packed.select(*RUN, payload.alias("payload"))
