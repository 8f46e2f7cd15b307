"""Tags, names and payload text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAPSHOT_NAME = r"^[^_]+_([^_]+)_(.+)_(\d{12})(?:-2)?\.json\.gz$"


def _utc(ts: Column) -> Column:
    return F.to_utc_timestamp(ts, F.current_timezone())


def minute(ts: Column) -> Column:
    """The minute a timestamp falls in."""
    return F.date_trunc("minute", ts)


def utc_minute(ts: Column) -> Column:
    """The `Date` tag: UTC, seconds forced to 00."""
    return F.date_format(_utc(ts), "yyyy-MM-dd'T'HH:mm:00'Z'")


def utc_day(ts: Column) -> Column:
    """The UTC day, for partitioned output."""
    return F.date_format(_utc(ts), "yyyy-MM-dd")


def local_minute(ts: Column, zone: str | Column) -> Column:
    """Twelve digits of *local* time, as snapshot files carry it."""
    return F.date_format(F.from_utc_timestamp(_utc(ts), zone), "yyyyMMddHHmm")


def config_stem(config: Column) -> Column:
    """A configuration file name without its directory and its last extension."""
    return F.regexp_replace(F.regexp_extract(config, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_name(prefix: str, serial: Column, config: Column, ts: Column,
              zone: str | Column = "UTC") -> Column:
    """Snapshot file name: prefix, serial, configuration stem and local minute.

    Where clocks are put back, an hour's local minutes come twice; names of the second
    time end in `-2`, or its runs would replace those of the first.
    """
    local = F.from_utc_timestamp(_utc(minute(ts)), zone)
    again = F.to_utc_timestamp(local, zone) != _utc(minute(ts))
    return F.concat(F.lit(prefix), F.lit("_"), serial, F.lit("_"), config_stem(config),
                    F.lit("_"), local_minute(ts, zone), F.when(again, "-2").otherwise(""), F.lit(".json.gz"))


def parse_file_name(name: Column) -> Column:
    """Inverse of `file_name`: struct(serial, config, stamp), NULL if it is no such name.

    Configuration stems may hold underscores.
    """
    part = lambda k: F.regexp_extract(name, SNAPSHOT_NAME, k)
    return F.when(name.rlike(SNAPSHOT_NAME), F.struct(
        part(1).alias("serial"), part(2).alias("config"), part(3).alias("stamp")))


def record_json(columns: list[str | Column]) -> Column:
    """A record as JSON text. NULL fields are left out, like keys a record lacks."""
    return F.to_json(F.struct(*columns))


def topic(base: Column, device: Column) -> Column:
    return F.concat(base, F.lit("/"), device)


def driver_version(label: Column, version: Column) -> Column:
    return F.concat(label, F.lit(" v"), version)
