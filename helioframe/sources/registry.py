"""Registries: device and broker lists kept as YAML files, one per site.

A file is a named list of flat entries. Files are read and split by Spark, so
a folder with the configurations of a whole fleet is one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe import schemas
from helioframe.functions.tags import config_stem

# Words YAML reads as a switch.
_ON, _OFF = ("yes", "true", "on", "1"), ("no", "false", "off", "0")


def _scalar(item: Column, key: str) -> Column:
    """The value after `key :`, without its comment and quotes; NULL if absent."""
    value = r"""("[^"\n]*"|'[^'\n]*'|.*?)(?:[ \t]+#.*)?[ \t\r]*$"""
    text = F.regexp_extract(item, rf"(?m)^[ \t]*{key}[ \t]*:[ \t]*{value}", 1)
    return F.nullif(F.regexp_replace(text, r"""^(['"])(.*)\1$""", "$2"), F.lit(""))


def _switch(item: Column, key: str) -> Column:
    word = F.lower(_scalar(item, key))
    return F.when(word.isin(*_ON), True).when(word.isin(*_OFF), False)


def _items(section: str) -> Column:
    """The texts of a section's entries, block or flow style; NULL without the section."""
    # A section ends at the next key that is not indented.
    found = F.regexp_extract("value", rf"(?ms)^{section}[ \t]*:(.*?)(?=^[^\s#-]|\z)", 1)
    body = F.when(F.col("value").rlike(rf"(?m)^{section}[ \t]*:"), found)
    # A list in brackets becomes one entry per line, an entry in braces one key per line.
    body = F.when(body.rlike(r"^\s*\["), F.regexp_replace(
        F.regexp_replace(body, r"\]\s*$", ""), r"(?:^\s*\[|,)\s*\{", "\n- {")).otherwise(body)
    parts = F.split(body, r"(?m)^[ \t]*-(?:[ \t]+|[ \t]*\r?$)")
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda item: F.when(
        item.rlike(r"^\s*\{"), F.regexp_replace(
            F.regexp_replace(item, r"^\s*\{\s*|\s*\}[^}]*$", ""), r"\s*,\s*(?=\w+[ \t]*:)", "\n"))
        .otherwise(item))


def _files(spark: SparkSession, path: str, section: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        config_stem(F.col("_metadata.file_name")).alias("config"), _items(section).alias("items"))


def _entries(spark: SparkSession, path: str, section: str) -> DataFrame:
    """One row per list entry: configuration, position from 0, entry text."""
    return (_files(spark, path, section).select("config", F.posexplode("items"))
            .withColumnsRenamed({"pos": "position", "col": "item"}))


def unreadable_registries(spark: SparkSession, path: str, section: str) -> DataFrame:
    """Configurations (config, reason) whose file has no such section, or no entry in it.

    Spark's readers pass over a file of no bytes, so that one is not listed.
    """
    return _files(spark, path, section).where("items IS NULL OR size(items) = 0").select(
        "config", F.when(F.col("items").isNull(), "no section").otherwise("no entries").alias("reason"))


def read_devices(spark: SparkSession, path: str) -> DataFrame:
    """The devices listed in the configuration files at `path`."""
    item = F.col("item")
    text = {k: _scalar(item, k) for k in ("name", "driver", "measurement", "ip_address")}
    numbers = {k: _scalar(item, k).try_cast("int") for k in ("slave_id", "port")}
    return _entries(spark, path, "devices").withColumns(
        {**text, **numbers, "enabled": _switch(item, "enabled")}).select(
        *_names(schemas.DEVICES))


def read_brokers(spark: SparkSession, path: str) -> DataFrame:
    """The brokers listed at `path`, known by (config, broker). Credentials are never read."""
    item = F.col("item")
    return _entries(spark, path, "servers").select(
        "config", F.col("position").alias("broker"), _scalar(item, "topic").alias("topic"),
        _scalar(item, "ip_address").alias("ip_address"),
        _scalar(item, "port").try_cast("int").alias("port"),
        _switch(item, "enabled").alias("enabled"))


def _names(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(", ")]
