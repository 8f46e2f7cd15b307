"""From whole polls to named, scaled, tagged values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.catalog import CATALOG, Catalog, Driver
from helioframe.functions import tags
from helioframe.functions.words import field_sql, rule_sql
from helioframe.operators.attempts import DEVICE, POLL, assemble, dispatch


TAGS = ["Device_Name", "Measurement_Suffix", "Date"]


def tag_columns() -> list[Column]:
    """The three tags every record starts with."""
    return [F.col("device_name").alias("Device_Name"),
            F.col("measurement").alias("Measurement_Suffix"),
            tags.utc_minute(F.col("poll_ts")).alias("Date")]


def value_columns(driver: Driver) -> list[Column]:
    """One double per catalogue field of `driver`, from `registers_k`."""
    return [F.expr(f"{field_sql(f'registers_{f.block}', f)} AS `{f.name}`") for f in driver.fields]


def decode_wide(polls: DataFrame, driver: Driver, keep: tuple[str, ...] = ("poll_id",)) -> DataFrame:
    """One column per field, for the polls of one driver."""
    return polls.where(F.col("driver") == driver.name).select(
        *keep, *tag_columns(), *value_columns(driver))


def decode_long(polls: DataFrame, catalog: Catalog = CATALOG,
                keep: tuple[str, ...] = ("poll_id",)) -> DataFrame:
    """One row per field, for a mixed fleet in one pass.

    Names need not be unique across configurations: `keep` may name `config` and
    `position`, by which `pivot_wide` then tells devices apart. The catalogue is joined by (driver, block), a broadcast hash join over a few
    hundred rows; no Python and no shuffle. The tags are made part of the
    exploded blocks, or the join would format the date anew for every field.
    """
    tagged = F.struct(*tag_columns()).alias("tags")
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), F.col(f"registers_{k}").alias("registers"),
                                tagged) for k in catalog.block_numbers()])
    rules = catalog.fields_frame(polls.sparkSession)
    return (polls.select(*keep, "driver", F.inline(blocks))
            .where("registers IS NOT NULL")
            .join(F.broadcast(rules), ["driver", "block"])
            .select(*keep, "tags.*", "driver", "field",
                    F.expr(rule_sql("registers")).alias("value")))


def pivot_wide(long: DataFrame, driver: Driver) -> DataFrame:
    """Long telemetry of one driver to one column per field.

    For data that is already long. Straight from polls `decode_wide` gives the
    same without a shuffle. Devices of one name are told apart by `config` and
    `position`, where the long rows have them (see `decode_long`).
    """
    place = [c for c in ("config", "position") if c in long.columns]
    # `pivot` would group by field first and move every long row; so a poll is one row before the shuffle.
    values = [F.first(F.when(F.col("field") == f.name, F.col("value")), ignorenulls=True).alias(f.name) for f in driver.fields]
    return (long.where(F.col("driver") == driver.name)
            .groupBy("poll_id", *place, "Device_Name", "Measurement_Suffix", "Date").agg(*values))


def records(polls: DataFrame, catalog: Catalog = CATALOG, keep: tuple[str, ...] = ()) -> DataFrame:
    """Polls as records: device, tags and the record as JSON text; `keep` names more columns.

    One driver's record is a generated struct. For a mixed fleet that would be
    too much code for one stage; there a driver's rules are joined as arrays (a
    row per driver) and applied in place. Either way a poll stays one row.
    """
    kept = ["poll_id", "config", "position", "poll_ts", *keep]
    if len(catalog.drivers) == 1:
        (driver,) = catalog
        text = tags.record_json([*tag_columns(), *value_columns(driver)])
        return (polls.where(F.col("driver") == driver.name)
                .select(*kept, *tag_columns(), text.alias("record")))
    number = rule_sql("get(registers, r.slot)", "r.")
    bit = "shiftright(get(get(registers, b.slot), b.lo), b.shift) & 1"
    values = F.expr(f"""array_join(concat(
        transform(numbers, r -> concat(r.key, CAST({number} AS STRING))),
        transform(bits, b -> concat(b.key, IF({bit} = 1, '1.0', '0.0')))), ',')""")
    # Tags may hold any text, so Spark writes them; keys and numbers need no escape.
    head = F.rtrim(tags.record_json(TAGS), F.lit("}"))
    registers = F.array(*[f"registers_{k}" for k in catalog.block_numbers()])
    return (polls.select(*dict.fromkeys([*kept, "driver"]), *tag_columns(), registers.alias("registers"))
            .join(F.broadcast(catalog.rules_frame(polls.sparkSession)), "driver")
            .select(*kept, *TAGS, F.concat(head, F.lit(","), values, F.lit("}")).alias("record")))


def decode(driver_name: str, reads: DataFrame, devices: DataFrame,
           catalog: Catalog = CATALOG) -> DataFrame:
    """Landed reads to the wide table of one driver."""
    own = catalog.only(driver_name)
    return decode_wide(assemble(dispatch(reads, devices, own), own), own[driver_name])


def decode_fleet(reads: DataFrame, devices: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """Landed reads of a mixed fleet to the long table."""
    return decode_long(assemble(dispatch(reads, devices, catalog), catalog), catalog)


def decode_with(polls: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame],
                schema: str) -> DataFrame:
    """Decode whole polls by a pandas function, for rules a catalogue cannot state.

    `fn` gets Arrow batches of whole polls, one row each with `registers_k`, and
    returns rows of `schema`. As a poll is one row here, no grouping is needed.
    """
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(fn, frames)
    return polls.mapInPandas(batches, schema)


__all__ = ["DEVICE", "POLL", "decode", "decode_fleet", "decode_long", "decode_wide",
           "decode_with", "pivot_wide", "records", "tag_columns", "value_columns"]
