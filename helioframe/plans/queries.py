"""Every operator as a query over the given tables.

Results hold strings, integers and doubles only, and carry the key of the row
they belong to.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe import sinks, streaming
from helioframe.catalog import CATALOG, Block, Catalog, Field
from helioframe.functions import host as h
from helioframe.functions import tags, words
from helioframe.operators import attempts, decode, host, messages, package, registry
from helioframe.plans import testbed as tb
from helioframe.plans.run import Collection
from helioframe.plans.shared import shared_folder
from helioframe.sources.landed import read_host_samples, read_registers, stream_registers
from helioframe.sources.registry import read_brokers, read_devices, unreadable_registries as unreadable
from helioframe.sources.snapshots import read_snapshots, read_snapshots_long

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STATION = "sensor_lufft_ws600"
INVERTER = "inv_abb_pvs800"
PREFIX = "site"
ZONE = "Asia/Riyadh"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _text(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


def _dispatched(spark: SparkSession, sf: str) -> DataFrame:
    return attempts.dispatch(tb.reads(spark, sf), tb.devices(spark, sf))


def _polls(spark: SparkSession, sf: str, driver: str | None = None) -> DataFrame:
    if driver is None:
        return attempts.assemble(_dispatched(spark, sf))
    own = CATALOG.only(driver)
    return attempts.assemble(attempts.dispatch(
        tb.reads_of(spark, sf, driver), tb.devices_of(spark, sf, driver), own), own)


def _station_records(spark: SparkSession, sf: str) -> DataFrame:
    return decode.records(_polls(spark, sf, STATION), CATALOG.only(STATION))


# Sources and registries

@query
def device_registry(spark, sf):
    path = shared_folder(spark, "devices")
    entries = (tb.devices(spark, sf).drop("config")
               .withColumn("site", F.split("ip_address", r"\.")[2]))
    tb.write_yaml(entries, "devices", "site", "position", path)
    return read_devices(spark, f"{path}/*/*.txt").drop("config")


@query
def broker_registry(spark, sf):
    path = shared_folder(spark, "brokers")
    tb.write_yaml(tb.brokers(spark, sf).withColumn("site", F.col("broker") % 2),
                  "servers", "site", "broker", path)
    return read_brokers(spark, f"{path}/*/*.txt").drop("config")


@query
def enabled_devices(spark, sf):
    return registry.enabled(tb.devices(spark, sf)).select("config", "position", "name")


@query
def enabled_brokers(spark, sf):
    return registry.enabled(tb.brokers(spark, sf)).select("broker", "topic")


@query
def device_listing(spark, sf):
    return registry.device_listing(tb.devices(spark, sf))


@query
def unknown_driver_rejects(spark, sf):
    return registry.unknown_drivers(tb.devices(spark, sf)).select("position", "name", "driver")


@query
def driver_version(spark, sf):
    return registry.with_driver_version(tb.devices(spark, sf)).select(
        "position", "name", "driver_version")


BY_ADDRESS = "inv_abb_pvs980"


@query
def address_blocks(spark, sf):
    """The blocks that count, put together from reads known by address."""
    own = CATALOG.only(BY_ADDRESS)
    found = attempts.address_blocks(tb.spans_of(spark, sf, BY_ADDRESS), tb.devices_of(spark, sf, BY_ADDRESS), own, usable=True)
    return attempts.choose_attempt(found, own).select(
        "poll_id", "device_name", "block", "attempt", F.size("registers").alias("n_words"),
        F.get("registers", F.lit(0)).alias("first_word"), F.element_at("registers", -1).alias("last_word"))


@query
def decode_by_address(spark, sf):
    own = CATALOG.only(BY_ADDRESS)
    found = attempts.address_blocks(tb.spans_of(spark, sf, BY_ADDRESS), tb.devices_of(spark, sf, BY_ADDRESS), own, usable=True)
    return decode.decode_wide(attempts.assemble(found, own), own[BY_ADDRESS])


@query
def unusable_entries(spark, sf):
    return registry.unusable_entries(tb.damaged_devices(spark, sf)).select("position", "driver", "slave_id")


@query
def unreadable_registries(spark, sf):
    """One registry file per nation: some under another section, some without entries."""
    path, nation = shared_folder(spark, "unreadable"), F.col("site").cast("int")
    entries = (tb.devices(spark, sf).drop("config").withColumn("site", F.split("ip_address", r"\.")[2]))
    tb.write_yaml(entries.where(nation % 4 != 1), "devices", "site", "position", f"{path}/good")
    tb.write_yaml(entries.where(nation % 4 == 1), "others", "site", "position", f"{path}/others")
    spark.createDataFrame([("devices:",)], "value string").write.text(f"{path}/empty")
    found = unreadable(spark, f"{path}/*/*/*.txt", "devices").unionByName(unreadable(spark, f"{path}/empty", "devices"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


@query
def registry_as_of(spark, sf):
    """Reads against the registry that held at their poll's time, of two readings of it."""
    own = CATALOG.only(INVERTER)
    found = attempts.dispatch(tb.reads_of(spark, sf, INVERTER), registry.versioned(tb.registry_readings(spark, sf)), own)
    return found.where("attempt = 0").select("poll_id", "device_name", "block", "measurement")


def _read_summary(reads: DataFrame) -> DataFrame:
    r = F.col("registers")
    return reads.select("device_name", "poll_id", _text("poll_ts"), "block", "attempt", "ok",
                        F.coalesce(F.size(r), F.lit(0)).alias("n_words"),
                        F.get(r, F.lit(0)).alias("first_word"),
                        F.element_at(r, -1).alias("last_word"))


def _landed_reads(spark: SparkSession, sf: str) -> str:
    path = shared_folder(spark, "reads")
    tb.reads(spark, sf).write.parquet(path)
    return path


@query
def register_reads(spark, sf):
    return _read_summary(read_registers(spark, _landed_reads(spark, sf)))


@query
def register_stream(spark, sf):
    out = shared_folder(spark, "register-stream")
    stream = stream_registers(spark, _landed_reads(spark, sf))
    streaming.append_table(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return _read_summary(read_registers(spark, f"{out}/table"))


@query
def host_samples(spark, sf):
    path = shared_folder(spark, "host-samples")
    tb.host_samples(spark, sf).write.parquet(path)
    return read_host_samples(spark, path).select(
        "host", _text("ts"), "cpu_temp_raw", "cpu_usage", "load1", "ram_cached", "ram_available",
        "disk_total", "disk_free")


# Choice of attempts and assembly

@query
def driver_dispatch(spark, sf):
    return _dispatched(spark, sf).select(
        "poll_id", "device_name", "driver", "measurement", "block", "attempt", "ok", "max_attempts")


@query
def accept_predicate(spark, sf):
    reads = tb.reads_of(spark, sf, tb.METER).where("ok").withColumn("driver", F.lit(tb.METER))
    return reads.select("poll_id", "block", "attempt",
                        attempts.accepted().cast("int").alias("accepted"))


@query
def first_good_attempt(spark, sf):
    own = CATALOG.only(INVERTER)
    reads = attempts.dispatch(tb.reads_of(spark, sf, INVERTER),
                              tb.devices_of(spark, sf, INVERTER), own)
    return attempts.choose_attempt(reads, own).select(
        "poll_id", "device_name", "block", "attempt",
        F.get("registers", F.lit(0)).alias("first_word"))


@query
def accepted_else_last_attempt(spark, sf):
    own = CATALOG.only(tb.METER)
    reads = attempts.dispatch(tb.reads_of(spark, sf, tb.METER),
                              tb.devices_of(spark, sf, tb.METER), own)
    return attempts.choose_attempt(reads.where("block = 1"), own).select(
        "poll_id", "device_name", "attempt",
        F.get("registers", F.lit(16)).alias("word_16"), F.get("registers", F.lit(17)).alias("word_17"))


@query
def complete_polls(spark, sf):
    return attempts.complete_polls(_dispatched(spark, sf)).select("poll_id", "device_name", "driver")


@query
def drop_failed(spark, sf):
    return attempts.drop_failed(_dispatched(spark, sf)).select(
        "poll_id", "device_name", "block", "attempt")


@query
def read_failures(spark, sf):
    return attempts.read_failures(_dispatched(spark, sf)).select(
        "poll_id", "device_name", "block", "attempts")


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    own = CATALOG.only(INVERTER)
    return attempts.dispatch(tb.damaged_reads(tb.reads_of(spark, sf, INVERTER)), tb.devices_of(spark, sf, INVERTER), own)


@query
def unusable_polls(spark, sf):
    return attempts.unusable_polls(_damaged(spark, sf), CATALOG.only(INVERTER)).select(
        "poll_id", "device_name", F.array_join("blocks", ",").alias("blocks"))


@query
def graded_polls(spark, sf):
    found = attempts.graded(_damaged(spark, sf), CATALOG.only(INVERTER))
    return found.select("poll_id", "device_name", "outcome", "n_reads", F.array_join("blocks", ",").alias("blocks"),
                        F.array_join("tries", ",").alias("tries"))


@query
def poll_rejects(spark, sf):
    return attempts.rejects(attempts.graded(_damaged(spark, sf), CATALOG.only(INVERTER))).select(
        "poll_id", "device_name", "outcome", "block", "attempts")


@query
def attempt_stats(spark, sf):
    return attempts.attempt_stats(tb.reads(spark, sf))


@query
def block_assembly(spark, sf):
    ends = [(F.get(f"registers_{k}", F.lit(0)).alias(f"first_{k}"),
             F.element_at(f"registers_{k}", -1).alias(f"last_{k}")) for k in tb.BLOCKS]
    return _polls(spark, sf).select("poll_id", "device_name", "driver",
                                    *[c for pair in ends for c in pair])


@query
def tag_columns(spark, sf):
    return _polls(spark, sf).select("poll_id", *decode.tag_columns())


@query
def minute_snapshot(spark, sf):
    polls = tb.table(spark, sf, "events").select(tb.as_instant(F.col("ts")).alias("poll_ts"))
    minute = tags.minute(F.col("poll_ts")).alias("minute")
    return polls.groupBy(minute).agg(F.count(F.lit(1)).alias("polls")).select(
        _text("minute"), "polls")


# Word decoding, on every good read of the weather station block

def _words(spark: SparkSession, sf: str, **values: Column) -> DataFrame:
    return tb.reads_of(spark, sf, STATION).where("ok").select(
        "poll_id", "attempt", *[c.alias(name) for name, c in values.items()])


R = "registers"


@query
def decode_u16(spark, sf):
    return _words(spark, sf, value=words.u16(R, 3))


@query
def decode_s16(spark, sf):
    return _words(spark, sf, value=words.s16(R, 10))


@query
def decode_u32(spark, sf):
    return _words(spark, sf, value=words.u32(R, 28, 29))


@query
def decode_s32(spark, sf):
    return _words(spark, sf, value=words.s32(R, 22, 23))


@query
def decode_u32_swapped(spark, sf):
    return _words(spark, sf, value=words.u32(R, 41, 40))


@query
def scale_pow10(spark, sf):
    return _words(spark, sf, **{f"by_{d}": words.scale(words.u16(R, 5), d)
                                for d in (1, 10, 100, 1000)})


@query
def post_multiplier(spark, sf):
    return _words(spark, sf, value=words.scale(words.u32(R, 21, 22), 10, 10))


@query
def decode_bits(spark, sf):
    return _words(spark, sf, **{f"bit_{n}": words.bit(R, 1, n)
                                for n in range(16)})


@query
def clamp_negative(spark, sf):
    return _words(spark, sf, value=words.clamp_negative(words.s16(R, 0)))


# Decoded telemetry

def _driver_query(name: str, driver: str) -> None:
    def run(spark, sf):
        return decode.decode(driver, tb.reads_of(spark, sf, driver),
                             tb.devices_of(spark, sf, driver))
    QUERIES[name] = run


DECODERS = dict(zip(
    ["decode_dcb", "decode_dcb_single", "decode_ion7650", "decode_diris_a10", "decode_pvs800",
     "decode_pvs980", "decode_irradiation_holding", "decode_smp11", "decode_ws600",
     "decode_3sistmb"], tb.DRIVER_KEYS))
for _name, _driver in DECODERS.items():
    _driver_query(_name, _driver)


@query
def field_decode(spark, sf):
    return decode.decode_fleet(tb.reads(spark, sf), tb.devices(spark, sf))


@query
def wide_pivot(spark, sf):
    own = CATALOG.only(STATION)
    return decode.pivot_wide(decode.decode_long(_polls(spark, sf, STATION), own), own[STATION])


@query
def wide_pivot_by_place(spark, sf):
    """Devices of one name in two configurations stay two."""
    own, place = CATALOG.only(STATION), ("device_name", "config", "position")
    both = F.explode(F.array(F.lit("config"), F.lit("second")))
    reads = tb.reads_of(spark, sf, STATION).select("*", both.alias("config"), F.substring("device_name", 5, 20).cast("int").alias("position"))
    listed = tb.devices_of(spark, sf, STATION).drop("config").select("*", both.alias("config"))
    polls = attempts.assemble(attempts.dispatch(reads, listed, own, place), own)
    return decode.pivot_wide(decode.decode_long(polls, own, ("poll_id", "config", "position")), own[STATION])


SITE_METER = Catalog().register_driver(
    "site_meter", "1.0", [Block(1, "input", 0, 50)],
    [Field("Flow", "u32", 1, 4, 5, 100), Field("Level", "s16", 1, 7, divisor=10, clamp=True),
     Field("Pump_On", "bit", 1, 9, 3), Field("Count", "u16", 1, 49)])


@query
def register_driver(spark, sf):
    own = tb.devices(spark, sf).withColumns({"driver": F.lit("site_meter"), "enabled": F.lit(True)})
    return decode.decode("site_meter", tb.reads_of(spark, sf, STATION), own, SITE_METER)


@query
def decode_with(spark, sf):
    # Nested, so that it travels by value and workers need not have this module.
    def spread(polls: pd.DataFrame) -> pd.DataFrame:
        # Sizes are equal, so a batch is one matrix.
        words = np.array(polls["registers_1"].tolist(), float).reshape(len(polls), -1)
        return pd.DataFrame({"poll_id": polls["poll_id"], "Device_Name": polls["device_name"],
                             "spread": words.max(axis=1, initial=0) - words.min(axis=1, initial=1 << 16)})

    return decode.decode_with(_polls(spark, sf, STATION), spread,
                              "poll_id bigint, Device_Name string, spread double")


# Host metrics

@query
def bytes_to_mib(spark, sf):
    return tb.host_samples(spark, sf).select(
        "host", "ram_cached", "ram_used", h.to_mib(F.col("ram_cached")).alias("cached_mib"),
        h.to_mib(F.col("ram_used")).alias("used_mib"))


@query
def bytes_to_gib(spark, sf):
    return tb.host_samples(spark, sf).select(
        "host", "disk_total", h.to_gib(F.col("disk_total")).alias("total_gib"))


@query
def cpu_temp_parse(spark, sf):
    return tb.host_samples(spark, sf).select(
        "host", "cpu_temp_raw", h.cpu_temp(F.col("cpu_temp_raw")).alias("cpu_temp"))


def _serials(spark: SparkSession, sf: str) -> DataFrame:
    return host.cpu_serial(tb.cpuinfo_lines(spark, sf), tb.hosts(spark, sf))


@query
def cpu_serial(spark, sf):
    return _serials(spark, sf)


@query
def unusable_samples(spark, sf):
    return host.unusable_samples(tb.damaged_samples(spark, sf)).select("host", "cpu_temp_raw", "cpu_usage", "ram_cached")


@query
def host_metrics(spark, sf):
    return host.host_metrics(tb.host_samples(spark, sf), _serials(spark, sf))


@query
def union_host_records(spark, sf):
    station = decode.decode_wide(_polls(spark, sf, STATION), CATALOG[STATION])
    metrics = host.host_metrics(tb.host_samples(spark, sf), _serials(spark, sf))
    return host.union_records(station, metrics)


# Names, payloads, snapshots, messages

@query
def utc_minute_string(spark, sf):
    ts = tb.as_instant(F.col("ts"))
    return tb.table(spark, sf, "events").select("event_id", tags.utc_minute(ts).alias("Date"))


@query
def file_minute_string(spark, sf):
    ts = tb.as_instant(F.col("ts"))
    return tb.table(spark, sf, "events").select(
        "event_id", tags.local_minute(ts, ZONE).alias("stamp"))


def _file_names(spark: SparkSession, sf: str) -> DataFrame:
    name = tags.file_name(PREFIX, F.hex("user_id"), F.concat(F.col("event_type"), F.lit("_cfg.yml")),
                          tb.as_instant(F.col("ts")), ZONE)
    return tb.table(spark, sf, "events").select("event_id", name.alias("file_name"))


@query
def snapshot_file_name(spark, sf):
    return _file_names(spark, sf)


@query
def parse_file_name(spark, sf):
    parts = tags.parse_file_name(F.col("file_name")).alias("parts")
    return _file_names(spark, sf).select("event_id", parts).select("event_id", "parts.*")


@query
def record_json(spark, sf):
    return _station_records(spark, sf).select("poll_id", "record")


def _packages(spark: SparkSession, sf: str, records: DataFrame) -> DataFrame:
    return package.package_snapshots(records, tb.runs(spark, sf, tb.LOGGERS[:1]), PREFIX, ZONE)


@query
def snapshot_package(spark, sf):
    return package.package_snapshots(
        _station_records(spark, sf), tb.runs(spark, sf), PREFIX, ZONE).select(
        "serial", "config", _text("minute"), "file_name", "payload")


@query
def snapshot_files(spark, sf):
    path = shared_folder(spark, "snapshot-files")
    sinks.write_snapshot_files(package.snapshot_entries(
        _station_records(spark, sf), tb.runs(spark, sf), PREFIX, ZONE), path)
    name = tags.parse_file_name(F.col("_metadata.file_name")).alias("name")
    return (spark.read.text(path, wholetext=True).select(name, "value")
            .select("name.*", F.size(F.from_json("value", "array<string>")).alias("records")))


STATION_SCHEMA = ", ".join(
    ["Device_Name string", "Measurement_Suffix string", "Date string"]
    + [f"{f.name} double" for f in CATALOG[STATION].fields])


def _written(spark: SparkSession, sf: str, records: DataFrame) -> str:
    path = shared_folder(spark, "snapshots")
    sinks.write_snapshots(_packages(spark, sf, records), path)
    return path


@query
def snapshot_read(spark, sf):
    path = _written(spark, sf, _station_records(spark, sf))
    return read_snapshots(spark, path, STATION_SCHEMA)


@query
def snapshot_long(spark, sf):
    path = _written(spark, sf, decode.records(_polls(spark, sf)))
    return read_snapshots_long(spark, path).select(
        "Device_Name", "Measurement_Suffix", "Date", "field",
        F.col("value").cast("double").alias("value"))


@query
def topic(spark, sf):
    return messages.fan_out(_station_records(spark, sf), tb.brokers(spark, sf)).select(
        "poll_id", "broker", tags.topic(F.col("broker_topic"), F.col("Device_Name")).alias("topic"))


@query
def broker_fanout(spark, sf):
    polls = _polls(spark, sf).select("poll_id", "device_name")
    return messages.fan_out(polls, tb.brokers(spark, sf))


@query
def mqtt_messages(spark, sf):
    return messages.build_messages(_station_records(spark, sf), tb.brokers(spark, sf))


@query
def measurement_routing(spark, sf):
    path = shared_folder(spark, "measurements")
    sinks.write_measurements(decode.decode_wide(
        _polls(spark, sf, STATION), CATALOG[STATION], keep=("poll_id", "poll_ts")), path)
    table = spark.read.parquet(path)
    return table.groupBy("Measurement_Suffix", F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("records"), F.min("poll_id").alias("first_poll"),
        F.max("Air_Temperature").alias("highest"))


@query
def measurement_replay(spark, sf):
    """A run written twice, the first time with more than it should hold, and another run."""
    path = shared_folder(spark, "measurement-replay")
    table = decode.decode_wide(_polls(spark, sf, STATION), CATALOG[STATION], keep=("poll_id", "poll_ts"))
    odd = table.where("poll_id % 2 = 1")
    sinks.write_measurements(odd.withColumn("Measurement_Suffix", F.lit("WRONG")).unionByName(odd), path, run="odd")
    sinks.write_measurements(odd, path, run="odd")
    sinks.write_measurements(table.where("poll_id % 2 = 0"), path, run="even")
    return spark.read.parquet(path).groupBy("Measurement_Suffix", F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("records"), F.min("poll_id").alias("first_poll"),
        F.max("Air_Temperature").alias("highest"))


@query
def collection_run(spark, sf):
    """One run from reads to sinks: what every sink got and every reject, by kind."""
    out = shared_folder(spark, "collection-run")
    own = CATALOG.only(INVERTER)
    one = Collection(tb.damaged_reads(tb.reads_of(spark, sf, INVERTER)), tb.devices_of(spark, sf, INVERTER), f"{out}/polls", own)

    def publish(broker, batch):
        batch.write.option("compression", "zstd").parquet(f"{out}/messages/to={broker['broker']}")

    one.send(tb.runs(spark, sf, tb.LOGGERS[:1]), PREFIX, ("files", "messages"), path=f"{out}/files",
             brokers=tb.brokers(spark, sf), publish=publish, zone=ZONE)
    files = (spark.read.text(f"{out}/files", wholetext=True)
             .select(F.size(F.from_json("value", "array<string>")).cast("long").alias("n")))
    counted = [(kind, one.counts[kind]) for kind in ("whole", "torn", "unusable")]
    return (spark.createDataFrame(counted, "kind string, n long")
            .unionByName(files.agg(F.lit("in files").alias("kind"), F.sum("n").alias("n")))
            .unionByName(spark.read.parquet(f"{out}/messages").groupBy(F.concat(F.lit("to "), "to").alias("kind"))
                         .agg(F.count(F.lit(1)).alias("n")))
            .unionByName(one.rejects().groupBy(F.concat_ws(" ", "outcome", "block").alias("kind")).agg(F.count(F.lit(1)).alias("n"))))


# Streams

def _table(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    out = shared_folder(spark, purpose)
    streaming.append_table(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


@query
def stream_decode(spark, sf):
    reads = tb.reads_of(spark, sf, STATION, stream=True, resolved=True)
    return _table(spark, streaming.stream_decode(
        reads, tb.devices_of(spark, sf, STATION), CATALOG.only(STATION)), "stream-decode")


@query
def stream_decode_retries(spark, sf):
    """All attempts are landed; each poll comes once, with the read that counts."""
    reads = tb.reads_of(spark, sf, STATION, stream=True)
    return _table(spark, streaming.stream_decode(
        reads, tb.devices_of(spark, sf, STATION), CATALOG.only(STATION), "10 minutes"), "stream-decode-retries")


def _closed(spark: SparkSession, sf: str, reads: DataFrame, purpose: str) -> DataFrame:
    return _table(spark, streaming.stream_polls(
        reads, tb.devices_of(spark, sf, INVERTER), catalog=CATALOG.only(INVERTER)), purpose)


@query
def stream_rejects(spark, sf):
    polls = _closed(spark, sf, tb.damaged_reads(tb.reads_of(spark, sf, INVERTER, stream=True)), "stream-rejects")
    return attempts.rejects(polls).select("poll_id", "device_name", "outcome", "block", "attempts")


@query
def stream_late_reads(spark, sf):
    """Block 2 of every seventh poll lands once the polls before the last ten minutes are closed."""
    out = shared_folder(spark, "late-reads")
    reads = tb.reads_of(spark, sf, INVERTER)
    late = F.expr("poll_id % 7 = 0 AND block = 2")
    in_time = (tb.reads_of(spark, sf, INVERTER, events=part) for part in tb.landings(spark, sf, f"{out}/events"))
    for part in chain((some.where(~late) for some in in_time), [reads.where(late)]):
        part.write.mode("append").parquet(f"{out}/landed")
        polls = streaming.stream_polls(stream_registers(spark, f"{out}/landed"), tb.devices_of(spark, sf, INVERTER),
                                       catalog=CATALOG.only(INVERTER))
        streaming.append_table(polls, f"{out}/polls", f"{out}/log").awaitTermination()
    closed = spark.read.schema(polls.schema).parquet(f"{out}/polls")
    return attempts.late_reads(reads, closed).where("block = 2").select("poll_id", "device_name", "block", "attempt", "n_late")


@query
def stream_assemble(spark, sf):
    """Events land part by part in order of time; what is open of a part waits for the next one."""
    out, devices = shared_folder(spark, "stream-assemble"), tb.devices_of(spark, sf, INVERTER)
    for part in tb.landings(spark, sf, f"{out}/events"):
        part.write.mode("append").parquet(f"{out}/landed")
        landed = spark.readStream.schema(part.schema).parquet(f"{out}/landed")
        stream = streaming.stream_assemble(tb.reads_of(spark, sf, INVERTER, events=landed), devices, catalog=CATALOG.only(INVERTER))
        streaming.append_table(stream, f"{out}/table", f"{out}/checkpoint", plain=("poll_id", "value")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def _delivered_twice(spark: SparkSession, sf: str) -> str:
    """A folder with the same snapshot files, by name, in two places."""
    path = shared_folder(spark, "snapshots")
    sinks.write_snapshot_files(package.snapshot_entries(
        _station_records(spark, sf), tb.runs(spark, sf, tb.LOGGERS[:1]), PREFIX, ZONE), f"{path}/first")
    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(f"{root}/second")
    fs.copy_files(f"{root}/first", f"{root}/second", files, files)
    return path


def _records_of(stream: DataFrame) -> DataFrame:
    return stream.drop("file_name", "line", "place", "read_ts")


@query
def stream_snapshots(spark, sf):
    path = _delivered_twice(spark, sf)
    return _records_of(_table(spark, streaming.stream_snapshots(spark, path, STATION_SCHEMA),
                              "stream-snapshots"))


@query
def stream_snapshots_small_batches(spark, sf):
    path = _delivered_twice(spark, sf)
    return _records_of(_table(spark, streaming.stream_snapshots(
        spark, path, STATION_SCHEMA, max_files=1000), "stream-snapshots-small"))


def _stream_records(spark: SparkSession, sf: str) -> DataFrame:
    own = CATALOG.only(STATION)
    dispatched = attempts.dispatch(tb.reads_of(spark, sf, STATION, stream=True, resolved=True),
                                   tb.devices_of(spark, sf, STATION), own)
    return decode.records(streaming.single_block_polls(dispatched, own), own)


@query
def stream_messages_retry(spark, sf):
    """One broker fails once; what it refused is kept and taken later."""
    out = shared_folder(spark, "stream-messages-retry")
    failed = []

    def publish(batch_id, broker, batch):
        if broker["broker"] == 2 and not failed:
            failed.append(batch_id)
            raise OSError("down")
        batch.write.mode("overwrite").parquet(f"{out}/sent/batch={batch_id}/to={broker['broker']}")

    streaming.stream_messages(_stream_records(spark, sf), tb.brokers(spark, sf), publish, f"{out}/log",
                              f"{out}/outbox").awaitTermination()
    if not failed:
        raise AssertionError("no broker has failed")
    left = messages.Outbox(spark, f"{out}/outbox").deliver(-1, None, tb.brokers(spark, sf), publish)
    if any(left.values()):
        raise AssertionError(f"messages are still pending: {left}")
    return spark.read.parquet(f"{out}/sent").select("broker", "topic", "payload")


@query
def stream_messages(spark, sf):
    records = _stream_records(spark, sf)
    out = shared_folder(spark, "stream-messages")

    def publish(batch_id, broker, batch):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}/to={broker['broker']}")

    streaming.stream_messages(records, tb.brokers(spark, sf), publish,
                              f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out).select("broker", "topic", "payload")
