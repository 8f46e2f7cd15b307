"""Registers, registries and host samples derived from the given tables.

The given tables hold no register reads, so `events` becomes polls, `supplier`
devices, `region` brokers and `lineitem` host samples, by arithmetic that a SQL
engine can repeat. Everything grows with its table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.catalog import CATALOG, Catalog

DRIVER_KEYS = tuple(CATALOG.drivers)
BLOCKS = (0, 1, 2, 3)
ATTEMPTS = (0, 1, 2, 3)
METER = "ekk_schneider_ion_7650"
#: Events of a task: each becomes sixteen reads of up to 116 words, and a file that is small
#: for its events would be one task's work otherwise.
EVENTS_A_TASK = 16_000
#: Events that land at once, in `landings`.
EVENTS_A_LANDING = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_instant(ts: Column) -> Column:
    """A zone-less timestamp, taken as UTC wall time."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def _pick(index: Column, values) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _driver_of(key: Column) -> Column:
    return F.when(key % 17 == 3, "unknown").otherwise(_pick(key % len(DRIVER_KEYS), DRIVER_KEYS))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        F.lit("config").alias("config"), key.cast("int").alias("position"),
        F.concat(F.lit("DEV_"), key).alias("name"), _driver_of(key).alias("driver"),
        (nation % 5 != 0).alias("enabled"),
        F.concat(F.lit("SPP_"), nation % 3).alias("measurement"),
        (1 + key % 247).cast("int").alias("slave_id"),
        F.concat(F.lit("10.0."), nation, F.lit("."), key % 250).alias("ip_address"),
        F.lit(502).alias("port"))


def devices_of(spark: SparkSession, sf_dir: str, driver: str) -> DataFrame:
    """The same devices, all on and all of one driver."""
    return (devices(spark, sf_dir).withColumn("driver", F.lit(driver))
            .withColumn("enabled", F.lit(True)))


def damaged_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The devices, some without a switch, a name or a driver."""
    at = F.col("position") % 9
    return devices(spark, sf_dir).withColumns({
        "enabled": F.when(at != 4, F.col("enabled")), "name": F.when(at != 5, F.col("name")),
        "driver": F.when(at != 6, F.col("driver"))})


def registry_readings(spark: SparkSession, sf_dir: str, driver: str = "inv_abb_pvs800") -> DataFrame:
    """The devices as read twice: before all events, and in the middle of them, when some are
    off, some are gone and the others are measured under another name."""
    ts = as_instant(F.col("ts"))
    times = table(spark, sf_dir, "events").agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    middle = F.timestamp_seconds(F.floor((F.unix_seconds("first") + F.unix_seconds("last")) / 2))
    both = devices_of(spark, sf_dir, driver).crossJoin(times)  # one row
    at = F.col("position") % 5
    return both.withColumn("read_ts", F.col("first")).unionByName(
        both.where(at != 1).withColumns({"read_ts": middle, "enabled": at != 2, "measurement": F.lit("LATER")})
    ).drop("first", "last")


def spans_of(spark: SparkSession, sf_dir: str, driver: str) -> DataFrame:
    """The reads of `reads_of` by address: whole, in two parts, or with words around them, by poll."""
    blocks = CATALOG.only(driver).blocks_frame(spark).select("block", "kind", "start", "count")
    reads = reads_of(spark, sf_dir, driver).join(F.broadcast(blocks), "block")  # a few rows
    half, way, r = F.floor(F.col("count") / 2).cast("int"), F.col("poll_id") % 3, F.col("registers")
    span = lambda start, words: F.struct(start.cast("int").alias("start"), words.alias("registers"))
    around = F.concat(F.array(F.lit(1), F.lit(2)), r, F.array(F.lit(3)))
    parts = (F.when((way == 0) | r.isNull(), F.array(span(F.col("start"), r)))
             .when(way == 1, F.array(span(F.col("start") + half - 1, F.slice(r, half, F.col("count"))),
                                     span(F.col("start"), F.slice(r, 1, half))))
             .otherwise(F.array(span(F.col("start") - 2, around))))
    return reads.select("device_name", "poll_id", "poll_ts", "kind", "attempt", "ok", F.explode(parts).alias("x")).select(
        "device_name", "poll_id", "poll_ts", "kind", "x.start", "attempt", "ok", "x.registers")


def damaged_reads(reads: DataFrame) -> DataFrame:
    """The reads; of every nineteenth poll, block 2 has two words left."""
    cut = (F.col("poll_id") % 19 == 0) & (F.col("block") == 2)
    return reads.withColumn("registers", F.when(cut, F.slice("registers", 1, 2)).otherwise(F.col("registers")))


def brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        key.alias("broker"), F.col("r_name").alias("topic"),
        F.concat(F.lit("10.1.0."), key).alias("ip_address"), (1883 + key).alias("port"),
        (key % 2 == 0).alias("enabled"))


def write_yaml(entries: DataFrame, section: str, site: str, order: str, path: str) -> None:
    """Registry entries as YAML lists, one file per value of `site`."""
    switch = F.when(F.col("enabled"), "yes  # on").otherwise("no  # off")
    values = [(name, switch if name == "enabled" else F.col(name).cast("string"))
              for name in entries.columns if name not in (site, order)]
    lines = [F.concat(F.lit(f"{'      ' if i else '    - '}{name} : "), value)
             for i, (name, value) in enumerate(values)]
    body = entries.select(site, order, F.concat_ws("\n", *lines).alias("text"))
    heads = entries.select(site).distinct().select(
        site, F.lit(-1).alias(order), F.lit(f"{section}:").alias("text"))
    (body.union(heads).repartition(site).sortWithinPartitions(site, order)
     .select(site, "text").write.partitionBy(site).text(path))


def _ok(attempt: Column) -> Column:
    e, b = F.col("poll_id"), F.col("block")
    return (((e * 7 + b * 13 + attempt * 5) % 4 != 0)
            & ((attempt == 3) | ((e + b * 3) % 11 != 0)))


def _landed(events: DataFrame, n_devices: int) -> DataFrame:
    """Events crossed with block and attempt numbers; word 0 in `base`.

    What is the same in all reads of an event stands before the crossing.
    """
    e, b, a = F.col("poll_id"), F.col("block"), F.col("attempt")
    polls = events.select(
        F.col("event_id").alias("poll_id"), as_instant(F.col("ts")).alias("poll_ts"),
        (F.col("user_id") % n_devices).alias("device"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    polls = polls.select("*", F.concat(F.lit("DEV_"), F.col("device")).alias("device_name"))
    reads = polls.select("*", F.explode(F.array(*[F.lit(k) for k in BLOCKS])).alias("block"))
    reads = reads.select("*", F.explode(F.array(*[F.lit(k) for k in ATTEMPTS])).alias("attempt"))
    return reads.select(
        "device_name", "device",
        "poll_id", "poll_ts", "block", "attempt", _ok(a).alias("ok"),
        (e * 40503 + b * 7919 + a * 104729 + F.col("cents") * 31).alias("base"))


def _registers(reads: DataFrame, driver: Column, count: Column, most: int) -> DataFrame:
    """The reads with `count` words each, `most` at most.

    Every word is an expression of its own: unlike a function over an array these are compiled,
    and `base`, which they share, is worked out once a read and not once a word.
    """
    e, a = F.col("poll_id"), F.col("attempt")
    dead = ((driver == METER) & (F.col("block") == 1)
            & ((e % 13 == 0) | ((e + a) % 3 == 0)))
    word = [((F.col("base") + i * 9973) % 65536).cast("int") for i in range(most)]
    words = F.array(*[F.when(dead, 0).otherwise(w) if i in (16, 17) else w for i, w in enumerate(word)])
    return reads.select("device_name", "poll_id", "poll_ts", "block", "attempt", "ok",
                        F.when(F.col("ok"), F.slice(words, 1, count)).alias("registers"))


def landings(spark: SparkSession, sf_dir: str, folder: str) -> Iterator[DataFrame]:
    """The events in parts of about `EVENTS_A_LANDING`, one after the other in time, as a site lands them.

    A stream over them has the polls of one part and of its delay as state, not all there are. The
    parts are written to `folder` first, where there are several.
    """
    found = table(spark, sf_dir, "events")
    parts = -(-found.count() // EVENTS_A_LANDING)
    if parts < 2:
        yield found
        return
    # With the id, many events of one time are several parts as well: none of them is late for another.
    dealt = found.repartitionByRange(parts, F.asc_nulls_first("ts"), F.asc_nulls_first("event_id"))
    dealt.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(folder)
    staged = spark.read.parquet(folder)
    for (part,) in staged.select("part").distinct().orderBy("part").collect():
        yield staged.where(F.col("part") == part).drop("part")


def _events(spark: SparkSession, sf_dir: str, stream: bool, events: DataFrame | None = None) -> DataFrame:
    """The events, what polls need of them, dealt out to tasks evenly and in no order."""
    if events is not None:
        tasks = 1 + (EVENTS_A_LANDING if events.isStreaming else events.count()) // EVENTS_A_TASK
        return events.select("event_id", "ts", "user_id", "value").repartition(tasks)
    found = table(spark, sf_dir, "events")
    tasks = 1 + found.count() // EVENTS_A_TASK
    if stream:
        found = (spark.readStream.schema(found.schema).option("pathGlobFilter", "events.parquet")
                 .parquet(sf_dir))
    found = found.select("event_id", "ts", "user_id", "value")
    return found.repartition(tasks) if tasks > 1 else found


def reads_of(spark: SparkSession, sf_dir: str, driver: str, stream: bool = False,
             resolved: bool = False, events: DataFrame | None = None) -> DataFrame:
    """Landed reads where every event is a poll of one driver.

    With `resolved`, only the first good attempt has been landed. `events` are those to take, or
    a stream of them, in place of the table's.
    """
    counts = {b.block: b.count for b in CATALOG[driver].blocks}
    reads = _landed(_events(spark, sf_dir, stream, events), table(spark, sf_dir, "supplier").count())
    if resolved:
        earlier = reduce(or_, [(F.col("attempt") > a) & _ok(F.lit(a)) for a in ATTEMPTS])
        reads = reads.where(F.col("ok") & ~earlier)
    count = reduce(lambda rest, k: F.when(F.col("block") == k, counts[k]).otherwise(rest),
                   counts, F.lit(0))
    return _registers(reads.where(F.col("block").isin(list(counts))), F.lit(driver), count, max(counts.values()))


def reads(spark: SparkSession, sf_dir: str, catalog: Catalog = CATALOG,
          stream: bool = False) -> DataFrame:
    """Landed reads of the mixed fleet in `devices`.

    Devices of an unknown driver answer with four words in block 1.
    """
    landed = (_landed(_events(spark, sf_dir, stream), table(spark, sf_dir, "supplier").count())
              .withColumn("driver", _driver_of(F.col("device"))))
    blocks = catalog.blocks_frame(spark).select("driver", "block", "count")
    most = max(4, *(b.count for rules in catalog.drivers.values() for b in rules.blocks))
    stray = spark.range(1).select(F.lit("unknown").alias("driver"), F.lit(1).alias("block"),
                                  F.lit(4).alias("count"))
    # Catalogue rows only.
    return _registers(landed.join(F.broadcast(blocks.union(stray)), ["driver", "block"]),
                      F.col("driver"), F.col("count"), most)


def host_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    def size(k: int) -> Column:
        return (F.col("l_partkey") + k) * 131072 * (F.col("l_linenumber") + 1)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("H"), F.col("l_suppkey")).alias("host"),
        as_instant(F.col("l_shipdate")).alias("ts"),
        F.concat(F.lit("temp="), F.col("l_quantity").cast("string"), F.lit("'C")).alias("cpu_temp_raw"),
        (F.col("l_discount") * 100).alias("cpu_usage"),
        F.col("l_tax").alias("load1"), (F.col("l_tax") * 2).alias("load5"),
        (F.col("l_tax") * 3).alias("load15"),
        *[size(k).alias(name) for k, name in enumerate(
            ["ram_cached", "ram_used", "ram_free", "ram_available"])],
        (F.col("l_discount") * 50).alias("ram_percent"),
        *[(size(k) * 16).alias(name) for k, name in enumerate(
            ["disk_total", "disk_used", "disk_free"], start=4)],
        (F.col("l_discount") * 25).alias("disk_percent"))


def damaged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples; some temperatures can't be read, some are missing."""
    raw, at = F.col("cpu_temp_raw"), F.col("ram_cached") / 131072 % 11
    return host_samples(spark, sf_dir).withColumn(
        "cpu_temp_raw", F.when(at == 3, F.lit("temp=n/a")).when(at != 4, raw))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("H"), F.col("s_suppkey")).alias("host"))


def cpuinfo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five kinds of host, by key modulo 5.

    One serial line, two of them, none, a short one, or no lines at all.
    """
    key = F.col("s_suppkey")
    serial = F.concat(F.lit("Serial\t\t: 00000000"), F.lpad(F.hex(key * 7919), 8, "0"))
    other = F.concat(F.lit("Serial\t\t: 11111111"), F.lpad(F.hex(key * 104729), 8, "0"))
    model = F.lit("Model\t\t: board")
    kinds = F.when(key % 5 == 0, F.array(model, serial)) \
        .when(key % 5 == 1, F.array(serial, model, other)) \
        .when(key % 5 == 2, F.array(model, model)) \
        .when(key % 5 == 3, F.array(F.lit("Serial\t\t: 1234"), model))
    return (table(spark, sf_dir, "supplier")
            .select(F.concat(F.lit("H"), key).alias("host"), F.posexplode(kinds))
            .select("host", F.col("pos").alias("line_no"), F.col("col").alias("line")))


LOGGERS = ("0badc0de", "0badf00d")


def runs(spark: SparkSession, sf_dir: str, serials: tuple[str, ...] = LOGGERS) -> DataFrame:
    """A run of every logger in the minute of every event and in the minute after.

    Most of the latter have no records.
    """
    ts = as_instant(F.col("ts"))
    minutes = F.explode(F.array(ts, ts + F.expr("INTERVAL 1 MINUTE")))
    return (table(spark, sf_dir, "events").select(minutes.alias("ts"))
            .select(F.date_trunc("minute", "ts").alias("minute")).distinct()
            .select(F.explode(F.array(*[F.lit(s) for s in serials])).alias("serial"),
                    F.lit("config").alias("config"), "minute"))
