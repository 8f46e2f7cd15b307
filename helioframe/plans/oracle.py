"""The same results in plain SQL, for a second engine to check.

Words are computed by arithmetic instead of array access and signs by
comparison instead of bit operations, so the two ways share only the catalogue.
"""

from __future__ import annotations

from helioframe.catalog import CATALOG, Driver, Field
from helioframe.plans import queries as q
from helioframe.plans import testbed as tb


def values(rows, columns: str) -> str:
    def literal(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"(VALUES {body}) {columns}"


# Landed reads

RAW = f"""raw AS (
  SELECT e.event_id AS poll_id, e.ts AS poll_ts, e.user_id % n.n AS device, b.block, a.attempt,
         (e.event_id * 7 + b.block * 13 + a.attempt * 5) % 4 <> 0
           AND (a.attempt = 3 OR (e.event_id + b.block * 3) % 11 <> 0) AS ok,
         e.event_id * 40503 + b.block * 7919 + a.attempt * 104729
           + CAST(round(e.value * 100) AS BIGINT) * 31 AS base
  FROM events e CROSS JOIN (SELECT count(*) AS n FROM supplier) n
       CROSS JOIN {values([(k,) for k in tb.BLOCKS], "b(block)")}
       CROSS JOIN {values([(k,) for k in tb.ATTEMPTS], "a(attempt)")})"""

DRIVER_CASE = "CASE WHEN s_suppkey % 17 = 3 THEN 'unknown' " + " ".join(
    f"WHEN s_suppkey % {len(tb.DRIVER_KEYS)} = {i} THEN '{d}'"
    for i, d in enumerate(tb.DRIVER_KEYS)) + " END"
DEVICE = f"""device AS (
  SELECT s_suppkey AS device, 'DEV_' || s_suppkey AS device_name, {DRIVER_CASE} AS driver,
         s_nationkey % 5 <> 0 AS enabled, 'SPP_' || (s_nationkey % 3) AS measurement
  FROM supplier)"""
BLOCK = "blk AS (SELECT * FROM " + values(
    [(d.name, b.block, b.count, d.max_attempts, len(d.blocks)) for d in CATALOG for b in d.blocks],
    "v(driver, block, cnt, tries, n_blocks)") + ")"
STRAY = "SELECT 'unknown', 1, 4, 0, 0"

FLEET = f"""{RAW}, {DEVICE}, {BLOCK},
dispatched AS (
  SELECT r.*, d.device_name, d.driver, d.measurement, k.cnt, k.tries, k.n_blocks,
         NOT (d.driver = '{tb.METER}' AND r.block = 1
              AND (r.poll_id % 13 = 0 OR (r.poll_id + r.attempt) % 3 = 0)) AS acc
  FROM raw r JOIN device d ON d.device = r.device AND d.enabled
       JOIN blk k ON k.driver = d.driver AND k.block = r.block)"""


def single(driver: str) -> str:
    """As FLEET, with every device on and of one driver."""
    own = DEVICE.replace(DRIVER_CASE, f"'{driver}'").replace("s_nationkey % 5 <> 0", "TRUE")
    return FLEET.replace(DEVICE, own)


CHOSEN = """chosen AS (
  SELECT * FROM dispatched WHERE ok AND attempt < tries
  QUALIFY row_number() OVER (PARTITION BY poll_id, block ORDER BY acc DESC,
                             CASE WHEN acc THEN attempt ELSE -attempt END) = 1)"""
POLL = """poll AS (
  SELECT poll_id, poll_ts, device_name, driver, measurement,
         max(CASE WHEN block = 0 THEN base END) AS base0,
         max(CASE WHEN block = 1 THEN base END) AS base1,
         max(CASE WHEN block = 2 THEN base END) AS base2,
         max(CASE WHEN block = 3 THEN base END) AS base3,
         max(CASE WHEN block = 0 THEN cnt END) AS cnt0, max(CASE WHEN block = 1 THEN cnt END) AS cnt1,
         max(CASE WHEN block = 2 THEN cnt END) AS cnt2, max(CASE WHEN block = 3 THEN cnt END) AS cnt3
  FROM chosen GROUP BY poll_id, poll_ts, device_name, driver, measurement, n_blocks
  HAVING count(*) = n_blocks)"""

DATE = "strftime(poll_ts, '%Y-%m-%dT%H:%M:00Z')"
TAGS = f"""device_name AS "Device_Name", measurement AS "Measurement_Suffix", {DATE} AS "Date\""""


def word(base: str, i: int | str) -> str:
    return f"(({base} + ({i}) * 9973) % 65536)"


def whole(x: str) -> str:
    return f"CAST({x} AS INTEGER)"


def s16(w: str) -> str:
    return f"(CASE WHEN {w} >= 32768 THEN {w} - 65536 ELSE {w} END)"


def u32(hi: str, lo: str) -> str:
    return f"({hi} * 65536 + {lo})"


def s32(hi: str, lo: str) -> str:
    return f"({u32(hi, lo)} - CASE WHEN {hi} >= 32768 THEN 4294967296 ELSE 0 END)"


def double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def value(f: Field) -> str:
    base = f"base{f.block}"
    w = [word(base, i) for i in f.words()]
    if f.kind == "bit":
        return double(f"({w[0]} >> {f.aux}) & 1")
    raw = {"u16": lambda: w[0], "s16": lambda: s16(w[0]),
           "u32": lambda: u32(*w), "s32": lambda: s32(*w)}[f.kind]()
    x = f"{double(raw)} / {double(f.divisor)} * {double(f.multiplier)}"
    return f"greatest({x}, {double(0)})" if f.clamp else x


def fields(d: Driver) -> str:
    return ", ".join(f'{value(f)} AS "{f.name}"' for f in d.fields)


def decoded(driver: str) -> str:
    return (f"WITH {single(driver)}, {CHOSEN}, {POLL} "
            f"SELECT poll_id, {TAGS}, {fields(CATALOG[driver])} FROM poll")


def long(source: str, catalog=CATALOG, polls: str = "poll") -> str:
    rules = values([(d.name, f.name, f.kind, f.block, f.offset, f.aux, f.divisor, f.multiplier,
                     f.clamp) for d in catalog for f in d.fields],
                   "r(driver, field, kind, block, hi, lo, divisor, multiplier, clamp)")
    w, low = word("base", "r.hi"), word("base", "r.lo")
    return f"""WITH {source}, {CHOSEN}, {POLL}, ruled AS (
      SELECT p.*, r.* EXCLUDE (driver),
             CASE r.block WHEN 0 THEN base0 WHEN 1 THEN base1 WHEN 2 THEN base2 ELSE base3 END AS base
      FROM {polls} p JOIN {rules} ON r.driver = p.driver),
    raw_value AS (
      SELECT *, {double(f'''CASE r.kind WHEN 'bit' THEN ({w} >> CAST(r.lo AS BIGINT)) & 1
        WHEN 'u16' THEN {w} WHEN 's16' THEN {s16(w)}
        WHEN 'u32' THEN {u32(w, low)} ELSE {s32(w, low)} END''')}
        / {double('r.divisor')} * {double('r.multiplier')} AS v FROM ruled r)
    SELECT poll_id, {TAGS}, driver, field,
           CASE WHEN clamp AND v < 0 THEN {double(0)} ELSE v END AS value FROM raw_value"""


# JSON text of a weather station record

STATION = single(q.STATION)
STATION_JSON = "'{\"Device_Name\":\"' || device_name || '\",\"Measurement_Suffix\":\"' || measurement " \
    "|| '\",\"Date\":\"' || " + DATE + " || '\"' || " + " || ".join(
        f"',\"{f.name}\":' || CAST({value(f)} AS VARCHAR)" for f in CATALOG[q.STATION].fields) + " || '}'"
RECORD = f"""{STATION}, {CHOSEN}, {POLL}, record AS (
  SELECT poll_id, poll_ts, CAST(substr(device_name, 5) AS INT) AS position, device_name,
         {STATION_JSON} AS record FROM poll)"""
# The first good attempt alone, whatever is allowed: what a resolved stream holds.
RESOLVED = RECORD.replace("ok AND attempt < tries", """ok AND attempt < tries AND NOT EXISTS (
    SELECT 1 FROM raw x WHERE x.poll_id = dispatched.poll_id AND x.block = dispatched.block
      AND x.ok AND x.attempt < dispatched.attempt)""")
RUNS = """run AS (
  SELECT DISTINCT date_trunc('minute', ts) AS minute FROM events
  UNION SELECT date_trunc('minute', ts + INTERVAL 1 MINUTE) FROM events)"""
PACKED = """packed AS (
  SELECT date_trunc('minute', poll_ts) AS minute, count(*) AS records,
         '[' || string_agg(record, ',' ORDER BY position, poll_id) || ']' AS payload
  FROM record GROUP BY 1)"""
LOGGERS = values([(s,) for s in tb.LOGGERS], "logger(serial)")
STAMP = "strftime({ts} + INTERVAL 3 HOUR, '%Y%m%d%H%M')"

DEVICES = f"""SELECT 'config' AS config, CAST(s_suppkey AS INT) AS position,
  'DEV_' || s_suppkey AS name, {DRIVER_CASE} AS driver, s_nationkey % 5 <> 0 AS enabled,
  'SPP_' || (s_nationkey % 3) AS measurement, CAST(1 + s_suppkey % 247 AS INT) AS slave_id,
  '10.0.' || s_nationkey || '.' || (s_suppkey % 250) AS ip_address, 502 AS port FROM supplier"""
BROKERS = """SELECT r_regionkey AS broker, r_name AS topic, '10.1.0.' || r_regionkey AS ip_address,
  1883 + r_regionkey AS port, r_regionkey % 2 = 0 AS enabled FROM region"""


def size(k: int) -> str:
    return f"((l_partkey + {k}) * 131072 * (l_linenumber + 1))"


def rounded(x: str, unit: int) -> str:
    return f"round_even({double(x)} / {double(unit)}, 2)"


MIB, GIB = 2 ** 20, 2 ** 30
TEMP = "'temp=' || CAST(l_quantity AS VARCHAR) || '''C'"
SERIAL = """CASE s_suppkey % 5 WHEN 0 THEN substr(printf('%08X', s_suppkey * 7919), 1, 8)
  WHEN 1 THEN printf('%08X', s_suppkey * 104729) WHEN 2 THEN '00000000' WHEN 3 THEN ''
  ELSE 'ERROR0000' END"""
METRICS = f"""SELECT 'LOGGER' AS "Device_Name", l_quantity AS "CPU_Temp",
  l_discount * {double(100)} AS "CPU_Usage", l_tax AS "SystemLoad_5mins",
  l_tax * {double(2)} AS "SystemLoad_10mins", l_tax * {double(3)} AS "SystemLoad_15mins",
  {rounded(size(0), MIB)} AS "RAM_Cached", {rounded(size(1), MIB)} AS "RAM_Used",
  {rounded(size(2), MIB)} AS "RAM_Free", {rounded(size(3), MIB)} AS "RAM_Available",
  l_discount * {double(50)} AS "RAM_Percent", {rounded(size(4) + ' * 16', GIB)} AS "DISK_Total",
  {rounded(size(5) + ' * 16', GIB)} AS "DISK_Used", {rounded(size(6) + ' * 16', GIB)} AS "DISK_Free",
  l_discount * {double(25)} AS "DISK_Percent",
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:00Z') AS "Date",
  coalesce({SERIAL}, 'ERROR0000') AS "Device_Serial"
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey"""
READS = f"""WITH {RAW}, {DEVICE}, {BLOCK}, landed AS (
  SELECT d.device_name, r.poll_id, r.poll_ts, r.block, r.attempt, r.ok, r.base, d.driver, k.cnt,
         r.ok AND k.driver = '{tb.METER}' AND r.block = 1
           AND (r.poll_id % 13 = 0 OR (r.poll_id + r.attempt) % 3 = 0) AS dead
  FROM raw r JOIN device d ON d.device = r.device
       JOIN (SELECT * FROM blk UNION ALL {STRAY}) k ON k.driver = d.driver AND k.block = r.block)"""
READ_SUMMARY = f"""{READS} SELECT device_name, poll_id, strftime(poll_ts, '%Y-%m-%d %H:%M:%S') AS poll_ts,
  block, attempt, ok, CASE WHEN ok THEN cnt ELSE 0 END AS n_words,
  {whole(f"CASE WHEN ok THEN {word('base', 0)} END")} AS first_word,
  {whole(f"CASE WHEN ok THEN {word('base', 'cnt - 1')} END")} AS last_word FROM landed"""


def station_words(**columns: str) -> str:
    chosen = ", ".join(f'{double(sql)} AS "{name}"' for name, sql in columns.items())
    return f"WITH {RAW} SELECT poll_id, attempt, {chosen} FROM raw WHERE ok AND block = 1"


def at(i: int) -> str:
    return word("base", i)


METER_WORDS = ", ".join(
    whole(f"CASE WHEN poll_id % 13 = 0 OR (poll_id + attempt) % 3 = 0 THEN 0 ELSE {at(i)} END")
    + f" AS word_{i}"
    for i in (16, 17))
TARGETS = "(SELECT r_regionkey AS broker, r_name AS base_topic FROM region WHERE r_regionkey % 2 = 0) t"
MESSAGES = f"""SELECT broker, base_topic || '/' || device_name AS topic, record AS payload
  FROM record CROSS JOIN {TARGETS}"""

# Polls of one inverter fleet where block 2 of every nineteenth is cut short.
GRADED = f"""WITH {single(q.INVERTER)}, per_block AS (
  SELECT poll_id, poll_ts, device_name, block, count(*) AS n, CAST(count(CASE WHEN attempt < tries THEN 1 END) AS BIGINT) AS tries,
         count(CASE WHEN ok AND attempt < tries THEN 1 END) = 0 AS torn
  FROM dispatched GROUP BY ALL),
graded AS (
  SELECT poll_id, poll_ts, device_name, CAST(sum(n) AS BIGINT) AS n_reads, count(CASE WHEN torn THEN 1 END) AS n_torn,
         string_agg(CASE WHEN torn THEN block END, ',' ORDER BY block) AS torn,
         string_agg(CASE WHEN torn THEN tries END, ',' ORDER BY block) AS tries,
         CAST(max(CASE WHEN block = 2 THEN tries END) AS VARCHAR) AS tries_2 FROM per_block GROUP BY ALL)"""
OUTCOME = "CASE WHEN n_torn > 0 THEN 'torn' WHEN poll_id % 19 = 0 THEN 'unusable' ELSE 'whole' END"
REJECTS = f"""SELECT poll_id, device_name, {OUTCOME} AS outcome, p.block, p.tries AS attempts
  FROM graded JOIN per_block p USING (poll_id, device_name)
  WHERE p.torn OR n_torn = 0 AND poll_id % 19 = 0 AND p.block = 2"""
OLD = "poll_ts <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"

ORACLE: dict[str, str] = {
    # Read back from one list per nation, or per kind of broker.
    "device_registry": f"""SELECT CAST(row_number() OVER (PARTITION BY split_part(ip_address, '.', 3)
      ORDER BY position) - 1 AS INTEGER) AS position, name, driver, enabled, measurement, slave_id,
      ip_address, port FROM ({DEVICES})""",
    "broker_registry": f"""SELECT CAST(row_number() OVER (PARTITION BY broker % 2 ORDER BY broker) - 1
      AS INTEGER) AS broker, topic, ip_address, port, enabled FROM ({BROKERS})""",
    "enabled_devices": f"SELECT config, position, name FROM ({DEVICES}) WHERE enabled",
    "enabled_brokers": f"SELECT broker, topic FROM ({BROKERS}) WHERE enabled",
    "device_listing": f"""SELECT config, position, name || ' <--> ' || driver || ' <--> ' || ip_address
      || ' <--> ' || port || ' <--> ' || slave_id AS line FROM ({DEVICES})""",
    "unknown_driver_rejects": f"""SELECT position, name, driver FROM ({DEVICES})
      WHERE enabled AND driver = 'unknown'""",
    "driver_version": f"""SELECT position, name, label || ' v' || version AS driver_version
      FROM ({DEVICES}) d JOIN {values([(d.name, d.label, d.version) for d in CATALOG],
                                      "v(driver, label, version)")} ON v.driver = d.driver""",
    "register_reads": READ_SUMMARY,
    "register_stream": READ_SUMMARY,
    "host_samples": f"""SELECT 'H' || l_suppkey AS host,
      strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS ts, {TEMP} AS cpu_temp_raw,
      l_discount * {double(100)} AS cpu_usage, l_tax AS load1, {size(0)} AS ram_cached,
      {size(3)} AS ram_available, {size(4)} * 16 AS disk_total, {size(6)} * 16 AS disk_free
      FROM lineitem""",
    "driver_dispatch": f"""WITH {FLEET} SELECT poll_id, device_name, driver, measurement, block,
      attempt, ok, tries AS max_attempts FROM dispatched""",
    "accept_predicate": f"""WITH {RAW} SELECT poll_id, block, attempt,
      CASE WHEN block = 1 AND (poll_id % 13 = 0 OR (poll_id + attempt) % 3 = 0) THEN 0 ELSE 1 END
      AS accepted FROM raw WHERE ok AND block IN (1, 2)""",
    "first_good_attempt": f"""WITH {single(q.INVERTER)}, {CHOSEN}
      SELECT poll_id, device_name, block, attempt, {whole(at(0))} AS first_word FROM chosen""",
    "accepted_else_last_attempt": f"""WITH {single(tb.METER)}, {CHOSEN}
      SELECT poll_id, device_name, attempt, {METER_WORDS} FROM chosen WHERE block = 1""",
    "complete_polls": f"""WITH {FLEET}, {CHOSEN}, {POLL}
      SELECT poll_id, device_name, driver FROM poll""",
    "drop_failed": f"""WITH {FLEET} SELECT poll_id, device_name, block, attempt FROM dispatched
      QUALIFY bit_count(bit_or(CASE WHEN ok AND attempt < tries THEN 1 << block ELSE 0 END)
                        OVER (PARTITION BY poll_id)) = n_blocks""",
    "read_failures": f"""WITH {FLEET} SELECT poll_id, device_name, block,
      count(CASE WHEN attempt < tries THEN 1 END) AS attempts FROM dispatched
      GROUP BY poll_id, device_name, block
      HAVING count(CASE WHEN ok AND attempt < tries THEN 1 END) = 0""",
    "address_blocks": f"""WITH {single(q.BY_ADDRESS)}, {CHOSEN}
      SELECT poll_id, device_name, block, attempt, CAST(cnt AS INTEGER) AS n_words, {whole(at(0))} AS first_word,
             {whole(word('base', 'cnt - 1'))} AS last_word FROM chosen""",
    "decode_by_address": decoded(q.BY_ADDRESS),
    "unusable_entries": f"""SELECT position, CASE WHEN position % 9 <> 6 THEN driver END AS driver, slave_id
      FROM ({DEVICES}) WHERE position % 9 IN (4, 5, 6)""",
    "unreadable_registries": """SELECT 'no section' AS reason, count(DISTINCT s_nationkey) AS files FROM supplier
      WHERE s_nationkey % 4 = 1 UNION ALL SELECT 'no entries', 1""",
    "registry_as_of": f"""WITH {single(q.INVERTER)}, middle AS (
        SELECT floor((floor(epoch(min(ts))) + floor(epoch(max(ts)))) / 2) AS half FROM events)
      SELECT poll_id, device_name, block, CASE WHEN epoch(poll_ts) < half THEN measurement ELSE 'LATER' END AS measurement
      FROM dispatched CROSS JOIN middle
      WHERE attempt = 0 AND (epoch(poll_ts) < half OR device % 5 NOT IN (1, 2))""",
    "unusable_polls": f"""WITH {single(q.INVERTER)}, {CHOSEN}, {POLL}
      SELECT poll_id, device_name, '2' AS blocks FROM poll WHERE poll_id % 19 = 0""",
    "graded_polls": f"""{GRADED} SELECT poll_id, device_name, {OUTCOME} AS outcome, n_reads,
      CASE WHEN n_torn > 0 THEN torn WHEN poll_id % 19 = 0 THEN '2' ELSE '' END AS blocks,
      CASE WHEN n_torn > 0 THEN tries WHEN poll_id % 19 = 0 THEN tries_2 ELSE '' END AS tries FROM graded""",
    "poll_rejects": f"""{GRADED} {REJECTS}""",
    "attempt_stats": f"""{READS} SELECT device_name, block, count(*) AS attempts,
      count(CASE WHEN NOT ok THEN 1 END) AS failed, max(attempt) AS last_attempt
      FROM landed GROUP BY device_name, block""",
    "block_assembly": f"WITH {FLEET}, {CHOSEN}, {POLL} SELECT poll_id, device_name, driver, "
      + ", ".join(f"{whole(word(f'base{k}', 0))} AS first_{k}, "
                  f"{whole(word(f'base{k}', f'cnt{k} - 1'))} AS last_{k}"
                  for k in tb.BLOCKS) + " FROM poll",
    "tag_columns": f"WITH {FLEET}, {CHOSEN}, {POLL} SELECT poll_id, {TAGS} FROM poll",
    "minute_snapshot": """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute,
      count(*) AS polls FROM events GROUP BY 1""",
    "decode_u16": station_words(value=at(3)),
    "decode_s16": station_words(value=s16(at(10))),
    "decode_u32": station_words(value=u32(at(28), at(29))),
    "decode_s32": station_words(value=s32(at(22), at(23))),
    "decode_u32_swapped": station_words(value=u32(at(41), at(40))),
    "scale_pow10": station_words(**{f"by_{d}": f"{double(at(5))} / {double(d)}"
                                    for d in (1, 10, 100, 1000)}),
    "post_multiplier": station_words(value=f"{double(u32(at(21), at(22)))} / {double(10)} * {double(10)}"),
    "decode_bits": station_words(**{f"bit_{n}": f"({at(1)} >> {n}) & 1" for n in range(16)}),
    "clamp_negative": station_words(value=f"greatest({s16(at(0))}, 0)"),
    **{name: decoded(driver) for name, driver in q.DECODERS.items()},
    "field_decode": long(FLEET),
    "wide_pivot": decoded(q.STATION),
    "wide_pivot_by_place": f"""SELECT d.*, config, CAST(substr("Device_Name", 5) AS INT) AS position
      FROM ({decoded(q.STATION)}) d CROSS JOIN {values([("config",), ("second",)], "c(config)")}""",
    "register_driver": f"""WITH {STATION}, {CHOSEN}, {POLL}
      SELECT poll_id, {TAGS}, {fields(q.SITE_METER["site_meter"])} FROM poll""",
    "decode_with": f"""WITH {STATION}, {CHOSEN}, {POLL}
      SELECT poll_id, device_name AS "Device_Name",
             {double(f'max({word("base1", "i")}) - min({word("base1", "i")})')} AS spread
      FROM poll CROSS JOIN range(50) w(i) GROUP BY poll_id, device_name""",
    "bytes_to_mib": f"""SELECT 'H' || l_suppkey AS host, {size(0)} AS ram_cached,
      {size(1)} AS ram_used, {rounded(size(0), MIB)} AS cached_mib,
      {rounded(size(1), MIB)} AS used_mib FROM lineitem""",
    "bytes_to_gib": f"""SELECT 'H' || l_suppkey AS host, {size(4)} * 16 AS disk_total,
      {rounded(size(4) + ' * 16', GIB)} AS total_gib FROM lineitem""",
    "cpu_temp_parse": f"""SELECT 'H' || l_suppkey AS host, {TEMP} AS cpu_temp_raw,
      l_quantity AS cpu_temp FROM lineitem""",
    "cpu_serial": f"SELECT 'H' || s_suppkey AS host, {SERIAL} AS serial FROM supplier",
    "unusable_samples": f"""SELECT 'H' || l_suppkey AS host,
      CASE WHEN {size(0)} // 131072 % 11 = 3 THEN 'temp=n/a' END AS cpu_temp_raw,
      l_discount * {double(100)} AS cpu_usage, {size(0)} AS ram_cached FROM lineitem
      WHERE {size(0)} // 131072 % 11 IN (3, 4)""",
    "host_metrics": METRICS,
    "union_host_records": f"SELECT * FROM ({decoded(q.STATION)}) UNION ALL BY NAME ({METRICS})",
    "utc_minute_string": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:00Z') AS "Date"
      FROM events""",
    "file_minute_string": f"SELECT event_id, {STAMP.format(ts='ts')} AS stamp FROM events",
    "snapshot_file_name": f"""SELECT event_id, '{q.PREFIX}_' || printf('%X', user_id) || '_'
      || event_type || '_cfg_' || {STAMP.format(ts='ts')} || '.json.gz' AS file_name FROM events""",
    "parse_file_name": f"""SELECT event_id, printf('%X', user_id) AS serial,
      event_type || '_cfg' AS config, {STAMP.format(ts='ts')} AS stamp FROM events""",
    "record_json": f"WITH {RECORD} SELECT poll_id, record FROM record",
    "snapshot_package": f"""WITH {RECORD}, {RUNS}, {PACKED}
      SELECT serial, 'config' AS config, strftime(run.minute, '%Y-%m-%d %H:%M:%S') AS minute,
        '{q.PREFIX}_' || serial || '_config_' || {STAMP.format(ts='run.minute')} || '.json.gz' AS file_name,
        coalesce(payload, '[]') AS payload
      FROM run CROSS JOIN {LOGGERS} LEFT JOIN packed ON packed.minute = run.minute""",
    "snapshot_files": f"""WITH {RECORD}, {RUNS}, {PACKED}
      SELECT serial, 'config' AS config, {STAMP.format(ts='run.minute')} AS stamp,
        CAST(coalesce(records, 0) AS INTEGER) AS records
      FROM run CROSS JOIN {LOGGERS} LEFT JOIN packed ON packed.minute = run.minute""",
    "snapshot_read": f"SELECT * EXCLUDE (poll_id), CAST(NULL AS VARCHAR) AS _corrupt_record "
                     f"FROM ({decoded(q.STATION)})",
    "snapshot_long": f"SELECT * EXCLUDE (poll_id, driver) FROM ({long(FLEET)})",
    "topic": f"""WITH {RECORD} SELECT poll_id, broker, base_topic || '/' || device_name AS topic
      FROM record CROSS JOIN {TARGETS}""",
    "broker_fanout": f"""WITH {FLEET}, {CHOSEN}, {POLL} SELECT poll_id, device_name, broker,
      base_topic AS broker_topic FROM poll CROSS JOIN {TARGETS}""",
    "mqtt_messages": f"WITH {RECORD} {MESSAGES}",
    "measurement_routing": f"""SELECT "Measurement_Suffix", substr("Date", 1, 10) AS day,
      count(*) AS records, min(poll_id) AS first_poll, max("Air_Temperature") AS highest
      FROM ({decoded(q.STATION)}) GROUP BY 1, 2""",
    "measurement_replay": f"""SELECT "Measurement_Suffix", substr("Date", 1, 10) AS day,
      count(*) AS records, min(poll_id) AS first_poll, max("Air_Temperature") AS highest
      FROM ({decoded(q.STATION)}) GROUP BY 1, 2""",
    "collection_run": f"""{GRADED}, told AS (SELECT poll_id, {OUTCOME} AS outcome FROM graded),
      reject AS ({REJECTS})
      SELECT outcome AS kind, count(*) AS n FROM told GROUP BY 1
      UNION ALL SELECT 'in files', count(*) FROM told WHERE outcome = 'whole'
      UNION ALL SELECT 'to ' || broker, count(*) FROM told CROSS JOIN {TARGETS} WHERE outcome = 'whole' GROUP BY broker
      UNION ALL SELECT outcome || ' ' || block, count(*) FROM reject GROUP BY outcome, block""",
    "stream_decode_retries": long(STATION, CATALOG.only(q.STATION)),
    "stream_rejects": f"{GRADED} {REJECTS} AND graded.{OLD}".replace("WHERE p.torn OR n_torn = 0 AND poll_id % 19 = 0 AND p.block = 2",
                                                             "WHERE (p.torn OR n_torn = 0 AND poll_id % 19 = 0 AND p.block = 2)"),
    "stream_late_reads": f"""WITH {single(q.INVERTER)}
      SELECT poll_id, device_name, block, attempt, CAST(4 AS BIGINT) AS n_late FROM dispatched
      WHERE poll_id % 7 = 0 AND block = 2 AND {OLD}""",
    "stream_messages_retry": f"WITH {RESOLVED} {MESSAGES}",
    "stream_decode": long(RESOLVED, CATALOG.only(q.STATION)).replace(
        f"{CHOSEN}, {POLL}, ruled", "ruled"),
    # Polls later than ten minutes before the last one are still open.
    "stream_assemble": long(single(q.INVERTER), CATALOG.only(q.INVERTER),
        "(SELECT * FROM poll WHERE poll_ts <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)"),
    **{name: f"SELECT * EXCLUDE (poll_id), CAST(NULL AS VARCHAR) AS _corrupt_record "
             f"FROM ({decoded(q.STATION)})" for name in ("stream_snapshots", "stream_snapshots_small_batches")},
    "stream_messages": f"WITH {RESOLVED} {MESSAGES}",
}
