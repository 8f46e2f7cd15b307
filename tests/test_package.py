import gzip
import json
from datetime import timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helioframe import schemas, sinks
from helioframe.functions import tags
from helioframe.operators import messages
from helioframe.operators.package import HOST_POSITION, package_snapshots, snapshot_entries
from helioframe.plans import run
from helioframe.sources.snapshots import read_snapshots, read_snapshots_long
from fixtures import T0, brokers, devices, reads

SCHEMA = "Device_Name string, Measurement_Suffix string, Date string, v double"


def records(spark, *rows):
    """Rows of (position, poll_id, minutes after T0, json)."""
    full = [("config", p, T0 + timedelta(minutes=m), i, r) for p, i, m, r in rows]
    return spark.createDataFrame(
        full, "config string, position int, poll_ts timestamp, poll_id bigint, record string")


def registry(spark, n=6):
    return devices(spark, *[(f"D{i}", "sensor_irradiation_akfen", True) for i in range(n)])


def runs(spark, *minutes):
    at = T0.replace(second=0)
    return spark.createDataFrame([("abc", "config", at + timedelta(minutes=m)) for m in minutes],
                                 schemas.RUNS)


def record(name, v):
    return json.dumps({"Device_Name": name, "Measurement_Suffix": "S",
                       "Date": "2024-03-01T12:00:00Z", "v": v}, separators=(",", ":"))


def test_order_empty_run_and_unlisted_run(spark):
    packed = package_snapshots(
        records(spark, (5, 1, 0, record("E", 5)), (HOST_POSITION, 9, 0, record("H", 9)),
                (0, 2, 0, record("A", 0)), (2, 3, 0, record("C", 2)), (1, 4, 7, record("B", 1))),
        runs(spark, 0, 1), "site", "Asia/Riyadh")
    got = {r.file_name: [x["Device_Name"] for x in json.loads(r.payload)] for r in packed.collect()}
    assert got == {"site_abc_config_202403011500.json.gz": ["A", "C", "E", "H"],
                   "site_abc_config_202403011501.json.gz": [],
                   "site_00000000_config_202403011507.json.gz": ["B"]}


def test_a_large_configuration_is_one_file_written_in_order(spark, tmp_path):
    many = [(p, p, 0, record(f"D{p}", p)) for p in range(25)] + [(HOST_POSITION, 99, 0, record("H", 1))]
    sinks.write_snapshot_files(snapshot_entries(
        records(spark, *many[::-1]), runs(spark, 0), "site"), str(tmp_path))
    (path,) = tmp_path.glob("*.gz")
    assert [x["Device_Name"] for x in json.loads(gzip.open(path).read())] == [
        *[f"D{p}" for p in range(25)], "H"]


def test_every_run_of_a_minute_is_kept(spark):
    both = runs(spark, 0, 1).union(runs(spark, 0, 1).withColumn("serial", F.lit("def")))
    packed = package_snapshots(records(spark, (0, 1, 0, record("A", 0))), both, "site")
    assert sorted((r.serial, r.minute.minute, len(json.loads(r.payload))) for r in packed.collect()) == [
        ("abc", 0, 1), ("abc", 1, 0), ("def", 0, 1), ("def", 1, 0)]


def test_loggers_sharing_a_configuration_name(spark):
    rows = records(spark, (0, 1, 0, record("A", 0)), (1, 2, 0, record("B", 1)))
    rows = rows.withColumn("serial", F.expr("IF(poll_id = 1, 'abc', 'def')"))
    both = runs(spark, 0).union(runs(spark, 0).withColumn("serial", F.lit("def")))
    packed = package_snapshots(rows, both, "site")
    assert {(r.serial, json.loads(r.payload)[0]["Device_Name"]) for r in packed.collect()} == {
        ("abc", "A"), ("def", "B")}


def test_records_and_runs_shuffle_once(spark):
    rows = records(spark, (0, 1, 0, record("A", 0))).withColumn("serial", F.lit("abc"))
    packed = package_snapshots(rows, runs(spark, 0), "site")
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan  # runs are made distinct first


@pytest.mark.parametrize("config, stem", [
    ("config.yml", "config"), ("/etc/site_a.b.yml", "site_a.b"), ("plain", "plain"), (".hidden", ".hidden")])
def test_config_stem_and_name_round_trip(spark, config, stem):
    row = spark.createDataFrame([(config, T0)], "c string, t timestamp").select(
        tags.file_name("p", F.lit("0a"), F.col("c"), F.col("t"), "Asia/Riyadh").alias("n"))
    name = row.first().n
    assert name == f"p_0a_{stem}_202403011500.json.gz"
    parsed = row.select(tags.parse_file_name(F.col("n")).alias("p")).first().p
    assert tuple(parsed) == ("0a", stem, "202403011500")
    assert row.select(tags.parse_file_name(F.lit("x.json.gz"))).first()[0] is None


def test_both_runs_of_a_repeated_local_minute_are_kept(spark, tmp_path):
    """Clocks go back at 01:00 UTC; half past two in the morning comes twice."""
    when = [F.timestamp_seconds(F.lit(1_729_989_000 + 3600 * k)) for k in range(3)]  # 2024-10-27 00:30, 01:30, 02:30 UTC
    names = spark.range(1).select(*[tags.file_name("p", F.lit("a"), F.lit("c"), t, "Europe/Berlin").alias(f"n{k}")
                                    for k, t in enumerate(when)]).first()
    assert list(names) == ["p_a_c_202410270230.json.gz", "p_a_c_202410270230-2.json.gz", "p_a_c_202410270330.json.gz"]
    parsed = spark.createDataFrame([(n,) for n in names], "n string").select(tags.parse_file_name(F.col("n")).alias("p")).collect()
    assert [tuple(x.p) for x in parsed] == [("a", "c", "202410270230")] * 2 + [("a", "c", "202410270330")]


def test_too_many_brokers_are_an_error(spark):
    many = spark.range(10_001).select(F.col("id").alias("broker"), F.lit("t").alias("topic"), F.lit(True).alias("enabled"))
    with pytest.raises(ValueError):
        messages.fan_out(records(spark, (0, 1, 0, record("A", 0))), many)
    assert messages.fan_out(records(spark, (0, 1, 0, record("A", 0))), many.limit(3)).count() == 3


def test_gzip_round_trip_with_empty_and_truncated(spark, tmp_path):
    path = str(tmp_path / "s")
    packed = package_snapshots(
        records(spark, (0, 1, 0, record("A", 1.5)), (1, 2, 0, record("B", -2.0)), (0, 3, 1, record("A", 3.0))),
        runs(spark, 0, 1, 2), "site")
    sinks.write_snapshots(packed, path)
    with gzip.open(f"{path}/torn.json.gz", "wt") as f:
        f.write('[{"Device_Name":"T","v":')
    got = read_snapshots(spark, path, SCHEMA).collect()
    assert sorted((r.Device_Name, r.v) for r in got if r.Device_Name) == [
        ("A", 1.5), ("A", 3.0), ("B", -2.0)]
    assert [r._corrupt_record for r in got if r._corrupt_record] == ['[{"Device_Name":"T","v":']


def test_named_files_like_a_single_logger_writes_them(spark, tmp_path):
    path = str(tmp_path / "named")
    packed = snapshot_entries(records(spark, (0, 1, 0, record("A", 1.5))), runs(spark, 0, 1), "site")
    sinks.write_snapshot_files(packed, path)
    sinks.write_snapshot_files(packed, path)  # a repeated task changes nothing
    names = sorted(p.name for p in (tmp_path / "named").glob("*.gz"))
    assert names == ["site_abc_config_202403011200.json.gz", "site_abc_config_202403011201.json.gz"]
    assert json.loads(gzip.open(f"{path}/{names[0]}").read()) == [json.loads(record("A", 1.5))]
    assert gzip.open(f"{path}/{names[1]}").read() == b"[]"
    assert [r.Device_Name for r in read_snapshots(spark, path, SCHEMA).collect()] == ["A"]


def test_a_run_with_most_records_is_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "hot")
    rows = [(k % 7, k, 0, record(f"D{k}", float(k))) for k in range(900)] + [(0, 2000 + m, m, record("X", 0)) for m in range(1, 9)]
    entries = snapshot_entries(records(spark, *rows), runs(spark, *range(12)), "site")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be one task
    try:
        sinks.write_snapshot_files(entries, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "hot").iterdir())
    assert [f.name for f in files if not f.name.endswith(".gz")] == [] and len(files) == 12
    hot = files[0].read_bytes()
    found = json.loads(gzip.decompress(hot))
    order = sorted(range(900), key=lambda k: (k % 7, k))
    assert [r["Device_Name"] for r in found] == [f"D{k}" for k in order]
    assert hot.count(b"\x1f\x8b\x08") > 4  # members of several tasks, and the brackets
    assert [json.loads(gzip.decompress(f.read_bytes())) for f in files[9:]] == [[], [], []]
    assert read_snapshots(spark, path, SCHEMA).count() == 908


def test_members_go_as_soon_as_their_file_is_there(spark, tmp_path, monkeypatch):
    entries, left = snapshot_entries(records(spark, *[(0, k, k, record("A", 1.0)) for k in range(3)]), runs(spark, *range(3)), "site"), []
    from_uri = sinks.fs.FileSystem.from_uri

    class Seen:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def delete_dir(self, folder):
            left.extend(p.name for p in (tmp_path / "out").glob("_staging-*/*"))
            self.files.delete_dir(folder)

    kinds = type("Kinds", (), {"FileSystem": type("Found", (), {"from_uri": staticmethod(
        lambda uri: (Seen(from_uri(uri)[0]), from_uri(uri)[1]))}), "FileSelector": sinks.fs.FileSelector, "FileType": sinks.fs.FileType})
    # Tasks have the module as it is; only the driver's end of it is watched.
    monkeypatch.setattr(sinks, "fs", kinds)
    sinks.write_snapshot_files(entries, str(tmp_path / "out"))
    assert left == [] and len(list((tmp_path / "out").glob("*.gz"))) == 3


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "broken")
    entries = snapshot_entries(records(spark, *[(0, k, k, record("A", 1.0)) for k in range(6)]), runs(spark, *range(6)), "site")
    bad = entries.withColumn("record", F.when(F.col("poll_id") == 5, F.raise_error(F.lit("no"))).otherwise(F.col("record")))
    with pytest.raises(Exception):
        sinks.write_snapshot_files(bad, path)
    assert list((tmp_path / "broken").iterdir()) == []


def test_mixed_records_read_long(spark, tmp_path):
    path = str(tmp_path / "mixed")
    sinks.write_snapshots(package_snapshots(records(
        spark, (0, 1, 0, record("A", 1.5)), (1, 2, 0, '{"Device_Name":"B","Date":"d","x":1,"y":"t"}')),
        runs(spark, 0), "site"), path)
    got = {(r.Device_Name, r.field, r.value) for r in read_snapshots_long(spark, path).collect()}
    assert got == {("A", "v", "1.5"), ("B", "x", "1"), ("B", "y", "t")}
    with gzip.open(f"{path}/torn.json.gz", "wt") as f:
        f.write('[{"Device_Name":"T","v":')
    torn = read_snapshots_long(spark, path).where("_corrupt_record IS NOT NULL").collect()
    assert [(r.file_name, r.field, r._corrupt_record) for r in torn] == [
        ("torn.json.gz", None, '[{"Device_Name":"T","v":')]


def test_json_array_over_many_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"Device_Name": "A", "v": 1.0}] * 2, indent=4))
    assert read_snapshots(spark, str(tmp_path), SCHEMA, multi_line=True).count() == 2


def test_measurement_tables(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([("A", "S1", T0, 1.0), ("B", "S2", T0 + timedelta(days=1), 2.0)],
                                 "Device_Name string, Measurement_Suffix string, poll_ts timestamp, v double")
    sinks.write_measurements(rows, path)
    found = {(r.Device_Name, r.Measurement_Suffix, str(r.day)) for r in spark.read.parquet(path).collect()}
    assert found == {("A", "S1", "2024-03-01"), ("B", "S2", "2024-03-02")}


def test_run_with_host_record_messages_and_dry_run(spark, tmp_path, capsys):
    ds = devices(spark, ("A", "sensor_irradiation_akfen", True), ("B", "sensor_irradiation_akfen", True))
    rs = reads(spark, ("B", 2, 1, 0, True, [4]), ("A", 1, 1, 0, True, [3]))
    metrics = spark.createDataFrame([("HOST", 50.0, "2024-03-01T12:00:00Z", "abc")],
                                    "Device_Name string, CPU_Temp double, Date string, Device_Serial string")
    found = run.collect(rs, ds, run.host_records(metrics, "config"))
    sent = []

    def publish(broker, messages):
        if broker["broker"] == 0:
            raise OSError("unreachable")
        sent.extend((m.topic, json.loads(m.payload)["Device_Name"]) for m in messages.collect())

    bs = brokers(spark, (0, "down", True), (1, "up", True), (2, "off", False))
    path = str(tmp_path / "out")
    run.run(found, runs(spark, 0), "site", path, bs, publish, sinks=("console", "messages"))
    assert sorted(sent) == [("up/A", "A"), ("up/B", "B"), ("up/HOST", "HOST")]
    assert '"record"' in capsys.readouterr().out
    assert not (tmp_path / "out").exists()
    run.run(found, runs(spark, 0), "site", path, sinks=("files",))
    (line,) = spark.read.option("recursiveFileLookup", True).text(path).collect()
    assert [r["Device_Name"] for r in json.loads(line.value)] == ["A", "B", "HOST"]
    assert json.loads(line.value)[0]["Irradiation"] == 3.0
    with pytest.raises(ValueError):
        run.run(found, runs(spark, 0), "site", path, sinks=("file",))
    assert T0.tzinfo is timezone.utc
