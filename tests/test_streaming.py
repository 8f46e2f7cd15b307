import gzip
import json

import pytest

from helioframe import sinks, streaming
from helioframe.catalog import CATALOG
from helioframe.operators import attempts, decode
from helioframe.sources.landed import stream_registers
from fixtures import brokers, devices, reads
from test_package import SCHEMA, record, records, runs
from helioframe.operators.package import snapshot_entries

INVERTER = "inv_abb_pvs800"
SENSOR = "sensor_irradiation_akfen"


def poll(n, minutes, blocks=(1, 2, 3)):
    sizes = {1: 7, 2: 27, 3: 8}
    return [("A", n, k, 0, True, [n] * sizes[k], minutes) for k in blocks]


def drain(spark, frame, tmp_path, name):
    streaming.append_table(frame, f"{tmp_path}/{name}", f"{tmp_path}/{name}-log").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{tmp_path}/{name}")


def land(spark, tmp_path, *rows):
    reads(spark, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")


def test_assembly_waits_emits_once_and_drops_late_and_torn_polls(spark, tmp_path):
    ds = devices(spark, ("A", INVERTER, True))
    own = CATALOG.only(INVERTER)
    land(spark, tmp_path, *poll(1, 0), *poll(2, 1, (1, 2)), *poll(3, 5))
    found = lambda: streaming.stream_assemble(
        stream_registers(spark, f"{tmp_path}/landed", max_files=1), ds, catalog=own)
    assert drain(spark, found(), tmp_path, "t").count() == 0          # all still open
    # The rest of poll 3 repeats; poll 4 moves the watermark to minute 20.
    land(spark, tmp_path, *poll(3, 5, (2,)), *poll(4, 30))
    got = drain(spark, found(), tmp_path, "t")
    assert {r.poll_id for r in got.select("poll_id").distinct().collect()} == {1, 3}
    land(spark, tmp_path, *poll(5, 2), *poll(2, 1, (3,)), *poll(6, 60))  # 5 and the rest of 2 are late
    got = drain(spark, found(), tmp_path, "t")
    assert {r.poll_id for r in got.select("poll_id").distinct().collect()} == {1, 3, 4}
    batch = decode.decode_long(attempts.assemble(attempts.dispatch(
        reads(spark, *poll(1, 0), *poll(3, 5), *poll(4, 30)), ds, own), own), own)
    assert batch.exceptAll(got).isEmpty() and got.exceptAll(batch).isEmpty()


def test_stateless_decode_equals_batch(spark, tmp_path):
    ds = devices(spark, ("A", SENSOR, True), ("B", SENSOR, False), ("C", INVERTER, True))
    rows = [(d, p, 1, 0, True, [p] * 7) for d in "ABC" for p in range(5)] + [("A", 9, 1, 3, True, [1])]
    land(spark, tmp_path, *rows)
    got = drain(spark, streaming.stream_decode(
        stream_registers(spark, f"{tmp_path}/landed"), ds), tmp_path, "d")
    assert sorted((r.Device_Name, r.poll_id, r.value) for r in got.collect()) == [
        ("A", p, float(p)) for p in range(5)]


@pytest.mark.parametrize("max_files", [None, 1])
def test_replayed_snapshot_files_add_nothing_and_equal_records_stay(spark, tmp_path, max_files):
    # Minutes out of order, two equal reads in one of them, a torn file.
    entries = snapshot_entries(records(
        spark, (0, 1, 50, record("A", 1.5)), (0, 2, 50, record("A", 1.5)), (0, 3, 10, record("A", 2.5)),
        (0, 4, 30, record("A", 3.5))), runs(spark, 10, 30, 50, 55), "s")
    for place in ("one", "two"):
        sinks.write_snapshot_files(entries, f"{tmp_path}/files/{place}")
    with gzip.open(f"{tmp_path}/files/torn.json.gz", "wt") as f:
        f.write('[{"Device_Name":"T","v":')
    found = lambda: drain(spark, streaming.stream_snapshots(
        spark, f"{tmp_path}/files", SCHEMA, max_files=max_files), tmp_path, "s")
    got = found().collect()
    assert sorted(r.v for r in got if r.Device_Name) == [1.5, 1.5, 2.5, 3.5]
    assert [r._corrupt_record for r in got if r._corrupt_record] == ['[{"Device_Name":"T","v":']
    sinks.write_snapshot_files(entries, f"{tmp_path}/files/three")
    assert found().count() == 5


def test_messages_per_batch_and_broker(spark, tmp_path):
    land(spark, tmp_path, *[("A", p, 1, 0, True, [p]) for p in range(4)])
    own = CATALOG.only(SENSOR)
    polls = streaming.single_block_polls(attempts.dispatch(
        stream_registers(spark, f"{tmp_path}/landed"), devices(spark, ("A", SENSOR, True)), own), own)
    sent = []

    def publish(batch_id, broker, messages):
        if broker["topic"] == "bad":
            raise OSError("down")
        sent.extend((batch_id, m.topic, json.loads(m.payload)["Irradiation"]) for m in messages.collect())

    streaming.stream_messages(
        decode.records(polls, own), brokers(spark, (0, "bad", True), (1, "good", True)),
        publish, f"{tmp_path}/log").awaitTermination()
    assert sorted(sent) == [(0, "good/A", float(p)) for p in range(4)]
