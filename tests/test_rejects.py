"""Rejects, replays, outboxes and registries that change, on streams and in one run."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helioframe import sinks, streaming
from helioframe.catalog import CATALOG
from helioframe.operators import attempts, decode, messages, registry
from helioframe.plans.run import Collection
from helioframe.sources.landed import stream_registers
from fixtures import brokers, devices, reads
from test_streaming import INVERTER, SENSOR, drain, land, poll

METER = "ekk_schneider_ion_7650"


def closed(spark, tmp_path, ds, own, files=1):
    return drain(spark, streaming.stream_polls(
        stream_registers(spark, f"{tmp_path}/landed", max_files=files), ds, catalog=own), tmp_path, "polls")


def test_torn_and_unusable_polls_of_a_stream_are_rejects(spark, tmp_path):
    ds, own = devices(spark, ("A", INVERTER, True)), CATALOG.only(INVERTER)
    failed = [("A", 3, 2, a, False, None, 2) for a in range(4)]
    short = [("A", 4, 3, 0, True, [1], 2)]
    land(spark, tmp_path, *poll(1, 0), *poll(2, 1, (1, 3)), *poll(3, 2, (1, 3)), *failed, *poll(4, 2, (1, 2)), *short)
    assert closed(spark, tmp_path, ds, own).count() == 0
    land(spark, tmp_path, *poll(9, 60))
    got = closed(spark, tmp_path, ds, own)
    assert {(r.poll_id, r.outcome, r.n_reads) for r in got.collect()} == {
        (1, "whole", 3), (2, "torn", 2), (3, "torn", 6), (4, "unusable", 3)}
    told = {(r.poll_id, r.outcome, r.block, r.attempts) for r in attempts.rejects(got).collect()}
    assert told == {(2, "torn", 2, 0), (3, "torn", 2, 3), (4, "unusable", 3, 1)}
    # The same as in a batch over the same reads, and as the two reject functions say.
    dispatched = attempts.dispatch(spark.read.parquet(f"{tmp_path}/landed").where("poll_id < 9"), ds, own)
    assert {(r.poll_id, r.block, r.attempts) for r in attempts.read_failures(dispatched, own).collect()} == {(2, 2, 0), (3, 2, 3)}
    batch = attempts.graded(dispatched, own)
    assert batch.exceptAll(got).isEmpty() and got.exceptAll(batch).isEmpty()
    long = decode.decode_long(got, own)
    assert {r.poll_id for r in long.select("poll_id").distinct().collect()} == {1}


def test_reads_that_come_late_are_found(spark, tmp_path):
    ds, own = devices(spark, ("A", INVERTER, True)), CATALOG.only(INVERTER)
    for part in ([*poll(1, 0), *poll(2, 1, (1, 2)), *poll(3, 40)], [*poll(4, 41)],
                 [*poll(2, 1, (3,)), *poll(5, 2), *poll(6, 42)]):
        land(spark, tmp_path, *part)
        got = closed(spark, tmp_path, ds, own)
    late = attempts.late_reads(spark.read.parquet(f"{tmp_path}/landed"), got)
    # Of poll 2 one read of three came late; poll 5 was never seen, but the youngest closed poll is older.
    assert {(r.poll_id, r.n_late) for r in late.collect()} == {(2, 1)}
    land(spark, tmp_path, *poll(7, 90))
    land(spark, tmp_path, *poll(8, 91))
    for _ in range(2):
        got = closed(spark, tmp_path, ds, own)
    late = attempts.late_reads(spark.read.parquet(f"{tmp_path}/landed"), got)
    assert {(r.poll_id, r.n_late) for r in late.collect()} == {(2, 1), (5, 3)}


def test_first_attempts_come_once_and_as_soon_as_they_are_certain(spark, tmp_path):
    ds, own = devices(spark, ("A", SENSOR, True)), CATALOG.only(SENSOR)

    def run():
        stream = streaming.stream_decode(stream_registers(spark, f"{tmp_path}/landed", max_files=1), ds, own, "10 minutes")
        return sorted((r.poll_id, r.value) for r in drain(spark, stream, tmp_path, "d").collect())

    # Poll 1 is certain at once; of poll 2 the first attempt is still unknown; poll 3 has failed so far.
    land(spark, tmp_path, ("A", 1, 1, 0, True, [10], 0), ("A", 1, 1, 1, True, [11], 0), ("A", 2, 1, 1, True, [21], 1),
         ("A", 3, 1, 0, False, None, 1))
    assert run() == [(1, 10.0)]
    land(spark, tmp_path, ("A", 1, 1, 0, True, [12], 0), ("A", 3, 1, 1, True, [31], 1))
    assert run() == [(1, 10.0), (3, 31.0)]
    # Poll 2's first attempt never comes: the watermark decides. Attempts beyond the allowed count for nothing.
    land(spark, tmp_path, ("A", 4, 1, 0, True, [40], 60), ("A", 5, 1, 7, True, [50], 60))
    assert run() == [(1, 10.0), (2, 21.0), (3, 31.0), (4, 40.0)]
    land(spark, tmp_path, ("A", 2, 1, 0, True, [20], 1), ("A", 6, 1, 0, True, [60], 61))
    assert run() == [(1, 10.0), (2, 21.0), (3, 31.0), (4, 40.0), (6, 60.0)]


def test_a_refused_read_waits_for_an_accepted_one(spark, tmp_path):
    """The meter takes the first read with a phase voltage, else the latest."""
    ds, own = devices(spark, ("A", METER, True)), CATALOG.only(METER)
    dead, good = [0] * 116, [7] * 116
    land(spark, tmp_path, ("A", 1, 1, 0, True, dead, 0), ("A", 1, 1, 1, True, good, 0), ("A", 2, 1, 0, True, dead, 0),
         ("A", 2, 1, 1, True, dead, 0))
    stream = lambda: streaming.first_attempts(attempts.dispatch(
        stream_registers(spark, f"{tmp_path}/landed", max_files=1), ds, own), catalog=own)
    got = lambda: sorted((r.poll_id, r.attempt) for r in drain(spark, stream(), tmp_path, "f").collect())
    assert got() == [(1, 1)]
    land(spark, tmp_path, ("A", 3, 1, 0, True, good, 60))
    assert got() == [(1, 1), (2, 1), (3, 0)]


def test_first_attempts_of_one_bucket(spark, tmp_path, monkeypatch):
    """Polls that share a state are decided alone; one call serves them all."""
    monkeypatch.setattr(streaming, "BUCKETS", 1)
    ds, own = devices(spark, ("A", SENSOR, True), ("B", SENSOR, True)), CATALOG.only(SENSOR)
    stream = lambda: streaming.first_attempts(attempts.dispatch(
        stream_registers(spark, f"{tmp_path}/landed", max_files=1), ds, own), catalog=own)
    got = lambda: sorted((r.device_name, r.poll_id, r.attempt, r.registers, r.poll_ts is None)
                         for r in drain(spark, stream(), tmp_path, "f").collect())
    big = 2 ** 53 + 1
    rows = reads(spark, ("A", big, 1, 0, True, [1, None], 0), ("B", big, 1, 0, True, [2], 0), ("A", 2, 1, 1, True, [3, None], 0),
                 ("B", 2, 1, 1, True, None, 5), ("A", 3, 1, 2, True, [4], 0), ("B", 3, 1, 0, False, None, 0))
    bare = reads(spark, ("A", 9, 1, 0, True, [9])).withColumn("poll_ts", F.lit(None).cast("timestamp"))
    rows.unionByName(bare).coalesce(1).write.parquet(f"{tmp_path}/landed")
    now = [("A", 9, 0, [9], True), ("A", big, 0, [1, None], False), ("B", big, 0, [2], False)]
    assert got() == now
    land(spark, tmp_path, ("A", 3, 1, 1, True, [5], 0), ("A", big, 1, 0, True, [7], 0))
    assert got() == now
    land(spark, tmp_path, ("A", 3, 1, 0, False, None, 0), ("B", 4, 1, 0, True, [8], 60))
    assert got() == sorted([*now, ("A", 2, 1, [3, None], False), ("A", 3, 1, [5], False), ("B", 2, 1, None, False),
                            ("B", 4, 0, [8], False)], key=lambda r: r[:3])


def test_a_repeated_run_replaces_its_part_of_the_table(spark, tmp_path):
    rows = lambda *m: spark.createDataFrame([(i, x, v) for i, (x, v) in enumerate(m)], "poll_id long, Measurement_Suffix string, v double"
                                            ).withColumn("poll_ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    sinks.write_measurements(rows(("a", 1.0), ("b", 2.0)), f"{tmp_path}/t", run="one")
    sinks.write_measurements(rows(("a", 5.0)), f"{tmp_path}/t", run="two")
    sinks.write_measurements(rows(("a", 3.0)), f"{tmp_path}/t", run="one")
    got = {(r.run, r.Measurement_Suffix, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    assert got == {("one", "a", 3.0), ("two", "a", 5.0)}
    with pytest.raises(ValueError):
        sinks.write_measurements(rows(("a", 1.0)), f"{tmp_path}/t", run="../x")


def test_an_outbox_keeps_what_a_broker_refuses(spark, tmp_path):
    records = lambda n: spark.createDataFrame([("D", f"r{n}")], "Device_Name string, record string")
    box, listed = messages.Outbox(spark, f"{tmp_path}/box"), brokers(spark, (0, "up", True), (1, "down", True), (2, "off", False))
    sent, down = [], [True]

    def publish(batch, broker, found):
        if broker["topic"] == "down" and down[0]:
            raise OSError("refused")
        sent.extend((broker["topic"], batch, m.payload) for m in found.collect())

    for n in range(3):
        left = box.deliver(n, records(n), listed, publish)
    assert sorted(left.values()) == [0, 3]
    assert sent == [("up", n, f"r{n}") for n in range(3)]
    down[0] = False
    # A batch that is sent again replaces what it left; older ones go first.
    assert set(box.deliver(2, records(2), listed, publish).values()) == {0}
    assert [x for x in sent if x[0] == "down"] == [("down", n, f"r{n}") for n in range(3)]
    assert set(box.deliver(9, None, listed, publish).values()) == {0} and len(sent) == 7


def test_a_device_switched_off_between_batches_gives_nothing_more(spark, tmp_path):
    own, now = CATALOG.only(SENSOR), [devices(spark, ("A", SENSOR, True), ("B", SENSOR, True))]
    got = []

    def write(dispatched, batch_id):
        got.extend((r.device_name, r.poll_id) for r in dispatched.collect())

    def run():
        streaming.stream_runs(stream_registers(spark, f"{tmp_path}/landed"), lambda: now[0], write, f"{tmp_path}/log", own).awaitTermination()

    land(spark, tmp_path, ("A", 1, 1, 0, True, [1]), ("B", 1, 1, 0, True, [1]))
    run()
    now[0] = devices(spark, ("A", SENSOR, True), ("B", SENSOR, False), ("C", SENSOR, True))
    land(spark, tmp_path, ("A", 2, 1, 0, True, [1]), ("B", 2, 1, 0, True, [1]), ("C", 2, 1, 0, True, [1]))
    run()
    assert sorted(got) == [("A", 1), ("A", 2), ("B", 1), ("C", 2)]


def test_versions_of_a_registry(spark):
    one = devices(spark, ("A", SENSOR, True), ("B", SENSOR, True)).withColumn("read_ts", F.timestamp_seconds(F.lit(0)))
    two = devices(spark, ("A", SENSOR, True)).withColumn("read_ts", F.timestamp_seconds(F.lit(600)))
    found = registry.versioned(one.unionByName(two))
    assert {(r.name, r.valid_from.minute, r.valid_to and r.valid_to.minute) for r in found.collect()} == {
        ("A", 0, 10), ("B", 0, 10), ("A", 10, None)}


def test_a_collection_reads_once_and_counts(spark, tmp_path):
    ds, own = devices(spark, ("A", INVERTER, True)), CATALOG.only(INVERTER)
    rows = reads(spark, *poll(1, 0), *poll(2, 1, (1, 2)), *poll(3, 2, (1, 2)), ("A", 3, 3, 0, True, [1], 2))
    one = Collection(rows, ds, f"{tmp_path}/polls", own)
    assert one.counts == {"whole": 1, "torn": 1, "unusable": 1}
    batch = decode.records(attempts.assemble(attempts.dispatch(rows, ds, own), own), own)
    assert one.records().collect() == batch.select(*one.records().columns).collect()
    assert {(r.poll_id, r.outcome, r.block) for r in one.rejects().collect()} == {(2, "torn", 3), (3, "unusable", 3)}
    plan = one.records()._jdf.queryExecution().toString()
    assert "Aggregate" not in plan  # what follows reads the written table
    again = Collection(rows, ds, f"{tmp_path}/polls", own)
    assert again.table.count() == 3


def test_a_collection_sends_what_it_has_written_without_another_copy(spark, tmp_path):
    ds, own = devices(spark, ("A", INVERTER, True)), CATALOG.only(INVERTER)
    one = Collection(reads(spark, *poll(1, 0), *poll(2, 1)), ds, f"{tmp_path}/polls", own)
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, sent = held(), []
    one.send(None, "site", ("messages",), brokers=brokers(spark, (0, "x", True)), publish=lambda broker, batch: sent.append(
        (batch.count(), held())))
    assert sent == [(2, before)]
    (table,) = tmp_path.glob("polls/outcome=whole/*.parquet")
    written = pq.ParquetFile(table).metadata.row_group(0)
    assert {written.column(k).compression for k in range(written.num_columns)} == {"ZSTD"}
