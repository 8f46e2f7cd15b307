import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helioframe import sinks
from helioframe.catalog import CATALOG, Block, Field
from helioframe.operators import attempts, decode
from helioframe.plans import testbed as tb
from fixtures import devices, reads


@pytest.mark.parametrize("driver", ["ekk_socomec_dirisa10", "inv_abb_pvs800"])
def test_wide_long_pivot_and_json_agree(spark, sf, driver):
    own = CATALOG.only(driver)
    polls = attempts.assemble(attempts.dispatch(
        tb.reads_of(spark, sf, driver), tb.devices_of(spark, sf, driver)))
    polls = polls.where("poll_id < 60").cache()
    wide = {r.poll_id: r.asDict() for r in decode.decode_wide(polls, own[driver]).collect()}
    assert wide
    pivoted = decode.pivot_wide(decode.decode_long(polls, own), own[driver])
    assert {r.poll_id: r.asDict() for r in pivoted.collect()} == wide
    for r in decode.records(polls, own).collect():
        record = json.loads(r.record)
        assert list(record)[:3] == ["Device_Name", "Measurement_Suffix", "Date"]
        assert list(record)[3:] == [f.name for f in own[driver].fields]
        assert {"poll_id": r.poll_id, **record} == wide[r.poll_id]
    # As part of a mixed fleet the same text comes from joined rules.
    both = decode.records(polls, CATALOG)
    assert both.exceptAll(decode.records(polls, own)).isEmpty() and both.count() == len(wide)


def test_clamp_is_by_driver(spark):
    drivers = ["sensor_irradiation_akfen", "sensor_kippzonen_smp11", "sensor_sevensolar_3SISTMB",
               "sensor_lufft_ws600"]
    ds = devices(spark, *[(f"D{i}", d, True) for i, d in enumerate(drivers)])
    rs = reads(spark, *[(f"D{i}", 1, 1, 0, True, [65535] * 50) for i in range(4)])
    got = {(r.driver, r.field): r.value for r in decode.decode_fleet(rs, ds).collect()}
    assert got[drivers[0], "Irradiation"] == 0.0
    assert got[drivers[1], "Pyranometer_Irradiation"] == 0.0
    assert got[drivers[2], "Irradiation"] == 0.0
    assert got[drivers[2], "Ref_Cell_Temp"] == -0.1
    assert got[drivers[3], "GlobalRadiation"] == -0.1


def test_tags_follow_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    rs = reads(spark, ("A", 1, 1, 0, True, [5]))
    ds = devices(spark, ("A", "sensor_irradiation_akfen", True))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        (r,) = decode.decode("sensor_irradiation_akfen", rs, ds).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (r.Device_Name, r.Measurement_Suffix, r.Date, r.Irradiation) == (
        "A", "SPP_1", "2024-03-01T12:00:00Z", 5.0)


def test_registered_driver_with_its_own_block_number(spark):
    more = CATALOG.register_driver(
        "mine", "1.0", [Block(7, "input", 0, 2, accept="get(registers, 0) > 10")],
        [Field("A", "u32", 7, 1, 0, 100, 10), Field("B", "bit", 7, 0, 1)], max_attempts=2)
    rs = reads(spark, ("A", 1, 7, 0, True, [3, 0]), ("A", 1, 7, 1, True, [400, 1]),
               ("B", 1, 1, 0, True, [9]))
    ds = devices(spark, ("A", "mine", True), ("B", "sensor_irradiation_akfen", True))
    got = {(r.Device_Name, r.field): r.value for r in decode.decode_fleet(rs, ds, more).collect()}
    assert got == {("A", "A"): (65536 + 400) / 100 * 10, ("A", "B"): 0.0, ("B", "Irradiation"): 9.0}


def test_decode_with_a_pandas_function(spark):
    rs = reads(spark, *[("A", p, 1, 0, True, [p]) for p in range(20)])
    polls = attempts.assemble(attempts.dispatch(
        rs, devices(spark, ("A", "sensor_irradiation_akfen", True))))

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"poll_id": frame["poll_id"],
                             "v": [float(r[0]) for r in frame["registers_1"]]})
    got = decode.decode_with(polls, first, "poll_id bigint, v double")
    assert {(r.poll_id, r.v) for r in got.collect()} == {(p, float(p)) for p in range(20)}


def test_decode_stays_in_the_jvm_and_shuffles_once(spark, sf):
    plan = (decode.decode_fleet(tb.reads(spark, sf), tb.devices(spark, sf))
            ._jdf.queryExecution().executedPlan().toString())
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_wide_tables_from_written_polls_read_one_partition(spark, tmp_path):
    drivers = ["sensor_irradiation_akfen", "sensor_kippzonen_smp11"]
    polls = attempts.assemble(attempts.dispatch(
        reads(spark, ("A", 1, 1, 0, True, [5]), ("B", 2, 1, 0, True, [6])),
        devices(spark, ("A", drivers[0], True), ("B", drivers[1], True))))
    sinks.write_polls(polls, f"{tmp_path}/polls")
    again = spark.read.parquet(f"{tmp_path}/polls")
    for driver, value in zip(drivers, (5.0, 6.0)):
        wide = decode.decode_wide(again, CATALOG[driver])
        assert [r[-1] for r in wide.collect()] == [value]
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "driver#" in plan.split("PartitionFilters")[1].split("]")[0]
        assert "Exchange" not in plan


def test_scan_reads_only_needed_columns(spark, sf, tmp_path):
    from helioframe.sources.landed import read_registers
    tb.reads_of(spark, sf, "inv_abb_pvs800").write.parquet(f"{tmp_path}/r")
    polls = decode.decode("inv_abb_pvs800", read_registers(spark, f"{tmp_path}/r"),
                          tb.devices_of(spark, sf, "inv_abb_pvs800"))
    plan = polls._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ok,true)" in plan
    assert polls.where(F.col("poll_id") == 5).count() <= 1


def test_a_pivot_moves_a_row_a_poll(spark):
    own = CATALOG.only("sensor_lufft_ws600")
    driver = own["sensor_lufft_ws600"]
    long = spark.createDataFrame(
        [(p, "D", "S", "T", driver.name, f.name, float(p) if k % 3 else None) for p in range(40) for k, f in enumerate(driver.fields)],
        "poll_id long, Device_Name string, Measurement_Suffix string, Date string, driver string, field string, value double").coalesce(2)
    found = decode.pivot_wide(long, driver)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(poll_id") == 1, plan
    for r in found.collect():
        assert [r[f.name] for f in driver.fields] == [float(r.poll_id) if k % 3 else None for k, f in enumerate(driver.fields)]
