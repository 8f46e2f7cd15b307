import pytest
from pyspark.sql import functions as F

from helioframe.catalog import CATALOG
from helioframe.operators import attempts, decode, registry
from helioframe.operators import lookup
from fixtures import devices, reads

CELL = "sensor_sevensolar_3SISTMB"
METER = "ekk_schneider_ion_7650"
INVERTER = "inv_abb_pvs800"


def block(first, size=9):
    return [first] + [0] * (size - 1)


def meter(volts, mark, size=116):
    r = [mark] + [0] * (size - 1)
    r[17] = volts
    return r


def chosen(spark, driver, rows):
    found = attempts.choose_attempt(attempts.dispatch(
        reads(spark, *rows), devices(spark, ("A", driver, True))))
    return {(r.poll_id, r.block): (r.attempt, r.registers[0]) for r in found.collect()}


def test_first_good_attempt_within_the_allowed_tries(spark):
    got = chosen(spark, CELL, [
        ("A", 1, 1, 0, False, None), ("A", 1, 1, 1, True, block(7)), ("A", 1, 1, 2, True, block(8)),
        ("A", 2, 1, 2, True, block(9)),
        ("A", 3, 1, 3, True, block(10))])   # a fourth try is beyond the three allowed
    assert got == {(1, 1): (1, 7), (2, 1): (2, 9)}


def test_large_inverter_may_try_ten_times(spark):
    got = chosen(spark, "inv_abb_pvs980", [("A", 1, 1, 9, True, block(7)),
                                           ("A", 2, 1, 10, True, block(7))])
    assert got == {(1, 1): (9, 7)}


def test_accepted_read_or_else_the_latest(spark):
    got = chosen(spark, METER, [
        ("A", 1, 1, 0, True, meter(0, 10)), ("A", 1, 1, 1, True, meter(5, 11)),
        ("A", 1, 1, 2, True, meter(5, 12)),
        ("A", 2, 1, 0, True, meter(0, 20)), ("A", 2, 1, 4, True, meter(0, 24)),
        ("A", 2, 1, 5, False, None),
        ("A", 3, 1, 0, True, meter(0, 30)[:3]), ("A", 3, 1, 1, True, meter(1, 31)),
        ("A", 4, 2, 0, True, block(40, 6)), ("A", 4, 2, 1, True, block(41, 6))])
    assert got == {(1, 1): (1, 11), (2, 1): (4, 24), (3, 1): (1, 31), (4, 2): (0, 40)}


def test_zero_voltage_record_is_still_emitted(spark):
    rows = [("A", 1, 1, 0, True, meter(0, 10)), ("A", 1, 1, 1, True, meter(0, 20)),
            ("A", 1, 2, 0, True, block(3, 6))]
    got = decode.decode(METER, reads(spark, *rows), devices(spark, ("A", METER, True))).collect()
    assert [(r.Ia, r.I1_THD_max) for r in got] == [(2.0, 0.03)]


def full_poll(poll, **replace):
    blocks = {1: block(1, 7), 2: block(2, 27), 3: block(3, 8)} | {
        int(k[1]): v for k, v in replace.items()}
    return [("A", poll, k, 0, v is not None, v) for k, v in blocks.items()]


def test_a_poll_is_whole_or_absent(spark):
    rows = full_poll(1) + full_poll(2, b3=None) + full_poll(3)[:2]
    ds = attempts.dispatch(reads(spark, *rows), devices(spark, ("A", INVERTER, True)))
    assert [r.poll_id for r in attempts.assemble(ds).collect()] == [1]
    assert [r.poll_id for r in attempts.complete_polls(ds).collect()] == [1]
    assert {(r.poll_id, r.block) for r in attempts.drop_failed(ds).collect()} == {
        (1, 1), (1, 2), (1, 3)}
    failures = attempts.read_failures(ds).collect()
    assert {(r.poll_id, r.block, r.attempts) for r in failures} == {(2, 3, 1), (3, 3, 0)}


@pytest.mark.parametrize("bad, kept", [
    (block(1, 27)[:26], False),                    # missing word of a pair
    ([0] * 19 + [70000] + [0] * 7, False),         # oversized word of a pair
    ([0] * 19 + [None] + [0] * 7, False),          # null word of a pair
    ([0] * 4 + [None] + [0] * 22, False),          # null unsigned word
    ([0] * 4 + [70000] + [0] * 22, True),          # oversized unsigned word passes
    ([0] * 10 + [None] + [0] * 16, True),          # null signed word is 0
    ([0] * 10 + [70000] + [0] * 16, True),         # oversized signed word is 0
    ([None] + [0] * 26, True),                     # a word no rule uses
    ([0] * 16 + [99999] + [0] * 10, True),
])
def test_error_policy_by_kind(spark, bad, kept):
    rows = full_poll(1, b2=bad) + full_poll(2)
    args = reads(spark, *rows), devices(spark, ("A", INVERTER, True))
    wide = {r.poll_id: r for r in decode.decode(INVERTER, *args).collect()}
    assert set(wide) == ({1, 2} if kept else {2})
    long = decode.decode_fleet(*args)
    assert {r.poll_id for r in long.collect()} == set(wide)
    rejects = attempts.unusable_polls(attempts.dispatch(*args)).collect()
    assert [(r.poll_id, r.blocks) for r in rejects] == ([] if kept else [(1, [2])])
    assert long.where("value IS NULL").count() == 0
    assert all(v is not None for r in wide.values() for v in r)
    if kept:
        assert wide[1].Inverter_Ambient_Temp == 0.0
        assert wide[1].Grid_Current == bad[4] / 10


def test_null_status_word_and_null_array_drop_the_record(spark):
    rows = (full_poll(1, b3=[0, None] + [0] * 6) + full_poll(2)
            + [("A", 3, 1, 0, True, None), *full_poll(3)[1:]])
    got = decode.decode(INVERTER, reads(spark, *rows), devices(spark, ("A", INVERTER, True)))
    assert [r.poll_id for r in got.collect()] == [2]


def test_dispatch_drops_disabled_unknown_and_stray(spark):
    ds = devices(spark, ("A", CELL, True), ("B", CELL, False), ("C", "nobody", True),
                 ("D", CELL, None))
    rows = [(d, 1, 1, 0, True, block(1)) for d in "ABCDE"] + [("A", 1, 2, 0, True, block(1))]
    got = attempts.dispatch(reads(spark, *rows), ds).collect()
    assert [(r.device_name, r.block) for r in got] == [("A", 1)]
    assert [r.name for r in registry.unknown_drivers(ds).collect()] == ["C"]
    assert [r.name for r in registry.unusable_entries(ds).collect()] == ["D"]


def test_same_name_in_two_configurations(spark):
    ds = devices(spark, ("A", CELL, True, "north", 0), ("A", CELL, True, "south", 4))
    rs = reads(spark, ("A", 1, 1, 0, True, block(11)), ("A", 2, 1, 0, True, block(12)))
    rs = rs.withColumns({"config": F.expr("IF(poll_id = 1, 'north', 'south')"),
                         "position": F.expr("IF(poll_id = 1, 0, 4)")})
    got = attempts.assemble(attempts.dispatch(rs, ds, on=("device_name", "config", "position")))
    assert {(r.poll_id, r.config, r.registers_1[0]) for r in got.collect()} == {
        (1, "north", 11), (2, "south", 12)}


def test_large_registry_joins_salted_with_the_same_result(spark, sf, monkeypatch):
    from helioframe.plans import testbed as tb
    small = attempts.dispatch(tb.reads(spark, sf), tb.devices(spark, sf))
    monkeypatch.setattr(lookup, "is_small", lambda df, rows: False)
    large = attempts.dispatch(tb.reads(spark, sf), tb.devices(spark, sf))
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()
    columns = sorted(small.columns)
    assert small.count() == large.count()
    assert small.select(columns).exceptAll(large.select(columns)).isEmpty()


def test_is_small_counts_no_further_than_needed(spark):
    assert lookup.is_small(spark.range(10), 10)
    assert not lookup.is_small(spark.range(11), 10)


def test_hot_device_is_spread_by_poll(spark):
    """The one shuffle is keyed by poll first, so a single device fills all partitions."""
    rows = reads(spark, *[("A", p, 1, 0, True, block(p)) for p in range(200)])
    polls = attempts.assemble(attempts.dispatch(rows, devices(spark, ("A", CELL, True))))
    plan = polls._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "hashpartitioning(poll_id" in plan
    assert CATALOG[CELL].block_numbers() == [1] and polls.count() == 200


def test_attempt_stats(spark):
    rows = [("A", 1, 1, 0, False, None), ("A", 1, 1, 1, True, block(1)), ("A", 2, 1, 0, True, block(1))]
    (r,) = attempts.attempt_stats(reads(spark, *rows)).collect()
    assert (r.attempts, r.failed, r.last_attempt) == (3, 1, 1)


def test_polls_without_a_stamp_are_kept_like_others(spark):
    rows = full_poll(1) + full_poll(2, b3=None)
    ds = (attempts.dispatch(reads(spark, *rows), devices(spark, ("A", INVERTER, True)))
          .withColumn("poll_ts", F.lit(None).cast("timestamp")))
    assert {r.poll_id for r in attempts.complete_polls(ds).collect()} == {1}
    assert {(r.poll_id, r.block) for r in attempts.drop_failed(ds).collect()} == {(1, 1), (1, 2), (1, 3)}


def test_blocks_by_address(spark):
    """Parts, overlaps, gaps, words around, spans of two blocks and failed tries."""
    own, ds = CATALOG.only("inv_abb_pvs980"), devices(spark, ("A", "inv_abb_pvs980", True), ("B", "inv_abb_pvs980", False))
    rows = [  # block 3 is 13 words from holding 42599, block 1 is 7 from 42496
        (1, "holding", 42599, 0, True, list(range(6))), (1, "holding", 42605, 0, True, list(range(6, 13))),
        (2, "holding", 42605, 0, True, list(range(6, 13))), (2, "holding", 42599, 0, True, [*range(6), 99, 99]),
        (3, "holding", 42599, 0, True, list(range(5))), (3, "holding", 42605, 0, True, list(range(6, 13))),
        (4, "holding", 42597, 0, True, [-1, -1, *range(13), -1]), (5, "input", 42599, 0, True, list(range(13))),
        (6, "holding", 42599, 0, False, None), (6, "holding", 42599, 1, True, list(range(13))),
        (7, "holding", 42496, 0, True, list(range(42612 - 42496)))]
    spans = spark.createDataFrame([("A", p, k, s, a, ok, w) for p, k, s, a, ok, w in rows] + [("B", 1, "holding", 42599, 0, True, [0] * 13)],
                                  "device_name string, poll_id long, kind string, start int, attempt int, ok boolean, registers array<int>"
                                  ).withColumn("poll_ts", F.timestamp_seconds(F.lit(0)))
    found = attempts.address_blocks(spans, ds, own)
    got = {(r.poll_id, r.block, r.attempt): r.registers for r in found.collect()}
    assert got[1, 3, 0] == got[4, 3, 0] == got[6, 3, 1] == list(range(13))
    assert got[2, 3, 0] == [*range(6), 99, 99, *range(8, 13)]  # where parts overlap, the one of less address
    assert got[3, 3, 0] is None and got[6, 3, 0] is None and (5, 3, 0) not in got
    assert got[7, 1, 0] == list(range(7)) and got[7, 3, 0] == list(range(103, 116)) and got[7, 2, 0] == list(range(49, 82))
    assert {r.poll_id for r in attempts.choose_attempt(found, own).where("block = 3").collect()} == {1, 2, 4, 6, 7}


def test_parts_of_a_poll_come_together_in_one_shuffle(spark):
    own = CATALOG.only("inv_abb_pvs980")
    ds = devices(spark, ("A", "inv_abb_pvs980", True))
    # Words beyond two bytes and null ones stay as they are; failed tries and those beyond the allowed number may go.
    odd = [70000, None, -5, 65535, 0, 1, 2]
    rows = [("A", 1, "holding", 42496, 0, False, None), ("A", 1, "holding", 42496, 1, True, odd),
            ("A", 1, "holding", 42496, 77, True, [3] * 7), ("A", 2, "holding", 42500, 0, True, [5, 6, 65535]),
            ("A", 2, "holding", 42496, 0, True, [1, 2, 3, 4])]
    spans = spark.createDataFrame(rows,
                                  "device_name string, poll_id long, kind string, start int, attempt int, ok boolean, registers array<int>"
                                  ).withColumn("poll_ts", F.timestamp_seconds(F.col("poll_id")))
    for usable, left in ((False, {(1, 0): None, (1, 77): [3] * 7}), (True, {})):
        found = attempts.address_blocks(spans, ds, own, usable=usable)
        assert {(r.poll_id, r.attempt): r.registers for r in found.collect()} == {
            (1, 1): odd, (2, 0): [1, 2, 3, 4, 5, 6, 65535], **left}
        plan = attempts.assemble(found, own)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(poll_id") == 1, plan
