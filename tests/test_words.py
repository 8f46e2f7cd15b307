import random
import struct

import pytest
from pyspark.sql import functions as F

from helioframe.catalog import CATALOG, Field
from helioframe.functions import words

HAND = [  # word, u16, s16, bits 0 and 15
    (0, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 1.0, 0.0), (32767, 32767.0, 32767.0, 1.0, 0.0),
    (32768, 32768.0, -32768.0, 0.0, 1.0), (65535, 65535.0, -1.0, 1.0, 1.0),
    (40000, 40000.0, -25536.0, 0.0, 1.0), (70000, 70000.0, 0.0, 0.0, 0.0),
    (None, None, 0.0, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<int>")


def test_hand_computed_words(spark):
    rows = (frame(spark, [[h[0]] for h in HAND])
            .select("i", words.u16("r", 0), words.s16("r", 0), words.bit("r", 0, 0),
                    words.bit("r", 0, 15)).orderBy("i").collect())
    assert [tuple(r)[1:] for r in rows] == [h[1:] for h in HAND]


def test_missing_words_are_null(spark):
    got = frame(spark, [[1], []]).select(
        words.u16("r", 1), words.s16("r", 1), words.u32("r", 0, 1), words.s32("r", 0, 1),
        words.bit("r", 1, 0)).collect()
    assert all(v is None for row in got for v in row)
    null = spark.sql("SELECT CAST(NULL AS ARRAY<INT>) AS r").select(words.s16("r", 0)).first()
    assert null[0] is None


def test_bad_word_in_a_pair_is_null(spark):
    got = frame(spark, [[70000, 1], [1, None], [-1, 0]]).select(
        words.u32("r", 0, 1), words.s32("r", 0, 1)).collect()
    assert all(v is None for row in got for v in row)


def test_random_words_agree_with_struct(spark):
    rnd = random.Random(7)
    rows = [[rnd.randrange(65536), rnd.randrange(65536)] for _ in range(500)]
    got = frame(spark, rows).select(
        "i", words.s16("r", 0), words.u32("r", 0, 1), words.s32("r", 0, 1), words.u32("r", 1, 0),
        F.expr(" + ".join(f"{words.bit_sql('r', 0, n)} * {1 << n}" for n in range(16)))
    ).orderBy("i").collect()
    for (hi, lo), row in zip(rows, got):
        packed = struct.pack(">HH", hi, lo)
        assert row[1] == struct.unpack("<h", struct.pack("<H", hi))[0]
        assert row[2] == struct.unpack(">L", packed)[0]
        assert row[3] == struct.unpack(">l", packed)[0]
        assert row[4] == struct.unpack(">L", struct.pack(">HH", lo, hi))[0]
        assert row[5] == hi


@pytest.mark.parametrize("divisor", [1, 10, 100, 1000])
def test_scale_divides(spark, divisor):
    got = spark.range(2000).select("id", words.scale(F.col("id").cast("double"), divisor)).collect()
    assert all(v == float(i) / divisor for i, v in got)


def test_rules_in_numbers_agree_with_field_expressions(spark):
    """The one formula for all kinds gives what the expression per field gives."""
    rnd = random.Random(3)
    for driver in CATALOG:
        size = max(b.count for b in driver.blocks)
        data = frame(spark, [[rnd.choice([0, 1, 32767, 32768, 65535, rnd.randrange(65536)])
                              for _ in range(size)] for _ in range(5)])
        wide = data.selectExpr("i", *[f"{words.field_sql('r', f)} AS `{f.name}`"
                                      for f in driver.fields]).collect()
        long = (data.join(CATALOG.only(driver.name).fields_frame(spark))
                .selectExpr("i", "field", f"{words.rule_sql('r')} AS value").collect())
        assert {(r.i, r.field): r.value for r in long} == {
            (row.i, f.name): row[f.name] for row in wide for f in driver.fields}


def test_rule_keeps_lenient_and_oversized_words(spark):
    catalog = CATALOG.register_driver("d", "1", CATALOG["sensor_lufft_ws600"].blocks, [
        Field("S", "s16", 1, 0), Field("U", "u16", 1, 0), Field("B", "bit", 1, 0, 4)]).only("d")
    rows = (frame(spark, [[70000], [None]]).join(catalog.fields_frame(spark))
            .selectExpr("i", "field", f"{words.rule_sql('r')} AS value").collect())
    assert {(r.i, r.field): r.value for r in rows} == {
        (0, "S"): 0.0, (0, "U"): 70000.0, (0, "B"): 1.0,
        (1, "S"): 0.0, (1, "U"): None, (1, "B"): None}
