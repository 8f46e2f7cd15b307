import pytest

from helioframe.catalog import CATALOG, Block, Catalog, Field

COUNTS = {
    "dcb_kernel_st0hs2425": (29, 0), "dcb_kernel_st0hs2425_single": (1, 0),
    "ekk_schneider_ion_7650": (21, 0), "ekk_socomec_dirisa10": (29, 0),
    "inv_abb_pvs800": (24, 54), "inv_abb_pvs980": (44, 147),
    "sensor_irradiation_akfen": (1, 0), "sensor_kippzonen_smp11": (1, 0),
    "sensor_lufft_ws600": (8, 0), "sensor_sevensolar_3SISTMB": (3, 0),
}


def test_field_counts():
    found = {d.name: (sum(f.kind != "bit" for f in d.fields), sum(f.kind == "bit" for f in d.fields))
             for d in CATALOG}
    assert found == COUNTS
    assert sum(map(sum, found.values())) == 362


def test_tries_and_blocks():
    assert {d.name for d in CATALOG if d.max_attempts == 10} == {
        "inv_abb_pvs980", "ekk_schneider_ion_7650"}
    assert CATALOG["inv_abb_pvs980"].block_numbers() == [0, 1, 2, 3]
    assert CATALOG["inv_abb_pvs800"].block_numbers() == [1, 2, 3]
    assert [b.block for d in CATALOG for b in d.blocks if b.accept] == [1]


def test_selected_rules():
    def rule(driver, name):
        return next(f for f in CATALOG[driver].fields if f.name == name)
    assert rule("dcb_kernel_st0hs2425", "I_DC_24") == Field("I_DC_24", "u16", 1, 23, divisor=1000)
    assert rule("dcb_kernel_st0hs2425", "Power") == Field("Power", "u32", 1, 41, 40)
    # Documented unsigned, decoded signed.
    assert rule("inv_abb_pvs980", "Inverter_Section_Humidity").kind == "s16"
    assert rule("inv_abb_pvs980", "Vac_Reference").kind == "s16"
    # Daily energy by 1000 although documented in tenths; totals / 10 * 10.
    assert rule("inv_abb_pvs800", "Daily_kWh").divisor == 1000
    assert (rule("inv_abb_pvs800", "Total_kWh").divisor,
            rule("inv_abb_pvs800", "Total_kWh").multiplier) == (10, 10)
    # Main status comes from block 1 word 1; only one inverter shows bit 11.
    main = rule("inv_abb_pvs800", "Status_Main_GridConnected")
    assert (main.block, main.offset, main.aux) == (1, 1, 11)
    assert not any(f.name == "Status_Main_GridConnected" for f in CATALOG["inv_abb_pvs980"].fields)
    # Reserved bits are skipped.
    limit = rule("inv_abb_pvs980", "Status_Limiting_InputDCDCSectionTempLimitation")
    assert limit.aux == 14
    assert rule("inv_abb_pvs980", "Status_Environment_OverTempDetected").aux == 1
    assert {f.name for d in CATALOG for f in d.fields if f.clamp} == {
        "Irradiation", "Pyranometer_Irradiation"}
    assert not rule("sensor_lufft_ws600", "GlobalRadiation").clamp


@pytest.mark.parametrize("field", [
    Field("X", "u16", 1, 4), Field("X", "u32", 1, 3, 4), Field("X", "u8", 1, 0),
    Field("X", "u16", 2, 0), Field("X", "u16", 1, 0, divisor=7), Field("X", "bit", 1, 0, 16)])
def test_register_driver_rejects_rules_outside_the_block(field):
    with pytest.raises(ValueError):
        Catalog().register_driver("d", "1", [Block(1, "input", 0, 4)], [field])


def test_register_driver_checks_names_and_block_numbers():
    for blocks, fields in [([Block(63, "input", 0, 1)], []),
                           ([Block(1, "input", 0, 1)] * 2, []),
                           ([Block(1, "input", 0, 1)], [Field("A", "u16", 1, 0)] * 2)]:
        with pytest.raises(ValueError):
            Catalog().register_driver("d", "1", blocks, fields)


def test_register_driver_adds_rows_only():
    more = CATALOG.register_driver("mine", "2.1", [Block(7, "input", 0, 2)],
                                   [Field("A", "u16", 7, 1)])
    assert more.block_numbers() == [0, 1, 2, 3, 7]
    assert "mine" not in CATALOG.drivers


def test_frames(spark):
    fields = CATALOG.fields_frame(spark)
    assert fields.count() == 362
    assert fields.select("driver", "field").distinct().count() == 362
    blocks = {(r.driver, r.block): r for r in CATALOG.blocks_frame(spark).collect()}
    assert len(blocks) == 18
    assert all(r.min_size <= r["count"] for r in blocks.values())
    single = blocks["dcb_kernel_st0hs2425_single", 1]
    assert (single["count"], single.min_size) == (2, 1)  # reads two words, uses one
