import pytest

from helioframe.operators import messages, registry
from helioframe.sources.registry import read_brokers, read_devices, unreadable_registries

DEVICES = """# site north
devices:
    - name : INV_1
      driver: inv_abb_pvs980 #which decoder
      enabled : yes #yes/no
      measurement: SPP_1  # table
      slave_id : 1     # address
      ip_address : 192.168.1.2
      port : 502
    - name : "Roof #2"
      driver: 'sensor_lufft_ws600'
      enabled : no
      measurement: SPP_1
      slave_id : 2
      ip_address : 192.168.1.3
      port : 503
    # - name : old one
    #   driver: nothing
    -   driver: sensor_lufft_ws600
        name: LAST
        port: x
"""
BROKERS = """servers:
    - topic : plant/a
      ip_address : 10.0.0.1
      port : 1234
      username : someone
      password: secret
      enabled : yes
    - topic : plant/b
      ip_address : 10.0.0.2
      port : 1235
      username : someone
      password: secret
      enabled : off
"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "north_1.yml").write_text(DEVICES)
    (tmp_path / "south.yml").write_text(DEVICES.replace("INV_1", "INV_S").replace("\n", "\r\n"))
    (tmp_path / "mqtt.yml").write_text(BROKERS)
    return tmp_path


def test_devices_of_all_files(spark, folder):
    rows = read_devices(spark, f"{folder}/*.yml").orderBy("config", "position").collect()
    assert [(r.config, r.position, r.name) for r in rows] == [
        ("north_1", 0, "INV_1"), ("north_1", 1, "Roof #2"), ("north_1", 2, "LAST"),
        ("south", 0, "INV_S"), ("south", 1, "Roof #2"), ("south", 2, "LAST")]
    assert tuple(rows[0]) == ("north_1", 0, "INV_1", "inv_abb_pvs980", True, "SPP_1", 1,
                              "192.168.1.2", 502)
    assert tuple(rows[4])[3:] == ("sensor_lufft_ws600", False, "SPP_1", 2, "192.168.1.3", 503)
    assert (rows[2].enabled, rows[2].port, rows[2].measurement) == (None, None, None)


def test_devices_agree_with_a_yaml_library(spark, folder):
    yaml = pytest.importorskip("yaml")
    want = yaml.safe_load(DEVICES)["devices"][:2]
    got = read_devices(spark, f"{folder}/north_1.yml").orderBy("position").limit(2).collect()
    assert [{k: r[k] for k in want[0]} for r in got] == want


def test_brokers_without_credentials(spark, folder):
    brokers = read_brokers(spark, f"{folder}/mqtt.yml")
    assert [tuple(r) for r in brokers.orderBy("broker").collect()] == [
        ("mqtt", 0, "plant/a", "10.0.0.1", 1234, True), ("mqtt", 1, "plant/b", "10.0.0.2", 1235, False)]
    assert [r.broker for r in registry.enabled(brokers).collect()] == [0]


def test_missing_file_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_devices(spark, f"{tmp_path}/none.yml")


def test_listing_and_versions(spark, folder):
    devices = read_devices(spark, f"{folder}/north_1.yml")
    assert registry.device_listing(devices).first().line == (
        "INV_1 <--> inv_abb_pvs980 <--> 192.168.1.2 <--> 502 <--> 1")
    versions = {r.name: r.driver_version for r in registry.with_driver_version(devices).collect()}
    assert versions["INV_1"] == "ABB_PVS980_TCP v0.1"


def test_brokers_of_two_files_get_their_own_messages(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.yml").write_text(f"servers:\n  - topic: {name}\n    enabled: yes\n")
    brokers = read_brokers(spark, str(tmp_path))
    sent = []
    records = spark.createDataFrame([("D", "{}")], "Device_Name string, record string")
    done = messages.deliver(records, brokers, lambda broker, batch: sent.extend(
        (broker["config"], r.topic) for r in batch.collect()))
    assert sent == [("a", "a/D"), ("b", "b/D")] and done == {("a", 0): True, ("b", 0): True}


STYLES = {
    "flow": "devices:\n  - {name: A, driver: d, enabled: yes}\n  - { name: 'B' , driver: d, enabled: 1 }  # last\n",
    "inline": "devices: [{name: A, driver: d, enabled: on},\n  {name: B, driver: d, enabled: true}]\n",
    "dash": "devices:\n  -\n    name: A\n    driver: d\n    enabled: yes\n  -\n    name: B\n    driver: d\n    enabled: yes\n",
    "first": "servers:\n  - topic: t\n    enabled: yes\ndevices:\n- name: A\n  driver: d\n  enabled: yes\n- name: B\n  driver: d\n  enabled: yes\n",
    "last": "---\ndevices:\n  - name: A\n    driver: d\n    enabled: yes\n  - name: B\n    driver: d\n    enabled: yes\nservers:\n  - topic: t\n    enabled: yes\n",
}


@pytest.mark.parametrize("style", STYLES)
def test_every_style_of_list_and_sections(spark, tmp_path, style):
    (tmp_path / "c.yml").write_text(STYLES[style])
    rows = read_devices(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.config, r.position, r.name, r.driver, r.enabled) for r in rows] == [
        ("c", 0, "A", "d", True), ("c", 1, "B", "d", True)]


def test_files_and_entries_that_give_nothing_are_rejects(spark, tmp_path):
    (tmp_path / "none.yml").write_text("servers:\n  - topic: t\n    enabled: yes\n")
    (tmp_path / "empty.yml").write_text("devices:\n")
    (tmp_path / "bad.yml").write_text("devices:\n  - driver: d\n    enabled: yes\n  - name: B\n    enabled: yes\n")
    assert sorted(r.config for r in unreadable_registries(spark, str(tmp_path), "devices").collect()) == [
        "empty", "none"]
    devices = read_devices(spark, str(tmp_path))
    assert registry.unusable_entries(devices).count() == 2 and registry.enabled(devices).isEmpty()
