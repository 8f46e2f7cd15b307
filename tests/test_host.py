import random

from pyspark.sql import functions as F

from helioframe import schemas
from helioframe.functions import host as h
from helioframe.operators import host
from fixtures import T0


def test_rounding_is_half_to_even_as_in_python(spark):
    rnd = random.Random(1)
    sizes = ([rnd.randrange(1 << 50) for _ in range(2000)] + [131072 * k for k in range(2000)]
             + [(1 << 27) * k for k in range(500)] + [0, 1, (1 << 53) + 1])
    got = spark.createDataFrame([(s,) for s in sizes], "s bigint").select(
        "s", h.to_mib(F.col("s")), h.to_gib(F.col("s"))).collect()
    assert all(m == round(s / 2**20, 2) and g == round(s / 2**30, 2) for s, m, g in got)


def test_cpu_temperature(spark):
    rows = [("temp=48.3'C",), ("temp=7'C\n",), ("hot",), (None,)]
    got = spark.createDataFrame(rows, "raw string").select(h.cpu_temp(F.col("raw"))).collect()
    assert [r[0] for r in got] == [48.3, 7.0, None, None]


LINES = [
    ("one", 0, "processor\t: 0"), ("one", 1, "Serial\t\t: 00000000aabbccdd"),
    ("two", 0, "Serial\t\t: 0000000011111111"), ("two", 5, "Serial\t\t: 0000000022222222"),
    ("two", 6, "Model\t\t: x"), ("none", 0, "Model\t\t: x"), ("short", 0, "Serial\t\t: 12")]


def test_serials(spark):
    lines = spark.createDataFrame(LINES, schemas.CPUINFO_LINES)
    hosts = spark.createDataFrame([(x,) for x in ("one", "two", "none", "short", "dark")], "host string")
    got = {r.host: r.serial for r in host.cpu_serial(lines, hosts).collect()}
    assert got == {"one": "aabbccdd", "two": "22222222", "none": "00000000", "short": "",
                   "dark": "ERROR0000"}
    assert host.cpu_serial(lines).count() == 4


def test_metrics_and_union(spark):
    sample = ("one", T0, "temp=50.0'C", 12.5, 0.1, 0.2, 0.3, 1 << 20, 1 << 21, 131072, 393216, 40.0,
              1 << 30, 1 << 29, 1 << 27, 50.0)
    samples = spark.createDataFrame([sample, ("two", T0, "?", *sample[3:])], schemas.HOST_SAMPLES)
    lines = spark.createDataFrame(LINES, schemas.CPUINFO_LINES)
    metrics = host.host_metrics(samples, host.cpu_serial(lines), "HOST")
    (one,) = metrics.collect()
    assert tuple(one) == ("HOST", 50.0, 12.5, 0.1, 0.2, 0.3, 1.0, 2.0, 0.12, 0.38, 40.0, 1.0, 0.5,
                          0.12, 50.0, "2024-03-01T12:00:00Z", "aabbccdd")
    assert [r.host for r in host.unusable_samples(samples).collect()] == ["two"]
    both = host.union_records(metrics, spark.sql("SELECT 'A' AS Device_Name, 1.5D AS P"))
    assert both.count() == 2 and both.where("P IS NULL").count() == 1


def test_hosts_beyond_a_broadcast_keep_every_sample(spark, monkeypatch):
    """The salted join gives the same rows, samples of unknown hosts included."""
    from helioframe.operators import lookup
    facts = spark.createDataFrame([("h", k) for k in range(50)] + [("x", 1), (None, 2)], "host string, ts long")
    serials = spark.createDataFrame([("h", "s1"), ("y", "s2")], "host string, serial string")
    plain = lookup.lookup_join(facts, serials, ["host"], "ts", how="left")
    salted = lookup.lookup_join(facts, serials, ["host"], "ts", rows=0, how="left")
    assert plain.count() == 52 and plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty()
