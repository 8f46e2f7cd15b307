"""Hand-made registries and reads."""

from datetime import datetime, timedelta, timezone

from helioframe import schemas

T0 = datetime(2024, 3, 1, 12, 0, 30, tzinfo=timezone.utc)


def devices(spark, *rows):
    """Rows of (name, driver, enabled[, config, position])."""
    full = [(r[3] if r[3:] else "config", r[4] if r[4:] else i, r[0], r[1], r[2], "SPP_1", 1,
             "10.0.0.1", 502) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schemas.DEVICES)


def reads(spark, *rows):
    """Rows of (device, poll, block, attempt, ok, registers[, minutes after T0])."""
    full = [(r[0], r[1], T0 + timedelta(minutes=r[6] if r[6:] else 0), *r[2:6]) for r in rows]
    return spark.createDataFrame(full, schemas.REGISTER_READS)


def brokers(spark, *rows):
    """Rows of (broker, topic, enabled[, config])."""
    return spark.createDataFrame([(r[3] if r[3:] else "mqtt", b, t, "10.0.0.2", 1883, on) for r in rows for b, t, on in [r[:3]]],
                                 schemas.BROKERS)
