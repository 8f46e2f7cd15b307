"""Records to broker messages, and their delivery."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from helioframe.functions import tags
from helioframe.operators.lookup import is_small
from helioframe.operators.registry import enabled

log = logging.getLogger(__name__)
#: Enabled brokers at most.
BROKERS = 10_000


def broker_key(brokers: DataFrame) -> list[str]:
    """What tells brokers apart: numbers start anew in every configuration file."""
    return [c for c in ("config", "broker") if c in brokers.columns]


def fan_out(records: DataFrame, brokers: DataFrame) -> DataFrame:
    """Every record once per enabled broker.

    The brokers of a site are a short configured list. They enter as one array
    value that is exploded per record, so records neither shuffle nor join. More
    than `BROKERS` of them are an error: each record would become as many messages.
    """
    key = broker_key(brokers)
    if not is_small(enabled(brokers), BROKERS):
        raise ValueError(f"more than {BROKERS} enabled brokers")
    listed = enabled(brokers).agg(F.array_sort(F.collect_list(
        F.struct(*key, "topic"))).alias("brokers"))
    names = {"config": "broker_config"}
    return records.withColumn("target", F.explode(listed.scalar())).select(
        *[c for c in records.columns], *[F.col(f"target.{k}").alias(names.get(k, k)) for k in key],
        F.col("target.topic").alias("broker_topic"))


def build_messages(records: DataFrame, brokers: DataFrame) -> DataFrame:
    """One message per record and enabled broker: broker, topic, payload."""
    return fan_out(records, brokers).select(
        "broker", tags.topic(F.col("broker_topic"), F.col("Device_Name")).alias("topic"),
        F.col("record").alias("payload"))


def deliver(records: DataFrame, brokers: DataFrame,
            publish: Callable[[Row, DataFrame], None], kept: bool = False) -> dict[int | tuple[str, int], bool]:
    """Hand each enabled broker the messages of all records, one try per broker.

    `publish(broker, messages)` gets a DataFrame and is expected to write it
    with a Spark writer or `foreachPartition`. A broker that fails is logged and
    the next one goes on. The loop is over the configured broker list; records
    are decoded once and kept once, not once per broker; with `kept` they are read
    from files as they are, and no copy of them is made. The result has a key per
    broker: its number, or (config, number) where brokers carry `config`.
    """
    done, names = {}, broker_key(brokers)
    records = records if kept else records.persist(StorageLevel.DISK_ONLY)
    try:
        for broker in enabled(brokers).orderBy(*names).toLocalIterator():
            own = brokers.where(reduce(and_, [F.col(k).eqNullSafe(F.lit(broker[k])) for k in names]))
            key = tuple(broker[k] for k in names) if "config" in names else broker["broker"]
            try:
                publish(broker, build_messages(records, own))
                done[key] = True
            except Exception:
                log.exception("sending to broker %s failed", key)
                done[key] = False
    finally:
        if not kept:
            records.unpersist()
    return done


class Outbox:
    """Messages that a broker has not taken, kept as files and offered again.

    They are known by batch and broker: a batch that is sent again after a failure replaces
    what it left here, and what has been taken is deleted at once. `path` has to be visible
    to all executors.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        return files, root

    def keep(self, batch: int, broker: str, messages: DataFrame) -> None:
        messages.write.mode("overwrite").parquet(f"{self.path}/{broker}/{batch:012d}")

    def pending(self, broker: str) -> list[int]:
        """Batches that a broker still has to get, oldest first."""
        files, root = self._files()
        found = files.get_file_info(fs.FileSelector(f"{root}/{broker}", allow_not_found=True))
        return sorted(int(f.base_name) for f in found if files.get_file_info(f"{f.path}/_SUCCESS").is_file)

    def messages(self, broker: str, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{broker}/{batch:012d}")

    def drop(self, broker: str, batch: int) -> None:
        files, root = self._files()
        if files.get_file_info(f"{root}/{broker}/{batch:012d}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{broker}/{batch:012d}")

    def deliver(self, batch: int, records: DataFrame | None, brokers: DataFrame,
                publish: Callable[[int, Row, DataFrame], None]) -> dict:
        """Offers every broker what it has not taken yet, batch by batch, then this batch.

        A broker that fails keeps its place: later batches wait behind the one it refused.
        With no records, only what is pending is offered. The result says, by broker, how many
        batches are still pending.
        """
        names, left = broker_key(brokers), {}
        records = None if records is None else records.persist(StorageLevel.DISK_ONLY)
        try:
            for broker in enabled(brokers).orderBy(*names).toLocalIterator():
                own = brokers.where(reduce(and_, [F.col(k).eqNullSafe(F.lit(broker[k])) for k in names]))
                key = tuple(broker[k] for k in names) if "config" in names else broker["broker"]
                place = "-".join(re.sub(r"[^A-Za-z0-9]", lambda m: f"%{ord(m[0]):02X}", str(broker[k])) for k in names)
                if records is not None:
                    self.keep(batch, place, build_messages(records, own))
                waiting = self.pending(place)
                try:
                    for number in waiting:
                        publish(number, broker, self.messages(place, number))
                        self.drop(place, number)
                except Exception:
                    log.exception("sending to broker %s failed", key)
                left[key] = len(self.pending(place))
        finally:
            if records is not None:
                records.unpersist()
        return left
