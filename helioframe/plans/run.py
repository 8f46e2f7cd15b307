"""One collection run over landed data: registry and reads in, records out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from helioframe import sinks as out
from helioframe.catalog import CATALOG, Catalog
from helioframe.functions import tags
from helioframe.operators.attempts import assemble, dispatch, graded, rejects
from helioframe.operators.decode import TAGS, records
from helioframe.operators.messages import deliver
from helioframe.operators.package import HOST_POSITION, snapshot_entries
from helioframe.session import shuffles_go

SINKS = ("console", "messages", "files")
KEPT = ["poll_id", "config", "position", "poll_ts"]


def host_records(metrics: DataFrame, config: str) -> DataFrame:
    """Host metrics (see `operators.host.host_metrics`) in the shape of `records`."""
    ts = F.to_timestamp("Date", "yyyy-MM-dd'T'HH:mm:ssX")
    return metrics.select(
        F.xxhash64("Device_Serial", "Date").alias("poll_id"), F.lit(config).alias("config"),
        F.lit(HOST_POSITION).alias("position"), ts.alias("poll_ts"), "Device_Name",
        F.lit(None).cast("string").alias("Measurement_Suffix"), "Date",
        tags.record_json(metrics.columns).alias("record"))


def collect(reads: DataFrame, devices: DataFrame, hosts: DataFrame | None = None,
            catalog: Catalog = CATALOG) -> DataFrame:
    """Records of all enabled devices, and of the hosts if given."""
    found = records(assemble(dispatch(reads, devices, catalog), catalog), catalog)
    return found if hosts is None else found.unionByName(hosts)


class Collection:
    """One collection run whose reads are scanned and decoded once.

    The graded polls of all enabled devices are written to `folder` with their records; the
    sinks and the rejects are fed from there. `counts` has what the writing saw: polls by
    outcome. A run that is repeated replaces its folder.
    """

    def __init__(self, reads: DataFrame, devices: DataFrame, folder: str, catalog: Catalog = CATALOG):
        self.spark, self.folder = reads.sparkSession, folder
        polls = graded(dispatch(reads, devices, catalog), catalog)
        # The record of a poll that isn't whole would be one of nulls.
        told = self._with_records(polls, catalog)
        seen = Observation()
        whole_, torn, unusable = (F.count(F.when(F.col("outcome") == x, 1)).alias(x) for x in ("whole", "torn", "unusable"))
        # Records are text whose keys come again and again: zstd takes far less disk for them.
        with shuffles_go(self.spark):
            (told.observe(seen, whole_, torn, unusable).write.mode("overwrite").option("compression", "zstd")
             .partitionBy("outcome").parquet(folder))
        self.counts = dict(seen.get)
        self.table = self.spark.read.schema(told.schema).parquet(folder)

    @staticmethod
    def _with_records(polls: DataFrame, catalog: Catalog) -> DataFrame:
        found = records(polls, catalog, keep=("driver", "outcome", "blocks", "tries"))
        return found.withColumn("record", F.when(F.col("outcome") == "whole", F.col("record")))

    def records(self) -> DataFrame:
        """Records of all whole polls, in the shape of `decode.records`."""
        return self.table.where("outcome = 'whole'").select(*KEPT, *TAGS, "record")

    def rejects(self) -> DataFrame:
        """A row for every block that kept a poll from being whole."""
        return rejects(self.table.withColumnsRenamed({"Device_Name": "device_name", "Measurement_Suffix": "measurement"}))

    def send(self, runs: DataFrame, prefix: str, sinks: Iterable[str] = ("files",), **options) -> None:
        """Sends the records to the chosen sinks, with the options of `run`."""
        run(self.records(), runs, prefix, sinks=sinks, kept=True, **options)


def run(found: DataFrame, runs: DataFrame, prefix: str, path: str | None = None,
        brokers: DataFrame | None = None, publish: Callable | None = None,
        sinks: Iterable[str] = ("files",), zone: str = "UTC", kept: bool = False) -> None:
    """Send records to the chosen sinks. Leave out "files" for a dry run.

    Messages go out first, and a failing broker does not keep the files back.
    Files are named by run, so a run that is repeated replaces its own. Say `kept` of
    records that are read from a written table (see `messages.deliver`).
    """
    unknown = set(sinks) - set(SINKS)
    if unknown:
        raise ValueError(f"unknown sinks: {sorted(unknown)}")
    if "console" in sinks:
        out.dump(found)
    if "messages" in sinks:
        deliver(found, brokers, publish, kept)
    if "files" in sinks:
        out.write_snapshot_files(snapshot_entries(found, runs, prefix, zone), path)
