"""Where records go: snapshot files, measurement tables, the console.

Files appear whole or not at all: Spark commits a batch by rename and a stream
by its log.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from helioframe.functions import tags


def write_snapshots(packages: DataFrame, path: str, mode: str = "append") -> None:
    """Packages as gzip text by configuration and day, a JSON array per line.

    The rebalance hint merges small output and splits a configuration that
    holds much of the data.
    """
    (packages.select("config", tags.utc_day(F.col("minute")).alias("day"), "payload")
     .hint("rebalance", "config", "day")
     .write.mode(mode).option("compression", "gzip").partitionBy("config", "day").text(path))


#: A gzip member is closed and the next one begun, so members can be joined byte by byte.
_COPY = 1 << 20


def write_snapshot_files(entries: DataFrame, path: str) -> None:
    """One gzip file per run, under its own name, from `package.snapshot_entries`.

    Entries are dealt out by ranges of (run, position): a run with most of the records is
    written by many tasks, each of which writes its part as a gzip member of its own and
    holds no more than a record. Members of a run are then joined in order, bytes only, and
    go as soon as its file is there, so that the records are not on disk twice.
    All of this happens in a folder beside the files, which goes in any case: if the run
    fails while it writes, no file has appeared. A repeated task or run replaces a file.
    `path` has to be visible to all executors.
    """
    stage = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    spark = entries.sparkSession
    files, root = fs.FileSystem.from_uri(path)
    _, staged = fs.FileSystem.from_uri(stage)
    files.create_dir(staged, recursive=True)

    def write(rows: Iterator[Row]) -> None:
        target, folder = fs.FileSystem.from_uri(stage)
        part = TaskContext.get().partitionId()
        for name, own in groupby(rows, lambda row: row["file_name"]):
            target.create_dir(f"{folder}/{name}", recursive=True)
            draft = f"{folder}/{uuid.uuid4().hex}"
            before = b""
            with target.open_output_stream(draft, compression="gzip") as out:
                for row in own:
                    if row["record"] is not None:
                        out.write(before + row["record"].encode("utf-8"))
                        before = b","
            # Ranges are in order, so the number of its task tells a member's place.
            target.move(draft, f"{folder}/{name}/{part:08d}{'' if before else '-empty'}")

    def join(names: Iterator[Row]) -> None:
        target, folder = fs.FileSystem.from_uri(stage)
        _, home = fs.FileSystem.from_uri(path)
        for row in names:
            if target.get_file_info(f"{folder}/{row['name']}").type == fs.FileType.NotFound:
                continue  # a task that failed later on has made this file
            found = target.get_file_info(fs.FileSelector(f"{folder}/{row['name']}"))
            members = sorted(f.path for f in found if not f.path.endswith("-empty"))
            draft = f"{folder}/{uuid.uuid4().hex}"
            with target.open_output_stream(draft, compression=None) as out:
                for k, member in enumerate(members):
                    out.write(gzip.compress(b"," if k else b"["))
                    with target.open_input_stream(member, compression=None) as one:
                        while some := one.read(_COPY):
                            out.write(some)
                out.write(gzip.compress(b"]" if members else b"[]"))
            target.move(draft, f"{home}/{row['name']}")
            # By another name first: no other try of this task finds some of the members.
            gone = f"{folder}/{uuid.uuid4().hex}"
            target.move(f"{folder}/{row['name']}", gone)
            target.delete_dir(gone)

    key = ["file_name", "position", "poll_id"]
    try:
        (entries.select(*key, "record").repartitionByRange(*[F.asc_nulls_first(c) for c in key])
         .sortWithinPartitions(*key).foreachPartition(write))
        # Names only, one for each run.
        names = [f.base_name for f in files.get_file_info(fs.FileSelector(staged)) if f.type == fs.FileType.Directory]
        if names:
            spark.createDataFrame([(n,) for n in names], "name string").repartition(
                min(len(names), 200)).foreachPartition(join)
    finally:
        files.delete_dir(staged)


def write_measurements(records: DataFrame, path: str, ts: str = "poll_ts",
                       mode: str = "append", run: str | None = None) -> None:
    """Records as one table per measurement suffix and day.

    With `run`, a name for what is written, a repeated run replaces its own part of the
    table, whatever it holds the second time; readers get the name as a column `run`.
    """
    if run is not None:
        if not re.fullmatch(r"[A-Za-z0-9._:-]+", run):
            raise ValueError(f"a run's name is letters, digits and . _ : - only, not {run!r}")
        path, mode = f"{path.rstrip('/')}/run={run.replace(':', '%3A')}", "overwrite"
    (records.withColumn("day", tags.utc_day(F.col(ts)))
     .hint("rebalance", "Measurement_Suffix", "day")
     .write.mode(mode).partitionBy("Measurement_Suffix", "day").parquet(path))


def write_polls(polls: DataFrame, path: str, mode: str = "append") -> None:
    """Whole polls by driver and day, to decode wide tables of many drivers from.

    The choice among attempts and its shuffle are then paid once; a wide decode
    reads only its driver's partitions.
    """
    (polls.withColumn("day", tags.utc_day(F.col("poll_ts")))
     .hint("rebalance", "driver", "day")
     .write.mode(mode).partitionBy("driver", "day").parquet(path))


def dump(records: DataFrame) -> None:
    """Print all records as indented JSON; the driver holds one partition at a time."""
    for row in records.select(F.to_json(F.struct("*"), {"pretty": "true"})).toLocalIterator():
        print(row[0])
