"""Snapshot files: gzip JSON, one array of records per line.

A file written by one run holds one array on one line; files written by
`helioframe.sinks` may hold several lines. Both read the same. Files of one
array over many lines need `multi_line=True`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_snapshots(spark: SparkSession, path: str, schema: str,
                   multi_line: bool = False) -> DataFrame:
    """One row per record. Keys a record lacks are NULL; an empty array gives no row.

    Text that is no JSON array arrives whole in `_corrupt_record`.
    """
    return (spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", multi_line)
            .option("recursiveFileLookup", True).json(path))


def read_snapshots_long(spark: SparkSession, path: str) -> DataFrame:
    """One row per key of a record, for records of any shape; values are text.

    Text that is no JSON array is one row with nothing but file_name and
    `_corrupt_record`.
    """
    text = F.col("line")
    parsed = F.from_json(text, "array<map<string,string>>")
    lines = (spark.read.option("recursiveFileLookup", True).text(path)
             .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))
             .where(F.trim(text) != "")
             .select("file_name", parsed.alias("parsed"), F.when(parsed.isNull(), text).alias(CORRUPT)))
    tags = ["Device_Name", "Measurement_Suffix", "Date"]
    return (lines.select("file_name", CORRUPT, F.explode_outer("parsed").alias("record"))
            .select("file_name", CORRUPT, *[F.col("record")[t].alias(t) for t in tags],
                    F.explode_outer("record").alias("field", "value"))
            .where(F.col(CORRUPT).isNotNull() | ~F.col("field").isin(tags)))


def stream_snapshot_files(spark: SparkSession, path: str, schema: str,
                          max_files: int | None = None) -> DataFrame:
    """Snapshot files as a stream of records: file_name, line, place in it, the record's keys
    and `_corrupt_record`, as `read_snapshots` has it.

    A file is read whole, so it should hold a run or a few, not a day. A file
    whose name was read in an earlier micro-batch is left out.
    """
    reader = (spark.readStream.option("recursiveFileLookup", True)
              .option("fileNameOnly", True).option("pathGlobFilter", "*.gz"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = F.col("text")
    parsed = F.from_json(text, f"array<struct<{_nested(schema)}>>")
    lines = (reader.text(path, wholetext=True)
             .select(F.col("_metadata.file_name").alias("file_name"),
                     F.posexplode(F.split("value", "\n")).alias("line", "text"))
             .where(F.trim(text) != "")
             .select("file_name", "line", parsed.alias("parsed"),
                     F.when(parsed.isNull(), text).alias(CORRUPT)))
    return (lines.select("file_name", "line", CORRUPT, F.posexplode_outer("parsed").alias("place", "record"))
            .where(F.col("record").isNotNull() | F.col(CORRUPT).isNotNull())
            .select("file_name", "line", "place", "record.*", CORRUPT))


def _nested(schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))
