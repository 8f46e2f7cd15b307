"""What the corpus operators share: written intermediate tables, bitmaps of fixed size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a bitmap that is sent to every task: 1 MB, whatever the input.
BITMAP_BITS = 1 << 23
#: Spark's setting by which a query's shuffle files go at its end, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space that divides words, as a Java or DuckDB pattern and as a word's pattern.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where it is unset, one machine may use its temporary folder; a cluster gets
    an error, because its executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return base.rstrip("/")


#: Tables that `cut` has written and nothing has removed, by run; the last run is the present one.
_RUNS: list[list[str]] = [[]]


def cut(frame: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage.

    Lost executors then cost nothing before this point, and the optimizer knows
    the true size. The table stays until its run ends: the innermost `scratch`
    around this call, or else the Python process. Files of its shuffles go once it is written.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    _RUNS[-1].append(path)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """A run whose tables go at its end, so results must have been written by then."""
    _RUNS.append([])
    try:
        yield
    finally:
        _remove(_RUNS.pop())


def _remove(paths: list[str]) -> None:
    """Deletes tables by Hadoop's file systems, wherever they are."""
    jvm = SparkContext._jvm
    while paths and jvm is not None:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        session = SparkSession.getActiveSession()
        conf = session._jsc.hadoopConfiguration() if session else jvm.org.apache.hadoop.conf.Configuration()
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _remove_all() -> None:
    for run in _RUNS:
        try:
            _remove(run)
        except Exception:  # the JVM may have gone before
            return


def schema_of(frame: DataFrame, names: list[str], more: str) -> T.StructType:
    """The fields of some columns, whatever their names and types, and more as DDL."""
    return T.StructType([frame.schema[c] for c in names] + T.StructType.fromDDL(more).fields)


def bitmap(values: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Marks the places `value mod bits` of the only column's 64-bit hashes.

    Built by a grouping that combines before its shuffle; at most bits / 32 small
    rows reach the driver, however many values there are. A place that isn't
    marked proves absence; a full bitmap only lets more rows through.
    """
    words = (values.select(F.pmod(F.col(values.columns[0]), F.lit(bits)).alias("place"))
             .select(F.floor(F.col("place") / 32).alias("word"),
                     F.expr("shiftleft(1L, cast(place % 32 AS int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    found = np.zeros(bits // 32, np.uint32)
    for word, marked in words.collect():
        found[word] = marked
    return found


def marked(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the bitmap may hold."""
    place = hashes & np.uint64(len(found) * 32 - 1)
    return (found[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)) & 1 == 1


def text_column(name: str = "text") -> Column:
    """The column as text; an empty text where there is none."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def packed(names: list[str], result: tuple[str, ...]) -> tuple[list[str], Column]:
    """Kept columns without those of a result's names, and all of them as one struct `row`,
    so that no name of theirs meets one of an operator's own."""
    kept = [c for c in dict.fromkeys(names) if c not in result]
    return kept, F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("int").alias("\x00")).alias("row")


def unpacked(kept: list[str]) -> list[Column]:
    """The columns of `row` again."""
    return [F.col("row").getField(c).alias(c) for c in kept]


def text_hashes(text: Column) -> list[Column]:
    """t1 and t2: 128 bits that stand for a text."""
    return [F.xxhash64(F.lit(seed), text).alias(f"t{seed}") for seed in (1, 2)]


def row_hashes() -> list[Column]:
    """id1 and id2: 128 bits that stand for a row's doc_id and text, null or not."""
    return [F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("doc_id").cast("string"),
                       F.col("text").isNull(), text_column()).alias(f"id{seed}") for seed in (1, 2)]
