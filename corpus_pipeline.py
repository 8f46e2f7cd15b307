"""A training corpus from `documents`, in stages; each one's rows are written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.llm import contamination, mixing, near_duplicates, quality, sharding
from helioframe.llm.shared import cut, row_hashes

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least doc_id."""
    return near_duplicates.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    # Rows are told apart by id and text: a null or repeated id condemns no other row.
    ident = [h.alias(f"row{k}") for k, h in enumerate(row_hashes())]
    bad = (contamination.decontaminate(docs.select("doc_id", "text", *ident), items, ["row0", "row1"])
           .where("contaminated").select("row0", "row1").distinct())
    return (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *ident)
            .join(bad, ["row0", "row1"], "left_anti").select("row.*"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight has it taken."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place in it."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Stage]] = [("quality", good), ("near_duplicates", distinct),
                                   ("decontamination", clean), ("mixing", mixed), ("sharding", shard)]

#: The stages use robust estimates and balanced random choices, beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs)
    return docs
