"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `nodes` points of a ring. A row goes clockwise from the hash of
its key to the next point; if that point's shard is full it continues clockwise
to the next shard with room. Shards hold rows / shards of the rows, the first
ones one more, so counts differ by at most one. Only the overflow leaves its own
arc, so another shard moves little more than the rows it takes.

The rows are put in ring order by a range partitioning (its tie-breaker divides
even a third of all rows with one key), and numbered by partition offsets. What
each arc holds is one number per arc; overflow is decided on those, at most
shards x nodes of them whatever the input, and rows find their shard by arc and
rank. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.shared import cut

SHARDS, NODES = 16, 64
#: The ring's circumference.
RING = 1 << 40


def ring_place(key: Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(RING))


def ring(frame: DataFrame, shards: int = SHARDS, nodes: int = NODES) -> list[tuple[int, int]]:
    """The ring's points in clockwise order, as (place, shard): a table of fixed size.

    A shard's points don't depend on how many other shards there are.
    """
    spark = frame.sparkSession
    points = spark.range(shards * nodes).select(
        F.pmod(F.xxhash64(F.lit("node"), F.floor(F.col("id") / nodes), F.col("id") % nodes),
               F.lit(RING)).alias("place"), F.floor(F.col("id") / nodes).cast("int").alias("shard"))
    return sorted((p, s) for p, s in points.collect())


def arc_of(place: Column, places: list[int]) -> Column:
    """How many points lie before the place, by binary search; after the last point,
    the number of points, an arc of its own that leads to the first point."""
    points = F.split(F.lit(",".join(map(str, places))), ",").cast("array<bigint>")
    steps = F.lit([1 << k for k in reversed(range(len(places).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(places)) & (F.get(points, at + step - 1) < place), at + step).otherwise(at))


def place_overflow(counts: list[int], owners: list[int], quota: list[int],
                   ) -> list[tuple[int, int, int, int, int]]:
    """Who takes which rows of each arc: (arc, from rank, to rank, shard, first slot).

    In round t, each arc offers what is left of it to the shard t points on, in
    ring order; a shard takes what it has room for, an arc's first rows first.
    """
    n, room, taken = len(owners), list(quota), []
    waiting = [(a, 0, c) for a, c in enumerate(counts) if c]
    for step in range(n):
        left = []
        for arc, lo, hi in waiting:
            shard = owners[(arc + step) % n]
            got = min(room[shard], hi - lo)
            if got:
                taken.append((arc, lo, lo + got, shard, quota[shard] - room[shard]))
                room[shard] -= got
            if lo + got < hi:
                left.append((arc, lo + got, hi))
        waiting = left
        if not waiting:
            break
    return taken


def shard(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """All rows and columns with `shard` (0 to shards - 1) and `slot` (gapless from 0 in it).

    A row's place depends on its key, rows with one key are neighbours in the
    order of their other columns; wholly equal rows are interchangeable. Rows
    without a key share the place of null. An empty table stays empty. Columns
    named shard or slot are replaced.
    """
    own = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    kinds = dict(rows.dtypes)
    rest = [F.col(f"row.`{c}`") for c in own if c != key and "map<" not in kinds[c]]
    order = ["place", "key", "rest", "tie"]
    placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")).select(
        "row", ring_place(F.col(f"row.`{key}`")).alias("place"), F.col(f"row.`{key}`").alias("key"),
        F.xxhash64(F.lit(0), *rest).alias("rest"), F.monotonically_increasing_id().alias("tie"))
    points = ring(rows, shards, nodes)
    numbered = cut(placed.repartitionByRange(*order).sortWithinPartitions(*order)
                   .select("row", arc_of(F.col("place"), [p for p, _ in points]).alias("arc"),
                           F.monotonically_increasing_id().alias("at")))
    numbered = numbered.withColumns({"part": F.shiftright("at", 33),
                                     "index": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})

    # Rows of an arc are neighbours: one number per partition and arc tells their ranks.
    runs = (numbered.groupBy("part", "arc")
            .agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("first"))
            .withColumn("before", F.coalesce(F.sum("n").over(
                Window.partitionBy("arc").orderBy("part")
                .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    counts = [0] * (len(points) + 1)
    for arc, n in runs.groupBy("arc").agg(F.sum("n")).collect():
        counts[arc] = n
    quota = [sum(counts) // shards + (s < sum(counts) % shards) for s in range(shards)]
    spans = rows.sparkSession.createDataFrame(
        place_overflow(counts, [s for _, s in points], quota),
        "arc int, lo long, hi long, shard int, base long")
    # Both tables are broadcast: they have at most a few rows per arc and partition.
    runs = (runs.join(F.broadcast(spans), "arc")
            .where((F.col("before") < F.col("hi")) & (F.col("before") + F.col("n") > F.col("lo")))
            .groupBy("part", "arc", "first", "before")
            .agg(F.collect_list(F.struct("lo", "hi", "shard", "base")).alias("spans")))
    rank = F.col("before") + F.col("index") - F.col("first")
    return (numbered.join(F.broadcast(runs), ["part", "arc"]).withColumn("rank", rank)
            .withColumn("span", F.filter("spans", lambda s: (s.lo <= F.col("rank"))
                                         & (F.col("rank") < s.hi))[0])
            .select("row.*", F.col("span.shard").alias("shard"),
                    (F.col("span.base") + F.col("rank") - F.col("span.lo")).alias("slot")))
