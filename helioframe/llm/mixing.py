"""Mixing sources to target weights by the cube method.

Every document has an expected number of copies, its source's target over its
source's size. Equal rows are one unit: of m rows at a rate r, floor(m * r) copies
are certain and the rest is an inclusion probability; the unit's copies are then
dealt over its rows, the first of which get one more than the others.
A flight moves the probabilities of three documents at a time along the null
space of the balancing equations (words, documents), one of two ways by chance
so that expectations hold, until one of them is 0 or 1; then the next document
takes its place. Nothing but three documents is ever held.

Documents fly in buckets by the hash of their id, so a source with a third of
all rows is many groups. Each bucket leaves at most two undecided documents;
those of a source fly together, and the last two land, keeping the words first.
Chance and order are hashes of the row: reruns agree, however the rows are
partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.shared import WORD, cut, text_column
from helioframe.llm.words import mix as scramble

#: Documents of a bucket, about.
BUCKET = 20_000


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds `target` to a table of `source`, `source_size`: one row per source.

    All targets together are `share` of all sizes, divided by weight; a target
    stops at `most` times its source's size, and the excess goes to the others
    by weight. Weights repeat over the sources by code point, null last. With
    the sources in order of (limit / weight), those before some place stop and
    the others share the rest: the common level is the largest of
    (rest / weights left) over all places.
    """
    everything = Window.partitionBy()
    name = everything.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(name) - 1, F.lit(len(weights))).cast("int")
    limit, weight = F.col("source_size") * F.lit(float(most)), F.col("weight")
    rise = everything.orderBy(limit / weight, F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    after = rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) * F.lit(float(share))
              - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum(weight).over(after))
    return (sizes.withColumn("weight", F.get(F.lit([float(w) for w in weights]), turn))
            .withColumn("level", level)
            .withColumn("target", F.least(limit, F.max("level").over(everything) * weight))
            .drop("weight", "level"))


def move(held: list[list], chance: float, balance: Sequence[int]) -> None:
    """Moves the probabilities (item 0) of the held documents until one is 0 or 1.

    Items 1 and 2 are its words and rows. With three documents the direction
    keeps both totals, with two only those of `balance`.
    """
    if len(held) == 3:
        (_, a, b, *_), (_, c, d, *_), (_, e, f, *_) = held
        way = [c * f - e * d, e * b - a * f, a * d - c * b]
        if not any(way):
            way = [d, -b, 0]
    elif len(held) == 2:
        way = [held[1][balance], -held[0][balance]]
        if not any(way):
            way = [1, -1]
    else:
        way = [1]
    forth = min(((1 - u[0]) if w > 0 else u[0]) / abs(w) for u, w in zip(held, way) if w)
    back = min((u[0] if w > 0 else (1 - u[0])) / abs(w) for u, w in zip(held, way) if w)
    step = forth if chance * (forth + back) < back else -back
    closest, at = 2.0, 0
    for i, (u, w) in enumerate(zip(held, way)):
        u[0] += step * w
        if w and (gap := min(u[0], 1 - u[0])) < closest:
            closest, at = gap, i
    held[at][0] = float(round(held[at][0]))
    for u in held:  # rounding errors of the rest
        u[0] = 0.0 if u[0] < 1e-12 else 1.0 if u[0] > 1 - 1e-12 else u[0]


def flight(land: bool):
    """A function over batches in group order; with `land`, nothing stays undecided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        group = late = schema = None

        def settle(p: list[float]) -> None:
            """Takes decided documents out: those of this batch into p, others into late."""
            for u in [u for u in held if u[0] in (0.0, 1.0)]:
                held.remove(u)
                if u[3] is not None:
                    p[u[3]] = u[0]
                else:
                    late.append(u[4] | {"p": u[0]})

        def finish(p: list[float]) -> None:
            while land and held:
                move(held, held[-1][5], 1)
                settle(p)
            for u in held:
                if u[3] is not None:
                    p[u[3]] = u[0]
                else:
                    late.append(u[4] | {"p": u[0]})
            held.clear()

        for batch in batches:
            schema, late = batch.schema, []
            column = {c: batch.column(c).to_pylist() for c in ("grouped", "source", "p", "size")}
            chances = scramble(np.asarray(batch.column("h")).view(np.uint64)) >> np.uint64(11)
            chances = (chances / 2.0 ** 53).tolist()
            p = list(column["p"])
            groups = list(zip(column["source"], column["grouped"]))
            for i, now in enumerate(groups):
                if now != group:
                    finish(p)
                    group = now
                if 0.0 < p[i] < 1.0:
                    held.append([p[i], column["size"][i], 1, i, None, chances[i]])
                    if len(held) == 3:
                        move(held, chances[i], 1)
                        settle(p)
            open_rows = {u[3] for u in held if u[3] is not None}
            for u in held:
                if u[3] is not None:
                    u[4] = batch.slice(u[3], 1).to_pylist()[0]
                    u[3] = None
            batch = batch.set_column(schema.get_field_index("p"), "p", pa.array(p, pa.float64()))
            if open_rows:
                batch = batch.filter(pa.array([i not in open_rows for i in range(len(p))]))
            yield batch
            if late:
                yield pa.RecordBatch.from_pylist(late, schema)
        late = []
        finish([])
        if late:
            yield pa.RecordBatch.from_pylist(late, schema)

    return run


def fly(units: DataFrame, land: bool) -> DataFrame:
    order = ["source", "grouped", "h", "unit", "size"]
    return (units.repartition("source", "grouped").sortWithinPartitions(*order)
            .mapInArrow(flight(land), units.schema))


def copies(units: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(unit, rows, copies): all copies of units of `unit`, `source`, `size`, `rows`, `rate`, `source_rows`."""
    wanted = F.col("rate") * F.col("rows")
    whole = F.floor(wanted).cast("long")
    groups = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / bucket))
    flown = cut(fly(units.select(
        "unit", "source", "size", "rows", whole.alias("whole"), (wanted - whole).alias("p"),
        F.xxhash64(F.col("unit"), F.lit("fly")).alias("h"),
        F.pmod(F.xxhash64(F.col("unit"), F.lit("bucket")), groups).alias("grouped")), land=False))
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    landed = fly(flown.where(undecided).withColumn("grouped", F.lit(0).cast("long")), land=True)
    return flown.where(~undecided).unionByName(landed).select(
        "unit", "rows", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def dealt(rows: DataFrame, part: int = BUCKET) -> DataFrame:
    """Rows with `rows` and `copies` of their unit: copies become the row's own.

    Rows of a unit are alike, so any order will do. A unit is divided into parts of
    about `part` rows, whose shares follow from their sizes; in a part rows are numbered.
    """
    alone, many = rows.where("rows = 1"), rows.where("rows > 1")
    parts = F.ceil(F.col("rows") / part)
    many = cut(many.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts)))
    sizes = many.groupBy("unit", "part", "rows", "copies").agg(F.count(F.lit(1)).alias("own"))
    upto = F.sum("own").over(Window.partitionBy("unit").orderBy("part"))
    share = lambda n: F.floor(n * (F.col("copies") / F.col("rows")) + 1e-9)
    last = F.when(F.col("upto") == F.col("rows"), F.col("copies")).otherwise(share(F.col("upto")))
    first = F.when(F.col("upto") == F.col("own"), 0).otherwise(share(F.col("upto") - F.col("own")))
    shares = sizes.withColumn("upto", upto).select("unit", "part", "own", (last - first).alias("share"))
    turn = F.row_number().over(Window.partitionBy("unit", "part").orderBy(F.lit(0)))
    spread = many.drop("copies", "rows").join(shares, ["unit", "part"]).withColumn("turn", turn)
    each = F.floor(F.col("share") / F.col("own")) + (F.col("turn") <= F.col("share") % F.col("own")).cast("long")
    return alone.drop("rows").unionByName(spread.withColumn("copies", each).drop("part", "own", "share", "turn"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        size: Column | None = None, bucket: int = BUCKET) -> DataFrame:
    """All rows and columns, with `mix`: a struct of size, source_size, target, copies.

    A row's size is its number of words, a null text's 0. Rows equal in all columns
    are one unit, whose copies differ by one at most from row to row. Null is a
    source, and an id, like any other. A source without words has the target 0 and
    none of its rows are taken. `copies` is at most `most`, rounded up. An empty
    table stays empty; a column named mix is replaced.
    """
    size = F.regexp_count(text_column(), F.lit(WORD)).cast("long") if size is None else size
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "mix"]
    # Two numbers of 64 bits name a unit: equal ones are equal rows. Maps have no hash, but a spelling.
    nulls = F.array(*[c.isNull() for c in columns])
    said = [c.cast("string") if "map<" in docs.schema[name].dataType.simpleString() else c
            for c, name in zip(columns, [x for x in docs.columns if x.lower() != "mix"])]
    unit = F.struct(*[F.xxhash64(F.lit(seed), nulls, *said).alias(f"u{seed}") for seed in (1, 2)])
    rows = docs.select(F.struct(*columns).alias("row"), unit.alias("unit"), "source", size.alias("size"))
    units = cut(rows.groupBy("unit", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    sources = targets(units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("source_rows")),
        weights, share, most)
    rated = (units.alias("u").join(sources.alias("s"), F.expr("u.source <=> s.source"))
             .select("u.*", "source_rows", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                     .otherwise(0.0).alias("rate")))
    decided = cut(copies(rated, bucket))
    found = rows.join(decided, "unit")
    found = dealt(found) if decided.where("rows > 1").take(1) else found.drop("rows")
    return (found.alias("r").join(sources.alias("s"), F.expr("r.source <=> s.source"))
            .select("r.row.*", F.struct(F.col("r.size"), F.col("s.source_size"), F.col("s.target"),
                                        F.col("r.copies")).alias("mix")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    found = mix(docs, **options)
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "mix"]
    return (found.where("mix.copies > 0").select(F.struct(*own).alias("row"), F.explode(
        F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))).select("row.*"))
