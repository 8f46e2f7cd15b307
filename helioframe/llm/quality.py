"""Quality rules and robust multivariate outliers per language and source.

A document's words, symbols and repetitions become a vector of transformed
statistics. For every language and source, the minimum-covariance-determinant
method looks for the `HALF` of the documents whose covariance has the least
determinant. From each of `STARTS` starts (all documents, the coordinatewise
medians, a sample by hash) it takes the documents that are nearest, then their mean
and covariance, and again, until no determinant falls any more; the start that ends
lowest counts. A document whose Mahalanobis distance from there goes beyond the
cutoff is rejected.

Groups of fewer than `LEAST` documents are judged by the estimate over all documents
of their language, in languages as small by that of the corpus.

Every step is one grouping over the narrow table of statistics that combines before
its shuffle: documents are counted and summed by group, start and distance, in bins
fine enough for a quantile; so a group may hold any part of the rows. Statistics are
whole numbers on a grid, whose sums are exact: verdicts don't depend on the order or
partitioning of the rows. Documents of one bin are taken or left together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.shared import cut, packed, schema_of, unpacked
from helioframe.llm.words import DENSE, by_text, cover, pieces
from helioframe.operators.lookup import lookup_join

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Words of a window that counts as repeated.
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words) -> np.ndarray:
    """How many words of each text lie in a window of it that is there twice or more."""
    starts, ends = words.windows(WINDOW)
    hashes, text = words.runs().hash(starts, ends), words.text[starts]
    order = by_text(text, hashes)
    h, t = hashes[order], text[order]
    same = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    again = np.zeros(len(h), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = cover(len(words.start), starts[order[again]], ends[order[again]])
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the column `text` by its statistics, other columns as they are."""
    for batch in batches:
        found = []
        for _, _, words in pieces(batch.column("text")):
            inside, bounds = DENSE[words.data], words.bounds

            def count(mask, bounds=bounds):
                return np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])

            found.append((words.counts, count(inside & (words.data & 0xC0 != 0x80)),
                          count(SYMBOLS[words.data]),
                          np.array([repeated_lines(words.data[a:b].tobytes())
                                    for a, b in zip(bounds[:-1], bounds[1:])]),
                          repeated_words(words)))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*found)] or [np.zeros(0, np.int64)] * 5
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(c) for c in columns],
                                         [*keep, *BASE])


# --- the vector, its estimate and the verdict -------------------------------------------

#: Fixed parts of the method: the bulk, its least size, steps at most, and squared distance of the cutoff.
HALF, LEAST, STEPS, CUTOFF = 0.75, 50, 12, 45.0
#: Starts: all documents, medians, a sample of about so many.
STARTS, SAMPLE = 3, 200
#: Steps of the grid in a unit, bins in a doubling of the distance, and bins of a unit for medians.
GRID, BINS, COARSE = 4096, 64, 64
#: What makes the covariance of the nearest three quarters consistent, in five dimensions.
CONSISTENT = 1.414
#: Transformed statistics, with the least standard deviation that any group is given.
#: Counts are shrunk towards usual texts, so that a few words alone aren't an outlier.
VECTOR = (
    ("ln(1.0 + n_words)", 0.5),
    ("(word_chars + 250.0) / (n_words + 50.0)", 0.25),
    ("sqrt(n_symbols / (word_chars + 100.0))", 0.03),
    ("sqrt(n_dup_lines / (n_words + 50.0))", 0.03),
    ("sqrt(n_repeat_words / (n_words + 50.0))", 0.1),
)
DIM = len(VECTOR)
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
SHAPE = "key long, start int, center array<double>, precision array<double>, det double"
#: Estimates that are broadcast at most; one has some forty numbers.
FEW = 50_000


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measured(read: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in `keep` and the base statistics of every whole `text`; null is empty."""
    return read.mapInArrow(statistics, schema_of(read, keep, ", ".join(f"{c} long" for c in BASE)))


def group_key(level: int, *names: str) -> Column:
    parts = [p for n in names for p in (F.col(n).isNull(), F.col(n))]
    return F.xxhash64(F.lit(level), *parts)


def levels(stats: DataFrame) -> DataFrame:
    """(pair, language, everything, key): each language and source, and the group that judges it, null if none can."""
    pairs = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    languages = pairs.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    total = pairs.agg(F.sum("n").alias("n_all"))
    told = (pairs.withColumn("language", group_key(1, "lang")).withColumn("pair", group_key(2, "lang", "source"))
            .join(languages.select(group_key(1, "lang").alias("language"), "n_lang"), "language").crossJoin(F.broadcast(total)))
    key = (F.when(F.col("n") >= LEAST, F.col("pair")).when(F.col("n_lang") >= LEAST, F.col("language"))
           .when(F.col("n_all") >= LEAST, group_key(0)))
    return told.select("pair", "language", group_key(0).alias("everything"), key.alias("key"))


def looked_up(rows: DataFrame, few: DataFrame, on: str) -> DataFrame:
    return lookup_join(rows, few, [on], "spread", FEW)


def vectors(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, spread, x0, x1, ...): a row for each document and each group that it helps to estimate."""
    used = groups.select("key").where("key IS NOT NULL").distinct()
    # Each pair's groups that are used at all: itself, its language, the corpus.
    member = (groups.select("pair", F.explode(F.array_distinct(F.array("pair", "language", "everything"))).alias("key"))
              .join(used, "key", "left_semi"))
    grid = lambda e: F.expr(f"cast(round(({e}) * {GRID}) AS long)")
    rows = stats.select(group_key(2, "lang", "source").alias("pair"),
                        *[grid(e).alias(f"x{i}") for i, (e, _) in enumerate(VECTOR)])
    rows = rows.withColumn("spread", F.xxhash64(*[f"x{i}" for i in range(DIM)]))
    return looked_up(rows, cut(member), "pair").drop("pair")


def distance(unit: str = "") -> Column:
    """The squared Mahalanobis distance of columns x0, x1, ... by center and precision."""
    return F.expr(" + ".join(
        f"{1 if i == j else 2} * precision[{i * DIM + j}] * (x{i}{unit} - center[{i}]) * (x{j}{unit} - center[{j}])"
        for i, j in PAIRS))


def moments() -> list[Column]:
    """Exact sums of a group's vectors and of their products."""
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    return [F.count(F.lit(1)).alias("n"), *[whole(F.col(f"x{i}")).alias(f"s{i}") for i in range(DIM)],
            *[whole(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS]]


SUMS = ["n", *[f"s{i}" for i in range(DIM)], *[f"p{i}{j}" for i, j in PAIRS]]


def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Center, precision and determinant of each group and start, from its sums; one small row each."""
    floor = np.diag([least ** 2 for _, least in VECTOR])
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            n, sums = int(row.n), [int(getattr(row, f"s{i}")) for i in range(DIM)]
            second = np.zeros((DIM, DIM))
            for i, j in PAIRS:  # from whole numbers, so nothing cancels
                second[i, j] = second[j, i] = (n * int(getattr(row, f"p{i}{j}")) - sums[i] * sums[j]) / (n * n * GRID ** 2)
            found = second * CONSISTENT + floor
            rows.append((row.key, row.start, [t / (n * GRID) for t in sums], np.linalg.inv(found).ravel().tolist(),
                         float(np.linalg.det(found))))
        yield pd.DataFrame(rows, columns=["key", "start", "center", "precision", "det"])


def starts(rows: DataFrame) -> DataFrame:
    """The first estimates of every group, in the shape `SHAPE`."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("all"))
    whole = rows.groupBy("key").agg(*moments()).withColumn("start", F.lit(0))
    # A document is in the sample by its own hash; groups that so get too few have one start less.
    turn = F.pmod(F.xxhash64("spread", F.lit(1)), F.ceil(F.col("all") / SAMPLE)) == 0
    sample = (looked_up(rows, cut(counts), "key").where(turn).groupBy("key").agg(*moments())
              .where(F.col("n") > 4 * DIM).withColumn("start", F.lit(2)))
    first = whole.unionByName(sample).select("key", "start", *SUMS).mapInPandas(fitted, SHAPE)
    # Medians and quartiles, from counts in bins.
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(f"x{i}") * COARSE / GRID).alias("bin"))
                               for i in range(DIM)])).alias("x")
    bins = rows.select("key", each).groupBy("key", "x.dim", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("key", "dim").orderBy("bin")
    bins = bins.withColumns({"cum": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy("key", "dim"))})
    at = lambda q: F.min(F.when(F.col("cum") >= q * F.col("total"), (F.col("bin") + 0.5) / COARSE))
    middle = bins.groupBy("key", "dim").agg(at(0.5).alias("median"), ((at(0.75) - at(0.25)) / 1.349).alias("scale"))
    found = middle.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("dim", "median", "scale"))).alias("x"))
    cells = ", ".join("0.0D" if i != j else f"1 / (power(x[{i}].scale, 2) + {VECTOR[i][1] ** 2}D)"
                      for i in range(DIM) for j in range(DIM))
    second = found.select("key", F.lit(1).alias("start"), F.expr("transform(x, v -> v.median)").alias("center"),
                          F.expr(f"array({cells})").alias("precision"), F.lit(float("inf")).alias("det"))
    # How low a start lies is known after its first step.
    return first.withColumn("det", F.lit(float("inf"))).unionByName(second)


def step(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The estimates over the nearest documents of those before."""
    near = looked_up(rows, found, "key").withColumn("bin", F.floor(F.log2(1 + F.greatest(distance(f" / {GRID}D"), F.lit(0.0))) * BINS))
    bins = near.groupBy("key", "start", "bin").agg(*moments())
    own = Window.partitionBy("key", "start")
    before = F.sum("n").over(own.orderBy("bin")) - F.col("n")
    bulk = bins.withColumns({"before": before, "total": F.sum("n").over(own)}).where(F.col("before") < HALF * F.col("total"))
    return bulk.groupBy("key", "start").agg(*[F.sum(c).alias(c) for c in SUMS]).select("key", "start", *SUMS).mapInPandas(fitted, SHAPE)


def estimate(stats: DataFrame) -> DataFrame:
    """Robust center and precision of every language and source: (pair, center, precision)."""
    groups = cut(levels(stats))
    rows = cut(vectors(stats, groups))
    best = cut(starts(rows))
    now = best
    for _ in range(STEPS):
        now = cut(step(rows, now))
        told = now.join(best.select("key", "start", F.col("det").alias("before")), ["key", "start"])
        falls = cut(told.where(F.col("det") < F.col("before") * (1 - 1e-9)).drop("before"))
        if not falls.take(1):
            break
        best = cut(best.join(falls.select("key", "start"), ["key", "start"], "left_anti").unionByName(falls))
        now = falls  # a start whose determinant no longer falls is done
    lowest = best.groupBy("key").agg(F.min_by(F.struct("center", "precision"), F.struct("det", "start")).alias("x"))
    return groups.select("pair", "key").join(lowest, "key", "left").select("pair", "x.center", "x.precision")


RESULT = (*BASE, "base_failed", "distance", "kept")


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep`, the base statistics, `base_failed`, `distance` and `kept`, for every row.

    The estimate covers all rows; `docs` needs text, lang and source. Null texts
    are empty and fail by their number of words; null languages and sources are
    groups of their own. Where even the corpus is too small to estimate, the base
    rules alone decide (distance null). Repeated rows are judged alike. Kept columns
    named as results give way to them. An empty table stays empty.
    """
    kept, row = packed(keep, RESULT)
    read = docs.select(row, "lang", "source", F.col("text").cast("string").alias("text"))
    found = cut(estimate(cut(measured(read.select("lang", "source", "text"), ["lang", "source"]))))
    stats = measured(read, ["row", "lang", "source"]).withColumns(
        {"pair": group_key(2, "lang", "source"), **{f"x{i}": F.expr(e) for i, (e, _) in enumerate(VECTOR)}})
    stats = stats.withColumn("spread", F.xxhash64(*BASE))
    return (looked_up(stats, found, "pair")
            .withColumn("distance", distance()).withColumn("base_failed", base_failed())
            .select(*unpacked(kept), *BASE, "base_failed", "distance",
                    (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).alias("kept")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, that base rules and outlier test keep."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        "text", "lang", "source")
    return judge(whole, ["row"]).where("kept").select("row.*")
