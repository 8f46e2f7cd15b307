"""Hard negatives: high-scoring rows of other labels, within a share of a positive's score.

Scores are integer inner products. With M the largest norm, the coordinate
sqrt(M^2 - |x|^2) added to every row (and 0 to an anchor a) makes them distances:
|a - x|^2 = |a|^2 + M^2 - 2 a.x, so a window of scores is an annulus around a.

*Tree.* A multiway hyperplane tree (GNAT) is fitted on a bounded sample: a node has
far-apart split points, and a row belongs to the nearest of them. Every row is
routed to a leaf, and each split point i stores, from all rows, the least and
greatest distance to the rows of each sibling subtree j. By the triangle
inequality, subtree j has no row in the annulus [r1, r2] around a point at distance
t of split point i when t - high_ij > r2, low_ij - t > r2 or t + high_ij < r1.

*Search.* An anchor visits the leaves that its annuli leave over; leaves are divided
into blocks of bounded size, and in each the scores are exact. First come the
positives, from the score of the fifth best in the sample on; then the windows,
down to the tenth best that the sample holds in them. What the sample can't bound
is searched in full, so the sample decides only about speed.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from helioframe.llm.shared import cut

#: Rows on which the tree is fitted, at most; fewer of more than 104 dimensions.
SAMPLE, SAMPLE_CELLS = 20_000, 1 << 21
#: Split points of a node, and levels of nodes at most.
WAYS, LEVELS = 12, 4
#: A node is divided while it stands for more rows than this.
LEAF = 4_000
#: Numbers in a block of rows, and anchors that meet a block at once.
CELLS, ANCHORS, SLICE = 1 << 19, 4_096, 256
#: Numbers up to here are exact as float64.
EXACT = float(1 << 53)
#: Distances are widened by this share of the largest, far more than they are rounded.
SLACK = 1e-6
BOTTOM, TOP = -(1 << 63), (1 << 63) - 1


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, out = column.flatten().to_numpy(zero_copy_only=False), np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, exact; beyond 64 bits the nearest that fits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.sqrt((a.astype(float) ** 2).sum(axis=1).max() * (b.astype(float) ** 2).sum(axis=1).max()))
    if bound < EXACT / 2:  # no sum on the way is larger
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object).dot(b.astype(object).T), BOTTOM, TOP).astype(np.int64)


def window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score s with low * p <= 100 * s <= high * p."""
    p = positive.astype(object)
    fit = lambda s: np.clip(s, BOTTOM, TOP).astype(np.int64)
    return fit(-((-p * low) // 100)), fit(p * high // 100)


class Tree:
    """Split points of every node, and who lies below; fitted on a sample, completed by all rows."""

    def __init__(self, sample: np.ndarray, rows: int, top: float, ways: int = WAYS, leaf: int = LEAF):
        self.top = top
        self.points: list[np.ndarray] = []  # of each node, as rows and with the added coordinate
        self.children: list[np.ndarray] = []  # node below each split point, or -1 - leaf
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.paths: list[list[tuple[int, int]]] = []  # of each leaf: (node, choice) from the root on
        self._grow(self.lift(sample.astype(float)), rows / max(len(sample), 1), ways, leaf, [])

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top ** 2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    @property
    def leaves(self) -> int:
        return len(self.paths)

    def _grow(self, x: np.ndarray, weight: float, ways: int, leaf: int, path: list) -> int:
        """The node of these sampled rows, or -1 - leaf."""
        chosen = [0] if len(x) else []
        if len(path) < LEVELS and len(x) >= 2 * ways and len(x) * weight > leaf:
            some = x[:: max(1, len(x) // (20 * ways))]
            far = distances(some, x[:1])[:, 0]
            points = [x[0]]
            while len(points) < ways and far.max() > 0:
                points.append(some[far.argmax()])
                far = np.minimum(far, distances(some, points[-1][None])[:, 0])
            chosen = points
        if len(chosen) < 2:
            self.paths.append(path)
            return -len(self.paths)
        node, points = len(self.points), np.array(chosen)
        self.points.append(points)
        self.children.append(np.zeros(len(points), np.int64))
        self.low.append(np.full((len(points), len(points)), np.inf))
        self.high.append(np.full((len(points), len(points)), -np.inf))
        nearest = distances(x, points).argmin(axis=1)
        for j in range(len(points)):
            self.children[node][j] = self._grow(x[nearest == j], weight, ways, leaf, [*path, (node, j)])
        return node

    def route(self, x: np.ndarray) -> np.ndarray:
        """Every row's leaf."""
        found, todo, x = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))], self.lift(x.astype(float))
        while todo:
            node, at = todo.pop()
            if not self.points or not len(at):
                continue
            nearest = distances(x[at], self.points[node]).argmin(axis=1)
            for j, below in enumerate(self.children[node]):
                if below < 0:
                    found[at[nearest == j]] = -1 - below
                else:
                    todo.append((below, at[nearest == j]))
        return found

    def widen(self, x: np.ndarray, leaves: np.ndarray) -> None:
        """Takes rows into the ranges on their leaves' paths. The leaf is given, not found
        again: a row between two split points could be rounded to the other one."""
        x = self.lift(x.astype(float))
        for leaf in np.unique(leaves):
            own = x[leaves == leaf]
            for node, j in self.paths[leaf]:
                far = distances(own, self.points[node])
                self.low[node][:, j] = np.minimum(self.low[node][:, j], far.min(axis=0))
                self.high[node][:, j] = np.maximum(self.high[node][:, j], far.max(axis=0))

    def visited(self, a: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, leaf): leaves that may hold a score from least[i] to most[i] with row i of a."""
        square = (a.astype(float) ** 2).sum(axis=1)
        radius = lambda s: np.sqrt(np.maximum(square + self.top ** 2 - 2 * s.astype(float), 0))
        slack = SLACK * (self.top + np.sqrt(square))
        inner, outer = radius(most) - slack, radius(least) + slack
        some = np.flatnonzero(least <= most)
        if not self.points:
            return some, np.zeros(len(some), np.int64)
        a = np.concatenate([a.astype(float), np.zeros((len(a), 1))], axis=1)
        places, leaves, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(0, some)]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            t = distances(a[at], self.points[node])[:, :, None]
            low, high = self.low[node][None], self.high[node][None]
            nearest = np.maximum(t - high, low - t).max(axis=1)  # inf for a subtree without rows
            farthest = (t + high).min(axis=1)
            open_ = (nearest <= outer[at, None]) & (farthest >= inner[at, None])
            for j, below in enumerate(self.children[node]):
                own = at[open_[:, j]]
                if below < 0:
                    places.append(own)
                    leaves.append(np.full(len(own), -1 - below))
                else:
                    todo.append((below, own))
        return np.concatenate(places), np.concatenate(leaves)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0))


def ranges(tree: Tree, d: int):
    """(node, i, j, low, high, n): distances from split point i to subtree j, and rows of leaves (node -1, leaf i)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = copy.deepcopy(tree), np.zeros(tree.leaves, np.int64)
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            n += np.bincount(leaf, minlength=len(n))
            own.widen(matrix(batch.column("x"), d), leaf)
        rows = [(-1, i, 0, 0.0, 0.0, int(k)) for i, k in enumerate(n) if k]
        for node, (lo, hi) in enumerate(zip(own.low, own.high)):
            rows += [(node, int(i), int(j), float(lo[i, j]), float(hi[i, j]), 0) for i, j in zip(*np.nonzero(lo <= hi))]
        cells = list(zip(*rows)) or [()] * 6
        kinds = [pa.int32()] * 3 + [pa.float64()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)],
                                         ["node", "i", "j", "low", "high", "n"])

    return run


def routed(tree: Tree, d: int):
    """Adds every row's leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.route(matrix(batch.column("x"), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))],
                                             [*batch.schema.names, "leaf"])

    return run


def best(score: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores, then smaller ids."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((uids[some], ids[some], ~score[some]))][:k]


def places(table) -> tuple[np.ndarray, ...]:
    """uid, id (a missing one last of all) and label."""
    get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(table.column("id"), TOP).to_numpy(zero_copy_only=False)
    return get("uid"), ids, get("label")


class Sample:
    """Rows that bound from below what a search over all rows finds."""

    def __init__(self, table: pa.Table, d: int):
        self.x = matrix(table.column("x"), d)
        self.uid, self.ids, self.label = places(table)


def seek_positives(tree: Tree, sample: Sample, d: int, k: int):
    """Anchors with the leaves that may hold their first k rows of the same label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, (uid, _, label) = matrix(batch.column("x"), d), places(batch)
            least = np.full(len(a), BOTTOM)
            for at in range(0, len(a), SLICE):
                found = scores(a[at:at + SLICE], sample.x)
                for i, row in enumerate(found, at):
                    own = row[(sample.label == label[i]) & (sample.uid != uid[i])]
                    if len(own) >= k:
                        least[i] = np.partition(own, len(own) - k)[len(own) - k]
            at, leaf = tree.visited(a, least, np.full(len(a), TOP))
            yield with_leaves(batch, at, leaf)

    return run


def seek_windows(tree: Tree, sample: Sample, d: int, k: int, low: int, high: int):
    """Anchors with the leaves that may hold the first k rows of a window of one of their `scores`,
    and as `floors` the scores that those have at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, (uid, _, label) = matrix(batch.column("x"), d), places(batch)
            column = batch.column("scores")
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, p = np.repeat(np.arange(len(a)), sizes), column.flatten().to_numpy(zero_copy_only=False)
            least, most = window(p, low, high)
            first = np.concatenate([[0], np.cumsum(sizes)])
            for at in range(0, len(a), SLICE):
                found = scores(a[at:at + SLICE], sample.x)
                for i, row in enumerate(found, at):
                    other = np.sort(row[sample.label != label[i]])
                    for w in range(first[i], first[i + 1]):
                        end = np.searchsorted(other, most[w], "right")
                        if end >= k:
                            least[w] = max(least[w], other[end - k])
            at, leaf = tree.visited(a[owner], least, most)
            pairs = np.unique(np.stack([owner[at], leaf]), axis=1)
            floors = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(least))
            yield with_leaves(pa.RecordBatch.from_arrays([*batch.columns, floors], [*batch.schema.names, "floors"]),
                              pairs[0], pairs[1])

    return run


def with_leaves(batch: pa.RecordBatch, at: np.ndarray, leaf: np.ndarray) -> pa.RecordBatch:
    taken = batch.take(pa.array(at))
    return pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])


FOUND = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("score", pa.int64()), ("uid", pa.int64()),
                   ("id", pa.int64())])
FOUND_DDL = "anchor long, positive long, score long, uid long, id long"


def within(d: int, pick: Callable) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of a block's rows with the anchors that visit it; `pick` says which rows to give out."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if rows.num_rows and anchors.num_rows:
            x, held = matrix(rows.column("x"), d), places(rows)
            missing = rows.column("id").is_null().to_numpy()
            for at in range(0, anchors.num_rows, SLICE):
                some = anchors.slice(at, SLICE)
                uid, _, label = places(some)
                found = scores(matrix(some.column("x"), d), x)
                extra = list(zip(*(some.column(c).to_pylist() for c in ("scores", "floors")))) \
                    if "scores" in some.schema.names else [None] * len(uid)
                for i, row in enumerate(found):
                    for positive, taken in pick(row, uid[i], label[i], extra[i], *held):
                        for column, part in zip(out, (np.full(len(taken), uid[i]), np.full(len(taken), positive),
                                                      row[taken], held[0][taken], np.where(missing[taken], TOP, held[1][taken]))):
                            column.append(part)
        arrays = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        return pa.Table.from_arrays([pa.array(c) for c in arrays], schema=FOUND)

    return run


def same_label(k: int):
    def pick(row, uid, label, _, uids, ids, labels):
        own = np.flatnonzero((labels == label) & (uids != uid))
        yield 0, own[best(row[own], ids[own], uids[own], k)]

    return pick


def other_label(k: int, low: int, high: int):
    def pick(row, uid, label, asked, uids, ids, labels):
        other, (positives, floors) = labels != label, asked
        _, tops = window(np.array(positives, np.int64), low, high)
        for positive, least, most in zip(positives, floors, tops.tolist()):
            fit = np.flatnonzero(other & (row >= least) & (row <= most))
            if len(fit):
                yield positive, fit[best(row[fit], ids[fit], uids[fit], k)]

    return pick


def searched(points: DataFrame, anchors: DataFrame, sizes: DataFrame, d: int, pick: Callable) -> DataFrame:
    """What `pick` takes of all points, block by block, for anchors placed in the leaves to visit.

    A leaf's rows are divided into blocks and its anchors into parts, both of bounded
    size by their counts; every block meets every part of its leaf in a task of its own.
    """
    parts = anchors.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("parts"))
    grid = cut(sizes.join(parts, "leaf"))  # a row for each leaf; the tree has a bounded number
    spread = lambda n, x: F.pmod(F.xxhash64("uid", F.lit(x)), F.col(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = points.join(F.broadcast(grid), "leaf").select("leaf", spread("blocks", 1).alias("block"),
                                                         numbers("parts").alias("part"), "uid", "id", "label", "x")
    right = anchors.join(F.broadcast(grid), "leaf").select(
        "leaf", numbers("blocks").alias("block"), spread("parts", 2).alias("part"),
        *[c for c in anchors.columns if c != "leaf"])
    key = ["leaf", "block", "part"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(within(d, pick), FOUND_DDL)


def firsts(found: DataFrame, k: int) -> DataFrame:
    """The k best of each (anchor, positive), with rank."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, x: Column, anchor: Column, id: str = "vec_id", label: str = "label",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `x` is a row's vector of whole numbers, null (or with a null entry) for rows that
    take no part, as do rows without a label; shorter vectors count as filled up with 0.
    For every row where `anchor` holds, and each of its first `positives` other rows of
    its label, come the first `negatives` rows of other labels whose score s satisfies
    low * p <= 100 * s <= high * p for the positive's score p. Higher scores come first,
    ties by smaller id, a null id last. Repeated rows are different rows. Scores beyond
    64 bits count as the nearest number that fits. Without rows the result is empty.
    """
    spark = rows.sparkSession
    points = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                         x.cast("array<bigint>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    points = points.where("label IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL)")
    points = cut(points.withColumn("uid", F.monotonically_increasing_id()))
    square = F.aggregate("x", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double"))
    told = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.max(square).alias("top")).first()
    if not told["n"]:
        return spark.createDataFrame([], RESULT)
    d = max(told["d"], 1)
    some = points.orderBy(F.xxhash64("uid")).limit(min(SAMPLE, max(SAMPLE_CELLS // d, 200))).drop("anchor")
    some = some.toArrow()
    sample = Sample(some, d)
    tree = Tree(np.unique(sample.x, axis=0), told["n"], float(np.sqrt(told["top"])) * (1 + 1e-12),
                leaf=leaf)
    shape = T.StructType([*points.schema.fields, T.StructField("leaf", T.IntegerType())])
    placed = cut(points.mapInArrow(routed(tree, d), shape))
    seen = (placed.select("x", "leaf").mapInArrow(ranges(tree, d), "node int, i int, j int, low double, high double, n long")
            .groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
            .collect())  # at most the square of WAYS rows a node
    for r in seen:
        if r["node"] >= 0:
            tree.low[r["node"]][r["i"], r["j"]], tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
    rows_a_block = max(CELLS // d, 64)
    sizes = spark.createDataFrame([(r["i"], -(-r["n"] // rows_a_block)) for r in seen if r["node"] < 0],
                                  "leaf int, blocks int")
    asked = placed.where("anchor").select("uid", "id", "label", "x")
    shape = T.StructType([*asked.schema.fields, T.StructField("leaf", T.IntegerType())])
    first = cut(firsts(searched(placed, cut(asked.mapInArrow(seek_positives(tree, sample, d, positives), shape)), sizes, d,
                                same_label(positives)), positives)
                .select("anchor", F.col("score").alias("positive"), F.col("id").alias("positive_id"), F.col("uid").alias("twin")))
    # At most `positives` scores for an anchor.
    wanted = asked.join(first.groupBy(F.col("anchor").alias("uid")).agg(F.collect_set("positive").alias("scores")), "uid")
    shape = T.StructType([*wanted.schema.fields, *T.StructType.fromDDL("floors array<long>, leaf int").fields])
    seek = seek_windows(tree, sample, d, negatives, low, high)
    last = firsts(searched(placed, cut(wanted.mapInArrow(seek, shape)), sizes, d, other_label(negatives, low, high)), negatives)
    named = lambda c: F.when(F.col(c) != TOP, F.col(c))
    return (first.join(last, ["anchor", "positive"]).join(asked.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", named("positive_id").alias("positive_id"), "rank", named("id").alias("negative_id"),
                    F.col("positive").alias("positive_score"), F.col("score").alias("negative_score")))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
