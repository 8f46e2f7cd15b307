"""Hard negatives against a search of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.llm import hard_negatives, queries

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plainly(rows, anchor, low=30, high=90):
    """Rows are (id, label, x); every one is a row of its own."""
    rows = [(i, l, x) for i, l, x in rows if l is not None and x is not None and None not in x]
    dot = lambda a, b: max(-2 ** 63, min(2 ** 63 - 1, sum(p * q for p, q in zip(a, b))))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    found = []
    for k, (i, label, x) in enumerate(rows):
        if not anchor(i):
            continue
        scored = [(dot(x, y), j, other) for m, (j, other, y) in enumerate(rows) if m != k]
        for p, pid, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            fit = [s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p]
            found += [(i, pid, n + 1, j, p, s) for n, (s, j, _) in enumerate(sorted(fit, key=order)[:10])]
    return sorted(found, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=repr)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id long, label int, x array<long>, uid string, leaf string")


def test_over_all_embeddings(spark, sf):
    rows = [(i, (l + 1) % 10 if l is not None and i % 7 == 0 else l, [int(np.floor(256 * float(c))) for c in v])
            for v, i, l in queries.table(spark, sf, "embeddings").select("embedding", "vec_id", "label").collect()]
    want = plainly(rows, lambda i: i % 100 == 0)
    assert want and got(queries.op12_hard_negatives(spark, sf)) == want


@pytest.mark.parametrize("leaf", [30, 150, 10_000])
def test_trees_of_any_depth(spark, leaf):
    """Clusters, a third of all rows alike, norms from 0 to large."""
    r = np.random.default_rng(leaf)
    centres = r.integers(-80, 80, (6, 8))
    x = [(centres[r.integers(6)] + r.integers(-25, 25, 8)) * (10 if i % 97 == 0 else 1) for i in range(800)]
    rows = [(i, int(r.integers(4)), v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, int(r.integers(4)), centres[0].tolist()) for i in range(400)] + [(5000, 1, [0] * 8), (5050, 2, [0] * 8)]
    want = plainly(rows, lambda i: i % 25 == 0)
    found = hard_negatives.mine(frame_of(spark, rows), F.col("x"), F.col("vec_id") % 25 == 0, leaf=leaf)
    assert len(want) > 500 and got(found) == want


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(2), [r.randrange(-9, 9) for _ in range(3)]) for i in range(60)]
    rows += [(None, 0, [3, 3, 3]), (None, 1, [2, 3, 3]), (0, 0, rows[0][2]), (0, 0, rows[0][2]), (70, None, [1, 2, 3]),
             (75, 1, None), (80, 0, [1, None, 2]), (85, 1, []), (90, 0, [5]), (95, 1, [10 ** 12, 10 ** 12, -3])]
    want = plainly(rows, lambda i: i is not None and i % 5 == 0)
    found = hard_negatives.mine(frame_of(spark, rows), F.col("x"), F.col("vec_id") % 5 == 0)
    assert want and got(found) == want
    nothing = lambda rs: hard_negatives.mine(frame_of(spark, rs), F.col("x"), F.col("vec_id") % 5 == 0).collect()
    assert nothing([]) == [] and nothing([(5, None, [1])]) == [] and nothing([(5, 1, [1])]) == []


def test_leaves_left_out_hold_nothing():
    """The tree leaves most leaves out for a narrow annulus, and never one that holds a score in it."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-9, 9, (300, 4)) + c for c in ([200, 0, 0, 0], [0, 200, 0, 0], [-200, 0, 0, 90], [0, -90, 0, 0])])
    tree = hard_negatives.Tree(x[::3], len(x), float(np.sqrt((x ** 2).sum(axis=1).max())), leaf=50)
    leaf = tree.route(x)
    tree.widen(x, leaf)
    assert tree.leaves > 8 and len(tree.points) > 1
    found, left = hard_negatives.scores(x, x), 0
    for i in range(0, len(x), 50):
        p = np.array([found[i].max()])
        least, most = hard_negatives.window(p, 80, 90)
        _, leaves = tree.visited(x[i:i + 1], least, most)
        need = set(leaf[(found[i] >= least[0]) & (found[i] <= most[0])].tolist())
        assert need <= set(leaves.tolist())
        left += tree.leaves - len(leaves)
    assert left > 24 * tree.leaves / 4
