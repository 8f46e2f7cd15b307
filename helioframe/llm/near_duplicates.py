"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct five-word shingles; documents
of one set are one node. XOR over a set gives a parity sketch: whatever part of
the hashes it looks at, two sketches differ in at most as many places as the
sets' symmetric difference, and at a Jaccard similarity of 0.8 that is at most
(a + b) / 9 of the sizes a and b.

*Pigeonhole.* In a size band, hashes fall into fixed blocks, and a block's
parity is the XOR of its hashes (64 bits, so equal parity means equal content).
A node gives out its first `size / 4 + spare` blocks that aren't empty; of any
two similar nodes, at least `spare` of those blocks agree, since each differing
hash spoils one block at most. A node with fewer blocks gives out the empty ones
too, which keeps the count for two such nodes. Bands are wide, and a node near a
band's lower end also gives out blocks of the band below.

*Stars.* All nodes that share a block are paired with a few hubs of it, not with
each other (the least, and nodes that share the most blocks, for those are the
least changed); nodes of one batch are joined to their least before the shuffle, so
a block that a third of all nodes share is few rows in any task. Pairs are
filtered by the Hamming distance of a bit sketch of two to four bits per
shingle, then verified on the whole sets.

*The rest.* Only nodes of different components can still add a link. A node that
shares fewer than `spare` blocks with nodes of other components has no link left
to find. The others give out all their blocks once more, `FINE` times as many and
so small that most hold one hash. Similar nodes then agree in all but a quarter of
them, which half a text in common does not: nodes that share fewer drop out, twice,
and who stays may leave out as many shared blocks as must agree, but one. It looks
into its rarest blocks only, at nodes of larger components. The rarest block that two
similar nodes share has as many after it, in either node, as must agree in the other;
a pair where a block has fewer, or whose sketches of one to two bits a shingle differ
too much, is no row of the join. With those pairs tested the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helioframe.llm.components import components
from helioframe.llm.shared import cut, packed, row_hashes, schema_of, text_column, text_hashes, unpacked
from helioframe.llm.words import BYTE_BASE, WORD_BASE, U, by_text, mix, pieces
from helioframe.operators.lookup import is_small

SHINGLE = 5
#: Similarity at least 80 / 100.
PERCENT = 80
#: Blocks for each hash of a band's largest set, for nodes that the stars left apart.
FINE = 4
#: Keys are joined to their least node within about so many.
FLUSH = 500_000
#: Numbers of 64 bits, at least, of the short sketch that joins compare.
SHORT = 4


def _bands() -> np.ndarray:
    """Least sizes of the bands; smaller sets are similar only if equal."""
    edges = [4]
    while edges[-1] < 1 << 40:
        edges.append(-(-edges[-1] * 25 // 16))
    return np.array(edges)


BANDS = _bands()
#: Blocks of each band: enough that a set has its share of blocks that aren't empty.
BLOCKS = np.ceil(0.36 * BANDS[1:] + 10 + 1.5 * np.sqrt(BANDS[1:])).astype(np.int64)


def spare(n):
    """In how many blocks, at least, a node of n shingles agrees with a similar one of its size or more."""
    return 2 + n // 16


class Sets:
    """The shingle sets of a piece's texts: `hash[first[i]:first[i + 1]]`, ascending."""

    def __init__(self, words, size: int = SHINGLE):
        starts, ends = words.windows(size, whole=True)
        hashes, text = words.runs().hash(starts, ends), words.text[starts]
        order = by_text(text, hashes)
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        self.hash, self.text = hashes[new], text[new]
        self.first = np.searchsorted(self.text, np.arange(words.n + 1))
        self.size = np.diff(self.first)
        sums = np.concatenate([[U(0)], np.cumsum(mix(self.hash ^ U(BYTE_BASE)))])
        total = sums[self.first[1:]] - sums[self.first[:-1]]
        #: One number per set; different sets share it with a chance of 2^-64.
        self.node = mix(total + self.size.astype(U) * U(WORD_BASE)).view(np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i]:self.first[i + 1]]


def bit_sketch(hashes: np.ndarray) -> bytes:
    """Parities of the hashes over two to four bits per hash, a power of two, 64 at least."""
    bits = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    parity = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def short_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the hashes over one to two bits per hash, a power of two."""
    bits = max(64 * SHORT, 1 << (len(hashes) - 1).bit_length())
    parity = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def hamming(a: bytes, b: bytes) -> int:
    """Differing bits; the longer sketch is folded to the shorter one's bits."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's set as (n, node, sketch, short); all but n are null for an empty set."""
    for batch in batches:
        n, node, sketch, short = [], [], [], []
        for _, _, words in pieces(batch.column("text"), lower=True):
            sets = Sets(words)
            n += sets.size.tolist()
            node += [x if k else None for x, k in zip(sets.node.tolist(), sets.size.tolist())]
            sketch += [bit_sketch(sets.of(i)) if sets.size[i] else None for i in range(words.n)]
            short += [short_sketch(sets.of(i)) if sets.size[i] else None for i in range(words.n)]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep]
            + [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()),
               pa.array(short, pa.list_(pa.int64()))], [*keep, "n", "node", "sketch", "short"])


def block_keys(sets: Sets, texts: np.ndarray, band: np.ndarray, wanted: np.ndarray | None = None,
               ) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first `wanted` blocks of the given texts, or of all their fine blocks, and the text of each."""
    if not len(texts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    sizes = sets.size[texts]
    take = np.repeat(sets.first[texts] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) \
        + np.arange(sizes.sum())
    hashes, at = sets.hash[take], np.repeat(np.arange(len(texts)), sizes)
    blocks = FINE * BANDS[band + 1] if wanted is None else BLOCKS[band]
    block = ((hashes >> U(32)) * blocks[at].astype(U)) >> U(32)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (block[1:] != block[:-1])
    opens = np.flatnonzero(new)
    parity = np.bitwise_xor.reduceat(mix(hashes ^ U(WORD_BASE)), opens)
    at, block = at[opens], block[opens]
    if wanted is None:
        wanted = np.zeros(len(texts), np.int64)
        rank = np.full(len(at), -1)
    else:
        counts = np.bincount(at, minlength=len(texts))
        rank = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    for i in np.flatnonzero(counts < wanted) if wanted.any() else ():  # few: sets whose hashes crowd in few blocks
        empty = np.setdiff1d(np.arange(blocks[i], dtype=U), block[at == i])
        at = np.concatenate([at, np.full(len(empty), i)])
        block = np.concatenate([block, empty])
        parity = np.concatenate([parity, np.zeros(len(empty), U)])
        rank = np.concatenate([rank, np.zeros(len(empty), np.int64)])
    keep = rank < wanted[at]
    at, block, parity = at[keep], block[keep], parity[keep]
    key = mix(parity ^ mix(block + (band[at].astype(U) << U(40))))
    # The last bit tells a node's two bands apart.
    return (key & ~U(1)) | (band[at].astype(U) & U(1)), texts[at]


def banded(sets: Sets) -> tuple[np.ndarray, ...]:
    """(texts, sizes, bands) of a piece's sets, and which of them reach a smaller set of the band below."""
    fit = np.flatnonzero(sets.size >= BANDS[0])
    n = sets.size[fit]
    band = np.searchsorted(BANDS, n, "right") - 1
    return fit, n, band, (band > 0) & (PERCENT * n <= 100 * (BANDS[band] - 1))


def keys_of(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """All (key, node) of a piece: blocks of a set's band, and of the band below where
    a smaller set of that band can be similar."""
    fit, n, band, low = banded(sets)
    own = block_keys(sets, fit, band, n // 4 + spare(n))
    below = block_keys(sets, fit[low], band[low] - 1, 2 * n[low] // 9 + spare(n[low]))
    return (np.concatenate([own[0], below[0]]).view(np.int64),
            sets.node[np.concatenate([own[1], below[1]])])


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, hub): hub is null for the least node of a key here, else that node."""

    def out(parts: list) -> pa.RecordBatch:
        key, node = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        least = np.ones(len(key), bool)
        least[1:] = key[1:] != key[:-1]
        opens = np.flatnonzero(least)
        hub = np.repeat(node[opens], np.diff(np.append(opens, len(key))))
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(node), pa.array(hub, mask=least)], ["key", "node", "hub"])

    parts, held = [], 0
    for batch in batches:
        for _, _, words in pieces(batch.column("text"), lower=True):
            parts.append(keys_of(Sets(words)))
            held += len(parts[-1][0])
            if held >= FLUSH:
                yield out(parts)
                parts, held = [], 0
    if held:
        yield out(parts)


def fine_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, need): all fine blocks, and how many of them agree with a similar node's at least."""
    for batch in batches:
        for _, _, words in pieces(batch.column("text"), lower=True):
            sets = Sets(words)
            fit, n, band, low = banded(sets)
            own, below = block_keys(sets, fit, band), block_keys(sets, fit[low], band[low] - 1)
            # Sets of a and b hashes differ in (a + b) / 9 at most, and a larger one has 5 / 4 as many.
            spoilt = np.zeros(words.n, np.int64)
            spoilt[fit] = n // 4
            need = [np.bincount(own[1], minlength=words.n) - spoilt]
            spoilt[fit] = 2 * n // 9
            need.append(np.bincount(below[1], minlength=words.n) - spoilt)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([own[0], below[0]]).view(np.int64)),
                 pa.array(sets.node[np.concatenate([own[1], below[1]])]),
                 pa.array(np.concatenate([need[0][own[1]], need[1][below[1]]]).astype(np.int32))], ["key", "node", "need"])


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hashes) of the texts."""
    for batch in batches:
        for _, _, words in pieces(batch.column("text"), lower=True):
            sets = Sets(words)
            some = np.flatnonzero(sets.size > 0)
            yield pa.RecordBatch.from_arrays([pa.array(sets.node[some]), pa.array(
                [sets.of(i).tobytes() for i in some], pa.binary())], ["node", "hashes"])


def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    for batch in batches:
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        fit = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
        sa, sb = batch.column("sa"), batch.column("sb")
        for i in np.flatnonzero(fit):
            fit[i] = hamming(sa[i].as_py(), sb[i].as_py()) <= (na[i] + nb[i]) // 9
        yield batch.select(["a", "b"]).filter(pa.array(fit))


def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose whole sets are similar."""
    for batch in batches:
        ha, hb = batch.column("ha"), batch.column("hb")
        fit = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(c[i].as_buffer(), U) for c in (ha, hb))
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            fit[i] = 100 * shared >= PERCENT * (len(both) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(fit))


def texts_of(texts: DataFrame, nodes: DataFrame, some: DataFrame) -> DataFrame:
    """The texts that stand for some nodes, each once; only those are moved and reach Python."""
    wanted = cut(nodes.join(some, "node", "left_semi").select("t1", "t2"))
    return (texts.join(F.broadcast(wanted) if is_small(wanted) else wanted, ["t1", "t2"], "left_semi")
            .groupBy("t1", "t2").agg(F.first("text").alias("text")).select("text"))


def verified(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which of the distinct pairs (a, b) are similar: by sketch, then by whole sets."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"),
                                  F.col("sketch").alias(f"s{x}"))
    near = cut(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(close, "a long, b long"))
    if not near.take(1):
        return near
    ends = cut(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    sets = cut(texts_of(texts, nodes, ends).mapInArrow(sets_of, "node long, hashes binary"))
    one = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}"))
    return cut(near.join(one("a"), "a").join(one("b"), "b").mapInArrow(similar, "a long, b long"))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def in_band():
    """A node's keys of one band."""
    return Window.partitionBy("node", F.col("key").bitwiseAND(F.lit(1)))


def enough(rows: DataFrame) -> DataFrame:
    """Keys with nodes of several components, of nodes that share as many of them as they need.

    `rows` has key, node, need and group. Adds crowd, largest (of the key) and shared (of the node).
    """
    on = Window.partitionBy("key")
    return (rows.select("key", "node", "need", "group", F.count(F.lit(1)).over(on).alias("crowd"),
                        F.min("group").over(on).alias("least"), F.max("group").over(on).alias("largest"))
            .where("least < largest").withColumn("shared", F.count(F.lit(1)).over(in_band())).where("shared >= need")
            .drop("least"))


def differing(x: str, y: str) -> str:
    """Differing bits of two short sketches, in SQL; one of twice the other's length is folded."""
    folded = lambda a, b: (f"if(size({a}) > size({b}), zip_with(slice({a}, 1, size({b})), "  # noqa: E731
                           f"slice({a}, 1 + size({b}), size({b})), (p, q) -> p ^ q), {a})")
    return f"aggregate(zip_with({folded(x, y)}, {folded(y, x)}, (p, q) -> bit_count(p ^ q)), 0, (t, d) -> t + d)"


def between(fine: DataFrame, info: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different components that can be similar.

    `fine` has the blocks of `enough` and their `place` among the node's, from the rarest on. At
    the first place that two nodes share, either has as many blocks left as the other one needs.
    """
    first = fine.where("place <= shared - need + 1").select(
        "key", "node", "need", "group", "largest", (1 + F.col("shared") - F.col("place")).alias("left"))
    looks = first.where("group < largest").drop("largest")
    looking = looks.join(info, "node")
    others = first.drop("largest").join(looks.select("key").distinct(), "key", "left_semi").join(info, "node")
    return (looking.alias("x").join(others.alias("y"), F.expr(
        "x.key = y.key AND x.group < y.group AND x.left >= y.need AND y.left >= x.need"
        f" AND 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)"
        f" AND {differing('x.short', 'y.short')} <= (x.n + y.n) div 9"))
            .select(*_pair("x.node", "y.node")).distinct())


def linked(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of all nodes with a link, over texts (t1, t2, text) and their distinct nodes."""
    stars = cut(texts.select("text").mapInArrow(block_rows, "key long, node long, hub long")
                .withColumn("hub", F.coalesce("hub", F.first("node").over(
                    Window.partitionBy("key", "hub").orderBy("node"))))
                .where("node <> hub"))
    # A node that shares many blocks is little changed, and so near to most of the others.
    shares = stars.groupBy("node").agg(F.count(F.lit(1)).alias("shares"))
    hubs = (stars.join(shares, "node").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array(
        F.max_by("node", F.struct("shares", "node")), F.max_by("node", F.struct("shares", F.xxhash64("node"))))
        .alias("hubs")).where("n > 1"))
    more = (stars.join(hubs, "key").select("node", F.explode("hubs").alias("hub")).where("node <> hub"))
    tried = cut(stars.select("node", "hub").unionByName(more).select(*_pair("node", "hub")).distinct())
    links = verified(texts, nodes, tried)
    found = cut(components(links))

    # What the stars left apart: blocks whose nodes lie in several components.
    root = lambda x: found.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    apart = (stars.join(root("node"), "node", "left").join(root("hub"), "hub", "left")
             .where(F.coalesce("node_root", "node") != F.coalesce("hub_root", "hub")).select("key").distinct())
    apart = cut(apart)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    group = F.struct(F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("root", "node").alias("root"))
    known = (nodes.select("node", "n", "short").join(found, "node", "left").join(sizes, "root", "left")
             .select("node", "n", "short", group.alias("group")))
    # A similar node may be a fifth smaller, and then spares as many blocks as its size says.
    members = (stars.select("key", "node").union(stars.select("key", "hub")).join(apart, "key", "left_semi").distinct()
               .join(known.select("node", (2 + F.floor(F.col("n") / 20)).cast("int").alias("need"), "group"), "node"))
    held = cut(enough(enough(members)).select("node", "group").distinct())
    fine = (texts_of(texts, nodes, held).mapInArrow(fine_rows, "key long, node long, need int")
            .join(F.broadcast(held) if is_small(held) else held, "node"))
    fine = enough(fine).select("key", "node", "need", "group")
    fine = cut(enough(fine).withColumn("place", F.row_number().over(in_band().orderBy("crowd", "key"))))
    info = known.join(held.select("node"), "node", "left_semi").select("node", "n", "short")
    pairs = between(fine, info).join(tried, ["a", "b"], "left_anti")
    rest = verified(texts, nodes, pairs)
    stars_found = found.select(F.col("root").alias("a"), F.col("node").alias("b"))
    return components(stars_found.unionByName(rest)) if rest.take(1) else found


def described(read: DataFrame, keep: list[str], least) -> tuple[DataFrame, DataFrame]:
    """The rows of (..., t1, t2, text) with their sets' nodes, and the different nodes."""
    rows = cut(read.mapInArrow(describe, schema_of(read, [*keep, "t1", "t2"], "n long, node long, sketch binary, short array<long>")))
    one = F.min_by(F.struct("n", "sketch", "short", "t1", "t2"), F.struct("t1", "t2"))  # of the texts of one set
    nodes = cut(rows.where("node IS NOT NULL").groupBy("node").agg(one.alias("one"), least.alias("least"))
                .select("node", "one.*", "least"))
    return rows.select(*keep, "n", "node"), nodes


def near_duplicates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep`, `n_shingles` and `component_id`, for every row.

    Words are what white space divides, A-Z in lower case; a text of fewer than
    five words is one shingle, one without words or null has none, is linked
    with nothing and is its own component. Two texts link at a Jaccard similarity
    of 0.8 or more; component_id is the least doc_id that links reach. Repeated
    rows and equal texts link; rows with a null doc_id link but name no component
    (null where no linked row has an id). Kept columns named as results give way to
    them. An empty table stays empty.
    """
    kept, row = packed(keep, ("n_shingles", "component_id"))
    read = docs.select(row, "doc_id", *text_hashes(text_column()), text_column().alias("text"))
    rows, nodes = described(read, ["row", "doc_id"], F.min("doc_id"))
    found = linked(read.select("t1", "t2", "text"), nodes.drop("least"))
    rooted = (nodes.select("node", "least").join(found, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        *unpacked(kept), F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, one row of each group of near duplicates.

    It is the one of least doc_id (a null one comes last), then of least hash of id and
    text: rows are told apart by both, so a repeated or null doc_id decides nothing for
    other rows. Texts without words are linked with nothing; of repeated rows one stays.
    """
    ident = row_hashes()
    read = docs.select("doc_id", *ident, *text_hashes(text_column()), text_column().alias("text"))
    rows, nodes = described(read, ["doc_id", "id1", "id2"], F.min(
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "id1", "id2")))
    found = linked(read.select("t1", "t2", "text"), nodes.drop("least"))
    first = (nodes.select("node", "least").join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
             .agg(F.min("least").alias("least")).select("least.id1", "least.id2")
             .unionByName(rows.where("node IS NULL").select("id1", "id2")).distinct())
    same = Window.partitionBy("id1", "id2").orderBy(F.lit(0))
    return (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *ident)
            .join(first, ["id1", "id2"], "left_semi")
            .select("row", F.row_number().over(same).alias("turn")).where("turn = 1").select("row.*"))
