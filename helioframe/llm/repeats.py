"""Removal of repeated passages: windows of words that occur more than once.

*First pass: count-min.* In every window the fragment (eight words) of least
hash is its anchor. Equal windows have equal anchors, so a window is repeated
only if its anchor is; counting anchors overestimates windows and needs about a
fourteenth of the entries. Every task counts its anchors in two rows of cells,
up to 2, and gives out only cells in use; the merged sketch becomes one bit per
cell. Its width follows the size of the texts up to `MOST_CELLS`; beyond that it
lets more windows through and loses none.

*Second pass: exact.* Windows whose cells both say "twice" are grouped by 95
bits of the window's own hash, in two lanes that are independent from the bytes on. A window that is repeated within a batch is known
at once, and the batch sends one row for it instead of one for each occurrence,
so a passage that a third of all documents share stays small in every task.

The words of all repeated windows are then removed from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helioframe.llm.shared import cut, packed, schema_of, unpacked
from helioframe.llm.words import BYTE_BASE, WORD_BASE, U, Words, cover, mix, pieces

WINDOW, FRAGMENT = 35, 8
#: Cells of a sketch row: one for so many bytes of text, within these bounds.
BYTES_PER_CELL, LEAST_CELLS, MOST_CELLS = 16, 1 << 20, 1 << 28
CHUNK = 1 << 16
#: Entries that a task holds before it gives them out.
FLUSH = 2_000_000
SALTS = (U(BYTE_BASE), U(WORD_BASE))


def _sliding(values: np.ndarray, size: int, least) -> np.ndarray:
    """least of every `size` neighbours, by doubling."""
    width = 1
    while 2 * width <= size:
        values = least(values[:-width], values[width:])
        width *= 2
    return least(values[:len(values) - (size - width)], values[size - width:]) if size > width else values


def anchors(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, each one's anchor hash, hashes of all anchors, each place once)."""
    starts, _ = words.windows(window)
    none = np.zeros(0, U)
    if not len(starts):
        return starts, none, none
    fragment = min(FRAGMENT, window)
    places = np.arange(len(words.start) - fragment + 1)
    hashes = words.runs().hash(places, places + fragment)
    span = window - fragment + 1
    least = _sliding(hashes, span, np.minimum)
    inside = np.zeros(len(least), bool)
    inside[starts] = True
    masked = np.where(inside, least, U(0))
    edge = np.zeros(span - 1, U)
    most = _sliding(np.concatenate([edge, masked, edge]), span, np.maximum)
    return starts, least[starts], hashes[most == hashes]


def cells_of(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(mix(hashes ^ salt) & U(cells - 1)).astype(np.int64) for salt in SALTS]


def sketch(cells: int, window: int):
    """(chunk, places, twice) of a task: cells in use, and which of them more than once."""

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = []
        for row, found in enumerate(cells_of(np.concatenate(parts), cells)):
            place, n = np.unique(found, return_counts=True)
            chunk = place // CHUNK
            bounds = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(place))
            rows += [(row * (cells // CHUNK) + int(chunk[a]), (place[a:b] % CHUNK).astype(np.uint16).tobytes(),
                      np.packbits(n[a:b] > 1).tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))],
            ["chunk", "places", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, _, words in pieces(batch.column("text")):
                parts.append(anchors(words, window)[2])
                held += len(parts[-1])
                if held >= FLUSH:
                    yield out(parts)
                    parts, held = [], 0
        if held:
            yield out(parts)

    return run


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, bits): cells counted twice or more, of rows in order of chunk."""
    now, counts = None, np.zeros(CHUNK, np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": pa.array([now], pa.int64()), "bits": pa.array(
            [np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())})

    for batch in batches:
        for chunk, places, twice in zip(*(batch.column(c).to_pylist() for c in ("chunk", "places", "twice"))):
            if chunk != now:
                if now is not None:
                    yield done()
                now, counts[:] = chunk, 0
            at = np.frombuffer(places, np.uint16)
            more = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at))
            counts[at] = np.minimum(counts[at] + 1 + more, 2)
    if now is not None:
        yield done()


def count_min(texts: DataFrame, window: int) -> np.ndarray:
    """The merged sketch: two rows of bits, set where anchors are counted twice or more."""
    octets = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(max(LEAST_CELLS, 1 << int(octets // BYTES_PER_CELL).bit_length()), MOST_CELLS)
    bits = np.zeros((len(SALTS), cells // 8), np.uint8)
    flat = bits.reshape(-1)
    parts = texts.mapInArrow(sketch(cells, window), "chunk long, places binary, twice binary")
    merged = (parts.repartition("chunk").sortWithinPartitions("chunk")
              .mapInArrow(merge, "chunk long, bits binary"))
    for chunk, found in merged.toLocalIterator():
        flat[chunk * CHUNK // 8:(chunk + 1) * CHUNK // 8] = np.frombuffer(found, np.uint8)
    return bits


def suspected(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for row, place in zip(bits, cells_of(hashes, bits.shape[1] * 8)):
        found &= (row[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return found


def window_rows(bits, window: int):
    """Suspected windows as (h, g, id1, id2, place, n).

    h and g are the window's hash. n = 1 is a window seen once in this batch;
    n = 2 without an id says that the batch has it twice or more. A run of
    windows known to be repeated has n = 0: place holds its start and its length.
    """

    def out(parts: list) -> pa.RecordBatch:
        h, g, id1, id2, place = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((g, h))
        same = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        again = np.zeros(len(h), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        told = order[again[order] & ~np.concatenate([[False], same])]
        once = np.flatnonzero(~again)
        known = np.flatnonzero(again)
        opens = np.ones(len(known), bool)
        opens[1:] = ((np.diff(known) != 1) | (np.diff(place[known]) != 1) | (np.diff(id1[known]) != 0)
                     | (np.diff(id2[known]) != 0))
        first = np.flatnonzero(opens)
        length = np.diff(np.append(first, len(known)))
        runs = known[first]
        spread = mix(id1[runs].view(U) ^ mix(place[runs].astype(U))).view(np.int64)
        rows = [np.concatenate(c) for c in (
            (h[once], h[told], spread), (g[once], g[told], np.full(len(runs), -1, np.int64)),
            (id1[once], id1[told], id1[runs]), (id2[once], id2[told], id2[runs]),
            (place[once] << 32 | 1, place[told], place[runs] << 32 | length),
            (np.ones(len(once), np.int64), np.full(len(told), 2), np.zeros(len(runs), np.int64)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0]), pa.array(rows[1].astype(np.int32)), pa.array(rows[2]), pa.array(rows[3]),
             pa.array(rows[4]), pa.array(rows[5].astype(np.int32))], ["h", "g", "id1", "id2", "place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            id1, id2 = (batch.column(c).to_numpy() for c in ("id1", "id2"))
            for at, _, words in pieces(batch.column("text")):
                starts, hashes, _ = anchors(words, window)
                starts = starts[suspected(bits.value, hashes)] if len(starts) else starts
                if not len(starts):
                    continue
                text = words.text[starts]
                parts.append((words.runs().hash(starts, starts + window).view(np.int64),
                              (words.runs(1).hash(starts, starts + window) >> U(33)).astype(np.int64),
                              id1[at + text], id2[at + text], starts - words.first[text]))
                held += len(starts)
                if held >= FLUSH // 2:
                    yield out(parts)
                    parts, held = [], 0
        if held:
            yield out(parts)

    return run


def strip(window: int):
    """Replaces (text, places) by n_words, n_removed and kept_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            places = batch.column("places")
            for i, text in enumerate(batch.column("text")):
                words = text.as_buffer().to_pybytes().split()
                total.append(len(words))
                found = places[i].values.to_numpy() if places[i].is_valid else ()
                if len(found):
                    hit = cover(len(words), found >> 32, (found >> 32) + (found & 0xFFFFFFFF) + window - 1)
                    words = [w for w, gone in zip(words, hit.tolist()) if not gone]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            keep = [c for c in batch.schema.names if c not in ("text", "places")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                                   pa.array(kept, pa.binary()).cast(pa.string())],
                [*keep, "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """Columns `keep`, `n_words`, `n_removed` and `kept_text`, for every row.

    A word goes if a window that covers it also starts anywhere else, in this
    row or another; repeated rows are such another. Words are what white space
    divides, kept ones are joined by one space. Texts shorter than a window stay
    whole; null texts have no words and an empty kept_text. Kept columns named as
    results give way to them. An empty table stays empty.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ident = [F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("doc_id").cast("string"), text).alias(f"id{seed}")
             for seed in (1, 2)]
    texts = docs.select(*ident, text.alias("text"))
    bits = spark.sparkContext.broadcast(count_min(texts.select("text"), window))
    rows = texts.mapInArrow(window_rows(bits, window),
                            "h long, g int, id1 long, id2 long, place long, n int")
    seen = F.sum("n").over(Window.partitionBy("h", "g"))
    places = cut(rows.withColumn("seen", seen).where("n = 0 OR n = 1 AND seen > 1")
                 .groupBy("id1", "id2").agg(F.collect_set("place").alias("places")))
    kept, row = packed(keep, ("n_words", "n_removed", "kept_text"))
    read = docs.select(row, *ident, text.alias("text"))
    whole = read.join(places, ["id1", "id2"], "left").select("row", "text", "places")
    found = whole.mapInArrow(strip(window), schema_of(read, ["row"], "n_words long, n_removed long, kept_text string"))
    return found.select(*unpacked(kept), "n_words", "n_removed", "kept_text")
