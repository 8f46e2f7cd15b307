"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (thirteen words, or the whole of a shorter item) are sets of
word shingles. A window is in a text only if all its shingles are, so with the
shingles in order of rarity over the corpus its prefix is one: the rarest. Only
prefixes are joined. The shingle's place in the window (positional bound) and
the text's length then fix where the window would lie, and the words there are
compared with the window's.

One pass over the texts finds which of the benchmark's shingles they hold and
where (a bitmap of fixed size drops the others inside the task; a join on the
hash drops the rest). Its counts give the rarity, its places the candidates. The
second pass verifies the candidates of each text. Shingles that most texts hold
are counted by partial sums and, being frequent, are hardly ever a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.shared import bitmap, cut, marked, packed, schema_of, unpacked
from helioframe.llm.words import ALNUM, cover, pieces

WINDOW, SHINGLE = 13, 5
#: A text with at least one word in 20 hit is contaminated.
SHARE = 20


def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words): every window of every item, words joined by one space."""
    for batch in batches:
        ids = batch.column("item_id")
        for at, _, words in pieces(batch.column("text"), ALNUM, lower=True):
            starts, ends = words.windows(WINDOW, whole=True)
            said = [words.word(i) for i in range(len(words.start))]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at + words.text[starts])),
                 pa.array([b" ".join(said[a:b]) for a, b in zip(starts, ends)], pa.binary()).cast(pa.string())],
                ["item_id", "words"])


def _shingles(words) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = words.windows(SHINGLE, whole=True)
    return starts, words.runs().hash(starts, ends)


def short_shingles(words, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of five words, and all runs of the sizes of shorter items."""
    found = [words.windows(size) for size in sizes]
    starts, ends = (np.concatenate(c) for c in zip(*found))
    return starts, words.runs().hash(starts, ends)


def window_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, words, n, shingle, place) of distinct windows."""
    for batch in batches:
        for at, _, words in pieces(batch.column("words"), ALNUM):
            starts, hashes = _shingles(words)
            text = words.text[starts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("window").take(pa.array(at + text)), batch.column("words").take(pa.array(at + text)),
                 pa.array(words.counts[text]), pa.array(hashes.view(np.int64)),
                 pa.array(starts - words.first[text])], ["window", "words", "n", "shingle", "place"])


def found_shingles(known: np.ndarray, sizes: list[int]):
    """(id1, id2, shingle, at): where texts may hold one of the marked shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id1, id2 = (batch.column(c).to_numpy() for c in ("id1", "id2"))
            for at, _, words in pieces(batch.column("text"), ALNUM, lower=True):
                starts, hashes = short_shingles(words, sizes)
                keep = marked(known, hashes)
                starts, text = starts[keep], words.text[starts[keep]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(id1[at + text]), pa.array(id2[at + text]), pa.array(hashes[keep].view(np.int64)),
                     pa.array((starts - words.first[text]).astype(np.int32))], ["id1", "id2", "shingle", "at"])

    return run


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces (text, candidates) by n_words, n_hit and the windows that occur."""
    for batch in batches:
        total, hits, windows = [], [], []
        candidates = batch.column("candidates")
        for at, to, words in pieces(batch.column("text"), ALNUM, lower=True):
            total += words.counts.tolist()
            for i in range(at, to):
                found: set[int] = set()
                starts, ends = [], []
                base, n = words.first[i - at], words.counts[i - at]
                for c in candidates[i].as_py() or ():
                    a, b = c["at"], c["at"] + c["n"]
                    # The length bound; then the words themselves.
                    if 0 <= a and b <= n and b" ".join(map(words.word, range(base + a, base + b))) \
                            == c["words"].encode():
                        found.add(c["window"])
                        starts.append(a)
                        ends.append(b)
                hits.append(int(cover(n, np.array(starts), np.array(ends)).sum()) if starts else 0)
                windows.append(sorted(found))
        keep = [c for c in batch.schema.names if c not in ("text", "candidates")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep] + [pa.array(total, pa.int64()), pa.array(hits, pa.int64()),
                                               pa.array(windows, pa.list_(pa.int64()))],
            [*keep, "n_words", "n_hit", "windows"])


RESULT = ("n_words", "n_hit", "n_items", "items", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep`, n_words, n_hit, n_items, items (their ids as sorted strings), contaminated.

    Words are ASCII letters (in lower case) and digits and all characters beyond
    ASCII. A text's word is hit if an item's window covers it. Null and empty
    texts have no words and are clean; items without words hit nothing. Repeated
    rows get equal results; items with one id count once, those without an id
    hit but aren't counted. Empty tables give empty or clean results. Kept columns
    named as results give way to them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = cut(benchmark.select("item_id", text.alias("text")).mapInArrow(
        item_windows, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, words string")
        .select(F.col("item_id").cast("string").alias("item_id"), "words",
                F.xxhash64("words").alias("window")).distinct())
    windows = cut(items.select("window", "words").distinct().mapInArrow(
        window_shingles, "window long, words string, n long, shingle long, place long"))
    sizes = sorted({SHINGLE} | {r.n for r in windows.where(F.col("n") < SHINGLE).select("n").distinct().collect()})

    ident = [F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("doc_id").cast("string"), text)
             .alias(f"id{seed}") for seed in (1, 2)]
    known = bitmap(windows.select("shingle"))
    places = cut(docs.select(*ident, text.alias("text"))
                 .mapInArrow(found_shingles(known, sizes), "id1 long, id2 long, shingle long, at int")
                 .join(windows.select("shingle").distinct(), "shingle", "left_semi"))
    rarity = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
    # A window with a shingle that no text holds is nowhere; else its rarest one is the prefix.
    prefixes = (windows.join(rarity, "shingle", "left").groupBy("window", "words", "n").agg(
        F.min_by(F.struct("shingle", "place"), F.struct(F.coalesce("seen", F.lit(0)), "shingle", "place"))
        .alias("prefix"), F.min(F.coalesce("seen", F.lit(0))).alias("least"))
        .where("least > 0").select("window", "words", "n", "prefix.*"))
    candidates = (places.join(prefixes, "shingle").where("at >= place")
                  .groupBy("id1", "id2").agg(F.collect_set(F.struct(
                      "window", F.col("n").cast("int").alias("n"),
                      (F.col("at") - F.col("place")).cast("int").alias("at"), "words")).alias("candidates")))
    kept, row = packed(keep, RESULT)
    read = docs.select(row, *ident, text.alias("text"))
    checked = cut(read.join(candidates, ["id1", "id2"], "left").select("row", "id1", "id2", "text", "candidates")
                  .mapInArrow(verify, schema_of(read, ["row", "id1", "id2"], "n_words long, n_hit long, windows array<long>")))
    hit = (checked.where("n_hit > 0").select("id1", "id2", F.explode("windows").alias("window"))
           .join(items.where("item_id IS NOT NULL").select("window", "item_id"), "window")
           .groupBy("id1", "id2").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    return checked.join(hit, ["id1", "id2"], "left").select(
        *unpacked(kept), "n_words", "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
