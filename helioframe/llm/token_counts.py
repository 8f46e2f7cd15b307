"""Token totals for every context limit from one exact histogram of encoded lengths.

Texts are encoded whole by a public byte-level BPE whose ranks are read from a
file; only lengths leave the tasks. Documents of equal length are one row of the
histogram, so all that follows is as large as there are different lengths, not
documents. Suffix sums over it tell, for a context limit at any of them, how many
documents fit, how many tokens a cut at the limit keeps, and how many it loses;
a limit between two lengths is the next lower row plus a multiple of the
documents beyond it (`truncated`).

The pattern's engine holds a state for each character of a run of white space and
gives up at about a million. So long runs are cut where the pattern itself divides
them: all but the last character are one piece, or all of them at the text's end.

The sums run in blocks of lengths: within blocks side by side, and over one row
per block.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helioframe.llm.shared import cut, packed, schema_of, unpacked

#: The vocabulary, and the public pattern that it was made with.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the pattern's engine (fixed values), and the length from which a run is cut.
SPACE, CUT = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]", 1000
#: A length's block is its number of such lengths.
BLOCK = 1024
QUANTILES = (0.5, 0.9, 0.99)


def encoder(file: bytes):
    """The tokenizer of lines of base64 tokens and ranks."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def length(tokens, text: str, cut_at: int = CUT) -> int:
    """Tokens of a text."""
    total, at = 0, 0
    for run in re.finditer(f"{SPACE}{{{max(cut_at, 2)},}}", text):
        end = run.end() - (run.end() < len(text))
        total += len(tokens.encode_ordinary(text[at:run.start()]))
        total += len(tokens._encode_single_piece(text[run.start():end]))
        at = end
    return total + len(tokens.encode_ordinary(text[at:]))


def lengths(file: bytes):
    """Replaces text by n_tokens; strings of special tokens are ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(file)
        for batch in batches:
            found = [length(tokens, text.as_py() or "") for text in batch.column("text")]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(found, pa.int64())],
                                             [*keep, "n_tokens"])

    return run


def token_counts(docs: DataFrame, keep: Sequence[str], ranks_path: str = RANKS) -> DataFrame:
    """Columns `keep` and n_tokens of every whole text; null and empty texts have 0.

    The driver reads the vocabulary, about 1 MB, and sends it with the plan. A kept
    column named n_tokens gives way to the result's.
    """
    with open(ranks_path, "rb") as ranks:
        file = ranks.read()
    kept, row = packed(keep, ("n_tokens",))
    read = docs.select(row, F.col("text").cast("string").alias("text"))
    found = read.mapInArrow(lengths(file), schema_of(read, ["row"], "n_tokens long"))
    return found.select(*unpacked(kept), "n_tokens")


def histogram(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n_docs of every (`by`, n_tokens)."""
    return counts.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(lengths_: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For every length of a histogram, taken as a context limit:

    docs_to, tokens_to: documents that fit whole and their tokens; docs_beyond,
    tokens_beyond: longer ones; truncated_total: tokens left when every document
    is cut at the limit; lost: tokens cut off; share_to: the share of documents
    that fit, so that a quantile q is the least n_tokens with share_to >= q.
    Null values of `by` are a group; an empty histogram has no rows.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocked = lengths_.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = blocked.groupBy(*by, "block").agg(F.sum("n_docs").alias("block_docs"),
                                               F.sum(tokens).alias("block_tokens"))
    over = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = blocks.select(*by, "block", *[e for name in ("docs", "tokens") for e in (
        F.coalesce(F.sum(f"block_{name}").over(over), F.lit(0)).alias(f"{name}_before"),
        F.sum(f"block_{name}").over(whole).alias(f"{name}_all"))])
    inner = Window.partitionBy(*by, "block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    same = [f"h.{c} <=> b.{c}" for c in [*by, "block"]]
    placed = (blocked.withColumns({"docs_in": F.sum("n_docs").over(inner), "tokens_in": F.sum(tokens).over(inner)})
              .alias("h").join(sums.alias("b"), F.expr(" AND ".join(same)))
              .select("h.*", "docs_before", "docs_all", "tokens_before", "tokens_all"))
    docs_to, tokens_to = F.col("docs_before") + F.col("docs_in"), F.col("tokens_before") + F.col("tokens_in")
    docs_beyond = F.col("docs_all") - docs_to
    kept = tokens_to + F.col("n_tokens") * docs_beyond
    return placed.select(
        *by, "n_tokens", "n_docs", docs_to.alias("docs_to"), tokens_to.alias("tokens_to"),
        docs_beyond.alias("docs_beyond"), (F.col("tokens_all") - tokens_to).alias("tokens_beyond"),
        kept.alias("truncated_total"), (F.col("tokens_all") - kept).alias("lost"),
        (docs_to / F.col("docs_all")).alias("share_to"))


def quantiles(sums: DataFrame, at: Sequence[float] = QUANTILES, by: Sequence[str] = ()) -> DataFrame:
    """The exact quantiles of the lengths, from their suffix sums."""
    return sums.groupBy(*by).agg(*[F.min(F.when(F.col("share_to") >= q, F.col("n_tokens")))
                                   .alias(f"q{round(100 * q)}") for q in at])


def truncated(sums: DataFrame, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """Tokens left when every document is cut at any limit, from the suffix sums."""
    fit: Column = F.col("n_tokens") <= limit
    below = F.max_by(F.struct("tokens_to", "docs_beyond"), F.when(fit, F.col("n_tokens")))
    everything = F.max("docs_to")
    return sums.groupBy(*by).agg(below.alias("b"), everything.alias("n")).select(
        *by, (F.coalesce(F.col("b.tokens_to"), F.lit(0))
              + limit * F.coalesce(F.col("b.docs_beyond"), F.col("n"))).alias("truncated_total"))


def token_report(docs: DataFrame, by: Sequence[str] = (), ranks_path: str = RANKS) -> DataFrame:
    """Suffix sums of the encoded lengths of all documents, one row per length."""
    return suffix_sums(cut(histogram(token_counts(docs, by, ranks_path), by)), by)
