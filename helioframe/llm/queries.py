"""The corpus operators over the given tables, as the driver's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.llm import contamination, fuzzy_lines, hard_negatives, mixing, near_duplicates, private, quality, repeats, revisits, sharding, templates, token_counts, whitening
from helioframe.llm.oracle import ORACLE  # noqa: F401
from helioframe.llm.shared import WORD, cut, text_column


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _only(kind: str):
    return lambda k: F.when(k == kind, k)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document lies in windows of benchmark items, and of which."""
    found = contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                        ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes; sources weigh 3, 1, 2."""
    sizes = cut(table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.regexp_count(text_column(), F.lit(WORD)).cast("long").alias("n")))
    return mixing.mix(sizes, size=F.col("n")).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target",
        (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 35 words that also start elsewhere."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def captures(pages: DataFrame) -> DataFrame:
    """Web archive records from the pages: each page's response and its later revisits.

    Pages are captured a minute apart. A revisit spells the address otherwise;
    some servers send no tag or no validator, some pages have changed, some
    responses failed, and some revisits come before any response.
    """
    page, said = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    with_tag, with_time = page % 5 != 0, page % 10 != 0
    first = pages.select(
        (page * 4).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"),
        F.timestamp_seconds(1704067200 + page * 60).alias("at"),
        F.when(page % 13 == 7, 404).otherwise(200).alias("status"), said.alias("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"),
                     F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
                     F.lit("ETag"), F.when(with_tag, said),
                     F.lit("Last-Modified"), F.when(with_time, page.cast("string")),
                     F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"))
    times = F.filter(F.array(F.when(page % 11 == 5, 0), F.lit(1), F.lit(2)), lambda k: k.isNotNull())
    k, changed = F.col("k"), (page + F.col("k")) % 7 == 3
    later = pages.withColumn("k", F.explode(times)).select(
        (page * 4 + 1 + k).alias("record_id"), F.lit("revisit").alias("kind"),
        F.when(k == 1, F.concat("url", F.lit("#again")))
        .otherwise(F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"),
                            F.lit("utm_source=again"))).alias("uri"),
        F.timestamp_seconds(1704067200 + page * 60 + F.when(k == 0, -86400).otherwise(k * 86400)).alias("at"),
        F.lit(304).alias("status"), said.alias("digest"),
        F.create_map(F.lit("etag"), F.when(with_tag, F.concat(F.lit("W/"), said, F.when(changed, "x").otherwise(""))),
                     F.lit("last-modified"), F.when(with_time, page.cast("string")),
                     F.lit("Cache-Control"), F.concat(F.lit("max-age="), (k * 60).cast("string")),
                     F.lit("Expires"), F.concat(F.lit("day "), k.cast("string")),
                     F.lit("Content-Length"), F.lit("0")).alias("headers"))
    return first.unionByName(later)


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the pages, with the response it repeats and the merged headers."""
    found = revisits.resolve(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return found.select("record_id", "url", F.unix_seconds("at").alias("seconds"), "outcome", "response_id",
                        F.unix_seconds("response_at").alias("response_seconds"), "digest",
                        F.array_join(lines, "\n").alias("headers"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard on the bounded-load ring; counts are at most one apart."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text_column("text")) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_column("text"), "UTF-8")).alias("text_crc32"))
    return sharding.shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data, and terms that would give it away."""
    found = private.private_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*private.KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    return found.select("doc_id", *[F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("long")
                                    .alias(f"n_{k}") for k in private.KINDS],
                        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens within and beyond every encoded length that occurs."""
    return token_counts.token_report(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and whether base rules and outlier test keep it."""
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of every document repeat an earlier line, or nearly."""
    found = fuzzy_lines.fuzzy_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return templates.main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a hundredth of the embeddings and their nearest of one label, the nearest of others in a window."""
    entry = lambda c: c.cast("double")
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.when(usable, F.transform("embedding", lambda c: F.floor(entry(c) * 256.0))).alias("x"))
    return hard_negatives.mine(rows, F.col("x"), F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first 16 components, each of unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), ["vec_id"])


QUERIES = {"op1_decontamination": op1_decontamination, "op2_mixing": op2_mixing, "op3_substring_dedup": op3_substring_dedup,
           "op4_revisits": op4_revisits, "op5_sharding": op5_sharding, "op6_pii": op6_pii, "op7_token_counts": op7_token_counts,
           "op8_jaccard_join": op8_jaccard_join, "op9_quality": op9_quality,
           "op10_fuzzy_lines": op10_fuzzy_lines, "op11_html_extraction": op11_html_extraction,
           "op12_hard_negatives": op12_hard_negatives,
           "op13_whitening": op13_whitening}
