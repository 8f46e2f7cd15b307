"""From landed read attempts to one whole poll per device and tick.

One shuffle does all of it. `assemble` groups once by poll and keeps, per block
number, the read that counts; Spark combines on the map side, so of all attempts
of a poll only one read per block and task crosses the network. The poll id is
part of the key, so a device with most of the rows still spreads evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.catalog import CATALOG, Catalog
from helioframe.operators.lookup import lookup_join
from helioframe.operators.registry import enabled

POLL = ["poll_id", "device_name", "poll_ts"]
DEVICE = ["config", "position", "measurement", "driver"]


def dispatch(reads: DataFrame, devices: DataFrame, catalog: Catalog = CATALOG,
             on: tuple[str, ...] = ("device_name",)) -> DataFrame:
    """Attach to each read its enabled device and the block it belongs to.

    Reads of devices that are off, of unknown drivers and of blocks the driver
    does not have are dropped. Names need not be unique across configurations:
    where reads also carry `config` and `position`, pass them in `on`. Where the
    devices are `registry.versioned`, the entry counts that held at the poll's time.
    """
    spark = reads.sparkSession
    times = [c for c in ("valid_from", "valid_to") if c in devices.columns]
    registry = (enabled(devices).withColumnRenamed("name", "device_name")
                .select("device_name", *DEVICE, *times))
    blocks = catalog.blocks_frame(spark).drop("kind", "start", "count", "accept")
    # Catalogue tables are local and a few hundred rows.
    known = registry.join(F.broadcast(catalog.versions_frame(spark)), "driver", "left_semi")
    found = lookup_join(reads, known, list(on), "poll_id")
    if times:
        found = found.where("poll_ts >= valid_from AND (valid_to IS NULL OR poll_ts < valid_to)").drop(*times)
    return found.join(F.broadcast(blocks), ["driver", "block"])


def _narrow(words: Column) -> list[Column]:
    """Words as two bytes each in `narrow`, or as they are in `wide` where one is null or larger."""
    fit = F.forall(words, lambda w: F.coalesce(w.between(0, 65535), F.lit(False)))
    narrow = F.transform(words, lambda w: (w - 32768).cast("smallint"))
    return [F.when(fit, narrow).alias("narrow"), F.when(~fit, words).alias("wide")]


def address_blocks(spans: DataFrame, devices: DataFrame, catalog: Catalog = CATALOG,
                   on: tuple[str, ...] = ("device_name",), usable: bool = False) -> DataFrame:
    """Reads known by address instead of block, as `dispatch` gives reads of blocks.

    `spans` has `kind` (input or holding) and `start`, the address of the first word, in
    place of `block`. A span may hold part of a block, several blocks, or words of none. The
    parts of a block that came with one try are stitched: they are taken in order of address, where they
    overlap the first one counts, and a block with a gap is not there. Blocks are found by
    (driver, kind) and overlap, a join with the catalogue's few hundred rows that moves no
    reads. The parts of a poll then come together once; stitching them, and what groups by poll
    afterwards, needs no further shuffle. With `usable`, tries that failed or are
    beyond the allowed number are left out before that, for those who only choose among reads.
    """
    blocks = catalog.blocks_frame(spans.sparkSession).drop("accept")
    registry = enabled(devices).withColumnRenamed("name", "device_name").select("device_name", *DEVICE)
    known = registry.join(F.broadcast(blocks.select("driver").distinct()), "driver", "left_semi")
    found = lookup_join(spans, known, list(on), "poll_id").withColumnRenamed("start", "first")
    size = F.coalesce(F.size("registers"), F.lit(0))
    good = F.col("ok") & (size > 0)
    # A try that failed has no words: it stands for the block that holds its first address.
    held = found.join(F.broadcast(blocks), ["driver", "kind"]).where(
        (F.col("first") < F.col("start") + F.col("count")) & (F.col("first") + F.greatest(size, F.lit(1)) > F.col("start")))
    if usable:
        held = held.where(good & (F.col("attempt") < F.col("max_attempts")))
    offset = F.col("first") - F.col("start")
    words = F.slice("registers", F.greatest(F.lit(1), 1 - offset).cast("int"),
                    F.least(F.col("count"), F.col("count") - offset).cast("int"))
    parts = held.select(*POLL, *DEVICE, "block", "attempt", F.greatest(offset, F.lit(0)).alias("at"), F.when(good, words).alias("words"))
    # By poll alone, which all that follows can use. What the catalogue says of a block is joined again, not moved.
    parts = parts.select(*POLL, *DEVICE, "block", "attempt", "at", *_narrow(F.col("words"))).repartition(*POLL)
    words = F.coalesce(F.transform("narrow", lambda w: w.cast("int") + 32768), "wide")
    piece = F.when(F.col("narrow").isNotNull() | F.col("wide").isNotNull(), F.struct("at", words.alias("words")))
    joined = (parts.groupBy(*POLL, *DEVICE, "block", "attempt").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
              .join(F.broadcast(blocks.drop("kind", "start")), ["driver", "block"]))
    stitched = F.expr("""aggregate(pieces, cast(array() AS array<int>), (have, p) ->
        if(p.at <= size(have), concat(have, slice(p.words, size(have) - p.at + 1, size(p.words))), have))""")
    told = joined.withColumn("registers", stitched).withColumn("ok", F.size("registers") >= F.col("count"))
    extra = [c for c in blocks.columns if c not in ("driver", "block", "kind", "start", "count")]
    return (told.withColumn("registers", F.when(F.col("ok"), F.col("registers")))
            .select(*POLL, *DEVICE, "block", "attempt", "ok", "registers", *extra))


def accepted(catalog: Catalog = CATALOG) -> Column:
    """Whether a read passes the accept rule of its block; true where there is none."""
    rules = [f"WHEN driver = '{d.name}' AND block = {b.block} THEN coalesce({b.accept}, false)"
             for d in catalog for b in d.blocks if b.accept]
    return F.expr(f"CASE {' '.join(rules)} ELSE true END") if rules else F.lit(True)


def whole() -> Column:
    """Whether a read holds every word its rules need (bounds from `blocks_frame`)."""
    return F.expr("""size(registers) >= min_size
        AND forall(present, i -> get(registers, i) IS NOT NULL)
        AND forall(paired, i -> coalesce(get(registers, i) BETWEEN 0 AND 65535, false))""")


def _usable(dispatched: DataFrame) -> DataFrame:
    return dispatched.where("ok AND attempt < max_attempts")


def _rank(catalog: Catalog) -> Column:
    # Accepted reads first, earliest ahead; without one, the latest read wins.
    good = accepted(catalog)
    return F.struct((~good).alias("refused"),
                    F.when(good, F.col("attempt")).otherwise(-F.col("attempt")).alias("turn"))


def choose_attempt(dispatched: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """The read that counts, per poll and block.

    It is the first successful attempt among the driver's allowed number. For a
    block with an accept rule it is the first accepted one, or the latest
    successful one if none was accepted.
    """
    best = F.min(F.struct(_rank(catalog).alias("rank"), "attempt", "registers"))
    return (_usable(dispatched).groupBy(*POLL, "block", *DEVICE).agg(best.alias("best"))
            .select(*POLL, *DEVICE, "block", "best.attempt", "best.registers"))


def _polls(dispatched: DataFrame, catalog: Catalog) -> DataFrame:
    """One row per poll: the read that counts of block k in `read_k`, if any."""
    best = [F.expr(f"min(CASE WHEN block = {k} THEN read END) AS read_{k}")
            for k in catalog.block_numbers()]
    read = F.struct(_rank(catalog).alias("rank"), whole().alias("whole"), "registers")
    return (_usable(dispatched)
            .select(*POLL, *DEVICE, "n_blocks", "block", read.alias("read"))
            .groupBy(*POLL, *DEVICE, "n_blocks").agg(*best))


def _total(flag: str, catalog: Catalog) -> str:
    return " + ".join(f"CAST(coalesce({flag.format(k=k)}, false) AS INT)"
                      for k in catalog.block_numbers())


def assemble(dispatched: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """One row per whole poll, with the registers of block k in `registers_k`.

    A poll is whole when every block of its driver has a read that counts and
    each of these holds the words its rules need; others give no row.
    """
    return (_polls(dispatched, catalog)
            .where(f"{_total('read_{k}.whole', catalog)} = n_blocks")
            .selectExpr(*POLL, *DEVICE, *[f"read_{k}.registers AS registers_{k}"
                                          for k in catalog.block_numbers()]))


def unusable_polls(dispatched: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """Polls that were read in full but hold words no rule can take, with the blocks.

    They give no record; here they are kept as rejects while others go on.
    """
    bad = ", ".join(f"CASE WHEN read_{k} IS NOT NULL AND NOT coalesce(read_{k}.whole, false) "
                    f"THEN {k} END" for k in catalog.block_numbers())
    return (_polls(dispatched, catalog)
            .where(f"{_total('read_{k} IS NOT NULL', catalog)} = n_blocks")
            .selectExpr(*POLL, *DEVICE, f"array_compact(array({bad})) AS blocks")
            .where("size(blocks) > 0"))


def complete_polls(dispatched: DataFrame) -> DataFrame:
    """Polls with at least one good read for every block of their driver."""
    return (_usable(dispatched)
            .groupBy(*POLL, *DEVICE, "n_blocks").agg(_blocks_seen().alias("seen"))
            .where(F.bit_count("seen") == F.col("n_blocks")).drop("seen", "n_blocks"))


def _blocks_seen() -> Column:
    # A bit per block number: a distinct count that still combines on the map side.
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("block")))


def drop_failed(dispatched: DataFrame) -> DataFrame:
    """Reads of complete polls only; one pass, one shuffle. A poll without a stamp is one too."""
    good = F.expr("CASE WHEN ok AND attempt < max_attempts THEN shiftleft(1L, block) END")
    seen = F.bit_or(good).over(Window.partitionBy(*POLL, *DEVICE, "n_blocks"))
    return (dispatched.withColumn("seen", seen)
            .where(F.bit_count("seen") == F.col("n_blocks")).drop("seen"))


def read_failures(dispatched: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """Blocks of a poll that no allowed attempt could read, with the tries made.

    One pass: a poll is seen through any of its reads, each expected block is
    looked up in what was counted per block, and blocks never tried count 0.
    """
    tried, expected = [], []
    for k in catalog.block_numbers():
        owners = ", ".join(f"'{d.name}'" for d in catalog if k in d.block_numbers())
        expected.append(f"CASE WHEN driver IN ({owners}) THEN {k} END")
        tried.append(f"""struct({k} AS block,
            count_if(block = {k} AND attempt < max_attempts) AS attempts,
            count_if(block = {k} AND attempt < max_attempts AND ok) AS good)""")
    polls = dispatched.groupBy(*POLL, *DEVICE).agg(
        F.expr(f"array({', '.join(tried)})").alias("tried"))
    missing = F.expr(f"""inline(filter(tried, t ->
        t.good = 0 AND array_contains(array_compact(array({', '.join(expected)})), t.block)))""")
    return polls.select(*POLL, *DEVICE, missing).drop("good")


def graded(dispatched: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """Every poll once, by one grouping: its registers where it is whole, else what is wrong.

    `outcome` is `whole`, `unusable` (read in full, but some word can't be taken) or `torn`
    (a block that no allowed attempt could read); `blocks` are the blocks concerned, with the
    tries made for each in `tries`. `n_reads` counts the reads seen, those beyond the allowed
    number included. Works on streams with a watermark on poll_ts.
    """
    numbers = catalog.block_numbers()
    read = F.struct(_rank(catalog).alias("rank"), whole().alias("whole"), "registers")
    counts = dispatched.select(*POLL, *DEVICE, "n_blocks", "block", "attempt", "max_attempts",
                               F.when(F.expr("ok AND attempt < max_attempts"), read).alias("read"))
    polls = counts.groupBy(*POLL, *DEVICE, "n_blocks").agg(
        F.count(F.lit(1)).alias("n_reads"),
        *[F.expr(f"min(CASE WHEN block = {k} THEN read END) AS read_{k}") for k in numbers],
        *[F.expr(f"count_if(block = {k} AND attempt < max_attempts) AS tries_{k}") for k in numbers])
    owners = {k: ", ".join(f"'{d.name}'" for d in catalog if k in d.block_numbers()) for k in numbers}

    def where(wrong: str) -> str:
        return "array_compact(array(" + ", ".join(
            f"CASE WHEN driver IN ({owners[k]}) AND {wrong.format(k=k)} THEN struct({k} AS block, tries_{k} AS tries) END"
            for k in numbers) + "))"

    told = polls.withColumns({"torn": F.expr(where("read_{k} IS NULL")),
                              "bad": F.expr(where("read_{k} IS NOT NULL AND NOT coalesce(read_{k}.whole, false)"))})
    outcome = F.expr("CASE WHEN size(torn) > 0 THEN 'torn' WHEN size(bad) > 0 THEN 'unusable' ELSE 'whole' END")
    told = told.withColumn("outcome", outcome).withColumn("wrong", F.expr("if(size(torn) > 0, torn, bad)"))
    return told.selectExpr(*POLL, *DEVICE, "n_reads", "outcome", "wrong.block AS blocks", "wrong.tries AS tries",
                           *[f"CASE WHEN outcome = 'whole' THEN read_{k}.registers END AS registers_{k}" for k in numbers])


def rejects(polls: DataFrame) -> DataFrame:
    """One row for each block that keeps a graded poll from being whole, with its tries."""
    return (polls.where("outcome <> 'whole'")
            .select(*POLL, *DEVICE, "outcome", F.explode(F.arrays_zip("blocks", "tries")).alias("x"))
            .select(*POLL, *DEVICE, "outcome", F.col("x.blocks").alias("block"), F.col("x.tries").alias("attempts")))


def late_reads(reads: DataFrame, polls: DataFrame) -> DataFrame:
    """Landed reads of polls that were closed without all of them: what a stream had to leave out.

    `polls` are the graded polls of a stream over `reads` (see `streaming.stream_polls`), by then
    closed. A poll closed with fewer reads than have landed has late ones; which of its reads they
    were isn't known, so all of them are listed, with the number missing. Polls that a stream has
    never seen count when they are older than the youngest closed one.
    """
    landed = reads.groupBy("poll_id", "device_name", "poll_ts").agg(F.count(F.lit(1)).alias("n_landed"))
    until = polls.agg(F.max("poll_ts").alias("until"))
    seen = polls.groupBy("poll_id", "device_name", "poll_ts").agg(F.max("n_reads").alias("n_seen"))
    short = (landed.join(seen, ["poll_id", "device_name", "poll_ts"], "left").crossJoin(F.broadcast(until))
             .where("coalesce(n_seen, 0) < n_landed AND poll_ts <= until")
             .select("poll_id", "device_name", "poll_ts", (F.col("n_landed") - F.coalesce("n_seen", F.lit(0))).alias("n_late")))
    return reads.join(short, ["poll_id", "device_name", "poll_ts"])


def attempt_stats(reads: DataFrame) -> DataFrame:
    """Tries and failed tries per device and block."""
    return reads.groupBy("device_name", "block").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count(F.when(~F.col("ok"), 1)).alias("failed"),
        F.max("attempt").alias("last_attempt"))
