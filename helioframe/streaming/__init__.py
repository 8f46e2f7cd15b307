"""The same work on streams."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from helioframe.catalog import CATALOG, Catalog
from helioframe.operators.attempts import DEVICE, POLL, accepted, assemble, dispatch, graded, whole
from helioframe.operators.decode import decode_long
from helioframe.operators.messages import Outbox, deliver
from helioframe.sources.snapshots import stream_snapshot_files


def single_block_polls(dispatched: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """Reads of one-block drivers as whole polls, without grouping.

    Each good read is taken as its own poll, so the stream must hold the one
    read that counts (where retries are landed too, use `stream_assemble`).
    """
    return (dispatched.where("n_blocks = 1 AND ok AND attempt < max_attempts").where(whole())
            .select(*POLL, *DEVICE, *[F.when(F.col("block") == k, F.col("registers"))
                                      .alias(f"registers_{k}") for k in catalog.block_numbers()]))


#: Polls are kept in so many buckets by hash, for a call a bucket and batch instead of one a poll.
BUCKETS = 4096
STATE = "polls binary"


def first_attempts(dispatched: DataFrame, delay: str = "10 minutes", catalog: Catalog = CATALOG) -> DataFrame:
    """The read that counts of every poll and block, as soon as it is certain, in append mode.

    The same reads as `attempts.choose_attempt`. State holds, per poll and block, the best read
    so far and the attempts seen. It is given out once, when every earlier attempt has been seen
    to fail, or when the watermark passes the poll by `delay`; until then later copies add
    nothing. Reads that come after that are late and dropped by Spark. The polls of a bucket
    share one state, which holds those of the last `delay` only.
    """
    keys = [*POLL, *DEVICE, "n_blocks", "block"]
    shape = dispatched.select(*keys, "attempt", "registers").schema
    told = T.StructType([T.StructField(f.name, T.LongType() if f.name == "poll_ts" else f.dataType) for f in shape if f.name in keys])
    # A key as text is exact and, unlike numbers with nulls, stays so in pandas.
    key = F.to_json(F.struct(*[F.unix_micros(c).alias(c) if c == "poll_ts" else F.col(c) for c in keys]))
    rank = (dispatched.where("attempt < max_attempts").withWatermark("poll_ts", delay)
            .select("poll_ts", key.alias("key"), "attempt", F.coalesce("ok", F.lit(False)).alias("ok"), "registers", "max_attempts",
                    accepted(catalog).alias("good"), F.coalesce(F.unix_millis("poll_ts"), F.lit(0)).alias("at"))
            .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")))

    def choose(_, frames, state):
        # A poll that is done is the time when it closes; others are what is known of them.
        polls = pickle.loads(zlib.decompress(state.get[0])) if state.exists else {}
        now, met, chosen = state.getCurrentWatermarkMs(), set(), []
        for frame in () if state.hasTimedOut else frames:
            for k, a, ok, registers, most, good, at in zip(*(frame[c] for c in (
                    "key", "attempt", "ok", "registers", "max_attempts", "good", "at"))):
                met.add(k)
                # A poll without a time waits no longer than the watermark takes to move.
                closes, one = max(at, now + 1), polls.get(k)
                if isinstance(one, int):
                    polls[k] = closes
                    continue
                seen, _, _, best, kept = one or (0, 0, 0, None, None)
                mine = (not good, a if good else -a)
                if ok and (best is None or mine < best):
                    best, kept = mine, registers
                polls[k] = (seen | 1 << a, most, closes, best, kept)
        for k in met:
            if isinstance(polls[k], int):
                continue
            seen, most, closes, best, kept = polls[k]
            # An accepted read is certain once all before it are known; a refused one once all are.
            before = 0 if best is None else (1 << (most if best[0] else best[1])) - 1
            if best is not None and seen & before == before:
                chosen.append((k, abs(best[1]), kept))
                polls[k] = closes
            elif isinstance(kept, np.ndarray):
                # Words of a list with nulls are doubles in pandas; a copy lets the batch go.
                polls[k] = (seen, most, closes, best, kept.copy())
        for k in [k for k, one in polls.items() if k not in met and (one if isinstance(one, int) else one[2]) < now]:
            one = polls.pop(k)
            if not isinstance(one, int) and one[3] is not None:
                chosen.append((k, abs(one[3][1]), one[4]))
        if polls:
            state.update((zlib.compress(pickle.dumps(polls), 1),))
            state.setTimeoutTimestamp(min(one if isinstance(one, int) else one[2] for one in polls.values()))
        else:
            state.remove()
        if chosen:
            yield pd.DataFrame({"key": [k for k, _, _ in chosen], "attempt": [a for _, a, _ in chosen], "registers": [
                [None if pd.isna(x) else int(x) for x in kept] if isinstance(kept, np.ndarray) and kept.dtype.kind != "i" else kept
                for _, _, kept in chosen]})

    found = (rank.groupBy("bucket").applyInPandasWithState(
        choose, "key string, attempt int, registers array<int>", STATE, "append", "EventTimeTimeout")
             .select(F.from_json("key", told).alias("key"), "attempt", "registers").select("key.*", "attempt", "registers"))
    return (found.withColumn("poll_ts", F.timestamp_micros("poll_ts"))
            .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape]))


def stream_decode(reads: DataFrame, devices: DataFrame, catalog: Catalog = CATALOG,
                  delay: str | None = None) -> DataFrame:
    """Decode of one-block drivers, in append mode.

    Without `delay` it keeps no state, and the stream must hold the one read of a poll that
    counts. With `delay`, retries may be landed as well: see `first_attempts`.
    """
    dispatched = dispatch(reads, devices, catalog)
    if delay is not None:
        few = dispatched.where("n_blocks = 1")
        chosen = first_attempts(few, delay, catalog)
        blocks = catalog.blocks_frame(reads.sparkSession).select("driver", "block", "max_attempts", "min_size", "present", "paired")
        dispatched = chosen.withColumn("ok", F.lit(True)).join(F.broadcast(blocks), ["driver", "block"])
    return decode_long(single_block_polls(dispatched, catalog), catalog)


def stream_polls(reads: DataFrame, devices: DataFrame, delay: str = "10 minutes",
                 catalog: Catalog = CATALOG) -> DataFrame:
    """Every poll once the watermark has passed it, whole or not, in append mode.

    One grouping serves records and rejects alike (see `attempts.graded`): write it once, and
    take `decode_long`, `records` and `attempts.rejects` from the table. What comes later than
    `delay` is found afterwards, by `attempts.late_reads`.
    """
    waiting = reads.withWatermark("poll_ts", delay)
    return graded(dispatch(waiting, devices, catalog), catalog)


def stream_assemble(reads: DataFrame, devices: DataFrame, delay: str = "10 minutes",
                    catalog: Catalog = CATALOG) -> DataFrame:
    """Choose attempts and assemble polls of any driver, in append mode.

    State holds the polls of the last `delay` only. A poll is emitted when the
    watermark passes it, or dropped if it is not whole by then; `stream_polls` keeps
    those as well, with what is wrong.
    """
    waiting = reads.withWatermark("poll_ts", delay)
    return decode_long(assemble(dispatch(waiting, devices, catalog), catalog), catalog)


def stream_snapshots(spark: SparkSession, path: str, schema: str, delay: str = "1 hour",
                     max_files: int | None = None) -> DataFrame:
    """Records from files named by run; one that is delivered again adds nothing.

    For files as `sinks.write_snapshot_files` writes them: names tell runs apart.

    A record is known by file name, line and place, so equal records of two reads
    both stay. Files known from earlier batches are left out by name; state only
    keeps what was read within `delay` of the wall clock, for copies of a file in
    one batch. Time is that of the batch, so no record is ever late and the rows
    are the same for any `max_files`, which bounds a micro-batch while catching
    up. Torn text is a row with `_corrupt_record`.
    """
    records = (stream_snapshot_files(spark, path, schema, max_files)
               .withColumn("read_ts", F.current_timestamp()).withWatermark("read_ts", delay))
    return records.dropDuplicatesWithinWatermark(["file_name", "line", "place"])


def stream_messages(records: DataFrame, brokers: DataFrame,
                    publish: Callable[[int, Row, DataFrame], None],
                    checkpoint: str, outbox: str | None = None) -> StreamingQuery:
    """Send the messages of each micro-batch, one try per broker and batch.

    `publish(batch_id, broker, messages)` may see a batch again after a failure;
    the batch id lets it recognise that. With `outbox`, a folder, a broker's messages
    are kept until it has taken them: each batch offers the older ones first, and
    `messages.Outbox.deliver` without records offers what is left at the end.
    """
    def send(batch: DataFrame, batch_id: int) -> None:
        if outbox is not None:
            Outbox(batch.sparkSession, outbox).deliver(batch_id, batch, brokers, publish)
        else:
            deliver(batch, brokers, lambda broker, messages: publish(batch_id, broker, messages))

    return (records.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_runs(reads: DataFrame, read_devices: Callable[[], DataFrame],
                write: Callable[[DataFrame, int], None], checkpoint: str, catalog: Catalog = CATALOG,
                on: tuple[str, ...] = ("device_name",)) -> StreamingQuery:
    """Each micro-batch against the registry as it is read for that batch.

    `read_devices` is called for every batch, so a device that a new file switches off or adds
    counts from the next batch on; `registry.versioned` entries count by the poll's time instead.
    `write(dispatched, batch_id)` gets the dispatched reads of the batch.
    """
    def send(batch: DataFrame, batch_id: int) -> None:
        write(dispatch(batch, read_devices(), catalog, on), batch_id)

    return (reads.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_table(stream: DataFrame, path: str, checkpoint: str, plain: tuple[str, ...] = ()) -> StreamingQuery:
    """Append what is available now to a parquet table, exactly once.

    Columns in `plain` are written without a dictionary, which costs time where most values differ.
    """
    written = {f"parquet.enable.dictionary#{c}": "false" for c in plain}
    return (stream.writeStream.format("parquet").outputMode("append").options(**written)
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
