"""Structured Streaming mode of the estimate table.

Requests arrive as files (here: the driver's ``events`` Parquet, read as a file source with an
``availableNow`` trigger, so the stream runs to completion without a server). Each micro-batch
runs the *same* batch transform through ``foreachBatch`` — validation joins against static,
bounded dimensions are stateless per request — and appends to a Parquet table. Progress and
exactly-once bookkeeping live in a checkpoint folder under the cluster's checkpoint dir.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from farelake.session import ensure_checkpoint_dir


def run_file_stream(
    spark: SparkSession,
    source_dir: str,
    file_glob: str,
    schema,
    transform: Callable[[DataFrame], DataFrame],
    name: str,
    max_files_per_trigger: int = 1,
    base: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Drive a file-source stream through ``transform`` per micro-batch; return the output path.

    ``base`` names the stream's folder: run again on the same folder, it goes on after its last finished batch.
    ``prepare`` is applied to the stream itself, so it may hold keyed state."""
    base = base or os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_glob)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(source_dir)
    )

    stream = prepare(stream) if prepare else stream

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # Append is idempotent per epoch: a replayed epoch rewrites its own sub-folder.
        transform(batch).write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch_id}"))

    mode = "update" if prepare else "append"
    q = stream.writeStream.outputMode(mode).foreachBatch(write_batch).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


#: A session's state goes after so many days without a request, by the requests' own clock; requests that are later than
#: that are dropped.
KEEP_DAYS = 400


def newest_of_stream(requests: DataFrame, n: int = 20, keep_days: int = KEEP_DAYS) -> DataFrame:
    """J10 on a stream: keyed state holds the newest ``n`` requests of a session (request_id, ts; ties by id) and goes when the
    session is silent for ``keep_days``. Every change gives the session's whole list: session_id, position, request_id,
    ts_micros. A request that comes again (a replay) changes nothing."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        have = set(zip(*state.get)) if state.exists else set()
        for part in batches:
            have.update(zip(part["ts_micros"].tolist(), part["request_id"].tolist()))
            have = set(sorted(have, reverse=True)[:n])  # a batch at a time: never a whole session
        newest = sorted(have, reverse=True)
        state.update(([t for t, _ in newest], [r for _, r in newest]))
        state.setTimeoutTimestamp(max(newest[0][0] // 1000 + keep_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]] * len(newest), "position": range(1, len(newest) + 1), "request_id": [r for _, r in newest], "ts_micros": [t for t, _ in newest]})

    ts = F.col("ts").cast("timestamp")
    keyed = requests.select("session_id", "request_id", ts.alias("ts"), F.unix_micros(ts).alias("ts_micros"))
    keyed = keyed.filter("session_id IS NOT NULL AND request_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", f"{keep_days} days")
    out, held = "session_id long, position int, request_id long, ts_micros long", "ts array<long>, ids array<long>"
    return keyed.groupBy("session_id").applyInPandasWithState(update, out, held, "update", GroupStateTimeout.EventTimeTimeout)


def last_lists(spark: SparkSession, out: str) -> DataFrame:
    """Of every session, the list that its last batch wrote."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("session_id").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["session_id", "epoch"]).drop("epoch")
