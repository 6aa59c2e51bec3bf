"""Change streams kept up with by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.operators.maintenance import last_operations

CHANGES = "seq long, path string, op string, ts timestamp"


def change_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """CHANGES from JSON files as they arrive in a folder."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).json(folder)


def keep_index(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1500 milliseconds"):
    """Starts a query that hands each micro-batch's last operation on each path to apply(frame, batch).

    apply must overwrite by path, as a batch may be repeated after a failure.
    """
    return changes.writeStream.foreachBatch(lambda batch, n: apply(last_operations(batch), n)).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def debounced(changes: DataFrame, quiet: str = "1500 milliseconds", late: str = "1 minute") -> DataFrame:
    """path, began, ended, n, op, seq of runs of changes without a longer pause, each event putting the end off; final once the watermark has passed."""
    return (
        changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq")).select("path", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n", "op", "seq")
    )


def live_index(store, scanned: DataFrame, changes: DataFrame, read: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame], checkpoint: str, every: str = "1500 milliseconds", quiet: str | None = None, late: str = "1 minute"):
    """Brings a store up to a scan, then keeps it so from a change stream; with quiet, from changes that no other of their path has followed for so long.

    read gives (path, contents, hash) of paths as they are now; a path that it no longer gives, unreadable or newly excluded, is taken out in the same batch.
    A batch that is repeated after a failure puts the same paths again.
    """
    store.update(scanned, cut)

    def apply(last: DataFrame, batch: int) -> None:
        last = last.persist()
        files = read(last.where("op != 'unlink'").select("path")).persist()
        gone = last.select("path").join(files.select("path"), "path", "left_anti")
        store.add(cut(files), files.select("path", "hash"), removed=gone)
        files.unpersist(), last.unpersist()

    return keep_index(changes if quiet is None else debounced(changes, quiet, late), apply, checkpoint, every)


def folded(events: DataFrame) -> DataFrame:
    """session, cursor, events, text: each session's state after every batch from events (session, seq, type, text).

    Events at or below the session's cursor are replays and change nothing; text pieces append.  A session's state is its whole text,
    as long as a session of its kind may be.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor, count, text = state.get if state.exists else (0, 0, "")
        rows = pd.concat(list(batches)).drop_duplicates("seq").sort_values("seq")
        fresh = rows[rows["seq"] > cursor]
        if len(fresh):
            cursor, count = int(fresh["seq"].iloc[-1]), count + len(fresh)
            text += "".join(fresh.loc[fresh["type"] == "text", "text"].fillna(""))
        state.update((int(cursor), int(count), text))
        yield pd.DataFrame([(key[0], cursor, count, text)], columns=["session", "cursor", "events", "text"])

    schema = "session string, cursor long, events long, text string"
    return events.groupBy("session").applyInPandasWithState(fold, schema, "cursor long, events long, text string", "update", GroupStateTimeout.NoTimeout)
