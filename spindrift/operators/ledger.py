"""What lies in a context window, entry by entry, and checkpoints of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as X

EXPORT_BYTES = 8 << 20


def entries(notes: DataFrame, flags: DataFrame) -> DataFrame:
    """The newest note of each entry (id, seq, bucket, label, tokens, turn, ...), with its flags as the actions (id, seq, action) leave them.

    pin and evict undo each other; unpin and restore undo one each.  An entry that is noted again keeps its flags.
    """
    last = notes.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).where("_n = 1").drop("_n")
    flag = lambda on, off: F.coalesce(F.max_by(F.when(F.col("action") == on, True).when(F.col("action").isin(*off), False), F.when(F.col("action").isin(on, *off), F.col("seq"))), F.lit(False))
    state = flags.join(notes.groupBy("id").agg(F.min("seq").alias("first")), "id").where("seq > first").groupBy("id").agg(flag("pin", ("unpin", "evict")).alias("pinned"), flag("evict", ("restore", "pin")).alias("evicted"))
    return last.join(state, "id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False))).withColumn("evicted", F.coalesce("evicted", F.lit(False)))


def snapshot(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """session, bucket, tokens: entries that are not evicted by bucket, and as history the messages (session, call, text) that no entry accounts for."""
    held = entries.where("not evicted").groupBy("session", "bucket").agg(F.sum("tokens").alias("tokens"))
    accounted = entries.where("call is not null").select("session", "call").distinct()
    rest = messages.join(accounted, ["session", "call"], "left_anti").groupBy("session").agg(F.sum(X.estimated_tokens(F.col("text")) + 4).alias("tokens"))
    return held.unionByName(rest.withColumn("bucket", F.lit("history"))).groupBy("session", "bucket").agg(F.sum("tokens").alias("tokens"))


def ordered(entries: DataFrame, by: str = "session") -> DataFrame:
    """Entries with their place: newest turn, then highest score, then label."""
    return entries.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("turn"), F.desc(F.coalesce("score", F.lit(0.0))), "label", "id")))


def rewritten(messages: DataFrame, entries: DataFrame, render=None) -> DataFrame:
    """Messages (session, call, text, ...) as they are sent on: answers whose entries were evicted give a note, or what render makes of the rest.

    render is a DataFrame (session, call, text) of what is left of retrievals that were evicted in part.
    """
    gone = entries.where("call is not null").groupBy("session", "call").agg(F.sum(F.col("evicted").cast("int")).alias("lost"), F.count(F.lit(1)).alias("all"), F.max(F.col("bucket") == "files").alias("is_file")).where("lost > 0")
    left = render.select("session", "call", F.col("text").alias("rest")) if render is not None else gone.select("session", "call", F.lit(None).cast("string").alias("rest"))
    note = F.concat(F.lit("[") , F.col("lost").cast("string"), F.when(F.col("lost") == 1, " result").otherwise(" results"), F.lit(" evicted from context by the user]"))
    text = (
        F.when(F.col("lost").isNull(), F.col("text")).when(F.col("is_file"), "[file contents evicted from context by the user]")
        .when(F.col("lost") == F.col("all"), F.concat(F.lit("No results retained for this search.\n\n"), note)).when(F.col("rest").isNull(), "[retrieval results evicted from context by the user]").otherwise(F.concat("rest", F.lit("\n\n"), note))
    )
    return messages.join(gone, ["session", "call"], "left").join(left, ["session", "call"], "left").withColumn("text", text).drop("lost", "all", "is_file", "rest")


def pinned_block(entries: DataFrame) -> DataFrame:
    """session, block: pinned entries (label, lines, contents) as text for the system prompt."""
    fence = "`" * 3
    section = F.concat(F.lit("### "), F.concat_ws(":", "label", "lines"), F.lit(f"\n{fence}\n"), "contents", F.lit(f"\n{fence}"))
    head = "## Pinned context\nThe user pinned this code as always-relevant. Treat it as current.\n\n"
    parts = F.transform(F.sort_array(F.collect_list(F.struct("id", section.alias("s")))), lambda x: x["s"])
    return entries.where("pinned and contents is not null").groupBy("session").agg(F.concat(F.lit(head), F.array_join(parts, "\n\n")).alias("block"))


def changed_since(edits: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """session, path of edits (session, seq, path) after each session's checkpoint (session, seq)."""
    return edits.join(checkpoints.select("session", F.col("seq").alias("since")), "session").where("seq > since").select("session", "path").distinct()


def rewound(edits: DataFrame, checkpoints: DataFrame, current: DataFrame) -> DataFrame:
    """session, path, outcome, contents: what undoing all edits after a checkpoint, newest first, leaves of each path.

    An edit is undone only while the file is as it left it; from the first that is not, the path is kept ("skipped").  edits: session, seq, path, old, new
    (null: none); current: session, path, contents.
    """
    after = edits.join(checkpoints.select("session", F.col("seq").alias("since")), "session").where("seq > since")
    steps = F.sort_array(F.collect_list(F.struct((-F.col("seq")).alias("order"), "old", "new")))
    grouped = after.groupBy("session", "path").agg(steps.alias("steps")).join(current, ["session", "path"], "left")
    start = F.struct(F.col("contents").alias("now"), F.lit(True).alias("going"), F.lit(0).alias("undone"))

    def undo(s, e):
        fits = s["going"] & s["now"].eqNullSafe(e["new"])
        return F.struct(F.when(fits, e["old"]).otherwise(s["now"]).alias("now"), fits.alias("going"), (s["undone"] + fits.cast("int")).alias("undone"))

    done = grouped.withColumn("s", F.aggregate("steps", start, undo))
    return done.select("session", "path", F.when(F.col("s.undone") > 0, "restored").otherwise("skipped").alias("outcome"), F.col("s.now").alias("contents"))


def exported(checkpoints: DataFrame, most: int = EXPORT_BYTES) -> DataFrame:
    """The newest checkpoints (session, seq, size) of each session that fit the budget together; the first that does not ends the list."""
    used = F.sum("size").over(Window.partitionBy("session").orderBy(F.desc("seq")))
    return checkpoints.withColumn("used", used).where(F.col("used") <= most).drop("used")
