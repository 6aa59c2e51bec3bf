"""Event logs, transcripts and what occupies a context window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as X


def chain_hash(seq: Column, ts: Column, kind: Column, data: Column, before: Column) -> Column:
    return F.sha2(F.concat_ws("|", seq.cast("string"), ts, kind, data, before), 256)


def chained_breaks(log: DataFrame, stretch: int = 4096, check_hash: bool = True) -> DataFrame:
    """seq, reason of the first record of a log (seq, ts, type, data, prev, hash) that breaks the chain.

    Each record needs its predecessor only.  Records are dealt in stretches of numbers, each with the
    last of the stretch before it, so no task holds the whole log.
    """
    at = F.floor((F.col("seq") - 1) / stretch)
    own = log.withColumn("stretch", at).withColumn("own", F.lit(True))
    lead = log.withColumn("stretch", at + 1).withColumn("own", F.lit(False)).where(F.col("seq") % stretch == 0)
    order = Window.partitionBy("stretch").orderBy("seq")
    checked = own.unionByName(lead).withColumn("before_seq", F.lag("seq").over(order)).withColumn("before_hash", F.lag("hash").over(order)).where("own")
    reason = (
        F.when(F.col("before_seq").isNull() & (F.col("seq") != 1), "gap").when(F.col("before_seq").isNotNull() & (F.col("seq") != F.col("before_seq") + 1), "gap")
        .when(F.col("prev") != F.coalesce("before_hash", F.lit("")), "link").when(F.lit(check_hash) & (F.col("hash") != chain_hash(F.col("seq"), F.col("ts"), F.col("type"), F.col("data"), F.col("prev"))), "hash")
    )
    return checked.withColumn("reason", reason).where("reason is not null").orderBy("seq").limit(1).select("seq", "reason")


def chained(records: Column) -> Column:
    """Records (an array of seq, ts, type, data in order) with prev and hash, each hash taking in the one before."""
    one = lambda r, before: F.struct(r["seq"].alias("seq"), r["ts"].alias("ts"), r["type"].alias("type"), r["data"].alias("data"), before.alias("prev"), chain_hash(r["seq"], r["ts"], r["type"], r["data"], before).alias("hash"))
    start = F.array().cast("array<struct<seq:bigint,ts:string,type:string,data:string,prev:string,hash:string>>")
    return F.aggregate(records, start, lambda s, r: F.concat(s, F.array(one(r, F.coalesce(F.try_element_at(s, F.lit(-1))["hash"], F.lit(""))))))


def chain_breaks(log: DataFrame, by: str) -> DataFrame:
    """by, seq, reason of the first record of each of many logs that breaks its chain; a log may begin at any number."""
    order = Window.partitionBy(by).orderBy("seq")
    checked = log.withColumn("before_seq", F.lag("seq").over(order)).withColumn("before_hash", F.lag("hash").over(order))
    hashed = chain_hash(F.col("seq"), F.col("ts"), F.col("type"), F.col("data"), F.col("prev"))
    reason = F.when(F.col("seq") != F.col("before_seq") + 1, "gap").when(F.col("prev") != F.coalesce("before_hash", F.lit("")), "link").when(F.col("hash") != hashed, "hash")
    return checked.withColumn("reason", reason).where("reason is not null").groupBy(by).agg(F.min("seq").alias("seq"), F.min_by("reason", "seq").alias("reason"))


def repeated_calls(events: DataFrame, least: int = 2) -> DataFrame:
    """Events whose signature stood before in their session, with how often so far."""
    order = Window.partitionBy("session", "signature").orderBy("seq")
    return events.withColumn("times", F.row_number().over(order)).where(F.col("times") >= least)


def message_tokens(text: Column) -> Column:
    """Estimated tokens of a message, with four for its frame."""
    return X.estimated_tokens(text) + 4


def buckets(messages: DataFrame) -> DataFrame:
    """conv_id, bucket, tokens, share: what fills each conversation's window."""
    bucket = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "assistant").otherwise("history")
    sums = messages.groupBy("conv_id", bucket.alias("bucket")).agg(F.sum(message_tokens(F.col("text"))).alias("tokens"))
    return sums.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("conv_id")))


def compacted(messages: DataFrame, budget: int) -> DataFrame:
    """conv_id, turn of the messages kept: the first user message and the longest tail within the budget, one message at least.

    Conversations of at most two messages or within the budget stay whole.
    """
    whole = Window.partitionBy("conv_id")
    counted = messages.withColumn("tokens", message_tokens(F.col("text"))).withColumn("all", F.sum("tokens").over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(whole)
    marked = counted.withColumn("first", first).withColumn("head", F.coalesce(F.col("turn") == F.col("first"), F.lit(False)))
    base = F.coalesce(F.sum(F.when(F.col("head"), F.col("tokens"))).over(whole), F.lit(0))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rest = F.sum(F.when(F.col("head"), 0).otherwise(F.col("tokens"))).over(back)
    place = F.sum(F.when(F.col("head"), 0).otherwise(1)).over(back)
    keep = (F.col("n") <= 2) | (F.col("all") <= budget) | F.col("head") | (F.col("place") == 1) | (F.col("base") + F.col("rest") <= budget)
    return marked.withColumn("base", base).withColumn("rest", rest).withColumn("place", place).where(keep).select("conv_id", "turn")


def replayed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, user_turn, event of a transcript as events: a prompt opens a turn, other messages belong to it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    event = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "text").otherwise("context")
    return messages.withColumn("user_turn", F.sum((F.col("role") == "user").cast("int")).over(order)).select("conv_id", "turn", "user_turn", event.alias("event"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """id, path, hunk, line, text of the lines that unified diffs (id, diff) add, with their numbers in the new file."""
    rows = diffs.select("id", F.posexplode(F.split("diff", "\n")).alias("pos", "raw"))
    order = Window.partitionBy("id").orderBy("pos")
    path = F.last(F.when(F.col("raw").startswith("+++ "), F.regexp_replace(F.substr("raw", F.lit(5)), "^b/", "")), ignorenulls=True).over(order)
    hunk = F.sum(F.col("raw").startswith("@@").cast("int")).over(order)
    begin = F.last(F.when(F.col("raw").startswith("@@"), F.regexp_extract("raw", r"\+(\d+)", 1).cast("int")), ignorenulls=True).over(order)
    marked = rows.withColumn("path", path).withColumn("hunk", hunk).withColumn("begin", begin)
    body = ~F.col("raw").startswith("@@") & ~F.col("raw").startswith("+++") & ~F.col("raw").startswith("---") & ~F.col("raw").startswith("-") & ~F.col("raw").startswith("diff ") & (F.col("hunk") > 0)
    here = Window.partitionBy("id", "hunk").orderBy("pos")
    counted = marked.withColumn("line", F.col("begin") + F.sum(body.cast("int")).over(here) - 1)
    return counted.where(F.col("raw").startswith("+") & ~F.col("raw").startswith("+++") & (F.col("hunk") > 0)).select("id", "path", "hunk", "line", F.substr("raw", F.lit(2)).alias("text"))


def without_orphans(kept: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, calls array<string>, answers string) without tool answers whose call is gone, and without calls that no answer is left to."""
    calls = kept.where("role = 'assistant'").select("conv_id", F.explode("calls").alias("answers"))
    answered = kept.where("role != 'tool' or answers is null").unionByName(kept.where("role = 'tool' and answers is not null").join(calls.distinct(), ["conv_id", "answers"], "left_semi"))
    given = answered.where("role = 'tool'").groupBy("conv_id").agg(F.collect_set("answers").alias("given"))
    left = answered.join(given, "conv_id", "left")
    return left.withColumn("calls", F.array_intersect("calls", F.coalesce("given", F.array().cast("array<string>")))).drop("given")


def up_to_turn(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role) before the prompt that follows each conversation's turn number (conv_id, last)."""
    numbered = messages.withColumn("user_turn", F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn")))
    return numbered.join(turns, "conv_id").where("user_turn <= last").drop("user_turn", "last")


def after_cursor(events: DataFrame, cursor: int, most: int) -> DataFrame:
    """Events behind a cursor, of the most newest ones that are kept, in order."""
    newest = events.orderBy(F.desc("seq")).limit(most)
    return newest.where(F.col("seq") > cursor).orderBy("seq")


def transcript(messages: DataFrame, most: int = 600) -> DataFrame:
    """conv_id, transcript: a conversation's messages as lines with their roles, tool answers cut."""
    body = F.when((F.col("role") == "tool") & (F.length("text") > most), F.concat(F.substring("text", 1, most), F.lit("…"))).otherwise(F.col("text"))
    head = F.when(F.col("role") == "tool", F.concat(F.lit("TOOL "), F.coalesce(F.col("name") if "name" in messages.columns else F.lit(""), F.lit("")))).otherwise(F.upper("role"))
    lines = messages.where("role in ('user', 'assistant', 'tool')").where("role != 'assistant' or text != ''").select("conv_id", "turn", F.concat(head, F.lit(": "), body).alias("line"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("transcript"))
