"""Notes kept between sessions: recall, pruning, duplicates, harvesting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.sources import fs

# Sentences that state a fact, in an answer and in a user's words.
ANSWER_FACTS = (
    r"(?i)(?:I (?:learned|found|noticed|discovered) that|key insight:)\s*(.+?)(?=\.(?:\s|$)|\n|$)",
    r"(?i)(?:the (?:codebase|project|system) (?:uses|has|contains))\s*(.+?)(?=\.(?:\s|$)|\n|$)",
)
USER_FACTS = (r"(?i)(?:actually[,:]?\s*|we (?:now )?(?:use|used|migrated (?:to|off)|switched to)|don'?t use|do not use|prefer|always|never)\s+(.+?)(?=\.(?:\s|$)|\n|$)",)
# What before a fact takes it back, how far before it that counts, and the least and most characters of a fact.
NEGATED = re.compile(r"\b(?:not|never|no|doubt|unlikely|whether|if|unless)\b[^.!?\n]*$", re.I)
LOOK_BACK, FACT_CHARS = 32, (20, 500)
#: Numbers of 64 bits in a set's signature, a power of two.
SIGNED = 8
PROMPT_HEAD = "## Remembered Context (from prior sessions — may be stale; verify against the current code before relying on it)\n"


def lexical_score(query: list[str], content: Column, tags: Column) -> Column:
    """For each query word: 1 if a note has it, 2 if a tag is it, 0.3 for each note word that contains it or is contained in it."""
    words = X.note_tokens(content)

    def one(word: str) -> Column:
        w = F.lit(word)
        return F.array_contains(words, word).cast("double") + 2 * F.array_contains(tags, word).cast("double") + 0.3 * F.size(F.filter(words, lambda t: F.contains(t, w) | F.contains(w, t)))

    return sum((one(word) for word in query), F.lit(0.0))


def freshness(age_hours: Column) -> Column:
    return 1 / (1 + age_hours * 0.01)


def recall(notes: DataFrame, query: str, top_k: int, similarity: Column | None = None) -> DataFrame:
    """The best notes (id, content, tags, age_hours, relevance): lexical score over its maximum, half and half with similarity where given."""
    words = list(dict.fromkeys(re.findall("[a-z0-9_]{3,}", query.lower())))
    scored = notes.withColumn("raw", lexical_score(words, F.col("content"), F.col("tags")))
    top = scored.agg(F.greatest(F.max("raw"), F.lit(1e-9)).alias("top"))
    lexical = F.col("raw") / F.col("top")
    mixed = lexical if similarity is None else F.when(similarity.isNull(), lexical).otherwise(0.5 * lexical + 0.5 * (similarity + 1) / 2)
    score = mixed * freshness(F.col("age_hours")) * F.col("relevance")
    return scored.join(F.broadcast(top), F.lit(True)).withColumn("score", score).where("score > 0").orderBy(F.desc(F.round("score", 9)), "id").limit(top_k)


def pruned(notes: DataFrame, most_days: float, most: int) -> DataFrame:
    """Notes young enough, the most relevant for their age first."""
    return notes.where(F.col("age_days") < most_days).orderBy(F.desc(F.round(F.col("relevance") / (1 + F.col("age_days")), 9)), "id").limit(most)


def signature(words: Column) -> list[Column]:
    """SIGNED numbers in whose bits a set's words stand, each at the place that its hash names; words are hashes."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    at = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(SIGNED - 1))
    own = lambda k: F.filter(words, lambda h: at(h) == k)
    return [F.aggregate(own(k), F.lit(0).cast("long"), lambda out, h: out.bitwiseOR(bit(h))).alias(f"s{k}") for k in range(SIGNED)]


def overlap_candidates(candidates: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """a, b: the pairs of sets (id, w) that may share least of the smaller one's words, each once.

    A set that shares so many has one of its rarest size - needed + 1 words among the other's, so
    only these of the smaller set are joined with all words of the larger.  Words travel as hashes with their set's signature: bits of the smaller
    set that the larger one lacks are words that it lacks, and where these are too many the pair goes no further than the join that met it.
    """
    hashed = lambda d: d.select("id", F.size("w").alias("size"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    words = lambda d: hashed(d).select("id", "size", F.explode("h").alias("w"))
    signed = lambda d: hashed(d).select("id", "size", "h", *signature(F.col("h")))
    common = words(candidates).select("w").unionAll(words(known).select("w")).groupBy("w").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("times", "w"))
    lacking = lambda size: size - F.ceil(least * size)
    rare = lambda d: words(d).join(common, "w").withColumn("place", place).where(F.col("place") <= lacking(F.col("size")) + 1).select("id", "w").join(signed(d).drop("h"), "id")
    every = lambda d: signed(d).withColumn("w", F.explode("h"))
    named = lambda d, n: d.select("w", F.col("id").alias(n), F.col("size").alias(f"{n}_size"), *[F.col(f"s{k}").alias(f"{n}{k}") for k in range(SIGNED)])
    fits = lambda x, y: sum((F.bit_count(F.col(f"{x}{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}{k}")))) for k in range(SIGNED)), F.lit(0)) <= lacking(F.col(f"{x}_size"))
    one = named(rare(candidates), "a").join(named(every(known), "b"), "w").where((F.col("a_size") <= F.col("b_size")) & fits("a", "b"))
    two = named(every(candidates), "a").join(named(rare(known), "b"), "w").where((F.col("a_size") > F.col("b_size")) & fits("b", "a"))
    return one.select("a", "b").unionAll(two.select("a", "b")).distinct()


def not_paraphrased(candidates: DataFrame, known: DataFrame, least: float = 0.8) -> DataFrame:
    """Candidates (id, content) that neither equal a known note nor share 0.8 of the smaller one's words with it.

    Notes of the same words count once: a set that both sides have is settled by equality, however many copies it has, and of the
    others each different set is compared once.  Pairs are made by overlap_candidates() and compared exactly: first one of each set, then
    the others of those sets that it leaves open, so sets with very many like them are not sent to each.
    """
    words = F.array_sort(F.array_distinct(X.note_tokens(F.col("content"))))
    keyed = lambda d: d.select("id", words.alias("w")).where(F.size("w") > 0).select("id", "w", F.unhex(F.sha2(F.array_join("w", " "), 256)).alias("key"))
    held = fs.kept(keyed(candidates))
    sets = lambda d: d.groupBy("key").agg(F.first("w").alias("w"))
    numbered = lambda d: fs.kept(d.select(F.monotonically_increasing_id().alias("id"), "key", "w"))
    theirs = numbered(sets(keyed(known)))
    every = sets(held)
    same = every.join(theirs.select("key"), "key", "left_semi").select("key")
    ours = numbered(every.join(theirs.select("key"), "key", "left_anti"))
    pairs = fs.kept(overlap_candidates(ours.select("id", "w"), theirs.select("id", "w"), least))

    def alike(some: DataFrame) -> DataFrame:
        both = some.join(ours.select(F.col("id").alias("a"), F.col("w").alias("x")), "a").join(theirs.select(F.col("id").alias("b"), F.col("w").alias("y")), "b")
        return both.where(F.size(F.array_intersect("x", "y")) >= least * F.least(F.size("x"), F.size("y"))).select("a")

    first = fs.kept(pairs.groupBy("a").agg(F.min("b").alias("b")))
    settled = fs.kept(alike(first))
    others = alike(pairs.join(settled, "a", "left_anti").join(first, ["a", "b"], "left_anti"))
    near = ours.join(settled.union(others).withColumnRenamed("a", "id"), "id", "left_semi").select("key")
    similar = held.select("id", "key").join(same.union(near), "key", "left_semi").select("id")
    equal = candidates.select("id", F.lower("content").alias("c")).join(known.select(F.lower("content").alias("c")), "c", "left_semi").select("id")
    return candidates.join(similar.union(equal).distinct(), "id", "left_anti")


def harvest(messages: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """id, fact: what messages (id, text) state, without code blocks, negated or conditional sentences, and secrets; of captures within one another the longest."""
    compiled = [re.compile(p) for p in patterns]
    secret = re.compile(X.SECRET.replace("|(?i)", "|")), re.compile(X.SECRET.rpartition("|(?i)")[2], re.I)

    def run(batches):
        for batch in batches:
            out = []
            for n, text in zip(batch["id"], batch["text"], strict=True):
                clean, found = re.sub(r"```[\s\S]*?```", " ", text or ""), []
                for pattern in compiled:
                    for m in pattern.finditer(clean):
                        fact = m[1].strip()
                        if FACT_CHARS[0] < len(fact) < FACT_CHARS[1] and not NEGATED.search(clean[max(0, m.start() - LOOK_BACK) : m.start()]) and not any(s.search(fact) for s in secret):
                            found.append(fact)
                out += [(n, f) for f in found if not any(f in g and len(g) > len(f) for g in found)]
            yield pd.DataFrame(out, columns=["id", "fact"])

    return messages.select("id", "text").mapInPandas(run, "id long, fact string")


def live(log: DataFrame) -> DataFrame:
    """The notes in force, newest first, from a log (seq, op, id, kind, content, supersedes, relevance): add, forget and relevance.

    An addition ends the note it supersedes, and older ones of the same content; relevance is held between 0 and 2.
    """
    added = log.where("op = 'add'")
    gone = log.where("op = 'forget'").select("id", "seq").unionByName(added.where("supersedes is not null").select(F.col("supersedes").alias("id"), "seq"))
    ended = added.select("id", F.col("seq").alias("born")).join(gone, "id").where("seq > born").select("id")
    same = added.withColumn("nth", F.row_number().over(Window.partitionBy(F.lower(F.trim("content"))).orderBy(F.desc("seq")))).where("nth > 1").select("id")
    told = log.where("op = 'relevance'").groupBy("id").agg(F.max_by("relevance", "seq").alias("told"))
    held = added.join(ended.union(same).distinct(), "id", "left_anti").join(told, "id", "left")
    return held.withColumn("relevance", F.least(F.greatest(F.coalesce("told", "relevance", F.lit(1.0)), F.lit(0.0)), F.lit(2.0))).drop("told", "op").orderBy(F.desc("seq"))


def prompt(recalled: DataFrame, most_chars: int = 2000) -> DataFrame:
    """query_id, text of recalled notes (query_id, place, kind, content) as lines below a head, up to the first that does not fit."""
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), "content", F.lit("\n"))
    used = F.sum(F.length("line")).over(Window.partitionBy("query_id").orderBy("place")) + len(PROMPT_HEAD)
    kept = recalled.withColumn("line", line).withColumn("used", used).where(F.col("used") <= most_chars)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    texts = kept.groupBy("query_id").agg(F.concat(F.lit(PROMPT_HEAD), F.array_join(lines, "")).alias("text"))
    return recalled.select("query_id").distinct().join(texts, "query_id", "left").withColumn("text", F.coalesce("text", F.lit(PROMPT_HEAD)))
