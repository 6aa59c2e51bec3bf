"""Spelling variants by anagram hashing: words one letter apart have anagram values that differ by one letter's value.

The anagram value of a word is the sum of its letters' fifth powers, whatever their order.  A word with a letter more differs
by that letter's power, a word with a letter replaced by the difference of two powers.  Both are met by one equi-join: each word
stands under its own value and under its value less each of its letters; own and lessened values meet where a letter was added
or removed, two lessened ones where a letter was exchanged.  The order of letters is verified after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import storage

#: Whole runs of LEAST_LETTERS letters at least: a match that begins with its run takes all of it.
RUN = "[A-Za-zÀ-ÿ]{5,}+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in whose crc32 this divides lose a letter (given by the query's contract).
SLIP = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3


def power(letter: Column) -> Column:
    """The fifth power of a letter's code point; no two pairs of letters below 256 have the same difference of these."""
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n: all words of at least LEAST_LETTERS letters and LEAST_COUNT occurrences."""
    text = F.translate(F.col("text").cast("string"), CAPITALS, SMALL)
    runs = documents.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    place = F.pmod(h, F.length("run").cast("long")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    words = runs.select(F.when(h % SLIP == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def anagram_keys(words: DataFrame) -> DataFrame:
    """word, n, own, key, back, h: a row for the word's value and for that less each of its letters, under its front and its back half.

    Two words one letter apart agree before or behind the place where they differ, so in the front or in the back half (h letters) of
    what they share.  The key is a hash of the value with that half, so that an anagram class of very many words never meets as a whole.
    """
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    value = F.aggregate("letters", F.lit(0).cast("long"), lambda total, c: total + power(c))
    own = F.array(F.struct(F.lit(True).alias("own"), F.col("value").alias("rest")))
    less = F.transform(F.array_distinct("letters"), lambda c: F.struct(F.lit(False).alias("own"), (F.col("value") - power(c)).alias("rest")))
    keyed = words.select("word", "n", letters.alias("letters")).select("*", value.alias("value")).select("word", "n", F.inline(F.concat(own, less)))
    shared = F.length("word") - F.when(F.col("own"), 0).otherwise(1)
    halved = keyed.select("word", "n", "own", "rest", F.floor(shared / 2).cast("int").alias("h"))
    front = F.struct(F.lit(False).alias("back"), F.substring(F.col("word"), F.lit(1), F.col("h")).alias("half"))
    behind = F.struct(F.lit(True).alias("back"), F.substring(F.col("word"), F.length("word") - F.col("h") + 1, F.col("h")).alias("half"))
    return halved.select("word", "n", "own", "rest", "h", F.inline(F.array(front, behind))).select("word", "n", "own", F.xxhash64("rest", "back", "half").alias("key"), "back", "h")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: both directions of every pair of words that differ by one inserted, deleted or replaced letter."""
    keys = anagram_keys(words)
    a, b = keys.alias("a"), keys.alias("b")
    same_front = F.substring(F.col("a.word"), F.lit(1), F.col("a.h")) == F.substring(F.col("b.word"), F.lit(1), F.col("a.h"))
    # the sizes that Spark guesses do not know how many rows a word makes: without the hint it would broadcast all of them
    met = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.back") == F.col("b.back")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.word") < F.col("b.word")) & ~(F.col("a.own") & F.col("b.own")))
    # a pair that agrees in both halves is met twice; the second time it is left out
    verified = met.where((F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1) & ~(F.col("a.back") & same_front))
    columns = ("word", "n", "near", "near_n")
    one = F.struct(*[F.col(c).alias(k) for k, c in zip(columns, ("a.word", "a.n", "b.word", "b.n"), strict=True)])
    other = F.struct(*[F.col(c).alias(k) for k, c in zip(columns, ("b.word", "b.n", "a.word", "a.n"), strict=True)])
    return verified.select(F.inline(F.array(one, other)))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of word, form: where the forms of forms end.

    Each round follows twice as many steps; a form occurs at least twice as often as its word, so steps are few and there are no circles.
    """
    at = storage.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not at.where("moved").isEmpty():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = storage.keep(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        storage.discard(at)
        at = stepped
    return at.select("word", "root")


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word.

    Words: runs of letters with A-Z in lower case, some of which lose a letter by rule (see SLIP), of at least 5 letters and 3
    occurrences.  A null or empty text has none; a null doc_id is an empty text before the rule's colon; repeated rows count
    each; of equally frequent near words the smallest in code-point order is the form; an empty table gives no rows.  Columns other than
    doc_id and text are not read.
    """
    words = storage.keep(word_counts(documents), "spelling-words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.less") >= 2 * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("to"))
    found = storage.keep(found.select("word", "n", "n_near", "to.form", "to.form_n"), "spelling-forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in DuckDB's SQL: pairs by strings with one letter out, crc32 from its polynomial.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(entry ORDER BY k) AS t FROM (SELECT k, list_reduce(range(8), lambda c, s: xor(c >> 1, CASE WHEN (c & 1) = 1 THEN 3988292384 ELSE 0 END), k) AS entry FROM range(256) x(k))),
docs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
runs AS (SELECT doc, run, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM docs) WHERE length(run) >= 5 GROUP BY doc, run),
bytes AS (SELECT run, n, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes, crc),
slips AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (SELECT word, n, p, left(word, p - 1) AS front, substr(word, p + 1) AS back FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.front || '*' || a.back = b.front || '*' || b.back AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.front || g.back = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.front || g.back = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
found AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS at, form AS further FROM found UNION ALL SELECT walk.word, walk.further, found.form FROM walk JOIN found ON found.word = walk.further)
SELECT found.word, form, walk.at AS root, n, n_near, form_n FROM found JOIN walk ON walk.word = found.word AND walk.further IS NULL
"""
