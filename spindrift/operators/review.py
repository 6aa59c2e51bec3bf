"""Review queries from unified diffs, each within its own row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a review asks for, how much of a diff it shows, and the words before its lists of files.
ASK = (
    "Review these pull-request changes like a senior engineer. For each file check correctness, edge cases, security (secrets, injection, path escapes), and missing test coverage. "
    "Ground every claim in the surrounding code you retrieved. Reply with markdown review comments — one section per file that has findings, most important first. "
    "If a file looks good, say so in one line. Do not restate the diff back."
)
ADVICE = (
    "The repo map and retrieval tool give you the codebase around these changes; retrieve any surrounding code a hunk depends on before judging it. "
    "This is a review: report findings, do not edit files."
)
NEW_FILES = "New files (not shown below — read them): "
DELETED_FILES = "Deleted files (check nothing still depends on them): "
LINES_A_HUNK, CHARS_A_FILE = 40, 6000

#: Where a file's part of a diff begins, and a hunk's part of a file.
FILE, HUNK = r"(?dm)^(?=\+\+\+ b/.)", r"(?dm)^(?=@@ -\d+(?:,\d+)? \+\d+)"


def _hunk(part: Column) -> Column:
    """new_start and the added lines, each as L<its number in the new file>: <line>."""
    head = F.element_at(F.split(part, "\n", 2), 1)
    start = F.regexp_extract(head, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).try_cast("long")
    body = F.split(F.element_at(F.split(F.concat(part, F.lit("\n")), "\n", 2), 2), "\n")
    # lines taken away have no number in the new file
    kept = F.filter(body, lambda line: ~line.startswith("-"))
    numbered = F.transform(kept, lambda line, n: F.when(line.startswith("+"), F.concat(F.lit("L"), (start + n).cast("string"), F.lit(": "), F.substring(line, 2, (1 << 31) - 1))))
    return F.struct(start.alias("new_start"), F.filter(numbered, lambda line: line.isNotNull()).alias("lines"))


def changed_files(diff: Column) -> Column:
    """A unified diff as array<struct<path, hunks: array<struct<new_start, lines>>>>.

    Files in the diff's order, without those to which no line is added; a hunk that only takes lines away has none.  A null or empty diff, or a text that is
    no diff, gives an empty array.
    """
    parts = F.filter(F.split(F.coalesce(diff, F.lit("")), FILE), lambda p: p.rlike(r"^\+\+\+ b/."))
    files = F.transform(
        parts, lambda p: F.struct(
            F.regexp_extract(p, r"(?d)^\+\+\+ b/(.+)", 1).alias("path"),
            F.transform(F.filter(F.split(p, HUNK), lambda h: h.rlike(r"^@@ -\d+(?:,\d+)? \+\d")), _hunk).alias("hunks"),
        )
    )
    return F.filter(files, lambda f: F.exists(f["hunks"], lambda h: F.size(h["lines"]) > 0))


def review_query(diff: Column, new_files: Column | None = None, deleted_files: Column | None = None, lines_a_hunk: int = LINES_A_HUNK, chars_a_file: int = CHARS_A_FILE) -> Column:
    """The text that asks for a review of a diff: of each hunk its first added lines, of each file its first code points.

    new_files and deleted_files are arrays of paths that the diff does not show; null and empty ones are not told of.
    """
    hunk = lambda h: F.concat(F.lit("  @@ +"), h["new_start"].cast("string"), F.lit("\n"), F.array_join(F.slice(h["lines"], 1, lines_a_hunk), "\n"))
    shown = F.transform(changed_files(diff), lambda f: F.substring(F.concat(F.lit("File: "), f["path"], F.lit("\n"), F.array_join(F.transform(f["hunks"], hunk), "\n")), 1, chars_a_file))
    nothing = F.array().cast("array<string>")
    told = lambda words, paths: nothing if paths is None else F.when(F.size(paths) > 0, F.array(F.lit(""), F.concat(F.lit(words), F.array_join(paths, ", ")))).otherwise(nothing)
    return F.array_join(F.concat(F.array(F.lit(ASK), F.lit(""), F.lit(ADVICE)), told(NEW_FILES, new_files), told(DELETED_FILES, deleted_files), F.array(F.lit("")), shown), "\n")
