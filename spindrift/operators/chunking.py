"""Files to line-ranged chunks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines at which a chunk may begin.
BOUNDARY = re.compile(
    r"(export\s+)?(default\s+)?(async\s+)?function\s+|(export\s+)?(default\s+)?(abstract\s+)?(class|interface|type|enum)\s+|(export\s+)?(const|let|var)\s+\w+\s*=\s*(\(|async|function)"
    r"|def\s+|class\s+|async\s+def\s+|(pub\s+)?(fn|struct|impl|trait|enum|mod)\s+|(public|private|protected|internal)\s+(static\s+)?(abstract\s+)?(class|interface|enum|void|async|record|struct)\s+"
    r"|func\s+|type\s+\w+\s+struct|package\s+|module\s+",
    re.A,
)
#: Files of an Arrow batch that are held as Python's objects.
HELD_ROWS = 256
CHUNKS = "path string, start_line int, end_line int, contents string"


def chunk_id(path: Column, start: Column, end: Column, contents: Column) -> Column:
    """SHA-256 of path:start-end and contents, with nothing between."""
    return F.sha2(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), contents), 256)


def windows(files: DataFrame, size: int = 80, overlap: int = 15) -> DataFrame:
    """path, start_line, end_line, contents: overlapping windows of lines, wholly as expressions.

    A window begins every size - overlap lines as long as the one before did not reach the end.
    """
    step = max(1, size - overlap)
    lines = F.split("contents", "\n")
    n = F.size(lines)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil((n - size) / step).cast("int") * step + 1), F.lit(step))
    return files.where("contents != ''").select("path", lines.alias("lines"), F.explode(starts).alias("start_line")).select(
        "path", "start_line", F.least(F.col("start_line") + size - 1, F.size("lines")).alias("end_line"), F.array_join(F.slice("lines", F.col("start_line"), size), "\n").alias("contents")
    )


def spans_of(lines: list[str], size: int, overlap: int) -> list[list[int]]:
    """Line ranges that begin at boundaries at least two lines apart; small ones merged, large ones in windows."""
    if len(lines) <= size:
        return [[1, len(lines)]]
    starts = [1]
    for number, line in enumerate(lines, 1):
        if number - starts[-1] >= 2 and BOUNDARY.match(line.strip()):
            starts.append(number)
    out: list[list[int]] = []
    for first, after in zip(starts, [*starts[1:], len(lines) + 1], strict=True):
        last = after - 1
        if last - first + 1 > size:
            at = first
            while True:
                out.append([at, min(at + size - 1, last)])
                if out[-1][1] >= last:
                    break
                at += max(1, size - overlap)
        elif out and out[-1][1] - out[-1][0] + 1 + last - first + 1 <= size:
            out[-1][1] = last
        else:
            out.append([first, last])
    return out


def by_characters(lines: list[str], first: int, most: int) -> list[tuple[int, int, str]]:
    """A span in parts of at most most characters, cut at line ends; a longer line stays whole."""
    if sum(map(len, lines)) + len(lines) - 1 <= most:
        return [(first, first + len(lines) - 1, "\n".join(lines))]
    out, at = [], 0
    while at < len(lines):
        end, used = at, 0
        while end < len(lines) and used + len(lines[end]) + 1 <= most:
            used += len(lines[end]) + 1
            end += 1
        end = max(end, at + 1)
        out.append((first + at, first + end - 1, "\n".join(lines[at:end])))
        at = end
    return out


def chunk_files(files: DataFrame, size: int = 80, overlap: int = 15, most_chars: int = 20_000) -> DataFrame:
    """CHUNKS of files (path, contents), by boundaries.  The greedy steps depend on each other within a file, so each file is cut in one Arrow batch row."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, HELD_ROWS):
                part = batch.slice(start, HELD_ROWS)
                rows = [
                    (path, *piece)
                    for path, contents in zip(part["path"].to_pylist(), part["contents"].to_pylist(), strict=True)
                    if contents
                    for lines in [contents.split("\n")]
                    for first, last in spans_of(lines, size, overlap)
                    for piece in by_characters(lines[first - 1 : last], first, most_chars)
                ]
                if rows:
                    columns = zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["path", "start_line", "end_line", "contents"])

    return files.select("path", "contents").mapInArrow(run, CHUNKS)


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with ids; the second and later of equal ids are hashed again with their number."""
    ids = chunks.withColumn("id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("contents")))
    copy = F.row_number().over(Window.partitionBy("id").orderBy("path", "start_line"))
    return ids.withColumn("copy", copy).withColumn("id", F.when(F.col("copy") > 1, F.sha2(F.concat("id", F.lit("#"), F.col("copy").cast("string")), 256)).otherwise(F.col("id"))).drop("copy")
