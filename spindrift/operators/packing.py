"""Search results to text under budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACKED = "query_id long, files int, chunks int, dropped int, chars int, output string, decisions array<struct<path:string,lines:string,action:string,reason:string,score:double>>"


def top_per_file(results: DataFrame, most: int = 4) -> DataFrame:
    """The best chunks of each file."""
    order = Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "rank")
    return results.withColumn("in_file", F.row_number().over(order)).where(F.col("in_file") <= most)


def merged_spans(chunks: DataFrame, gap: int = 8, by: tuple[str, ...] = ("query_id", "path")) -> DataFrame:
    """Spans of chunks that lie at most gap lines apart: start_line, end_line, score, n_chunks."""
    order = Window.partitionBy(*by).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = chunks.withColumn("reach", reach).withColumn("span", F.sum(F.when(F.col("start_line") <= F.col("reach") + gap, 0).otherwise(1)).over(order))
    return islands.groupBy(*by, "span").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_chunks"))


def pack(results: DataFrame, total: int = 24_000, per_file: int = 8_000, most: int = 4, gap: int = 8) -> DataFrame:
    """PACKED: one text for each query from results (query_id, rank, path, start_line, end_line, contents, score, symbol).

    Skipping what does not fit makes each step depend on those before, so a query's results, a few
    dozen rows, are folded together.  decisions tell what became of each chunk and span, and why.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        sections, used, included, dropped = [], 0, 0, 0
        told: list[tuple] = []
        files = rows.groupby("path", sort=False)["score"].max().sort_values(ascending=False, kind="stable")
        for path in files.index:
            mine = rows[rows["path"] == path].sort_values("score", ascending=False, kind="stable")
            dropped += max(0, len(mine) - most)
            told += [(path, f"{c.start_line}-{c.end_line}", "dropped", "per-file chunk budget", float(c.score)) for c in mine.iloc[most:].itertuples()]
            spans: list[dict] = []
            for c in mine.head(most).sort_values("start_line", kind="stable").to_dict("records"):
                last = spans[-1] if spans else None
                symbols = [c["symbol"]] if isinstance(c["symbol"], str) and c["symbol"] else []
                if last and c["start_line"] <= last["end"] + gap:
                    tail = "\n".join(c["contents"].split("\n")[max(0, last["end"] - c["start_line"] + 1) :])
                    missing = max(0, c["start_line"] - last["end"] - 1)
                    last["text"] = "\n".join(x for x in (last["text"], f"... ({missing} lines omitted)" if missing else "", tail) if x)
                    told.append((path, f"{c['start_line']}-{c['end_line']}", "merged", "adjacent or overlapping chunk", float(c["score"])))
                    last |= {"end": max(last["end"], c["end_line"]), "score": max(last["score"], c["score"]), "n": last["n"] + 1, "symbols": [*dict.fromkeys([*last["symbols"], *symbols])]}
                else:
                    spans.append({"start": c["start_line"], "end": c["end_line"], "text": c["contents"], "score": c["score"], "n": 1, "symbols": symbols})
            names = [*dict.fromkeys(s for x in spans for s in x["symbols"])][:8]
            parts = [f"## {path}", *([f"Symbols: {', '.join(names)}"] if names else [])]
            heads, size = len(parts), len("\n".join(parts))
            for x in spans:
                lines = "\n".join(f"{x['start'] + n:>5} │ {line}" for n, line in enumerate(x["text"].split("\n")))
                block = f"\n\nLines {x['start']}-{x['end']} (score {x['score']:.4f}):\n{lines}"
                fits = size + len(block) <= per_file
                told.append((path, f"{x['start']}-{x['end']}", *(("included", "within budget") if fits else ("dropped", "per-file char budget")), float(x["score"])))
                if fits:
                    parts.append(block)
                    size += len(block)
            if len(parts) == heads:
                continue
            body, n = "\n".join(parts), sum(x["n"] for x in spans)
            if used + len(body) > total:
                if total - used < 400:
                    dropped += n
                    told += [(path, f"{x['start']}-{x['end']}", "dropped", "total context budget", float(x["score"])) for x in spans]
                    continue
                body = body[: total - used - 28] + "\n... (file truncated)"
            sections.append(body)
            used += len(body) + 7
            included += n
            if used >= total:
                break
        plural = lambda n, word: f"{n} {word}{'' if n == 1 else 's'}"
        head = f"Relevant context (packed): {plural(len(sections), 'file')}, {plural(included, 'chunk')}{f', {dropped} dropped by budget' if dropped else ''}."
        output = "\n\n".join(x for x in (head, "\n\n---\n\n".join(sections)) if x)
        return pd.DataFrame([(rows["query_id"].iloc[0], len(sections), included, dropped, len(output), output, [dict(zip(("path", "lines", "action", "reason", "score"), t, strict=True)) for t in told])], columns=["query_id", "files", "chunks", "dropped", "chars", "output", "decisions"])

    columns = ["query_id", "rank", "path", "start_line", "end_line", "contents", "score", "symbol"]
    return results.select(F.col("query_id").cast("long").alias("query_id"), *columns[1:]).groupBy("query_id").applyInPandas(fold, PACKED)


def pack_with_dependencies(results: DataFrame, dependencies: DataFrame, total: int = 24_000, share: float = 0.3, **options) -> DataFrame:
    """PACKED: results within what the dependencies' share of the budget leaves, and dependencies, where there are some, within that share behind them."""
    first = int(total * (1 - share))
    main, more = pack(results, first, **options), pack(dependencies, total - first, **options)
    joined = main.join(more.select("query_id", *[F.col(c).alias(f"d_{c}") for c in more.columns[1:]]), "query_id", "left")
    head = F.lit("\n\n---\n\n**Dependencies (imported by above):**\n\n")
    output = F.when(F.col("d_output").isNull(), F.col("output")).otherwise(F.concat("output", head, "d_output"))
    sums = [(F.col(c) + F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in ("files", "chunks", "dropped")]
    return joined.select("query_id", *sums, F.length(output).alias("chars"), output.alias("output"), F.concat("decisions", F.coalesce("d_decisions", F.array().cast(more.schema["decisions"].dataType))).alias("decisions"))


def repo_map(chunks: DataFrame, most_chars: int = 4000, header: str = "Repository map (files → declared symbols; line ranges):") -> DataFrame:
    """Lines of a map of files and their symbols under a budget: place, path, symbol.

    Files with more symbols come first, tests counting a fifth; the map ends at the first line that
    does not fit, so a running sum decides.  Symbols are counted once a file.
    """
    first = Window.partitionBy("path", "symbol").orderBy("start_line")
    symbols = chunks.where("symbol is not null and symbol != ''").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    test = F.col("path").rlike(r"(?i)(^|/)(tests?|__tests__)(/|$)|\.(test|spec)\.[a-z]+$|_test\.go$")
    counts = symbols.groupBy("path").agg((F.count(F.lit(1)) * F.when(F.first(test), 0.2).otherwise(1.0)).alias("weight"))
    # no line is shorter than 10 characters, so only so many can ever fit
    lines = symbols.join(counts, "path").orderBy(F.desc("weight"), "path", "start_line", "symbol").limit(most_chars // 10)
    order = Window.orderBy(F.desc("weight"), "path", "start_line", "symbol")
    head = F.when(F.row_number().over(Window.partitionBy("path").orderBy("start_line", "symbol")) == 1, F.length("path") + 3).otherwise(2)
    size = head + F.length(F.concat_ws("", F.lit("sym "), "symbol", F.lit(" ("), "start_line", F.lit("-"), "end_line", F.lit(")"))) + 1
    return lines.withColumn("size", size).withColumn("used", F.sum("size").over(order) + len(header)).withColumn("place", F.row_number().over(order)).where(F.col("used") <= most_chars).select("place", "path", "symbol")
