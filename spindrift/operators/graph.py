"""Relationship graphs as edge tables."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.sources import fs

EDGES = "source_path string, source_symbol string, target_path string, target_symbol string, kind string, confidence double"


@F.pandas_udf(T.StringType())
def resolved(path: pd.Series, specifier: pd.Series) -> pd.Series:
    """A relative specifier against the file that names it; others stay."""
    return pd.Series([posixpath.normpath(posixpath.join(posixpath.dirname(p), s)) if s and s.startswith(".") else s for p, s in zip(path, specifier, strict=True)])


def _found(files: DataFrame, pattern: str, groups: int) -> DataFrame:
    """path and groups g1.. of every match in contents."""
    whole = F.explode(F.regexp_extract_all("contents", F.lit(pattern), F.lit(0))).alias("m")
    return files.select("path", whole).select("path", *[F.regexp_extract("m", pattern, n + 1).alias(f"g{n + 1}") for n in range(groups)])


def _edges(rows: DataFrame, source: Column | None, target: Column, symbol: Column | None, kind: str, confidence: float) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(
        F.col("path").alias("source_path"), (null if source is None else source).alias("source_symbol"), target.alias("target_path"), (null if symbol is None else symbol).alias("target_symbol"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence")
    )


# The patterns, kinds and confidences below define the edges of each language (fixed values).


def source_edges(files: DataFrame) -> DataFrame:
    """EDGES of source files (path, contents, language): imports, exports, inheritance, and calls of imported names."""
    script = files.where(F.col("language").isin("typescript", "tsx", "javascript"))
    python, go, rust, java, sharp = (files.where(F.col("language") == x) for x in ("python", "go", "rust", "java", "c_sharp"))
    pick = lambda c: F.explode(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))
    out = []
    named = _found(script, r"import\s+(?:type\s+)?(?:\{([^}]+)\}|(\w+)(?:\s*,\s*\{([^}]+)\})?)\s+from\s+[\"']([^\"']+)[\"']", 4).where(F.col("g4").startswith("."))
    target = resolved(F.col("path"), F.col("g4"))
    out.append(_edges(named.where("g2 != ''"), F.col("g2"), target, F.lit("default"), "imports", 1.0))
    parts = named.withColumn("to", target).select("path", "to", pick(F.concat_ws(",", F.nullif("g1", F.lit("")), F.nullif("g3", F.lit("")))).alias("n"))
    split = F.split(F.regexp_replace("n", r"^type\s+", ""), r"\s+as\s+")
    imported = _edges(parts, F.element_at(split, -1), F.col("to"), split[0], "imports", 1.0)
    out.append(imported)
    for pattern in (r"import\s*\(\s*[\"']([^\"']+)[\"']\s*\)", r"require\(\s*[\"']([^\"']+)[\"']\s*\)"):
        out.append(_edges(_found(script, pattern, 1).where(F.col("g1").startswith(".")), None, resolved(F.col("path"), F.col("g1")), None, "imports", 0.9))
    exported = _found(script, r"export\s+(?:default\s+)?(?:function|class|const|let|var|interface|type|enum)\s+(\w+)", 1).select("path", F.col("g1").alias("n"))
    listed = _found(script, r"export\s+\{([^}]+)\}", 1).select("path", pick(F.col("g1")).alias("n")).withColumn("n", F.split("n", r"\s+as\s+")[0])
    both = exported.unionAll(listed)
    out.append(_edges(both, F.col("n"), F.col("path"), F.col("n"), "exports", 1.0))
    for pattern, kind in ((r"class\s+(\w+)\s+extends\s+(\w+)", "extends"), (r"class\s+(\w+)\s+implements\s+([^{]+)", "implements"), (r"interface\s+(\w+)\s+extends\s+([^{]+)", "extends")):
        rows = _found(script, pattern, 2).select("path", "g1", pick(F.col("g2")).alias("n")).withColumn("n", F.trim(F.split("n", "<")[0])).where(F.col("n").rlike("^[A-Z]"))
        out.append(_edges(rows, F.col("g1"), F.col("path"), F.col("n"), kind, 0.8))
    calls = _found(script, r"\b([A-Za-z_]\w*)\s*\(", 1)
    names = out[0].unionAll(imported).select(F.col("source_path").alias("path"), F.col("source_symbol").alias("g1"), "target_path", "target_symbol").dropDuplicates(["path", "g1"])
    out.append(_edges(calls.join(names, ["path", "g1"]), None, F.col("target_path"), F.col("target_symbol"), "calls", 0.7))

    dotted = _found(python, r"from\s+(\.+\w*(?:\.\w+)*)\s+import\s+([^#\n]+)", 2).select("path", "g1", pick(F.col("g2")).alias("n")).withColumn("n", F.split("n", r"\s+as\s+")[0]).where("n != '*'")
    up = F.greatest(F.length(F.regexp_extract("g1", r"^(\.+)", 1)) - 1, F.lit(0))
    module = F.concat(F.lit("./"), F.expr("repeat('../', greatest(length(regexp_extract(g1, '^([.]+)', 1)) - 1, 0))"), F.regexp_replace(F.regexp_replace("g1", r"^\.+", ""), r"\.", "/"))
    out.append(_edges(dotted.withColumn("up", up), F.col("n"), resolved(F.col("path"), module), F.col("n"), "imports", 1.0))
    direct = _found(python, r"(?m)^import\s+(\w+(?:\.\w+)*)", 1)
    out.append(_edges(direct, None, F.regexp_replace("g1", r"\.", "/"), None, "imports", 0.9))
    bases = _found(python, r"class\s+(\w+)\s*\(([^)]+)\)", 2).select("path", "g1", pick(F.col("g2")).alias("n")).withColumn("n", F.trim(F.split("n", r"\[")[0])).where(F.col("n").rlike("^[A-Z]"))
    out.append(_edges(bases, F.col("g1"), F.col("path"), F.col("n"), "extends", 0.8))

    block = _found(go, r"import\s*\(([^)]+)\)", 1).select("path", F.explode(F.regexp_extract_all("g1", F.lit(r'"([^"]+)"'), F.lit(1))).alias("n"))
    out.append(_edges(block, None, F.col("n"), None, "imports", 1.0))
    out.append(_edges(_found(go, r'import\s+(?:\w+\s+)?"([^"]+)"', 1), None, F.col("g1"), None, "imports", 1.0))
    used = _found(rust, r"use\s+((?:crate|super|self)(?:::\w+)+)(?:::\{([^}]+)\})?", 2)
    names = F.when(F.col("g2") == "", F.element_at(F.split("g1", "::"), -1)).otherwise(F.col("g2"))
    out.append(_edges(used.withColumn("n", pick(names)).where("n != 'self'"), F.col("n"), F.regexp_replace("g1", "::", "/"), F.col("n"), "imports", 0.9))
    out.append(_edges(_found(rust, r"impl\s+(\w+)\s+for\s+(\w+)", 2), F.col("g2"), F.col("path"), F.col("g1"), "implements", 0.9))
    last = F.element_at(F.split("g1", r"\."), -1)
    out.append(_edges(_found(java, r"import\s+(?:static\s+)?([\w.]+)", 1), last, F.regexp_replace("g1", r"\.", "/"), last, "imports", 0.9))
    classes = _found(java, r"class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([^{]+))?", 3)
    out.append(_edges(classes.where("g2 != ''"), F.col("g1"), F.col("path"), F.col("g2"), "extends", 0.9))
    out.append(_edges(classes.select("path", "g1", pick(F.col("g3")).alias("n")).withColumn("n", F.trim(F.split("n", "<")[0])), F.col("g1"), F.col("path"), F.col("n"), "implements", 0.9))
    out.append(_edges(_found(sharp, r"using\s+(?:static\s+)?([\w.]+)\s*;", 1), None, F.regexp_replace("g1", r"\.", "/"), None, "imports", 0.8))
    heirs = _found(sharp, r"(?:class|struct|record)\s+(\w+)(?:\s*<[^>]*>)?\s*:\s*([^{]+)", 2).select("path", "g1", pick(F.col("g2")).alias("n")).withColumn("n", F.trim(F.split("n", "<")[0])).where("n != ''")
    interface = F.col("n").rlike("^I[A-Z]")
    for kind, rows in (("implements", heirs.where(interface)), ("extends", heirs.where(~interface))):
        out.append(_edges(rows, F.col("g1"), F.col("path"), F.col("n"), kind, 0.8))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionAll(part)
    return whole


def neighbours(edges: DataFrame, seeds: DataFrame, limit: int = 50) -> DataFrame:
    """seed, direction, id: for each seed node the first edges that leave it and those that reach it."""
    leaving = edges.join(seeds, F.col("source") == F.col("seed")).select("seed", F.lit("out").alias("direction"), "id", F.col("target").alias("node"))
    reaching = edges.join(seeds, F.col("target") == F.col("seed")).select("seed", F.lit("in").alias("direction"), "id", F.col("source").alias("node"))
    order = Window.partitionBy("seed", "direction").orderBy("id")
    return leaving.unionAll(reaching).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).drop("nth")


def reached(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """seed, node, hops: nodes within depth steps in either direction, by the fewest steps."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionAll(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    for hop in range(1, depth + 1):
        step = seen.where(F.col("hops") == hop - 1).join(both, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node"), F.lit(hop).alias("hops"))
        seen = seen.unionAll(step).groupBy("seed", "node").agg(F.min("hops").alias("hops"))
    return seen


def verb(kind: Column) -> Column:
    """How a reason names an edge's kind."""
    return F.regexp_replace(kind, "_", " ")


#: Edges of a node and direction that an expansion looks at, and of a node that was itself met on the way (fixed values).
MOST_EDGES, FURTHER_EDGES = 50, 3


def adjacency(leaving: DataFrame, reaching: DataFrame) -> DataFrame:
    """node, direction (0 leaving, 1 reaching), nth, id, to, confidence, reason: the first MOST_EDGES edges of each node and direction by id.

    leaving and reaching are edges (node, id, to, confidence, reason) from a node's side.  The limit is applied before edges are shuffled too, so a
    hub sends no more than that from each task.
    """
    both = leaving.withColumn("direction", F.lit(0)).unionByName(reaching.withColumn("direction", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("node", "direction").orderBy("id", "to"))
    return both.withColumn("nth", nth).where(F.col("nth") <= MOST_EDGES).select("node", "direction", "nth", "id", "to", "confidence", "reason")


def walked(ranked: DataFrame, near: DataFrame | Callable[[DataFrame], DataFrame], top: int = 5, most: int = 15, decay: float = 0.55) -> DataFrame:
    """query_id, node, place, score, reason of extra nodes about each query's results (query_id, node, rank, score).

    near: an adjacency, or a function that gives the part of one that distinct nodes (node) need.  Each of the first top results
    takes up its leaving and reaching edges; then the first three extras take up three of theirs.  A node
    counts where it is first met.  What comes next depends on what was met before, so the few hundred edges that a query may
    need are found by joins, hop by hop, and folded together.  Each frontier is written before the next is found from it.
    """
    look_up = near if callable(near) else lambda nodes: near.join(nodes, "node", "left_semi")
    ranked = fs.kept(ranked.select("query_id", "node", "rank", "score"))
    columns = ["query_id", "hop", "rank", "node", "direction", "nth", "to", "confidence", "reason"]
    seeds = ranked.where(F.col("rank") <= top)
    found = fs.kept(seeds.join(look_up(seeds.select("node").distinct()), "node").withColumn("hop", F.lit(1)).select(columns))
    step = found
    for n in (2, 3):
        nodes = step.select("query_id", F.col("to").alias("node")).distinct().withColumn("rank", F.lit(None).cast("int"))
        further = look_up(nodes.select("node").distinct()).where((F.col("direction") == 0) & (F.col("nth") <= FURTHER_EDGES))
        step = fs.kept(nodes.join(further, "node").withColumn("hop", F.lit(n)).select(columns))
        found = found.unionAll(step)
    node_type = ranked.schema["node"].dataType.simpleString()
    query_type = ranked.schema["query_id"].dataType.simpleString()

    def fold(rows: pd.DataFrame, results: pd.DataFrame) -> pd.DataFrame:
        results = results.set_axis(["query_id", "node", "rank", "score"], axis=1)
        seen, extras = set(results["node"]), []
        edges = rows.sort_values(["direction", "nth"], kind="stable")
        first_hop = {k: v.to_dict("records") for k, v in edges[edges["hop"] == 1].groupby("node")}
        later = {k: v.drop_duplicates("nth").to_dict("records") for k, v in edges[edges["hop"] > 1].groupby("node")}

        def take(edge: dict, score: float) -> None:
            if len(extras) < most and edge["to"] not in seen:
                seen.add(edge["to"])
                extras.append((edge["to"], score * decay * edge["confidence"], edge["reason"]))

        for seed in results[results["rank"] <= top].sort_values("rank").to_dict("records"):
            for edge in first_hop.get(seed["node"], []):
                take(edge, seed["score"])
            for node, score, _ in extras[:3]:
                for edge in [*(e for e in first_hop.get(node, []) if e["direction"] == 0), *later.get(node, [])][:3]:
                    take(edge, score)
        out = pd.DataFrame(extras, columns=["node", "score", "reason"])
        query = results["query_id"].iloc[0] if len(results) else rows["query_id"].iloc[0]
        return out.assign(query_id=query, place=range(1, len(out) + 1))[["query_id", "node", "place", "score", "reason"]]

    schema = f"query_id {query_type}, node {node_type}, place int, score double, reason string"
    given = ranked.select(F.col("query_id").alias("of_query"), F.col("node").alias("of_node"), F.col("rank").alias("of_rank"), F.col("score").alias("of_score"))
    return found.groupBy("query_id").cogroup(given.groupBy("of_query")).applyInPandas(fold, schema)


def expand(ranked: DataFrame, edges: DataFrame, top: int = 5, most: int = 15, decay: float = 0.55) -> DataFrame:
    """query_id, node, place, score, reason of extra nodes from edges (id, source, target, kind, confidence), to the second hop."""
    leaving = edges.select(F.col("source").alias("node"), "id", F.col("target").alias("to"), "confidence", F.concat_ws(" ", verb(F.col("kind")), "target").alias("reason"))
    reaching = edges.select(F.col("target").alias("node"), "id", F.col("source").alias("to"), "confidence", F.concat_ws(" ", "source", verb(F.col("kind")), F.lit("this")).alias("reason"))
    return walked(ranked, fs.kept(adjacency(leaving, reaching)), top, most, decay)


def resolved_ends(ends: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, symbol, rowid of the chunk that each end (path, symbol) of an edge stands for: of the first two chunks of that symbol one in its file, else the file's first."""
    named = chunks.where("symbol is not null").select("symbol", "path", "rowid").withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy("rowid"))).where("nth <= 2")
    by_symbol = ends.where("symbol is not null").distinct().join(named.withColumnRenamed("path", "at"), "symbol").where(F.col("path").isNull() | (F.col("path") == F.col("at"))).groupBy("path", "symbol").agg(F.min("rowid").alias("by_symbol"))
    by_path = chunks.groupBy("path").agg(F.min_by("rowid", F.struct("start_line", "rowid")).alias("by_path"))
    both = ends.distinct().join(by_symbol.select(F.col("path").alias("p"), F.col("symbol").alias("s"), "by_symbol"), F.col("path").eqNullSafe(F.col("p")) & F.col("symbol").eqNullSafe(F.col("s")), "left").join(by_path, "path", "left")
    return both.select("path", "symbol", F.coalesce("by_symbol", "by_path").alias("rowid")).where("rowid is not null")


def chunk_adjacency(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """The adjacency of chunks by rowid: a chunk with a symbol has that symbol's edges in its file, others their file's.

    Edges are cut to MOST_EDGES of a file's symbol, and of a file, before they meet its chunks.
    """
    label = lambda path, symbol: F.concat(path, F.coalesce(F.concat(F.lit(":"), symbol), F.lit("")))
    whole = fs.kept(edges.select("id", "source_path", "source_symbol", "target_path", "target_symbol", "kind", "confidence"))
    end = lambda side: F.struct(F.col(f"{side}_path").alias("path"), F.col(f"{side}_symbol").alias("symbol"))
    ends = whole.select(F.explode(F.array(end("source"), end("target"))).alias("e")).select("e.*").distinct()
    ends = fs.kept(resolved_ends(ends, chunks).select(F.col("path").alias("e_path"), F.col("symbol").alias("e_symbol"), F.col("rowid").alias("to")))

    def side(path: str, symbol: str, to_path: str, to_symbol: str, reason: Column, direction: int) -> DataFrame:
        led = whole.join(ends, F.col(to_path).eqNullSafe(F.col("e_path")) & F.col(to_symbol).eqNullSafe(F.col("e_symbol")))
        return led.select(F.col(path).alias("path"), F.col(symbol).alias("symbol"), F.lit(direction).alias("direction"), "id", "to", "confidence", reason.alias("reason"))

    led = side("source_path", "source_symbol", "target_path", "target_symbol", F.concat_ws(" ", verb(F.col("kind")), label(F.col("target_path"), F.col("target_symbol"))), 0).unionAll(
        side("target_path", "target_symbol", "source_path", "source_symbol", F.concat_ws(" ", label(F.col("source_path"), F.col("source_symbol")), verb(F.col("kind")), F.lit("this")), 1)
    )
    cut = lambda rows, *by: rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by, "direction").orderBy("id", "to"))).where(F.col("nth") <= MOST_EDGES)
    of_file, of_symbol = cut(led, "path").drop("symbol"), cut(led.where("symbol is not null"), "path", "symbol")
    c = chunks.select(F.col("rowid").alias("node"), "path", "symbol")
    told = ["node", "direction", "nth", "id", "to", "confidence", "reason"]
    return c.where("symbol is null").join(of_file, "path").select(told).unionAll(c.where("symbol is not null").join(of_symbol, ["path", "symbol"]).select(told))


def expand_chunks(results: DataFrame, near: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id, rowid, place, score, reason of extra chunks about results (query_id, rowid, rank, score), over an adjacency of chunks."""
    ranked = results.select("query_id", F.col("rowid").alias("node"), "rank", "score")
    return walked(ranked, near).withColumnRenamed("node", "rowid")


def touching(edges: DataFrame, seeds: DataFrame, kinds: list[str] | None = None, limit: int = 50) -> DataFrame:
    """The edges of seeds (seed, path, symbol), either of which may be null: direction, and the first limit of each by id, of these kinds."""
    some = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    fits = lambda path, symbol: (F.col("path").isNull() | (F.col(path) == F.col("path"))) & (F.col("symbol").isNull() | (F.col(symbol) == F.col("symbol")))
    # equality joins by what a seed names
    with_path, without = seeds.where("path is not null"), seeds.where("path is null and symbol is not null")
    parts = []
    for direction, path, symbol in (("out", "source_path", "source_symbol"), ("in", "target_path", "target_symbol")):
        parts += [some.join(with_path, F.col(path) == F.col("path")).where(fits(path, symbol)).withColumn("direction", F.lit(direction)), some.join(without, F.col(symbol) == F.col("symbol")).withColumn("direction", F.lit(direction))]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    order = Window.partitionBy("seed", "direction").orderBy("id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).drop("path", "symbol", "nth")


def callers(edges: DataFrame, symbols: DataFrame, limit: int = 50) -> DataFrame:
    """Edges by which symbols (symbol) are called."""
    return touching(edges, symbols.select(F.col("symbol").alias("seed"), F.lit(None).cast("string").alias("path"), "symbol"), ["calls", "called_by"], limit).where("direction = 'in'")


def implementors(edges: DataFrame, symbols: DataFrame, limit: int = 50) -> DataFrame:
    """Edges by which symbols (symbol) are implemented or extended."""
    return touching(edges, symbols.select(F.col("symbol").alias("seed"), F.lit(None).cast("string").alias("path"), "symbol"), ["implements", "extends"], limit).where("direction = 'in'")


#: Specifiers of relative imports, exports and requires, by priority (fixed values).
SPECIFIERS = (r"""import\s+(?:[^"']+?\s+from\s+)?["'](\.{1,2}/[^"']+)["']""", r"""export\s+[^"']+?\s+from\s+["'](\.{1,2}/[^"']+)["']""", r"""require\(["'](\.{1,2}/[^"']+)["']\)""")


def imported_paths(rows: DataFrame, indexed: DataFrame) -> DataFrame:
    """rows (path, contents, ...) with spec_no and target of each relative import that stands for an indexed path, each target once a row."""
    from spindrift.operators.symbols import resolved_imports

    keys = [c for c in rows.columns if c != "contents"]
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("contents", F.lit(p), F.lit(1)) for p in SPECIFIERS]))
    specifiers = rows.select(*keys, F.posexplode(found).alias("spec_no", "specifier"))
    led = specifiers.join(resolved_imports(specifiers.select("path", "specifier").distinct(), indexed), ["path", "specifier"])
    return led.groupBy(*keys, "target").agg(F.min("spec_no").alias("spec_no"))


def dependency_chunks(results: DataFrame, edges: DataFrame, chunks: DataFrame, top: int = 5, most: int = 8) -> DataFrame:
    """query_id, rowid, place, score of the first chunks of files that the first results' files import, and of those that these import.

    Files of the results themselves are left out, and each file counts once; an import scores 0.4 of its result, one behind it 0.3 of that.
    """
    imports = edges.where("kind = 'imports'").groupBy("source_path", "target_path").agg(F.min("id").alias("id"))
    listed = imports.withColumn("nth", F.row_number().over(Window.partitionBy("source_path").orderBy("id"))).where("nth <= 50").select(F.col("source_path").alias("path"), "nth", F.col("target_path").alias("to"))
    first = chunks.groupBy(F.col("path").alias("to")).agg(F.min_by("rowid", F.struct("start_line", "rowid")).alias("rowid"))
    led = listed.join(first, "to", "left")
    near = results.where(F.col("rank") <= top).select("query_id", "path").distinct().join(led, "path").select("query_id", F.lit(1).alias("hop"), "path", "nth", "to", "rowid")
    far = near.where("rowid is not null").select("query_id", F.col("to").alias("path")).distinct().join(led.where("nth <= 2"), "path").select("query_id", F.lit(2).alias("hop"), "path", "nth", "to", "rowid")
    farther = far.where("rowid is not null").select("query_id", F.col("to").alias("path")).distinct().join(led.where("nth <= 2"), "path").select("query_id", F.lit(2).alias("hop"), "path", "nth", "to", "rowid")
    query_type = results.schema["query_id"].dataType.simpleString()

    def fold(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.set_axis(["query_id", "path", "rank", "score"], axis=1)
        own, seen, out = set(given["path"]), set(), []
        rows = rows.drop_duplicates(["hop", "path", "nth"]).sort_values(["hop", "nth"], kind="stable")
        imports = {(h, p): v[["to", "rowid"]].to_dict("records") for (h, p), v in rows.groupby(["hop", "path"])}

        def take(edge: dict, score: float) -> None:
            if len(out) < most and edge["to"] not in own and edge["to"] not in seen:
                seen.add(edge["to"])
                if edge["rowid"] == edge["rowid"]:
                    out.append((int(edge["rowid"]), score, edge["to"]))

        for r in given[given["rank"] <= top].sort_values("rank").to_dict("records"):
            for edge in imports.get((1, r["path"]), []):
                take(edge, r["score"] * 0.4)
            if len(out) >= most:
                break
            for _, score, path in out[:3]:
                for edge in (imports.get((2, path)) or imports.get((1, path), []))[:2]:
                    take(edge, score * 0.3)
            if len(out) >= most:
                break
        out.sort(key=lambda x: -x[1])
        return pd.DataFrame([(given["query_id"].iloc[0], n, k + 1, s) for k, (n, s, _) in enumerate(out)] if len(given) else [], columns=["query_id", "rowid", "place", "score"])

    ranked = results.select(F.col("query_id").alias("of_query"), F.col("path").alias("of_path"), F.col("rank").alias("of_rank"), F.col("score").alias("of_score"))
    return near.unionAll(far).unionAll(farther).groupBy("query_id").cogroup(ranked.groupBy("of_query")).applyInPandas(fold, f"query_id {query_type}, rowid long, place int, score double")
