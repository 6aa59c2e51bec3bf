"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced clustering of a bounded sample and lie in memory with a
neighbour graph, through which both vectors and queries find their
nearest centroids.  A vector near a border goes into several lists; a query reads the lists whose
centroids are not much farther than its nearest one.  How much farther is measured: for a few rows the
true neighbours are sought among all rows, and the distance ratio is the least that reaches them.  Every vector is
indexed.  Beyond MOST_LISTS lists each becomes a cell with centroids and a graph of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import storage

#: Rows clustered at most; rows aimed at in a list; lists at most at one level (which bounds what is broadcast).
SAMPLE_ROWS, LIST_ROWS, MOST_LISTS = 32_768, 128, 2048
#: A vector goes into every list whose centroid is at most so many times as far as its nearest, to REPLICAS lists at
#: most; a centroid that is CLOSE times as far from one already taken as from the vector, or less, is left out.
REPLICAS, REPLICA_RATIO, CLOSE = 3, 1.15, 0.25
#: Rows whose true neighbours set the distance ratio, and the part of these neighbours that it must reach.
JUDGES, REACH = 128, 0.95
#: Neighbours of a centroid in the graph; centroids kept in a search for a vector to be indexed; nodes expanded at a time.
GRAPH_DEGREE, HOME_BEAM, EXPANDED = 24, 32, 4
#: Postings are read in bundles of about so many rows, a longer list in parts.
BUNDLE_ROWS = 2_000
#: Rows of a cell that are dealt to their lists in one task.
CELL_ROWS = 65_536
#: Rows that one task puts into lists, and tasks at most.
TASK_ROWS, MOST_TASKS = 2_048, 10_000


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Halves the largest cluster by two-means with equal halves until there are lists clusters."""
    rng = np.random.default_rng(seed)
    clusters = [sample]
    while len(clusters) < lists:
        k = max(range(len(clusters)), key=lambda n: len(clusters[n]))
        rows = clusters[k]
        if len(rows) < 2 or (rows == rows[0]).all():
            break
        a, b = rows[rng.choice(len(rows), 2, replace=False)]
        for _ in range(8):
            lean = rows @ (a - b)
            order = np.argsort(lean, kind="stable")
            half = len(rows) // 2
            a, b = rows[order[half:]].mean(0), rows[order[:half]].mean(0)
        clusters[k] = rows[order[half:]]
        clusters.append(rows[order[:half]])
    centroids = np.array([c.mean(0) for c in clusters])
    for _ in range(3):  # each centroid moves to the mean of what is nearest to it
        near = np.concatenate([distances(sample[n : n + 2048], centroids).argmin(1) for n in range(0, len(sample), 2048)])
        counts = np.bincount(near, minlength=len(centroids))
        for d in range(centroids.shape[1]):
            total = np.bincount(near, sample[:, d], len(centroids))
            centroids[:, d] = np.where(counts > 0, total / np.maximum(counts, 1), centroids[:, d])
    return centroids


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, up to rounding (for choosing lists only)."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def graph(centroids: np.ndarray, degree: int = GRAPH_DEGREE) -> np.ndarray:
    """The nearest centroids of each centroid, and a few far ones by which searches cross the space."""
    n = len(centroids)
    degree = min(degree, n)
    near = np.concatenate([np.argsort(distances(centroids[k : k + 512], centroids), 1, kind="stable")[:, :degree] for k in range(0, n, 512)])
    far = np.stack([(np.arange(n) + (n * k) // 5 + 1) % n for k in range(1, 5)], 1)
    return np.concatenate((near, far), 1)


def search(vectors: np.ndarray, centroids: np.ndarray, edges: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroids of each vector by best-first search of the graph, many vectors at a time: ids and distances, ascending."""
    n, rows = len(centroids), np.arange(len(vectors))
    beam = min(beam, n)
    entries = np.unique(np.linspace(0, n - 1, min(n, max(beam, 16))).astype(np.int64))[:beam]
    ids = np.full((len(vectors), beam), n)
    far = np.full((len(vectors), beam), np.inf)
    ids[:, : len(entries)] = entries
    far[:, : len(entries)] = distances(vectors, centroids[entries])
    # a place behind the last centroid takes what is none
    seen, spent = np.zeros((len(vectors), n + 1), bool), np.zeros((len(vectors), n + 1), bool)
    seen[:, entries] = True
    seen[:, n] = spent[:, n] = True
    squares, own = (centroids * centroids).sum(1), (vectors * vectors).sum(1)
    live = rows
    for _ in range(n):
        open_far = np.where(spent[live[:, None], ids[live]], np.inf, far[live])
        width = min(EXPANDED, beam)
        pick = np.argpartition(open_far, width - 1, 1)[:, :width] if beam > width else np.tile(np.arange(beam), (len(live), 1))
        reach = np.take_along_axis(open_far, pick, 1)
        some = np.isfinite(reach).any(1)
        live, pick, reach = live[some], pick[some], reach[some]
        if not len(live):
            break
        node = np.where(np.isfinite(reach), np.take_along_axis(ids[live], pick, 1), n)
        spent[live[:, None], node] = True
        step = np.sort(np.where((node < n)[:, :, None], edges[np.minimum(node, n - 1)], n).reshape(len(live), -1), 1)
        step[:, 1:][step[:, 1:] == step[:, :-1]] = n
        step[seen[live[:, None], step]] = n
        seen[live[:, None], step] = True
        at = np.minimum(step, n - 1)
        new = np.sqrt(np.maximum(own[live, None] + squares[at] - 2 * np.einsum("qd,qkd->qk", vectors[live], centroids[at]), 0))
        new[step == n] = np.inf
        both, all_ids = np.concatenate((far[live], new), 1), np.concatenate((ids[live], step), 1)
        keep = np.argpartition(both, beam - 1, 1)[:, :beam]
        far[live], ids[live] = np.take_along_axis(both, keep, 1), np.take_along_axis(all_ids, keep, 1)
    order = np.argsort(far, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def lists_of(ids: np.ndarray, far: np.ndarray, centroids: np.ndarray) -> list[list[int]]:
    """The lists of each vector: its nearest, and others nearly as near that do not lie close beside those taken."""
    out = []
    for row, reach in zip(ids, far, strict=True):
        taken = [int(row[0])]
        for c, d in zip(row[1:], reach[1:], strict=True):
            if len(taken) == REPLICAS or not d <= REPLICA_RATIO * reach[0] + 1e-12:
                break
            if (np.sqrt(((centroids[taken] - centroids[c]) ** 2).sum(1)) > CLOSE * d).all():
                taken.append(int(c))
        out.append(taken)
    return out


def within(vectors: np.ndarray, centroids: np.ndarray, edges: np.ndarray, ratio: float, beam: int, sizes: np.ndarray, least: int, step: int = 512):
    """For each vector the ids and distances of the centroids within ratio times its nearest one's distance, found through the graph, and of further ones until their lists hold least rows."""
    for start in range(0, len(vectors), step):
        for row, reach in zip(*search(vectors[start : start + step], centroids, edges, beam), strict=True):
            before = np.cumsum(sizes[row]) - sizes[row]
            near = (reach <= ratio * reach[0] + 1e-9) | (before < least)
            yield row[near], reach[near]


def homes_of(vectors: np.ndarray, centroids: np.ndarray, edges: np.ndarray, step: int = 512) -> list[list[int]]:
    return [x for start in range(0, len(vectors), step) for x in lists_of(*search(vectors[start : start + step], centroids, edges, HOME_BEAM), centroids)]


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), float)


def closest(asked: np.ndarray, there: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, row of there, Euclidean distance) of each one's k nearest, and of others as near as the last."""
    squares, own = (there * there).sum(1), (asked * asked).sum(1)[:, None]
    about = own + squares - 2 * asked @ there.T
    if len(there) > k:
        about_last = np.partition(about, k - 1, 1)[:, k - 1 : k]
        q, v = np.nonzero(about <= about_last + 1e-9 * (own + squares.max() + 1))
    else:
        q, v = (x.ravel() for x in np.indices(about.shape))
    return q, v, np.sqrt(((there[v] - asked[q]) ** 2).sum(1))


def best(q: np.ndarray, rep: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest (score, rep) of each q, every rep once."""
    order = np.lexsort((rep, score, q))
    q, rep = q[order], rep[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (rep[1:] != rep[:-1])  # equal reps of a query stand together: they have one score
    order, q = order[fresh], q[fresh]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


HITS = "query_id long, rep long, score double"


def hits_frame(q, rep, score) -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.asarray(q, np.int64), "rep": np.asarray(rep, np.int64), "score": np.asarray(score, float)})


def true_neighbours(distinct: DataFrame, judges: list[tuple[int, np.ndarray]], k: int) -> list[tuple[int, int]]:
    """(judge, rep) of the k nearest other vectors of each judge, sought among all rows: the judges are few and fixed in number."""
    ids, asked = np.array([j for j, _ in judges]), np.array([v for _, v in judges])

    def run(batches):
        for batch in batches:
            if len(batch):
                q, v, score = closest(asked, matrix(batch["v"]), k + 1)
                rep = batch["rep"].to_numpy()[v]
                other = rep != ids[q]
                q, rep, score = q[other], rep[other], score[other]
                take = best(q, rep, score, k)
                yield hits_frame(ids[q[take]], rep[take], score[take])

    first = Window.partitionBy("query_id").orderBy("score", "rep")
    found = distinct.select("rep", "v").mapInPandas(run, HITS).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    return [(r["query_id"], r["rep"]) for r in found.select("query_id", "rep").collect()]


def trained(rows: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    centroids = balanced_centroids(rows, lists)
    return centroids, graph(centroids)


class Level:
    """Centroids of one level, broadcast, with the ratio and the beam that reach most true neighbours."""

    def __init__(self, spark, sample: np.ndarray, lists: int):
        self.centroids, self.edges = trained(sample, lists)
        self.shared = spark.sparkContext.broadcast((self.centroids, self.edges))
        self.ratio, self.beam = 1.0, HOME_BEAM
        self.sizes, self.least = np.ones(len(self.centroids), np.int64), 0

    def postings(self, distinct: DataFrame) -> DataFrame:
        """list, rep, v."""
        shared = self.shared

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def homes(column: pd.Series) -> pd.Series:
            return pd.Series(homes_of(matrix(column), *shared.value), dtype=object)

        return distinct.select(F.explode(homes("v")).alias("list"), "rep", "v")

    def judge(self, postings: DataFrame, judges: list[tuple[int, np.ndarray]], truth: list[tuple[int, int]], reach: float, k: int) -> None:
        """Sets the ratio that reaches a part of the true neighbours, and the beam that it needs.

        In any case a query reads lists until they hold k + 1 vectors, each of which may stand in REPLICAS of them.
        """
        self.least = REPLICAS * (k + 1)
        for r in postings.groupBy("list").count().collect():  # a row for each list of this level
            self.sizes[r["list"]] = r["count"]
        lists: dict[int, list[int]] = {}
        wanted = postings.sparkSession.createDataFrame([(r,) for r in sorted({r for _, r in truth})], "rep long")
        for r in postings.select("list", "rep").join(F.broadcast(wanted), "rep").collect():
            lists.setdefault(r["rep"], []).append(r["list"])
        far = distances(np.array([v for _, v in judges]), self.centroids)
        far /= np.maximum(far.min(1, keepdims=True), 1e-12)
        row = {j: n for n, (j, _) in enumerate(judges)}
        need = [far[row[j], lists[r]].min() for j, r in truth]
        self.ratio = float(np.quantile(need, reach, method="higher")) * (1 + 1e-9) if need else float("inf")
        self.beam = min(len(self.centroids), max(HOME_BEAM, int(1.25 * (far <= self.ratio).sum(1).max()) + 8))

    def probes(self, queries: DataFrame) -> DataFrame:
        """query_id, v, list."""
        shared, ratio, beam, sizes, least = self.shared, self.ratio, self.beam, self.sizes, self.least

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def near(column: pd.Series) -> pd.Series:
            return pd.Series([ids.tolist() for ids, _ in within(matrix(column), *shared.value, ratio, beam, sizes, least)], dtype=object)

        return queries.select("query_id", "v", F.explode(near("v")).alias("list"))


#: Lists of one cell at most, and lists that a query is told of in each cell at least.
CELL_LISTS, CELL_PROBES = 1 << 11, 8


class Cells:
    """The second level: each list of the first is a cell, whose own centroids are found from a bounded sample of its rows.

    Cells are dealt in parts of CELL_ROWS rows, each beside its cell's centroids, so no task holds a whole cell and
    nothing that grows with the rows is broadcast.
    """

    def __init__(self, cells: DataFrame, name: str):
        cells = cells.withColumnRenamed("list", "cell")
        counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # one row for each list of the first level
        self.parts = F.broadcast(counts.select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts")))
        share = F.abs(F.xxhash64("rep") % 1_000_000) * F.col("n") < F.lit(1_000_000 * CELL_LISTS * 8)

        def centres(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            made = balanced_centroids(matrix(rows["v"]), int(min(CELL_LISTS, max(1, rows["n"].iloc[0] // LIST_ROWS))))
            return pd.DataFrame({"cell": key[0], "centroids": [made.tolist()]})

        sampled = cells.join(F.broadcast(counts), "cell").where(share).select("cell", "v", "n")
        self.centroids = storage.keep(sampled.groupBy("cell").applyInPandas(centres, "cell long, centroids array<array<double>>"), f"{name}-centroids")
        self.rows, self.ratio = cells, 1.0

    def _dealt(self, rows: DataFrame, by: str, work, schema: str) -> DataFrame:
        part = F.pmod(F.xxhash64(by), F.col("parts")).cast("int")
        left = rows.join(self.parts, "cell").withColumn("part", part).drop("parts")
        right = self.centroids.join(self.parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "centroids")
        return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(work, schema)

    def postings(self) -> DataFrame:
        def deal(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(known):
                return pd.DataFrame({"list": [], "rep": [], "v": []})
            centroids = np.array([np.asarray(c, float) for c in known["centroids"].iloc[0]])
            homes = homes_of(matrix(rows["v"]), centroids, graph(centroids))
            return rows[["cell", "rep", "v"]].assign(list=homes).explode("list").assign(list=lambda x: x["cell"] * CELL_LISTS + x["list"].astype("int64"))[["list", "rep", "v"]]

        return self._dealt(self.rows, "rep", deal, "list long, rep long, v array<double>")

    def probes(self, asked: DataFrame, ratio: float) -> DataFrame:
        """query_id, v, list, far: lists of the cells that a query reads, within ratio times the nearest of all of them."""

        def deal(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(known):
                return pd.DataFrame({"query_id": [], "v": [], "list": [], "far": []})
            centroids = np.array([np.asarray(c, float) for c in known["centroids"].iloc[0]])
            # of this cell's lists at least the first CELL_PROBES are told, of which the window below keeps what it needs
            found = [*within(matrix(rows["v"]), centroids, graph(centroids), ratio, len(centroids), np.ones(len(centroids), np.int64), CELL_PROBES)]
            sized = [len(ids) for ids, _ in found]
            out = rows[["query_id", "v"]].loc[rows.index.repeat(sized)]
            return out.assign(list=int(rows["cell"].iloc[0]) * CELL_LISTS + np.concatenate([i for i, _ in found]), far=np.concatenate([d for _, d in found]))

        found = self._dealt(asked.withColumnRenamed("list", "cell"), "query_id", deal, "query_id long, v array<double>, list long, far double")
        if ratio == float("inf"):
            return found
        order = Window.partitionBy("query_id").orderBy("far", "list")
        before = F.sum("n").over(order) - F.col("n")
        counted = found.join(self.sizes, "list").withColumn("nearest", F.min("far").over(Window.partitionBy("query_id"))).withColumn("before", before)
        return counted.where((F.col("far") <= ratio * F.col("nearest") + 1e-9) | (F.col("before") < self.least)).drop("nearest", "before", "n")

    def judge(self, postings: DataFrame, asked: DataFrame, truth: list[tuple[int, int]], reach: float, k: int) -> None:
        """Sets the ratio that reaches a part of the true neighbours through the cells that are read."""
        self.sizes, self.least = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")), REPLICAS * REPLICAS * (k + 1)
        spark = postings.sparkSession
        pairs = F.broadcast(spark.createDataFrame(truth, "query_id long, rep long"))
        far = self.probes(asked, float("inf")).select("query_id", "list", (F.col("far") / F.greatest(F.min("far").over(Window.partitionBy("query_id")), F.lit(1e-12))).alias("far"))
        need = postings.select("list", "rep").join(pairs, "rep").join(far, ["query_id", "list"]).groupBy("query_id", "rep").agg(F.min("far").alias("far"))
        found = sorted(r["far"] for r in need.collect())
        missed = len(truth) - len(found)
        at = min(len(found) - 1, int(np.ceil(reach * len(truth))))
        self.ratio = found[at] * (1 + 1e-9) if found and missed <= (1 - reach) * len(truth) else float("inf")


def _vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where("vec_id is not null and v is not null")
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    )


def nearest(embeddings: DataFrame, k: int = 10, query_every: int = 100, most_lists: int = MOST_LISTS, reach: float = REACH) -> DataFrame:
    """The k nearest found for each vec_id divisible by query_every: query_id, rank, vec_id, score (Euclidean distance).

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    rows without a vec_id or (should lengths differ) with another length than the commonest.  A
    row never finds its own vec_id; repeated rows count once.  Ties go to the smaller vec_id.
    Equal vectors are indexed once with the k + 1 smallest of their vec_ids,
    since no query can return more of them.  Other columns are not read.  An empty table gives no rows.
    reach is the part of the true neighbours of JUDGES rows that the lists read must hold.
    """
    names = "query_id long, rank int, vec_id long, score double"
    index = build(embeddings, k, most_lists, reach)
    return embeddings.sparkSession.createDataFrame([], names) if index is None else answers(index, k, query_every)


def answers(index: tuple, k: int, query_every: int) -> DataFrame:
    """What nearest() returns, from a built index."""
    rows, distinct, postings, probes = index
    queries = rows.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    counts = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.select("list", F.ceil(F.col("n") / BUNDLE_ROWS).cast("int").alias("parts"))
    total = max(1, postings.count() // BUNDLE_ROWS)
    bundle = F.pmod(F.xxhash64("list", "part"), F.lit(total)).alias("bundle")
    left = postings.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).select(bundle, "list", "part", "rep", "v")
    right = probes(queries).join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(bundle, "list", "part", "query_id", "v")

    def best_in(posted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 nearest vectors of a bundle for each query, from the lists that it reads."""
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        readers = dict(iter(asked.groupby(["list", "part"])))
        for place, there in posted.groupby(["list", "part"]):
            if place in readers:
                q, v, score = closest(matrix(readers[place]["v"]), matrix(there["v"]), k + 1)
                found.append((readers[place]["query_id"].to_numpy()[q], there["rep"].to_numpy()[v], score))
        q, rep, score = (np.concatenate(x) for x in zip(*found, strict=True))
        take = best(q, rep, score, k + 1)
        return hits_frame(q[take], rep[take], score[take])

    # stated numbers of partitions, since small rows that take long would be put into few
    tasks = min(total, MOST_TASKS)
    hits = left.repartition(tasks, "bundle").groupBy("bundle").cogroup(right.repartition(tasks, "bundle").groupBy("bundle")).applyInPandas(best_in, HITS)
    # k + 1 vectors are enough for each query: each holds a vec_id of its own, one of which may be the query's
    first = Window.partitionBy("query_id").orderBy("score", "rep")
    merged = hits.groupBy("query_id", "rep").agg(F.min("score").alias("score")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        merged.join(distinct.select("rep", "ids"), "rep").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id != vec_id")
        .groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def build(embeddings: DataFrame, k: int = 10, most_lists: int = MOST_LISTS, reach: float = REACH):
    """(rows, distinct vectors, postings, probes) or None where no vector takes part: rows are vec_id and v; postings list, rep and v; probes(queries) gives query_id, v and list."""
    spark = embeddings.sparkSession
    rows = _vectors(embeddings)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return None
    rows = rows.where(F.size("v") == lengths[0]["d"])
    order = Window.partitionBy("key", "v").orderBy("vec_id")
    ranked = (
        rows.withColumn("key", F.xxhash64("v")).groupBy("key", "v", "vec_id").agg(F.lit(1).alias("one"))
        .withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1)
    )
    distinct = storage.keep(ranked.groupBy("key", "v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("rep", "v", "ids"), "ann-vectors")
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("rep")).limit(SAMPLE_ROWS).select("rep", "v").toArrow()
    reps, values = sample["rep"].to_numpy(), sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(sample.num_rows, -1)
    judges = [(int(r), v) for r, v in zip(reps[:JUDGES], values[:JUDGES], strict=True)]
    truth = true_neighbours(distinct, judges, k)
    level = Level(spark, values, min(most_lists, max(1, n // LIST_ROWS)))
    postings = storage.keep(level.postings(distinct.repartition(min(MOST_TASKS, n // TASK_ROWS + 1), "rep")), "ann-lists")
    if n // LIST_ROWS <= most_lists:
        level.judge(postings, judges, truth, reach, k)
        return rows, distinct, postings, level.probes
    # half of what may be missed is missed at each level
    level.judge(postings, judges, truth, 1 - (1 - reach) / 2, k)
    cells = Cells(postings, "ann-cells")
    fine = storage.keep(cells.postings(), "ann-fine")
    asked = level.probes(spark.createDataFrame([(j, v.tolist()) for j, v in judges], "query_id long, v array<double>"))
    cells.judge(fine, asked, truth, reach, k)
    return rows, distinct, fine, lambda queries: cells.probes(level.probes(queries), cells.ratio).select("query_id", "v", "list")
