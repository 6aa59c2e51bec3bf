"""A stored index: chunks, postings with positions, vectors, file hashes and edges.

Tables lie in immutable segments named by a UUID; a manifest names the segments in force and what scores need.  A change writes its
segment first and then a manifest under the next version's name, which can be taken once only.  A writer that finds
the name taken reads what came between: changes of other paths are put behind those, a change of the same paths is an error and
leaves the other's rows alone.  A row counts unless a later segment lists its rowid as dead.

Postings lie in blocks: one row holds a term's postings within SLICE rowids, with the rows' lengths, the greatest frequencies and
the least lengths; places stand one after the other, as many a row as its frequency says.  So a block tells how much its rows can score at most, and a search reads the blocks that can matter.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import stem as S
from spindrift.functions import text as X
from spindrift.operators import graph, lexical, maintenance, vectors
from spindrift.operators.cache import EmbedCache
from spindrift.sources import fs

SCHEMA_VERSION = "3"
#: Rowids of a block of postings.
SLICE = 1024
#: Tokens for each bucket of postings, buckets at most, and buckets over which a term's blocks are dealt.
BUCKET_TOKENS, MOST_BUCKETS, SALTS = 1 << 20, 4096, 8
#: Compression of the index's files.
CODEC = "zstd"
#: Words of queries, or rowids, that are told to a scan at most.
MOST_TOLD = 1000
#: Postings of a search's words beyond which blocks are pruned before they are read, and the blocks of a word that set the bar.
PRUNED_FROM, SEED_BLOCKS = 200_000, 16
#: Times that a change is put behind others that came between.
ATTEMPTS = 20
FIELDS = ("path", "symbol", "contents")
CHUNKS = "rowid long, id string, path string, start_line int, end_line int, symbol string, kind string, parent string, language string, contents string"
EDGES = "path string, id long, source_path string, source_symbol string, target_path string, target_symbol string, kind string, confidence double"
FILES = "path string, hash string, op string, indexed_at timestamp"
LENGTHS = "rowid long, path string, n0 int, n1 int, n2 int"
POSTINGS = "term string, slice long, n int, counts array<long>, m0 int, m1 int, m2 int, l0 int, l1 int, l2 int, rowids array<long>, f0 array<int>, f1 array<int>, f2 array<int>, n0 array<int>, n1 array<int>, n2 array<int>, p0 array<int>, p1 array<int>, p2 array<int>, bucket int"
#: A block while it is made: its list of numbers begins with PACKED_HEAD.
PACKED = "term string, slice long, n int, packed array<int>"
PACKED_HEAD = ("counts",) * 7 + ("places of path", "places of symbol") + ("m0", "m1", "m2", "l0", "l1", "l2")
VECTORS = "rowid long, path string, embedding array<float>"
ADJACENCY = "node long, direction int, nth int, id long, to long, confidence double, reason string"
DEAD = "rowid long, n0 int, n1 int, n2 int"
TABLES = {"chunks": CHUNKS, "dead": DEAD, "edges": EDGES, "files": FILES, "lengths": LENGTHS, "postings": POSTINGS, "vectors": VECTORS}
#: Columns of a block that tell of its rows, and those that hold them.
HEADS = ("n", "m0", "m1", "m2", "l0", "l1", "l2")
LISTS = ("rowids", "f0", "f1", "f2", "n0", "n1", "n2", "p0", "p1", "p2")


class ConcurrentChange(RuntimeError):
    """Another writer changed the same files since this store was opened; nothing of this change is in force."""


def buckets_of(tokens: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-tokens // BUCKET_TOKENS)))


def salts_of(buckets: int) -> int:
    return SALTS if buckets > SALTS else 1


def bucket_of(term: Column, slice_: Column, buckets: int) -> Column:
    """A term's blocks lie in one bucket, or dealt by their slices over SALTS in a row."""
    return F.pmod(F.pmod(F.xxhash64(term), F.lit(buckets)) + F.pmod(slice_, F.lit(salts_of(buckets))), F.lit(buckets)).cast("int")


def blocks_of(chunks: DataFrame, stemmed: bool, counts_only: bool = False) -> DataFrame:
    """term, slice, n, packed of chunks: each row's places of each term in path, symbol text and contents, in blocks.

    Blocks are built where the rows lie, so only blocks are shuffled; a slice whose rows lie in several tasks makes several blocks.
    packed is one list of numbers (see opened), a third of what the columns of POSTINGS take while they are shuffled and sorted.
    With counts_only term and counts alone, a row for each term of some rows in whatever order.
    counts: how many rows hold the term in the fields 1 (path), 2 (symbol), 1 and 2, 4 (contents) and so on.
    """
    tokens = [X.tokens(F.coalesce(c, F.lit(""))).alias(f"t{n}") for n, c in enumerate((F.col("path"), X.symbol_text(F.col("symbol"), F.col("parent")), F.col("contents")))]

    def block(rows: pa.Table) -> pa.RecordBatch:
        rowids = rows["rowid"].to_numpy()
        if (rowids[1:] < rowids[:-1]).any():
            order = np.argsort(rowids, kind="stable")
            rows, rowids = rows.take(pa.array(order)), rowids[order]
        words, length, key, place = [], [], [], []
        for k in range(3):
            lists = rows[f"t{k}"].combine_chunks()
            length.append(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            words.append(lists.flatten())
            key.append(np.repeat(np.arange(len(rowids)), length[k]))
            place.append(np.arange(len(words[k])) - np.repeat(np.cumsum(length[k]) - length[k], length[k]))
        coded = pa.concat_arrays(words).dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if stemmed:
            stems = pa.array([S.stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
            terms, codes = stems.dictionary, stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        at = 0
        for k in range(3):  # a posting's key: its term's code, then its row
            key[k] = key[k] + codes[at : at + len(key[k])] * len(rowids)
            at += len(key[k])
        postings, which = np.unique(np.concatenate(key), return_inverse=True)
        if not len(postings):
            return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in packed_type], schema=packed_type)
        codes, nth = np.divmod(postings, len(rowids))
        slices = np.zeros_like(nth) if counts_only else rowids[nth] // SLICE
        starts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (slices[1:] != slices[:-1])))
        n = np.diff(np.append(starts, len(codes)))
        at, frequency, places = 0, [], []
        for k in range(3):
            own = which[at : at + len(key[k])]
            at += len(own)
            frequency.append(np.bincount(own, minlength=len(postings)))
            places.append(place[k][np.argsort(own, kind="stable")])
        mask = sum((f > 0).astype(np.int64) << k for k, f in enumerate(frequency))
        counts = np.stack([np.add.reduceat((mask == k).astype(np.int64), starts) for k in range(1, 8)], 1)
        term = terms.take(pa.array(codes[starts]))
        if counts_only:
            counts = pa.ListArray.from_arrays(pa.array(np.arange(0, 7 * len(starts) + 1, 7), pa.int32()), pa.array(counts.reshape(-1)))
            return pa.RecordBatch.from_arrays([term, counts], schema=packed_type)
        held = [np.add.reduceat(f, starts) for f in frequency]  # places of a block, by field
        size = len(PACKED_HEAD) + 7 * n + sum(held)
        ends = np.cumsum(size)
        first = ends - size
        flat = np.zeros(ends[-1], np.int32)
        for k in range(7):
            flat[first + k] = counts[:, k]
        flat[first + 7], flat[first + 8] = held[0], held[1]
        for k in range(3):
            flat[first + 9 + k], flat[first + 12 + k] = np.maximum.reduceat(frequency[k], starts), np.minimum.reduceat(length[k][nth], starts)
        inside = np.arange(len(codes)) - np.repeat(starts, n)
        to = np.repeat(first + len(PACKED_HEAD), n) + inside
        wide = np.repeat(n, n)
        for column in (rowids[nth] - slices * SLICE, *frequency, *(x[nth] for x in length)):
            flat[to] = column
            to += wide
        to = first + len(PACKED_HEAD) + 7 * n
        for k in range(3):
            before = np.cumsum(held[k]) - held[k]
            flat[np.repeat(to - before, held[k]) + np.arange(len(places[k]))] = places[k]
            to = to + held[k]
        packed = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([term, pa.array(slices[starts]), pa.array(n, pa.int32()), packed], schema=packed_type)

    packed_type = pa.schema([("term", pa.string()), ("counts", pa.list_(pa.int64()))] if counts_only else [("term", pa.string()), ("slice", pa.int64()), ("n", pa.int32()), ("packed", pa.list_(pa.int32()))])

    def run(batches):
        left = None  # rows of a slice that may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch]).combine_chunks()
            slices = rows["rowid"].to_numpy() // SLICE
            ends = [*(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(slices)]
            start = 0
            for k, end in enumerate(ends[:-1]):
                while end - start >= SLICE or (end > start and ends[k + 1] - start > SLICE):
                    yield block(rows.slice(start, min(SLICE, end - start)))
                    start += min(SLICE, end - start)
            while len(slices) - start > SLICE:
                yield block(rows.slice(start, SLICE))
                start += SLICE
            left = rows.slice(start)
        if left is not None and left.num_rows:
            yield block(left)

    return chunks.select("rowid", *tokens).mapInArrow(run, "term string, counts array<long>" if counts_only else PACKED)


def opened(blocks: DataFrame) -> DataFrame:
    """POSTINGS of packed blocks, in their order.

    packed holds counts, the numbers of places in path and symbol text, the greatest frequencies and least lengths, then for all rows of the block one list after the other: rowids within
    the slice, frequencies and lengths by field; then the places by field.
    """
    n, head = F.col("n"), len(PACKED_HEAD)
    part = lambda nth: F.slice("packed", n * nth + (head + 1), n)
    behind = n * 7 + (head + 1)
    p0, p1 = F.col("packed")[7], F.col("packed")[8]
    places = (F.slice("packed", behind, p0), F.slice("packed", behind + p0, p1), F.slice("packed", behind + p0 + p1, F.size("packed") + 1 - (behind + p0 + p1)))
    out = {"term": F.col("term"), "slice": F.col("slice"), "n": n, "bucket": F.col("bucket"), "counts": F.slice("packed", 1, 7).cast("array<long>")}
    out["rowids"] = F.transform(part(0), lambda x: x + F.col("slice") * SLICE)
    for k in range(3):
        out |= {f"f{k}": part(1 + k), f"n{k}": part(4 + k), f"p{k}": places[k], f"m{k}": F.col("packed")[9 + k], f"l{k}": F.col("packed")[12 + k]}
    return blocks.select(*[out[c.split()[0]].alias(c.split()[0]) for c in POSTINGS.split(", ")])


def placed_apart(blocks: DataFrame, places: list[str]) -> DataFrame:
    """Blocks whose places are a list for each row of a block, cut by the rows' frequencies."""
    schema = ", ".join(f"{f.name} {'array<array<int>>' if f.name in places else f.dataType.simpleString()}" for f in blocks.schema)

    def run(batches):
        for batch in batches:
            out = []
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if name in places:
                    sizes = batch[f"f{name[1:]}"]
                    outer = np.append(0, np.cumsum(sizes.value_lengths().to_numpy(zero_copy_only=False)))
                    inner = np.append(0, np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False)))
                    column = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), column.flatten()))
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    return blocks.mapInArrow(run, schema)


def lengths_of(chunks: DataFrame) -> DataFrame:
    size = lambda c, n: F.size(X.tokens(F.coalesce(c, F.lit("")))).alias(n)
    return chunks.select("rowid", "path", size(F.col("path"), "n0"), size(X.symbol_text(F.col("symbol"), F.col("parent")), "n1"), size(F.col("contents"), "n2"))


def spread(frame: DataFrame) -> DataFrame:
    """A frame whose few large parts are dealt to all cores; one that has parts enough stays as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def in_order(frame: DataFrame) -> DataFrame:
    """Rows by rowid, a slice's rows in one part: they make one block a term, whatever order they came in.

    How many parts is left to the shuffle, which knows the rows' bytes; the plan is not run to ask it for its parts.
    """
    return frame.repartitionByRange(F.floor(F.col("rowid") / SLICE)).sortWithinPartitions("rowid")


def shaped(frame: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its order; missing ones null."""
    columns = [c.strip().split(" ", 1) for c in schema.split(",")]
    return frame.select(*[(F.col(n) if n in frame.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])


class Store:
    """An index below a folder.

    With read_only a store that does not fit is opened all the same, and stale_reason tells why; version opens the state of a kept version.
    """

    def __init__(self, spark: SparkSession, root: str, model: str | None = None, dim: int | None = None, stemmed: bool = False, buckets: int | None = None, read_only: bool = False, version: int | None = None):
        self.spark, self.root, self.read_only, self.buckets = spark, root.rstrip("/"), read_only or version is not None, buckets
        self.stale_reason: str | None = None
        fresh = {"schema_version": SCHEMA_VERSION, "model": model, "dim": dim, "stemmed": stemmed, "version": 0, "segments": [], "next_rowid": 0, "meta": {}}
        self.manifest = self._read(version) or fresh
        wrong = [k for k in ("schema_version", "model", "dim", "stemmed") if self.manifest[k] != fresh[k]]
        if wrong == ["model", "dim"] and model is None and self.has_vectors():
            wrong = []  # opened for words only: vectors that stand there are left alone
        if wrong and self.read_only:
            self.stale_reason = ", ".join(f"{k} is {self.manifest[k]!r}, not {fresh[k]!r}" for k in wrong)
        elif wrong:
            self._publish(lambda base: fresh | {"meta": base["meta"], "next_rowid": base["next_rowid"]})

    def _versions(self) -> list[int]:
        return [int(n[:-5]) for n in fs.names(self.spark, f"{self.root}/manifests") if n.endswith(".json") and n[0] not in "_."]

    def _read(self, version: int | None = None) -> dict | None:
        versions = self._versions()
        if version is not None and version not in versions:
            raise ValueError(f"version {version} is not kept")
        return json.loads(fs.read_text(self.spark, f"{self.root}/manifests/{version or max(versions):010d}.json")) if versions else None

    # what is there

    def segments(self, name: str) -> list[dict]:
        return [s for s in self.manifest["segments"] if name in s["tables"]]

    def has_vectors(self) -> bool:
        return bool(self.segments("vectors"))

    def totals(self) -> dict[str, int]:
        """Rows that count, and tokens of their fields."""
        return {k: sum(s["sums"][k] - s["gone"][k] for s in self.manifest["segments"]) for k in ("n", "n0", "n1", "n2")}

    def table(self, name: str, wanted: set[str] | None = None, own_rowids: bool = False) -> DataFrame:
        """A table's rows in the segments in force, with the segment's id; rowids as the index counts them, or each segment's own."""
        paths = [f"{self.root}/{name}/segment={s['id']}" for s in self.segments(name) if wanted is None or s["id"] in wanted]
        schema = f"{TABLES[name]}, segment string"
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)
        return rows.withColumn("rowid", F.col("rowid") + self._first()) if name in ("chunks", "lengths", "vectors") and self._moved() and not own_rowids else rows

    def _moved(self) -> bool:
        return any(s["first"] for s in self.manifest["segments"])

    def _of_segment(self, key: str) -> Column:
        return F.element_at(F.create_map(*[x for s in self.manifest["segments"] for x in (F.lit(s["id"]), F.lit(s[key]).cast("long"))]), F.col("segment"))

    def _first(self) -> Column:
        """What a segment's own rowids are counted from."""
        return self._of_segment("first")

    def _placed(self) -> Column:
        """The place of a row's segment among those in force."""
        return F.element_at(F.create_map(*[x for n, s in enumerate(self.manifest["segments"]) for x in (F.lit(s["id"]), F.lit(n))]), F.col("segment"))

    def files(self) -> DataFrame:
        """path, hash, indexed_at, segment of the files in the index."""
        rows = self.table("files")
        if self.manifest["segments"]:
            rows = rows.groupBy("path").agg(F.max_by(F.struct("op", "hash", "indexed_at", "segment"), self._placed()).alias("f")).select("path", "f.*")
        return rows.where("op = 'put'").select("path", "hash", "indexed_at", "segment")

    def live(self, name: str) -> DataFrame:
        """A table's rows that count."""
        rows = self.table(name)
        if name == "edges":
            return rows if len(self.manifest["segments"]) < 2 else rows.join(self.files().select("path", "segment"), ["path", "segment"], "left_semi")
        return self._counting(rows)

    def _counting(self, rows: DataFrame) -> DataFrame:
        """Rows (rowid, segment, ...) that no later segment lists as dead; a later segment may use a rowid again."""
        if not any(s["gone"]["n"] for s in self.manifest["segments"]):
            return rows
        dead = self.table("dead").groupBy("rowid").agg(F.max(self._placed()).alias("_killed"))
        return rows.withColumn("_placed", self._placed()).join(dead, "rowid", "left").where("_killed is null or _placed >= _killed").drop("_placed", "_killed")

    def chunks(self) -> DataFrame:
        return self.live("chunks").drop("segment")

    def fetched(self, wanted: DataFrame) -> DataFrame:
        """The chunks of wanted rowids; up to MOST_TOLD of them are told to the scan, which then skips what cannot hold them."""
        ids = [r["rowid"] for r in wanted.select("rowid").distinct().limit(MOST_TOLD + 1).collect()]
        rows = self.table("chunks")
        if len(ids) > MOST_TOLD:
            return self._counting(rows.join(wanted.select("rowid").distinct(), "rowid", "left_semi")).drop("segment")
        parts = []
        for s in self.segments("chunks"):  # told as the segment's own rowids, so that its files' statistics apply
            if own := [i - s["first"] for i in ids if not s["first"] or s["first"] <= i < s["first"] + s["span"]]:
                found = self.table("chunks", {s["id"]}, own_rowids=True).where(F.col("rowid").isin(own))
                parts.append(found.withColumn("rowid", F.col("rowid") + s["first"]) if s["first"] else found)
        out = parts[0] if parts else rows.limit(0)
        for part in parts[1:]:
            out = out.unionAll(part)
        return self._counting(out).drop("segment")

    def edges(self) -> DataFrame:
        return self.live("edges").drop("segment", "path")

    def hashes(self) -> DataFrame:
        return self.files().select("path", "hash")

    def vectors(self) -> DataFrame:
        return self.live("vectors").drop("segment")

    def meta(self, key: str) -> str | None:
        return self.manifest["meta"].get(key)

    def set_meta(self, **values: str) -> None:
        self._publish(lambda base: base | {"meta": base["meta"] | values})

    def status(self) -> DataFrame:
        """One row: counts, last time, mode and why the index may be stale or of lesser use."""
        m, mode = self.manifest, "hybrid" if self.has_vectors() else "keyword-only"
        files = self.files().agg(F.count(F.lit(1)).alias("files"), F.max("indexed_at").alias("last_indexed"))
        edges = self.live("edges").agg(F.count(F.lit(1)).alias("edges"))
        given = [F.lit(v).cast("string").alias(k) for k, v in (("mode", mode), ("model", m["model"]), ("stale_reason", self.stale_reason), ("degraded_reason", None if self.has_vectors() else "no vectors"))]
        return files.join(edges, F.lit(True)).select("*", F.lit(self.totals()["n"]).cast("long").alias("chunks"), F.lit(m["version"]).alias("version"), *given)

    # changes

    def _publish(self, change: Callable[[dict], dict]) -> None:
        """Puts a manifest behind the last one; change makes it of that one, again for each that came between, or raises ConcurrentChange."""
        if self.read_only:
            raise PermissionError("the index was opened for reading only")
        for _ in range(ATTEMPTS):
            base = self._read() or self.manifest
            new = change(base) | {"version": base["version"] + 1}
            if fs.claim(self.spark, f"{self.root}/manifests/{new['version']:010d}.json", json.dumps(new)):
                self.manifest = new
                return
        raise ConcurrentChange(f"{ATTEMPTS} other changes came first")

    def _chunks_of(self, rows: DataFrame, ordered: bool = False) -> tuple[str, DataFrame]:
        """A new segment's number, and its chunks, which are written once and read by what is made of them; ordered: rows come by rowid."""
        number = uuid.uuid4().hex
        to = f"{self.root}/chunks/segment={number}"
        rows = shaped(rows, CHUNKS)
        (rows if ordered else in_order(rows)).write.mode("errorifexists").option("compression", CODEC).parquet(to)
        return number, self.spark.read.schema(CHUNKS).parquet(to)

    def _write(self, number: str, parts: dict[str, DataFrame], first: int | None) -> dict:
        """Writes the rest of a segment that no manifest names yet, and tells what a manifest says of it."""
        tables = {"chunks": parts["chunks"]}
        for name in sorted(parts.keys() - tables, key=lambda n: n == "postings"):  # the postings last: their buckets follow from the lengths
            frame, to = parts[name], f"{self.root}/{name}/segment={number}"
            if name != "postings":
                shaped(frame, TABLES[name]).write.mode("errorifexists").option("compression", CODEC).parquet(to)
                tables[name] = self.spark.read.schema(TABLES[name]).parquet(to)
                continue
            sums = tables["lengths"].agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("rowid"), F.lit(-1)).alias("last"), *(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(3))).first().asDict()
            gone = tables["dead"].agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(3))).first().asDict()
            last, buckets = sums.pop("last"), self.buckets or buckets_of(sum(sums[f"n{k}"] for k in range(3)))
            blocks = frame.withColumn("bucket", bucket_of(F.col("term"), F.col("slice"), buckets))
            # few buckets are cut by their terms, so that all cores write them
            pieces = max(1, -(-4 * self.spark.sparkContext.defaultParallelism // buckets))
            dealt = blocks.repartition(buckets, "bucket") if pieces == 1 else blocks.repartition(buckets * pieces, "bucket", F.pmod(F.xxhash64("term"), F.lit(997 * pieces)) % pieces)
            sorted_ = dealt.sortWithinPartitions("bucket", "term", "slice")
            opened(sorted_).write.partitionBy("bucket").mode("errorifexists").option("compression", CODEC).parquet(to)
        return {"id": number, "tables": sorted(parts), "first": first, "span": last + 1, "buckets": buckets, "sums": sums, "gone": gone}

    def _commit(self, number: str, parts: dict[str, DataFrame], first: int | None = None, replaces: list[str] | None = None) -> None:
        """Writes a segment of parts and puts it in force: behind the others, or in place of those that it replaces.

        first: None where the segment counts its rowids from 0; they then follow on those of the manifest that it goes into.
        """
        if self.read_only:
            raise PermissionError("the index was opened for reading only")
        seen = {s["id"] for s in self.manifest["segments"]}
        made = self._write(number, parts, first)
        touched = self.spark.read.schema(FILES).parquet(f"{self.root}/files/segment={made['id']}").select("path")

        def change(base: dict) -> dict:
            there = [s["id"] for s in base["segments"]]
            between = [s for s in base["segments"] if s["id"] not in seen]
            if any(base[k] != self.manifest[k] for k in ("schema_version", "model", "dim", "stemmed")):
                raise ConcurrentChange("the index was begun anew for another model")
            if replaces is not None:
                if not set(replaces) <= set(there):
                    raise ConcurrentChange("segments to be replaced are gone")
                kept = [s for s in base["segments"] if s["id"] not in replaces]
                return base | {"segments": [made | {"first": 0}, *kept]}
            added = [s for s in between if not s.get("replaces")]
            if added:
                paths = [f"{self.root}/files/segment={s['id']}" for s in added]
                clash = self.spark.read.schema(FILES).parquet(*paths).join(touched, "path", "left_semi").select("path").limit(3).collect()
                if clash:
                    raise ConcurrentChange("changed by another writer too: " + ", ".join(r["path"] for r in clash))
            at = base["next_rowid"] if made["first"] is None else made["first"]
            after = max(base["next_rowid"], -(-(at + made["span"]) // SLICE) * SLICE)
            return base | {"segments": [*base["segments"], made | {"first": at}], "next_rowid": after}

        if replaces is not None:
            made["replaces"] = True
        try:
            self._publish(change)
        except ConcurrentChange:
            self._discard(made["id"])
            raise

    def _discard(self, segment: str) -> None:
        for name in TABLES:
            fs.delete(self.spark, f"{self.root}/{name}/segment={segment}")

    def numbered(self, chunks: DataFrame) -> DataFrame:
        """Chunks with rowids from 0 on that follow path, start_line and id."""
        keys = ["path", "start_line", "id"]
        # a row's place in its part stands in the lower 33 bits
        placed = chunks.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
        placed = self._held(placed, "numbering").withColumn("_part", F.shiftright("_at", 33).cast("int"))
        starts, at = [], 0
        for r in placed.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
            starts.append((r["_part"], at))
            at += r["count"]
        starts = self.spark.createDataFrame(starts or [(0, 0)], "_part int, _first long")
        nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        return placed.join(F.broadcast(starts), "_part").withColumn("rowid", F.col("_first") + nth).drop("_part", "_first", "_at")

    def _held(self, frame: DataFrame, what: str) -> DataFrame:
        """A table of this change's own, written once; expire() deletes it."""
        to = f"{self.root}/_{what}/{uuid.uuid4().hex}"
        frame.write.option("compression", CODEC).parquet(to)
        return self.spark.read.schema(frame.schema).parquet(to)

    def add(self, chunks: DataFrame, hashes: DataFrame | None = None, removed: DataFrame | None = None, edges: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, indexed_at: Column | None = None, cache: EmbedCache | None = None) -> None:
        """Puts files (their chunks, hashes and edges) in place of what stood under their paths, and takes removed paths out.

        chunks need path and contents; embed makes a vector column of a text column (an expression or a pandas UDF), which cache is
        asked for first.  Another writer's
        change of other files that came first stays in force, one of the same files raises ConcurrentChange.
        """
        lines = chunks if "start_line" in chunks.columns else chunks.withColumn("start_line", F.lit(1)).withColumn("end_line", F.size(F.split("contents", "\n")))
        if "id" not in lines.columns:
            lines = lines.withColumn("id", F.sha2(F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.col("contents")), 256))
        given = "rowid" in chunks.columns
        number, rows = self._chunks_of(lines if given else self.numbered(lines), ordered=not given)
        at = F.current_timestamp() if indexed_at is None else indexed_at
        put = (rows.groupBy("path").agg(F.sha2(F.first("path"), 256).alias("hash")) if hashes is None else hashes.select("path", "hash")).withColumn("op", F.lit("put"))
        if removed is not None:
            put = put.unionByName(removed.select("path").distinct().join(put.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("hash"), F.lit("remove").alias("op")))
        put = self._held(put.withColumn("indexed_at", at), "adding")
        parts = {"chunks": rows, "lengths": lengths_of(rows), "files": put, "dead": self.spark.createDataFrame([], DEAD), "postings": blocks_of(rows, self.manifest["stemmed"])}
        if self.manifest["segments"]:
            old = self.live("lengths").join(put.select("path"), "path", "left_semi").select("rowid", "n0", "n1", "n2")
            parts["dead"] = old = self._held(old, "adding")
            if not old.isEmpty():  # their words are taken out of the words' counts
                less = blocks_of(spread(self.table("chunks").join(old.select("rowid"), "rowid", "left_semi")), self.manifest["stemmed"], counts_only=True)
                gone = less.groupBy("term").agg(F.array(*[F.sum(-F.col("counts")[k]) for k in range(7)], *[F.lit(0)] * (len(PACKED_HEAD) - 7)).alias("packed"))
                parts["postings"] = parts["postings"].unionByName(shaped(gone.withColumn("slice", F.lit(-1)).withColumn("n", F.lit(0)), PACKED))
        if embed is not None:
            texts = rows.select("rowid", "path", "contents")
            parts["vectors"] = texts.select("rowid", "path", embed(F.col("contents")).alias("embedding")) if cache is None else cache.embedded(texts, self.manifest["model"], self.manifest["dim"], embed)
        if edges is not None:
            parts["edges"] = edges.withColumn("path", F.col("source_path"))
        self._commit(number, parts, 0 if given else None)

    def remove(self, paths: DataFrame) -> None:
        """Takes the files of these paths out of every table."""
        self.add(self.spark.createDataFrame([], CHUNKS), self.spark.createDataFrame([], "path string, hash string"), removed=paths)

    def update(self, scanned: DataFrame, cut: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
        """Brings the index to the state of scanned (path, contents, hash): only added and changed files are cut, and gone ones are taken out.

        Returns path, status of all files.
        """
        report = self._held(maintenance.freshness(self.hashes(), scanned), "updates")
        touched = scanned.join(report.where("status in ('added', 'changed')"), "path", "left_semi")
        self.add(cut(touched), touched.select("path", "hash"), removed=report.where("status = 'removed'"), **options)
        return report

    def link(self) -> None:
        """Writes the adjacency of the chunks in force, so that searches find a chunk's edges by its rowid; a manifest names it.

        It tells of one state of the index: after a change it is made anew, here or by the first search that needs it.
        """
        number = uuid.uuid4().hex
        near = graph.chunk_adjacency(self.edges(), self.chunks())
        near.repartitionByRange("node").sortWithinPartitions("node", "direction", "nth").write.parquet(f"{self.root}/adjacency/segment={number}")
        of = sorted(s["id"] for s in self.manifest["segments"])

        def change(base: dict) -> dict:
            if sorted(s["id"] for s in base["segments"]) != of:
                fs.delete(self.spark, f"{self.root}/adjacency/segment={number}")
                raise ConcurrentChange("the index was changed while its edges were linked")
            return base | {"adjacency": {"id": number, "of": of}}

        self._publish(change)

    def near(self, nodes: DataFrame) -> DataFrame:
        """The adjacency (see graph.adjacency) of nodes; up to MOST_TOLD of them are told to the scan."""
        linked = self.manifest.get("adjacency")
        if linked is None or linked["of"] != sorted(s["id"] for s in self.manifest["segments"]):
            if self.read_only:
                return graph.chunk_adjacency(self.edges(), self.chunks()).join(nodes, "node", "left_semi")
            self.link()
            linked = self.manifest["adjacency"]
        rows = self.spark.read.schema(ADJACENCY).parquet(f"{self.root}/adjacency/segment={linked['id']}")
        ids = [r["node"] for r in nodes.limit(MOST_TOLD + 1).collect()]
        return rows.where(F.col("node").isin(ids)) if len(ids) <= MOST_TOLD else rows.join(nodes, "node", "left_semi")

    def remove_edges(self, path: str) -> DataFrame:
        """Edges without those that leave or reach a path."""
        return self.edges().where((F.col("source_path") != path) & F.coalesce(F.col("target_path") != path, F.lit(True)))

    def compact(self, root: str | None = None) -> Store:
        """Rewrites what counts as one segment, here or (a backup) below another folder; rowids stay.

        Changes that other writers commit meanwhile stay in force behind it.
        """
        target = self if root is None else Store(self.spark, root, self.manifest["model"], self.manifest["dim"], self.manifest["stemmed"], self.buckets)
        number, rows = target._chunks_of(self.live("chunks"))
        parts = {"chunks": rows, "lengths": self.live("lengths"), "files": self.files().withColumn("op", F.lit("put")), "dead": self.spark.createDataFrame([], DEAD), "postings": blocks_of(rows, self.manifest["stemmed"])}
        if self.segments("edges"):
            parts["edges"] = self.live("edges")
        if self.has_vectors():
            parts["vectors"] = self.live("vectors")
        target._commit(number, parts, 0, replaces=[s["id"] for s in target.manifest["segments"]])
        if target is not self:
            target.set_meta(**self.manifest["meta"])
        return target

    def expire(self, keep: int = 1, grace_s: float = 86_400) -> list[str]:
        """Deletes all but the last versions kept, and segments and tables of changes that none of these names; returns what went.

        A folder younger than grace_s may belong to a change that is being made, and stays.  Readers of kept versions read on.
        """
        if self.read_only:
            raise PermissionError("the index was opened for reading only")
        versions = sorted(self._versions())
        kept = [self._read(v) for v in versions[-max(1, keep) :]]
        named = {s["id"] for m in kept for s in m["segments"]} | {m["adjacency"]["id"] for m in kept if m.get("adjacency")}
        gone = [f"manifests/{v:010d}.json" for v in versions[: -max(1, keep)]]
        for name in (*TABLES, "adjacency"):
            gone += [f"{name}/{n}" for n, age in fs.ages(self.spark, f"{self.root}/{name}").items() if n.removeprefix("segment=") not in named and age >= grace_s]
        for name in ("_adding", "_numbering", "_updates"):
            gone += [f"{name}/{n}" for n, age in fs.ages(self.spark, f"{self.root}/{name}").items() if age >= grace_s]
        for path in gone:  # manifests first: nobody opens a version whose segments are going
            fs.delete(self.spark, f"{self.root}/{path}")
        return gone

    # searches

    def postings(self, words: list[str] | None = None, slices: list[int] | None = None) -> DataFrame:
        """Blocks, with slices as the index counts them; of these words only, and then of their buckets only; of these slices only."""
        rows = self.table("postings")
        if words is not None:
            hashes = {r["h"] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()} if words else set()
            per = {}
            for s in self.segments("postings"):
                per.setdefault(s["buckets"], []).append(s["id"])
            where = F.lit(False)
            for buckets, ids in per.items():
                wanted = sorted({(h % buckets + salt) % buckets for h in hashes for salt in range(salts_of(buckets))})
                where = where | (F.col("segment").isin(ids) & F.col("bucket").isin(wanted))
            rows = rows.where(where & F.col("term").isin(words))
        moved = self._moved()
        if slices is not None:
            told = F.col("slice").isin(slices)
            rows = rows.where(F.col("slice").isin(sorted({x - s["first"] // SLICE for s in self.manifest["segments"] for x in slices}))) if moved else rows.where(told)
        return rows.withColumn("slice", F.when(F.col("slice") < 0, F.col("slice")).otherwise(F.col("slice") + F.floor(self._first() / SLICE))) if moved else rows

    def unpacked(self, blocks: DataFrame, *keep: str | Column, lists: tuple[str, ...] = LISTS) -> DataFrame:
        """A row for each posting of blocks, with its segment."""
        zipped = F.inline(F.arrays_zip(*lists))
        blocks = blocks.where("n > 0")
        if places := [x for x in lists if x[0] == "p"]:
            blocks = placed_apart(blocks.select("segment", *keep, *dict.fromkeys((*lists, *(f"f{x[1:]}" for x in places)))), places)
            keep = tuple(c for c in blocks.columns if c not in LISTS and c != "segment")
        rows = blocks.select("segment", *keep, zipped).withColumnRenamed("rowids", "rowid")
        return rows.withColumn("rowid", F.col("rowid") + self._first()) if self._moved() else rows

    def _weighed(self, weights: tuple[float, ...], columns: tuple[str, ...]) -> tuple[list[int], list[float], Column, float, float]:
        """Fields and weights that count, which entries of counts these make, rows and the mean length."""
        taken = [(FIELDS.index(c), float(w)) for c, w in zip(columns, weights, strict=True)]
        totals, fields = self.totals(), [k for k, w in taken if w > 0]
        n = float(totals["n"])
        mean = sum(totals[f"n{k}"] for k, _ in taken) / n if n else 1.0
        bits = sum(1 << k for k in fields)
        held = sum((F.col("counts")[m - 1] for m in range(1, 8) if m & bits), F.lit(0).cast("long"))
        return [k for k, _ in taken], [w for _, w in taken], held, n, mean or 1.0

    def scores(self, queries: DataFrame, weights: tuple[float, ...] = lexical.WEIGHTS, columns: tuple[str, ...] = FIELDS, top_k: int | None = None) -> DataFrame:
        """query_id, rowid, path, score of every hit: BM25 over stored postings, as lexical.bm25 computes it.

        With top_k, hits that cannot be among a query's best top_k may be left out, and path is left out too.
        """
        taken, weight, held, n, mean = self._weighed(weights, columns)
        terms = lexical.phrases(queries)
        asked = terms.select("query_id", "term", F.size("words").alias("n_words"), F.posexplode("words").alias("k", "word"))
        if self.manifest["stemmed"]:
            asked = asked.withColumn("word", S.stemmed("word"))
        shapes = asked.groupBy("word").agg(F.max("n_words").alias("n_words")).limit(MOST_TOLD + 1).collect()
        words = [r["word"] for r in shapes] if len(shapes) <= MOST_TOLD else None  # more are sorted out by the join alone
        blocks = self.postings(words)
        prefixed = "path_prefix" in queries.columns
        tf = lambda parts: sum((F.lit(w) * p for w, p in zip(weight, parts, strict=True)), F.lit(0.0))
        saturated = lambda f, length: f * (lexical.K1 + 1) / (f + lexical.K1 * (1 - lexical.B + lexical.B * length / F.lit(mean)))
        idf_of = lambda rows: F.when(F.log((F.lit(n) - rows + 0.5) / (rows + 0.5)) > 0, F.log((F.lit(n) - rows + 0.5) / (rows + 0.5))).otherwise(1e-6)
        bound = saturated(tf([F.col(f"m{k}") for k in taken]), sum((F.col(f"l{k}") for k in taken), F.lit(0)))
        bound = F.when(tf([F.col(f"m{k}") for k in taken]) > 0, bound).otherwise(0.0)
        part = saturated(F.col("tf"), F.col("n_tokens"))
        single = asked.where("n_words = 1").select("query_id", "word")
        stats = blocks.groupBy(F.col("term").alias("word")).agg(F.sum(held).alias("n_rows"), F.max(bound).alias("bound"), F.sum("n").alias("postings"))
        many = 0
        if words is not None:
            told = stats.collect()  # a row for each word told
            many = sum(r["postings"] for r in told)
            stats = self.spark.createDataFrame([tuple(r) for r in told], "word string, n_rows long, bound double, postings long")
        weighed = single.join(stats, "word").select("query_id", "word", idf_of(F.col("n_rows")).alias("idf"), "bound")
        columns_read = ("rowids", *(f"f{k}" for k in taken), *(f"n{k}" for k in taken))
        length = sum((F.col(f"n{k}") for k in taken), F.lit(0)).alias("n_tokens")
        phrased = words is None or any(r["n_words"] > 1 for r in shapes)
        if top_k is not None and words is not None and not phrased and not prefixed and many > PRUNED_FROM:
            return self._best(words, weighed, bound, columns_read, tf([F.col(f"f{k}") for k in taken]), length, part, top_k)
        read = self.unpacked(blocks, F.col("term").alias("word"), lists=columns_read).select("word", "rowid", "segment", tf([F.col(f"f{k}") for k in taken]).alias("tf"), length).where("tf > 0")
        scored = self._counting(read).join(weighed, "word").select("query_id", "rowid", (F.col("idf") * part).alias("part"))
        if phrased:
            scored = scored.unionAll(self._phrases(asked.where("n_words > 1"), words, taken, tf, length).select("query_id", "rowid", (idf_of(F.col("n_rows")) * part).alias("part")))
        scored = scored.groupBy("query_id", "rowid").agg(F.sum("part").alias("score"))
        if top_k is not None and not prefixed:
            return scored
        scored = scored.join(self.live("lengths").select("rowid", "path"), "rowid")
        if prefixed:
            scored = scored.join(queries.select("query_id", "path_prefix"), "query_id").where(F.col("path_prefix").isNull() | X.like_prefix(F.col("path"), F.col("path_prefix"))).drop("path_prefix")
        return scored

    def _phrases(self, asked: DataFrame, words: list[str] | None, taken: list[int], tf: Callable, length: Column) -> DataFrame:
        """query_id, rowid, tf, n_tokens, n_rows of rows that hold a phrase: its words' places less their number in it have one in common."""
        places = [f"p{k}" for k in taken]
        lists = ("rowids", *places, *(f"n{k}" for k in taken))
        hits = self._counting(self.unpacked(self.postings(words), F.col("term").alias("word"), lists=lists)).select("word", "rowid", *places, length).join(asked, "word")
        moved = [F.transform(p, lambda x: x - F.col("k")).alias(p) for p in places]
        grouped = hits.groupBy("query_id", "term", "n_words", "rowid").agg(F.collect_list(F.struct("k", *moved)).alias("parts"), F.first("n_tokens").alias("n_tokens")).where("size(parts) = n_words")
        common = lambda p: F.size(F.aggregate(F.slice("parts", 2, 1 << 20), F.col("parts")[0][p], lambda s, x: F.array_intersect(s, x[p])))
        found = grouped.select("query_id", "term", "rowid", "n_tokens", tf([common(p) for p in places]).alias("tf")).where("tf > 0")
        rows = found.groupBy("term").agg(F.countDistinct("rowid").alias("n_rows"))
        return found.join(rows, "term")

    def references(self, terms: DataFrame, limit: int = 8) -> DataFrame:
        """term, rowid, path, n: the first rows whose contents hold each term as a whole word in its own case.

        The stored places tell the rows in which the term's words follow one another, whatever their case; only the chunks of these are
        read to check the case.  As words are the index's words, a term beside a letter beyond ASCII is part of a longer word.
        """
        asked = terms.select("term").distinct().withColumn("words", X.tokens(F.col("term"))).where(F.size("words") > 0)
        asked = asked.select("term", F.size("words").alias("n_words"), F.posexplode("words").alias("k", "word"))
        if self.manifest["stemmed"]:
            asked = asked.withColumn("word", S.stemmed("word"))
        told = [r["word"] for r in asked.select("word").distinct().limit(MOST_TOLD + 1).collect()]
        blocks = self.postings(told if len(told) <= MOST_TOLD else None).where("m2 > 0")
        hits = self.unpacked(blocks, F.col("term").alias("word"), lists=("rowids", "p2")).where(F.size("p2") > 0).join(asked, "word")
        single = hits.where("n_words = 1").select("term", "rowid", "segment")
        parts = hits.where("n_words > 1").groupBy("term", "n_words", "rowid", "segment").agg(F.collect_list(F.transform("p2", lambda x: x - F.col("k"))).alias("parts")).where("size(parts) = n_words")
        common = F.aggregate(F.slice("parts", 2, 1 << 20), F.col("parts")[0], lambda s, x: F.array_intersect(s, x))
        found = fs.kept(self._counting(single.unionAll(parts.where(F.size(common) > 0).select("term", "rowid", "segment"))).select("term", "rowid"))
        words = F.regexp_extract_all("contents", F.lit("[A-Za-z0-9_]+"), F.lit(0))
        checked = found.join(self.fetched(found).select("rowid", "path", words.alias("held")), "rowid").where(F.array_contains("held", F.col("term")))
        nth = F.row_number().over(Window.partitionBy("term").orderBy("rowid"))
        return checked.select("term", "rowid", "path", nth.alias("n")).where(F.col("n") <= limit)

    def _best(self, words: list[str], weighed: DataFrame, bound: Column, lists: tuple[str, ...], tf: Column, length: Column, part: Column, top_k: int) -> DataFrame:
        """query_id, rowid, score of the rows that may be among each query's best top_k; their scores are whole.

        MaxScore over blocks: the best blocks of each word set a bar that top_k rows reach for certain; words whose bounds together stay below
        it lead no row past it by themselves; of the other words those blocks are read that reach it together with the other words'
        bounds; what is left gets its whole score from the blocks of its slices.
        """
        total = weighed.groupBy("query_id").agg(F.sum(F.col("idf") * F.col("bound")).alias("total"))
        heads = self.postings(words).where("n > 0").select(F.col("term").alias("word"), "segment", "slice", "n", bound.alias("most"))
        opened = lambda blocks, *keep: self.unpacked(blocks, *keep, lists=lists).select(*keep, "rowid", "segment", tf.alias("tf"), length).where("tf > 0")
        full = self.postings(words).withColumnRenamed("term", "word")
        nth = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("most"), "slice"))
        seeds = heads.withColumn("nth", nth).where(F.col("nth") <= SEED_BLOCKS).select("word", "segment", "slice").distinct()
        seen = self._counting(opened(full.join(seeds, ["word", "segment", "slice"], "left_semi"), "word")).join(weighed, "word").groupBy("query_id", "rowid").agg(F.sum(F.col("idf") * part).alias("score"))
        bar = seen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("rank") == top_k).select("query_id", (F.col("score") - 1e-6).alias("bar"))
        below = F.sum(F.col("idf") * F.col("bound")).over(Window.partitionBy("query_id").orderBy(F.col("idf") * F.col("bound"), "word"))
        leading = weighed.join(total, "query_id").join(bar, "query_id", "left").fillna(0.0, ["bar"]).withColumn("below", below).where(F.col("below") >= F.col("bar"))
        reach = F.col("idf") * F.col("most") + F.col("total") - F.col("idf") * F.col("bound")
        led = heads.join(leading, "word").where(reach >= F.col("bar")).select("word", "segment", "slice").distinct()
        rows = self._counting(opened(full.join(led, ["word", "segment", "slice"], "left_semi"), "word")).join(leading, "word")
        own = F.col("idf") * part
        found = rows.where(own + F.col("total") - F.col("idf") * F.col("bound") >= F.col("bar")).select("query_id", "rowid").distinct()
        found = fs.kept(found)
        slices = found.select("query_id", F.floor(F.col("rowid") / SLICE).alias("slice")).distinct()
        told = [r["slice"] for r in slices.select("slice").distinct().limit(MOST_TOLD + 1).collect()]
        needed = weighed.join(slices, "query_id").select("word", "slice").distinct()
        blocks = (full if len(told) > MOST_TOLD else self.postings(words, told).withColumnRenamed("term", "word")).join(needed, ["word", "slice"], "left_semi")
        return self._counting(opened(blocks, "word")).join(weighed, "word").join(found, ["query_id", "rowid"], "left_semi").groupBy("query_id", "rowid").agg(F.sum(F.col("idf") * part).alias("score"))

    def search(self, queries: DataFrame, top_k: int, weights: tuple[float, ...] = lexical.WEIGHTS, columns: tuple[str, ...] = FIELDS) -> DataFrame:
        """query_id, rowid, score, rank: each query's best rows."""
        return lexical.ranked(self.scores(queries, weights, columns, top_k).select("query_id", "rowid", "score"), top_k)

    def nearest(self, queries: DataFrame, top_k: int) -> DataFrame:
        """The exact nearest rows to query vectors (query_id, embedding, and where told path_prefix); none where the index holds no vectors."""
        dim = self.manifest["dim"]
        if not self.has_vectors():
            return self.spark.createDataFrame([], "query_id long, rowid long, distance double, score double, rank int")
        wrong = queries.where(F.size("embedding") != dim).limit(1).count() if dim else 0
        if wrong:
            raise ValueError(f"query vectors must have {dim} components")
        return vectors.knn(self.vectors(), queries, top_k)
