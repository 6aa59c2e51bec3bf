"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of word shingles.  Equal sets are one node.  Nodes that share a band of MinHash values, and whose
sizes allow the threshold, become candidates; a pair that shares several bands is one in the first of them.  A pair's
MinHash values are compared a few at a time and the pair is dropped as soon as the posterior probability that its
similarity reaches the threshold is below a tolerance; what is left is verified exactly.  Up to then only
signatures travel; sets go where a pair is left.  A large band is compared in blocks of two chunks each,
which bounds memory.  Verification gives each node's number of links and a
spanning forest, so copies by the thousand cost rows in proportion to their number.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import storage, textscan
from spindrift.llm.components import components
from spindrift.llm.decontamination import spaced

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: MinHash values; a pair of similarity 0.8 shares none of the BANDS bands with probability 3e-6.
BANDS, BAND_VALUES = 24, 4
VALUES = BANDS * BAND_VALUES
STEP, TOLERANCE = 16, 1e-6
#: Nodes and shingles of a chunk at most, but for one larger set; a block is a chunk, or two.
CHUNK_NODES, CHUNK_SHINGLES = 1024, 1 << 21
#: Candidate pairs held in memory at a time.
PAIRS = 1 << 20
#: Sets whose sizes lie in classes further apart than one differ by more than the threshold allows.
CLASS_STEP = math.log(1.01 / THRESHOLD)


def shingles(words: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending; a shorter text of a word at least is one shingle."""
    hashes, where = textscan.windows(words, offsets, width)
    row = np.repeat(np.arange(len(where) - 1), np.diff(where))
    lengths = np.diff(offsets)
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    if len(short):
        whole = []
        for r in short.tolist():
            total = np.full(1, lengths[r], np.uint64)
            for k in range(offsets[r], offsets[r + 1]):
                total = textscan.mix(total * np.uint64(0xD6E8FEB86659FD93) + words[k])
            whole.append(total[0])
        hashes, row = np.concatenate((hashes, np.array(whole, np.uint64))), np.concatenate((row, short))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[keep], row[keep]
    return hashes, np.searchsorted(row, np.arange(len(offsets)))


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, VALUES, np.uint64)


def signatures(hashes: np.ndarray, where: np.ndarray) -> np.ndarray:
    """MinHash values (rows x VALUES, uint32) of rows that have a shingle; zeros for others."""
    out = np.zeros((len(where) - 1, VALUES), np.uint32)
    full = np.flatnonzero(np.diff(where) > 0)
    if len(full):
        factor, shift = _functions()
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat(((hashes * factor[k] + shift[k]) >> np.uint64(32)).astype(np.uint32), where[full])
    return out


def pass_bar(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest agreements among compared values with which a pair goes on.

    With a uniform prior the similarity's posterior is Beta(agreements + 1, disagreements + 1); it exceeds the
    threshold with the probability that a Binomial(compared + 1, threshold) is at most agreements.
    """
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared


def intersections(sets_a: list, sets_b: list, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections, as products of incidence matrices over slices of the elements that both sides hold."""
    both = np.intersect1d(np.unique(np.concatenate(sets_a)), np.unique(np.concatenate(sets_b)), assume_unique=True)
    out = np.zeros((len(sets_a), len(sets_b)), np.float32)

    def places(sets: list) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(both, flat)
        hit = both[np.minimum(at, len(both) - 1)] == flat
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    if len(both):
        (row_a, at_a), (row_b, at_b) = places(sets_a), places(sets_b)
        for start in range(0, len(both), columns):
            width = min(columns, len(both) - start)
            one, two = np.zeros((len(sets_a), width), np.float32), np.zeros((len(sets_b), width), np.float32)
            for matrix, row, at in ((one, row_a, at_a), (two, row_b, at_b)):
                x, y = np.searchsorted(at, [start, start + width])
                matrix[row[x:y], at[x:y] - start] = 1
            out += one @ two.T
    return out.astype(np.int64)


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each one's component, after edges a, b are added to components that label names."""
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new)  # a root follows its members
        new = new[new]
        if (new == label).all():
            return label
        label = new


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """Rows x BANDS hashes of the bands' values; a hash tells the band's number too."""
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for v in range(BAND_VALUES):
        out = textscan.mix(out * np.uint64(0xD6E8FEB86659FD93) + sig[:, v::BAND_VALUES])
    return out


def likely(sig: np.ndarray, size: np.ndarray, bands: np.ndarray, number: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the pairs a, b of rows that may reach the threshold and share no band before the one that they were met in.

    sig holds a byte of each MinHash value, which can only add agreements.
    """
    alive = np.flatnonzero(np.minimum(size[a], size[b]) >= THRESHOLD * np.maximum(size[a], size[b]) - 1e-9)
    agree = np.zeros(len(alive), np.int32)
    for start in range(0, VALUES, STEP):
        agree += (sig[a[alive], start : start + STEP] == sig[b[alive], start : start + STEP]).sum(1)
        keep = agree >= pass_bar(start + STEP)
        alive, agree = alive[keep], agree[keep]
    before = np.arange(BANDS) < number[a[alive], None]
    return alive[~((bands[a[alive]] == bands[b[alive]]) & before).any(1)]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


def whole_groups(batches, key: str):
    """Record batches cut anew so that no group of equal keys, which stand together, is parted."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(runs(batch[key].to_numpy())[-1])
        if last or held and held[-1][key][-1] != batch[key][0]:
            whole = pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
            if whole.num_rows:
                yield whole.combine_chunks()
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def fixed(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def pairs_of(table: pa.Table):
    """(a, b) of likely pairs of a table's rows, some at a time.  Rows are sorted by block, and within one by side."""
    block, side, two = (table[c].to_numpy() for c in ("block", "side", "two"))
    sig, size, number = fixed(table["sig"], np.uint8, VALUES), table["size"].to_numpy(), table["number"].to_numpy()
    bands = np.zeros((len(block), BANDS), np.uint64)
    bands[np.arange(BANDS) < number[:, None]] = np.frombuffer(b"".join(table["earlier"].to_pylist()), np.uint64)
    begins = runs(block)
    group = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(block)))
    ends = np.append(begins[1:], len(block))[group]
    # a row meets those behind it, or in a block of two chunks the second chunk's
    first_of_second = begins + np.add.reduceat(side == 0, begins)
    start = np.where(two, np.maximum(first_of_second[group], np.arange(len(block)) + 1), np.arange(len(block)) + 1)
    count = np.where(two & (side == 1), 0, np.maximum(ends - start, 0))
    for x, y in textscan.in_parts(count, PAIRS):
        a, b = np.repeat(np.arange(x, y), count[x:y]), textscan.ranges(start[x:y], count[x:y])
        left = likely(sig, size, bands, number, a, b)
        yield a[left], b[left]


def compared(batches):
    """The rows (block, side, two, number, node) that have a likely pair in their block."""
    for table in whole_groups(batches, "block"):
        met = np.zeros(table.num_rows, bool)
        for a, b in pairs_of(table):
            met[a] = met[b] = True
        if met.any():
            yield from table.select(["block", "side", "two", "number", "node"]).filter(pa.array(met)).to_batches()


def common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements the sets a and b of each pair share; pairs of a block stand together."""
    out = np.zeros(len(a), np.int64)
    for x, y in textscan.in_parts(np.ones(len(a), np.int64), 1 << 16):
        rows, columns = np.unique(a[x:y]), np.unique(b[x:y])
        if (y - x) * 4 >= len(rows) * len(columns) and y - x >= 4 * (len(rows) + len(columns)):
            shared = intersections([sets[i] for i in rows], [sets[j] for j in columns])
            out[x:y] = shared[np.searchsorted(rows, a[x:y]), np.searchsorted(columns, b[x:y])]
            continue
        for n in range(x, y):
            p, q = (sets[a[n]], sets[b[n]]) if len(sets[a[n]]) >= len(sets[b[n]]) else (sets[b[n]], sets[a[n]])
            out[n] = (p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum()
    return out


def verified(batches):
    """node, links, near of the nodes with a link in a block."""
    for table in whole_groups(batches, "block"):
        # a set may come more than once, from repeated rows
        keep = np.ones(table.num_rows, bool)
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        order = np.lexsort((np.arange(len(node)), node, block))
        keep[order[1:]] = (node[order[1:]] != node[order[:-1]]) | (block[order[1:]] != block[order[:-1]])
        table = table.filter(pa.array(keep))
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        sets = [np.frombuffer(e.as_buffer(), np.uint64) for e in table["elements"]]
        size = table["size"].to_numpy()
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for a, b in pairs_of(table):
            both = common(sets, a, b)
            good = both >= THRESHOLD * (size[a] + size[b] - both) - 1e-9
            a, b = a[good], b[good]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            label = forest(label, a, b)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[label[some]])], names=["node", "links", "near"])


def _read_sets(batches):
    for batch in batches:
        for begin, end in textscan.blocks(batch["text"]):
            part = batch.slice(begin, end - begin)
            hashes, where = shingles(*textscan.word_hashes(part["text"]))
            yield part, hashes, where


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _row_key(doc_id, raw, words):
    """Names a row by doc_id and words, or where it has no word by its text."""
    told = F.when(words == "", F.concat(F.lit("\0"), F.coalesce(raw.cast("string"), F.lit("\0")))).otherwise(words)
    return F.struct(F.xxhash64(F.lit(1), F.coalesce(doc_id, F.lit(-1)), doc_id.isNull(), told).alias("one"), F.xxhash64(told, doc_id, F.lit(2)).alias("two"))


def _met(nodes: DataFrame) -> DataFrame:
    """block, side, two, number, node: the blocks in which nodes have a likely pair; each pair is one in one block only."""

    def band(batches):
        for batch in batches:
            if batch.num_rows:
                bands = fixed(batch["bands"], np.uint64, BANDS).view(np.int64)
                kind = np.floor(np.log(batch["size"].to_numpy()) / CLASS_STEP).astype(np.int32)
                for k in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(bands[:, k]), pa.array(np.full(len(bands), k, np.int32)), pa.array(kind), batch["node"]], names=["band", "number", "kind", "node"])

    members = storage.keep(nodes.select("node", "size", "bands").mapInArrow(band, "band long, number int, kind int, node long"), "join-bands")
    counts = members.groupBy("band", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("kinds"), F.sum("n").alias("n")).where("n > 1").select("band", "kinds")

    def chunks(step: int):
        """The chunks of the kind so many steps away; 0 where none of the band is of it."""
        kind = F.col("kind") + step
        most = F.greatest(F.lit(1.0), F.least(F.lit(float(CHUNK_NODES)), F.floor(F.lit(float(CHUNK_SHINGLES)) / F.exp((kind + 1) * CLASS_STEP)).cast("double")))
        return F.ceil(F.coalesce(F.try_element_at("kinds", kind), F.lit(0)) / most).cast("int")

    kind, none = F.col("kind"), F.array().cast("array<struct<ka:int,ia:int,kb:int,ib:int,side:int>>")
    place = lambda ka, ia, kb, ib, side: F.struct(ka.alias("ka"), ia.cast("int").alias("ia"), kb.alias("kb"), ib.cast("int").alias("ib"), side.cast("int").alias("side"))
    upto = lambda c, made: F.when(c > 0, F.transform(F.sequence(F.lit(0), c - 1), made)).otherwise(none)
    chunk = F.col("chunk")
    own = F.when(F.try_element_at("kinds", kind) > 1, upto(F.col("here"), lambda j: place(kind, F.least(j, chunk), kind, F.greatest(j, chunk), chunk > j))).otherwise(none)
    after = upto(F.col("above"), lambda j: place(kind, chunk, kind + 1, j, F.lit(0)))
    before = upto(F.col("below"), lambda j: place(kind - 1, j, kind, chunk, F.lit(1)))
    met = (
        members.join(kinds, "band").select("band", "number", "kind", "node", "kinds", chunks(0).alias("here"), chunks(1).alias("above"), chunks(-1).alias("below"))
        .withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("here")).cast("int"))
        .select("band", "number", "node", F.concat(own, after, before).alias("places")).where(F.size("places") > 0)
    )
    carried = met.join(nodes.select("node", "size", "sig", "bands"), "node").withColumn("earlier", F.substr("bands", F.lit(1), F.col("number") * 8))
    rows = carried.select("number", "node", "size", "sig", "earlier", "band", F.inline("places")).select(
        F.xxhash64("band", "ka", "ia", "kb", "ib").alias("block"), "side", ((F.col("ka") != F.col("kb")) | (F.col("ia") != F.col("ib"))).alias("two"), "number", "node", "size", "sig", "earlier"
    )
    return rows.repartition("block").sortWithinPartitions("block", "side").mapInArrow(compared, "block long, side int, two boolean, number int, node long")


def _classes(documents: DataFrame) -> DataFrame:
    """doc_id, row_key, class_id, class_key, n_links for every row."""
    words = spaced(F.col("text"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("raw"), words.alias("text")).select("doc_id", _row_key(F.col("doc_id"), F.col("raw"), F.col("text")).alias("row_key"), "text")

    def sign(batches):
        names = ["doc_id", "row_key", "key", "size", "bands", "sig"]
        for part, hashes, where in _read_sets(batches):
            sig = signatures(hashes, where)
            bands, short = band_hashes(sig.astype(np.uint64)), sig.astype(np.uint8)
            size = np.diff(where)
            columns = [[_digest(hashes[a:b]) if b > a else None for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]]
            columns += [[x.tobytes() if n else None for x, n in zip(many, size.tolist(), strict=True)] for many in (bands, short)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["row_key"], pa.array(columns[0], pa.binary()), pa.array(size), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

    base = storage.keep(texts.mapInArrow(sign, "doc_id long, row_key struct<one:long,two:long>, key binary, size long, bands binary, sig binary"), "join-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key"))
    nodes = storage.keep(
        base.where("key is not null").groupBy("key").agg(first.alias("rep"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("size", "bands", "sig"))).withColumn("node", F.xxhash64("key")),
        "join-nodes",
    )
    wanted = storage.keep(_met(nodes), "join-wanted")
    chosen = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select(F.col("rep.row_key").alias("row_key"), "node", "copies", "sig", "bands")

    def read(batches):
        seen: set[int] = set()  # repeated rows of one doc_id and text come to one task, which reads one
        for batch in batches:
            fresh = [n for n, node in enumerate(batch["node"].to_pylist()) if not (node in seen or seen.add(node))]
            for part, hashes, where in _read_sets([batch.take(pa.array(fresh, pa.int64()))]):
                sets = pa.array([hashes[a:b].tobytes() for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part["node"], part["copies"], part["sig"], part["bands"], pa.array(np.diff(where)), sets], names=["node", "copies", "sig", "bands", "size", "elements"])

    sets = texts.join(chosen, "row_key").select("node", "copies", "sig", "bands", "text").mapInArrow(read, "node long, copies long, sig binary, bands binary, size long, elements binary")
    there = wanted.join(sets, "node").withColumn("earlier", F.substr("bands", F.lit(1), F.col("number") * 8)).drop("bands")
    links = storage.keep(there.repartition("block").sortWithinPartitions("block", "side").mapInArrow(verified, "node long, links long, near long"), "join-links")
    joined = components(links.select(F.col("node").alias("a"), F.col("near").alias("b")), "join-classes")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = storage.keep(nodes.select("key", "node", F.col("rep.doc_id").alias("rep"), "copies").join(counts, "node", "left").join(joined, "node", "left").where("copies > 1 or links is not null").withColumn("label", F.coalesce("label", "node")), "join-known")
    names = known.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = known.join(names, "label").select("key", "class_id", F.col("label").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return base.select("doc_id", "row_key", "key").join(named, "key", "left").select(
        "doc_id", "row_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_key", F.when(F.col("key").isNull(), F.col("row_key.one")).otherwise(F.xxhash64("key"))).alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, class_key for every row.

    class_id: the smallest doc_id that can be reached over links (rows of one text, or similarity of at least
    0.8 over shingles of five words); n_links: the number of other rows linked directly.  class_key tells classes
    apart whose smallest doc_ids are equal because a doc_id stands on different texts.  A text of one
    to four words is one shingle.  Null texts and texts without a word link
    to nothing.  Repeated rows count as copies.  A null doc_id takes part but names no class unless
    it is alone.  An empty table gives no rows.  Columns other than doc_id and text are not read.
    """
    return _classes(documents).select("doc_id", "class_id", "n_links", "class_key")


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each class with all its columns: that with the smallest doc_id (null last); of repeated rows any one.

    Classes are told apart by their texts, so a row stays whose doc_id stands on another class's text too, and a row without a
    doc_id goes if its text is linked to another's.  A text without a word is its own class beside its doc_id.
    """
    first = _classes(documents).groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("first"))
    key = _row_key(documents["doc_id"].cast("long"), documents["text"], spaced(documents["text"]))
    rows = documents.withColumn("_row_key", key).join(first.select(F.col("first.row_key").alias("_row_key")), "_row_key", "left_semi")
    return rows.dropDuplicates(["_row_key"]).drop("_row_key")
