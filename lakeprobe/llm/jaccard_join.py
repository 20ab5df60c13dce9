"""N-gram Jaccard join by set relations: skipping index lists by position, and deriving answers from similar sets.

A document's set is its distinct shingles of five words.  Two documents link when
100 * |intersection| >= percent * |union|.

*   Shingles have one order for all sets: common ones last (by a fixed-size count over
    all documents), then by hash.  Two similar sets share a shingle among the first few
    of each (the prefix), so lists of prefix shingles find every linked pair.
*   A list is skipped by position: only entries whose sizes fit (blocks of sizes a factor
    of 1/percent apart) and whose places leave room for the overlap are compared, and the
    shorter set needs only its shorter, indexed prefix.
*   Answers are derived from those of a highly similar set: in each list one set, the most
    typical of it, is compared with all others first.  A set that links to it has its
    component, and is afterwards compared only with sets of other components.  So
    a group of n similar sets costs about n comparisons and not n*n, while every
    link between components is still looked for without any cap.

Candidates lose those whose parity sketches (about a bit a member) differ too much for a
link, which is an exact bound, and the rest are counted shingle by shingle.

The number of links of each document is exact too.  Links never leave a component, equal sets
are counted as one class with its size, and the classes of a component are compared with each
other, all of them, in chunks; only sums leave a comparison, so no row is made for a pair.

Defined cases: a null text or one without words has an empty set, linked with nothing; fewer
words than five are one shingle; equal sets link; a null doc_id links with nothing; rows that repeat a
doc_id with one text are one document (with several texts, the result is of one of them for each
row); very long texts are read whole; other columns don't get in.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import BLOBS, Scratch, blob_batch, bucket_count, build_filter, documents, id_filter, in_filter, map_batches, may_be_in, shuffles_removed
from .kernels import fitting, gram_hashes, mix, slices, word_hashes, words

SKETCH_BITS = 20
#: Sketches are added up in groups of so many, then those of the groups.
MERGED = 64
#: Least bits of a parity sketch; a larger set has as many as the next power of two from its size.
PARITY_BITS = 1024


def shingles(part, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a slice's documents (with repeats) and the document of each."""
    w = words(part)
    h = word_hashes(part, w, fold=True)
    g = gram_hashes(h, size)
    at = np.flatnonzero(fitting(w.bounds, size, len(g)))
    docs = np.searchsorted(w.bounds, at, side="right") - 1
    out, of = [g[at]], [docs]
    counts = w.counts
    for n in range(1, size):
        few = np.flatnonzero(counts == n)
        if len(few):
            short = gram_hashes(h, n)
            out.append(mix(short[w.bounds[few]] + np.uint64(n)))
            of.append(few)
    return np.concatenate(out), np.concatenate(of)


def _sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of shingles by the top bits of their hashes, over all documents; 2**SKETCH_BITS numbers whatever the input's size."""
    block = 1 << 14

    def rows(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        group = TaskContext.get().partitionId() // MERGED
        blobs = [pa.compress(x.astype(np.uint64).tobytes(), "zstd", asbytes=True) for x in held.values()]
        return pa.RecordBatch.from_arrays([pa.array([group] * len(held), pa.int32()), pa.array(list(held), pa.int32()), pa.array(blobs, pa.binary())], names=["group", "block", "counts"])

    def count(batches):
        held = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch.column(1)):
                h, _ = shingles(part, size)
                held += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(held))
        yield rows({b: held[b : b + block] for b in range(0, len(held), block)})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(pa.decompress(raw.as_py(), block * 8, "zstd"), np.uint64)
                held[b] = held[b] + x if b in held else x
        if held:
            yield rows(held)

    schema = "group int, block int, counts binary"
    counted = documents(docs).mapInArrow(count, schema).repartition("group", "block").mapInArrow(add, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, np.uint64)
    with shuffles_removed(docs.sparkSession):
        for _, b, raw in counted.collect():
            out[b : b + block] = np.frombuffer(pa.decompress(bytes(raw), block * 8, "zstd"), np.uint64)
    return out


def _tiers(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each sketch cell: how far above the mean it is (0: not), in powers of two; and the logarithm of its count."""
    usual = 4 * counts.mean() + 8
    return np.minimum(15, np.floor(np.log2(1 + counts // usual))).astype(np.int32), np.log2(1 + counts).astype(np.float32)


def least_overlap(total, percent: int):
    """Least intersection of two linked sets that have `total` members together, as a Column or number."""
    n = total * percent + (100 + percent) - 1
    return F.floor(n / F.lit(100 + percent)) if not isinstance(total, int | np.ndarray) else n // (100 + percent)


_SETS = "doc_id long, n_shingles long, fp1 long, fp2 long, typical float, parity binary, prefix binary"


def sets(docs: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Per document: its set's size and fingerprint, how common its shingles are, parity sketch, and the hashes of its prefix in order."""
    shared = docs.sparkSession.sparkContext.broadcast(_tiers(counts))

    def run(batch: pa.RecordBatch):
        tiers, logs = shared.value
        for part in slices(batch.column(1)):
            n_docs = part.last - part.first
            h, doc = shingles(part, size)
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            cell = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            place = doc * 16 + tiers[cell]
            order = np.argsort(place.astype(np.uint16) if n_docs < 4096 else place, kind="stable")
            h, doc, cell = h[order], doc[order], cell[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc, cell = h[new], doc[new], cell[new]
            n = np.bincount(doc, minlength=n_docs)
            bounds = np.concatenate([[0], np.cumsum(n)])

            def total(x: np.ndarray, bounds=bounds) -> np.ndarray:
                sums = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
                return sums[bounds[1:]] - sums[bounds[:-1]]

            fp1, fp2 = total(mix(h)), total(mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
            typical = total(logs[cell].astype(np.float64)) / np.maximum(1, n)
            bits = np.maximum(PARITY_BITS, 1 << np.ceil(np.log2(np.maximum(1, n))).astype(np.int64))
            begin = np.concatenate([[0], np.cumsum(bits)])
            flips = np.bincount(begin[doc] + ((h >> np.uint64(10)).astype(np.int64) & (bits[doc] - 1)), minlength=begin[-1])
            parity = np.packbits((flips & 1).astype(np.uint8))
            take = np.where(n > 0, n - -(-n * percent // 100) + 1, 0)
            cuts = np.concatenate([[0], np.cumsum(take)])
            at = np.arange(cuts[-1]) + np.repeat(bounds[:-1] - cuts[:-1], take)
            prefix = pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer((cuts * 8).astype(np.int32).tobytes()), pa.py_buffer(h[at].tobytes())])
            sketches = pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer((begin // 8).astype(np.int32).tobytes()), pa.py_buffer(parity.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0)[part.first : part.last], pa.array(n.astype(np.int64)), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), pa.array(typical.astype(np.float32)), sketches, prefix], names=["doc_id", "n_shingles", "fp1", "fp2", "typical", "parity", "prefix"])

    return map_batches(documents(docs), run, _SETS)


def _prefix_blobs(table: DataFrame) -> DataFrame:
    buckets = bucket_count(table.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return blob_batch([np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).copy()], buckets)

    return map_batches(table.select("prefix"), run, BLOBS)


def postings(table: DataFrame) -> DataFrame:
    """token, doc_id, n, pos, typical: the prefix entries whose shingle may stand in two prefixes."""
    shared = table.sparkSession.sparkContext.broadcast(build_filter(_prefix_blobs(table), repeated=True))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(3).to_pylist()
        h = np.frombuffer(b"".join(raw), np.uint64)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
        row = np.repeat(np.arange(len(raw)), sizes)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seen = in_filter(shared.value, h)
        own = batch.select([0, 1, 2]).take(pa.array(row[seen]))
        return pa.RecordBatch.from_arrays([pa.array(h[seen].view(np.int64)), own.column(0), own.column(1).cast(pa.int32()), pa.array(pos[seen].astype(np.int32)), own.column(2)], names=["token", "doc_id", "n", "pos", "typical"])

    return map_batches(table.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "typical", "prefix"), run, "token long, doc_id long, n int, pos int, typical float")


def parity_difference(x: bytes, y: bytes) -> int:
    """Members that two sets differ in at least: places at which their sketches, the larger folded to the smaller's size, differ."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def full_sets(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """doc_id and the sorted hashes of its set, of the documents in pairs (and a few others that the fixed-size filter lets pass)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids, "doc_id"))

    def run(batch: pa.RecordBatch):
        id_ = batch.column(0)
        batch = batch.filter(pa.array(may_be_in(shared.value, id_)))
        if not batch.num_rows:
            return
        for part in slices(batch.column(1)):
            n_docs = part.last - part.first
            h, doc = shingles(part, size)
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            order = np.argsort(doc.astype(np.uint16) if n_docs < 65536 else doc, kind="stable")
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n_docs))])
            held = pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer((bounds * 8).astype(np.int32).tobytes()), pa.py_buffer(h[new].tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0)[part.first : part.last], held], names=["doc_id", "members"])

    return map_batches(documents(docs.where(F.col("doc_id").isNotNull())), run, "doc_id long, members binary")


def verified(docs: DataFrame, pairs: DataFrame, signatures: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Written table of the pairs (a, b) that link."""

    def may_link(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        most = total - 2 * least_overlap(total, percent)
        differ = [parity_difference(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        return batch.select([0, 1]).filter(pa.array(np.array(differ, np.int64) <= most))

    def link(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            ok.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
        return batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def side(name: str) -> DataFrame:
        return signatures.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("parity").alias(f"p{name}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb")
    near = scratch.keep(map_batches(near, may_link, "a long, b long"))
    members = scratch.keep(full_sets(docs, near, size))
    both = near.join(members.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a").join(members.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b")
    out = scratch.keep(map_batches(both.select("a", "b", "ma", "mb"), link, "a long, b long").distinct())
    scratch.drop(near, members)
    return out


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Written table node, root: the least node of each linked node's component.

    Every node takes the least root among its own and its neighbours'.  From the third
    round on, roots are replaced by their own roots as well, so long chains need
    about as many rounds as the logarithm of their length.  A round is one written table; it also
    counts what has changed, and the last one changes nothing.
    """
    one = links.where("a <> b").select("a", "b")
    edges = scratch.keep(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    rounds = 0
    while True:
        rounds += 1
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "root", F.col("root").alias("old"))
        new = near.unionByName(own).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        if rounds > 2:
            mid = scratch.keep(new)
            new = mid.join(mid.select(F.col("node").alias("root"), F.col("root").alias("up")), "root").select("node", F.least("root", "up").alias("root"), "old")
        changed = Observation()
        after = scratch.keep(new.observe(changed, F.count_if(F.col("root") != F.col("old")).alias("n")).select("node", "root"))
        scratch.drop(labels)
        labels = after
        if not changed.get["n"]:
            scratch.drop(edges)
            return labels


def _first_pairs(lists: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Each entry with the most typical set of its list, if their sizes fit."""
    heads = scratch.keep(lists.groupBy("token").agg(F.max(F.struct("typical", "n", F.col("doc_id").alias("d"))).alias("h"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("token", "h.d", F.col("h.n").alias("m")))
    fits = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    pairs = lists.join(heads, "token").where(fits & (F.col("d") != F.col("doc_id"))).select(F.least("d", "doc_id").alias("a"), F.greatest("d", "doc_id").alias("b")).distinct()
    out = scratch.keep(pairs)
    scratch.drop(heads)
    return out


def _other_pairs(lists: DataFrame, roots: DataFrame, done: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of different components that a list does not let skip."""
    own = lists.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("token", "doc_id", "n", "pos", F.coalesce("root", "doc_id").alias("c"))
    own = scratch.keep(own)
    mixed = scratch.keep(own.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("token"))
    left = scratch.keep(own.join(mixed, "token").withColumn("block", F.floor(F.log("n") / math.log(101 / percent)).cast("int")))
    scratch.drop(own, mixed)
    # x is the shorter set with its indexed prefix; y the longer, which is at most one block on: blocks are a little wider than sizes may differ
    indexed = F.col("n") - F.floor((2 * percent * F.col("n") + 99 + percent) / F.lit(100 + percent)) + 1
    x = left.where(F.col("pos") < indexed).select("token", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("qa"), F.col("c").alias("ca"))
    y = left.select("token", "block", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("qb"), F.col("c").alias("cb"))
    need = least_overlap(F.col("na") + F.col("nb"), percent)
    room = F.least(F.col("na") - F.col("qa"), F.col("nb") - F.col("qb"))
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = x.join(y, ["token", "block"]).where(shorter & (F.col("ca") != F.col("cb")) & (F.col("na") * 100 >= F.col("nb") * percent) & (room >= need))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = scratch.keep(pairs.join(done, ["a", "b"], "left_anti"))
    scratch.drop(left)
    return out


def _roots(docs: DataFrame, size: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written tables: doc_id, n_shingles, fp1, fp2 and parity of each document, and the root of each linked one."""
    spark = docs.sparkSession
    table = scratch.keep(sets(docs, size, percent, _sketch(docs, size)))
    lists = scratch.keep(postings(table))
    signatures = scratch.keep(table.select("doc_id", "n_shingles", "fp1", "fp2", "parity"))
    scratch.drop(table)
    first = _first_pairs(lists, percent, scratch)
    links = verified(docs, first, signatures, size, percent, scratch)
    roots = connected(links, scratch)
    second = _other_pairs(lists, roots, first, percent, scratch)
    if not second.isEmpty():
        more = verified(docs, second, signatures, size, percent, scratch)
        roots = connected(links.unionByName(more), scratch)
    return signatures, roots


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    signatures, roots = _roots(docs, size, percent, Scratch(docs.sparkSession, "jaccard"))
    return signatures.select("doc_id", "n_shingles").join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


#: About the most sets and members of a chunk, and the chunk pairs of one Arrow batch.
CHUNK_SETS, CHUNK_MEMBERS, PAIR_ROWS = 128, 1 << 16, 32


def chunk_links(x: tuple, y: tuple, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that each set of chunk x links with in chunk y, and the other way round.

    A chunk is its distinct members in order, the places among them of each set's members, the
    sets' sizes, and how many documents have each set.  With `same`, no set meets itself.
    """
    (vx, ix, nx, cx), (vy, iy, ny, cy) = x, y
    _, ax, ay = np.intersect1d(vx, vy, assume_unique=True, return_indices=True)

    def cells(values, index, sizes, at):
        column = np.full(len(values), -1, np.int64)
        column[at] = np.arange(len(at))
        column = column[index]
        row = np.repeat(np.arange(len(sizes)), sizes)[column >= 0]
        column = column[column >= 0]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    (rx, kx), (ry, ky) = cells(vx, ix, nx, ax), cells(vy, iy, ny, ay)
    both = np.zeros((len(nx), len(ny)), np.float32)
    step = 4096
    for b in range(0, len(ax), step):
        width = min(step, len(ax) - b)
        sides = []
        for r, k, n in ((rx, kx, len(nx)), (ry, ky, len(ny))):
            dense = np.zeros((n, width), np.float32)
            here = slice(*np.searchsorted(k, [b, b + width]))
            dense[r[here], k[here] - b] = 1
            sides.append(dense)
        both += sides[0] @ sides[1].T
    k = both.astype(np.int64)
    linked = 100 * k >= percent * (nx[:, None] + ny[None, :] - k)
    if same:
        np.fill_diagonal(linked, False)
    return linked @ cy, cx @ linked


def _counted(docs: DataFrame, reps: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Written table rep, links: documents with another set that links to each class; reps: rep, n_shingles, copies, root."""
    spark = docs.sparkSession
    many = reps.groupBy("root").agg(F.count("*").alias("classes")).where("classes > 1").select("root")
    reps = scratch.keep(reps.join(many, "root").withColumn("block", F.floor(F.log("n_shingles") / math.log(101 / percent)).cast("int")))
    groups = scratch.keep(reps.groupBy("root", "block").agg(F.ceil(F.greatest(F.count("*") / CHUNK_SETS, F.sum("n_shingles") / CHUNK_MEMBERS)).cast("int").alias("k")))
    members = full_sets(docs, reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")), size)
    placed = reps.join(groups, ["root", "block"]).select("root", "block", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int").alias("i"), "rep", "copies")
    held = placed.join(members, F.col("rep") == F.col("doc_id")).groupBy("root", "block", "i").agg(F.collect_list(F.struct("rep", "copies", "members")).alias("sets"))

    def pack(batch: pa.RecordBatch):
        for k, found in enumerate(batch.column(3)):
            rows = found.as_py()
            sizes = np.array([len(r["members"]) // 8 for r in rows], np.int64)
            values, index = np.unique(np.frombuffer(b"".join(r["members"] for r in rows), np.uint64), return_inverse=True)
            wide = np.uint16 if len(values) <= 1 << 16 else np.uint32
            ids, copies = (np.array([r[c] for r in rows], np.int64) for c in ("rep", "copies"))
            blobs = [x.tobytes() for x in (ids, copies, sizes, values, index.astype(wide))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c)[k : k + 1] for c in range(3)), *(pa.array([b], pa.binary()) for b in blobs)], names=["root", "block", "i", *names])

    names = ["ids", "copies", "sizes", "vocabulary", "places"]
    with _few_rows(spark):
        chunks = scratch.keep(map_batches(held, pack, "root long, block int, i int, " + ", ".join(f"{c} binary" for c in names)))
    scratch.drop(reps)
    other = groups.select(F.col("root").alias("r"), F.col("block").alias("block_y"), F.col("k").alias("k_y"))
    # the sets of a block link within it and, with larger ones, in the next
    meet = groups.join(other, (F.col("root") == F.col("r")) & F.col("block_y").between(F.col("block"), F.col("block") + 1))
    meet = meet.select("root", "block", "block_y", "k_y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    meet = meet.select("root", "block", "block_y", "i", F.explode(F.sequence(F.lit(0), F.col("k_y") - 1)).alias("j")).where("block <> block_y or i <= j")
    x = chunks.select("root", "block", "i", F.struct(*names).alias("x"))
    y = chunks.select("root", F.col("block").alias("block_y"), F.col("i").alias("j"), F.struct(*names).alias("y"))
    pairs = meet.join(x, ["root", "block", "i"]).join(y, ["root", "block_y", "j"]).select(((F.col("block") == F.col("block_y")) & (F.col("i") == F.col("j"))).alias("same"), "x", "y")

    def chunk(c: dict) -> tuple:
        values = np.frombuffer(c["vocabulary"], np.uint64)
        index = np.frombuffer(c["places"], np.uint16 if len(values) <= 1 << 16 else np.uint32)
        return values, index, np.frombuffer(c["sizes"], np.int64), np.frombuffer(c["copies"], np.int64)

    def count(batch: pa.RecordBatch):
        ids, sums = [], []
        for same, a, b in zip(*batch.columns, strict=True):
            same, a, b = same.as_py(), a.as_py(), b.as_py()
            of_x, of_y = chunk_links(chunk(a), chunk(b), same, percent)
            for c, n in ((a, of_x),) if same else ((a, of_x), (b, of_y)):
                ids.append(np.frombuffer(c["ids"], np.int64)[n > 0])
                sums.append(n[n > 0])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sums))], names=["rep", "links"])

    with _few_rows(spark):
        found = scratch.keep(map_batches(pairs, count, "rep long, links long"))
    scratch.drop(groups, chunks)
    return found.groupBy("rep").agg(F.sum("links").alias("links"))


@contextmanager
def _few_rows(spark: SparkSession):
    """Arrow batches inside have PAIR_ROWS rows at most, as a row is a chunk or two."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(PAIR_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def links(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (the number of other documents that it links with)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    signatures, roots = _roots(docs, size, percent, scratch)
    key = ["n_shingles", "fp1", "fp2"]
    classes = signatures.where("doc_id is not null and n_shingles > 0").groupBy(key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = scratch.keep(classes.join(roots, F.col("rep") == F.col("node")).select(*key, "rep", "copies", "root"))
    counted = _counted(docs, reps.select("rep", "n_shingles", "copies", "root"), size, percent, scratch)
    own = reps.join(counted, "rep", "left").select(*key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("own"))
    out = signatures.select("doc_id", *key).join(roots, F.col("doc_id") == F.col("node"), "left").join(own, key, "left")
    n_links = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("own", F.lit(0))).cast("long")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), n_links.alias("n_links"))
