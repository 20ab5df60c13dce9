"""Substring deduplication by level-wise doubling of word windows.

Windows that repeat at one length alone are extended to twice that length.

The lengths are a quarter of the wanted window, half of it, and all of it.  A level need not list
every window of its length: of those inside each full window the one with the least hash is
chosen, so equal full windows choose equal ones, and only chosen ones are counted.
A fixed-size filter tells which of them occur twice.  The next level looks only at the full windows
whose choice does, and doubling ends as soon as a level leaves none.  At the full length nothing is
left out: successive windows that made the same choice are a
fragment; equal fragments are counted once with the least and greatest document
they occur in, and the windows of distinct fragments, by 128-bit hash, find the
least document that has them.  `levels` goes on doubling for callers who want the longest repeats.

A window is removed from every document but the one with the least doc_id it
starts in.  Nothing depends on the order of rows, and no group is gathered in one task: hashes
are aggregated before they are shuffled, and the join that brings the least
document back to the windows is one whose large partitions Spark splits.

Defined cases: a null text has no words; documents shorter than a window keep
everything; rows without doc_id keep everything; rows that repeat a doc_id are judged as one
document's, and each loses only its own words; equal texts of different ids lose all but
the least id's; very long texts are cut nowhere; other columns don't get in.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, Scratch, blob_batch, bucket_count, build_filter, documents, in_filter, map_batches, split_by_filter, with_key
from .kernels import fitting, gram_hashes, leftmost_minima, mix, slices, word_hashes, words


def lengths_to(window: int) -> list[int]:
    """The lengths of the levels before the full one: a quarter of it and half of it, rounded up."""
    half = -(-window // 2)
    return [-(-half // 2), half]


def chosen(h: np.ndarray, starts: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the full windows at `starts` the place of the window of `length` each has chosen, and the hashes of all windows of that length."""
    grams = gram_hashes(h, length)
    return leftmost_minima(grams, window - length + 1)[starts], grams


def survivors(h: np.ndarray, bounds: np.ndarray, window: int, filters: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the full windows whose choices at all levels may occur twice, and their places of the last choice."""
    starts = np.flatnonzero(fitting(bounds, window, max(0, len(h) - window + 1)))
    low = starts
    for length, filter_ in filters:
        if not len(starts):
            break
        low, grams = chosen(h, starts, window, length)
        first = np.flatnonzero(np.diff(low, prepend=-1))
        seen = np.repeat(in_filter(filter_, grams[low[first]]), np.diff(np.append(first, len(low))))
        starts, low = starts[seen], low[seen]
    return starts, low


def level_filters(docs: DataFrame, window: int) -> list[tuple[int, np.ndarray]]:
    """For each level before the full one a filter of the windows that occur twice among those the levels before it leave."""
    spark = docs.sparkSession
    buckets = bucket_count(spark)
    found: list[tuple[int, np.ndarray]] = []
    for length in lengths_to(window):
        shared = spark.sparkContext.broadcast(found)

        def run(batch: pa.RecordBatch, shared=shared, length=length) -> pa.RecordBatch:
            parts = []
            for part in slices(batch.column(1)):
                w = words(part)
                h = word_hashes(part, w)
                starts, _ = survivors(h, w.bounds, window, shared.value)
                if len(starts):
                    low, grams = chosen(h, starts, window, length)
                    parts.append(grams[low[np.flatnonzero(np.diff(low, prepend=-1))]])
            return blob_batch(parts, buckets)

        found = [*found, (length, build_filter(map_batches(documents(docs), run, BLOBS), repeated=True))]
        shared.unpersist()
        if not found[-1][1].any():
            break
    return found


def candidate_windows(docs: DataFrame, window: int) -> DataFrame:
    """h1, h2, doc_id, pos of the full windows that survive all levels."""
    shared = docs.sparkSession.sparkContext.broadcast(level_filters(docs, window))

    def run(batch: pa.RecordBatch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for part in slices(batch.column(1)):
            w = words(part)
            h = word_hashes(part, w)
            at, _ = survivors(h, w.bounds, window, shared.value)
            if len(at):
                doc = np.searchsorted(w.bounds, at, side="right") - 1
                h2 = gram_hashes(word_hashes(part, w, seed=2), window, seed=2)[at]
                yield pa.RecordBatch.from_arrays([pa.array(gram_hashes(h, window)[at].view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[part.first + doc].astype(np.int64)), pa.array((at - w.bounds[doc]).astype(np.int32))], names=["h1", "h2", "doc_id", "pos"])

    return map_batches(documents(docs.where(F.col("doc_id").isNotNull())), run, "h1 long, h2 long, doc_id long, pos int")


_FRAGMENTS = "c1 long, c2 long, doc_id long, key long, pos int, least long, most long, windows binary"


def fragments(docs: DataFrame, window: int) -> DataFrame:
    """Occurrences of fragments: successive full windows that survive all levels and made the same last choice.

    c1, c2 are the 128-bit hash of a fragment's words.  Its first occurrence in a
    run of documents also has the hashes of its windows (h1, h2 after h1, h2) and the
    least and greatest document of that run.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level_filters(docs, window))

    def run(batch: pa.RecordBatch):
        ids, keys = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
        for part in slices(batch.column(1)):
            w = words(part)
            h = word_hashes(part, w)
            at, low = survivors(h, w.bounds, window, shared.value)
            if not len(at):
                continue
            first = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(low, prepend=-1) != 0))
            n = np.diff(np.append(first, len(at)))
            a = at[first]
            g1, g2 = gram_hashes(h, window), gram_hashes(word_hashes(part, w, seed=2), window, seed=2)
            # the hash of a fragment is that of its first and last window and its length
            last = a + n - 1
            c1 = mix(g1[a] * np.uint64(3) + mix(g1[last] + n.astype(np.uint64)))
            c2 = mix(g2[a] * np.uint64(5) + mix(g2[last] ^ n.astype(np.uint64)))
            place = np.searchsorted(w.bounds, a, side="right") - 1
            doc = ids[part.first + place]
            _, once, back = np.unique(c1, return_index=True, return_inverse=True)
            if (c2 != c2[once][back]).any():  # different fragments with one hash: each is a lead of its own
                once = back = np.arange(len(a))
            least, most = np.full(len(once), np.iinfo(np.int64).max), np.full(len(once), np.iinfo(np.int64).min)
            np.minimum.at(least, back, doc)
            np.maximum.at(most, back, doc)
            lead = np.zeros(len(a), bool)
            lead[once] = True
            sizes = np.where(lead, n, 0)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            listed = np.arange(bounds[-1]) + np.repeat(a - bounds[:-1], sizes)
            raw = np.stack([g1[listed], g2[listed]], 1)
            held = pa.py_buffer(np.packbits(lead, bitorder="little").tobytes())
            windows = pa.Array.from_buffers(pa.binary(), len(a), [held, pa.py_buffer((bounds * 16).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            columns = [pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(doc), pa.array(keys[part.first + place]), pa.array((a - w.bounds[place]).astype(np.int32)), pa.array(least[back], pa.int64(), mask=~lead), pa.array(most[back], pa.int64(), mask=~lead), windows]
            yield pa.RecordBatch.from_arrays(columns, names=["c1", "c2", "doc_id", "key", "pos", "least", "most", "windows"])

    return map_batches(with_key(docs.where(F.col("doc_id").isNotNull())), run, _FRAGMENTS)


def _exploded(distinct: DataFrame) -> DataFrame:
    """h1, h2, c1, c2, at, least, most: a row for each window of each distinct fragment."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        listed = batch.column(4)
        n = pc.binary_length(listed).to_numpy() // 16
        raw = np.frombuffer(b"".join(listed.to_pylist()), np.int64).reshape(-1, 2)
        back = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)
        own = batch.select([0, 1, 2, 3]).take(pa.array(back))
        return pa.RecordBatch.from_arrays([pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy()), own.column(0), own.column(1), pa.array(at.astype(np.int32)), own.column(2), own.column(3)], names=["h1", "h2", "c1", "c2", "at", "least", "most"])

    return map_batches(distinct.select("c1", "c2", "least", "most", "windows"), run, "h1 long, h2 long, c1 long, c2 long, at int, least long, most long")


def removed_windows(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Written table: doc_id, key (the hash of a row's text) and the starts of its windows that also start in a document with a smaller doc_id."""
    found = scratch.keep(fragments(docs, window))
    distinct = scratch.keep(found.where("windows is not null").groupBy("c1", "c2").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.first("windows").alias("windows")))
    listed = _exploded(distinct)
    first = scratch.keep(listed.groupBy("h1", "h2").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last").select("h1", "h2", "first"))
    decided = listed.join(first, ["h1", "h2"]).where("first < most").groupBy("c1", "c2").agg(F.collect_list(F.struct("at", "first")).alias("runs"))
    decided = scratch.keep(decided)
    scratch.drop(distinct, first)
    hit = found.select("c1", "c2", "doc_id", "key", "pos").join(decided, ["c1", "c2"])
    places = F.transform(F.filter("runs", lambda r: r["first"] < F.col("doc_id")), lambda r: F.col("pos") + r["at"])
    out = hit.select("doc_id", "key", places.alias("at")).where(F.size("at") > 0).groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    out = scratch.keep(out)
    scratch.drop(found, decided)
    return out


SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string"


def kept_words(batch: pa.RecordBatch, window: int, digest: bool):
    """n_words, n_removed and the kept words joined by blanks (or their SHA-256) of a batch of doc_id, text, at."""
    n_words, n_removed, kept = [], [], []
    at = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
    text = batch.column(1)
    for part in slices(text):
        for d in range(part.last - part.first):
            found = part.bytes_of(d).split()
            hits = at[part.first + d]
            n_words.append(len(found))
            if hits:
                step = np.zeros(len(found) + 1, np.int32)
                a = np.array(hits)
                a = a[a + window <= len(found)]
                np.add.at(step, a, 1)
                np.add.at(step, a + window, -1)
                keep = np.cumsum(step[:-1]) == 0
                found = [x for x, k in zip(found, keep.tolist(), strict=True) if k]
            n_removed.append(n_words[-1] - len(found))
            joined = b" ".join(found)
            kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def deduplicate(docs: DataFrame, window: int = 50, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: every document without the words of windows that a smaller doc_id has.

    digest: kept_text is the lower-case SHA-256 of that text.
    """
    scratch = Scratch(docs.sparkSession, "levels")
    removed = removed_windows(docs, window, scratch)
    some, others = split_by_filter(with_key(docs), removed)
    joined = some.join(removed, ["doc_id", "key"], "left").select("doc_id", "text", "at")
    done = map_batches(joined, lambda b: kept_words(b, window, digest), SCHEMA)
    return done.unionByName(map_batches(others.select("doc_id", "text"), lambda b: kept_words(b, window, digest), SCHEMA))


def levels(docs: DataFrame, start: int = 25, most: int | None = None) -> DataFrame:
    """length, h1, h2, doc_id, pos: all windows of lengths start, 2*start, ... that occur in two documents or more, until none is left.

    A window of twice the length is looked at only where both its halves repeat.
    """
    scratch = Scratch(docs.sparkSession, "doubling")
    whole = candidate_windows(docs, start)
    many = scratch.keep(whole.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2"))
    now = scratch.keep(whole.join(many, ["h1", "h2"]).select(F.lit(start).alias("length"), "h1", "h2", "doc_id", "pos").distinct())
    out, length = now, start
    while not now.isEmpty() and (most is None or length * 2 <= most):
        later = now.select("doc_id", (F.col("pos") - length).alias("pos"), F.col("h1").alias("r1"), F.col("h2").alias("r2"))
        pairs = now.join(later, ["doc_id", "pos"]).select("doc_id", "pos", F.xxhash64("h1", "h2", "r1", "r2").alias("h1"), F.xxhash64("r2", "h1", "r1", "h2", F.lit(1)).alias("h2"))
        many = pairs.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2")
        length *= 2
        now = scratch.keep(pairs.join(many, ["h1", "h2"]).select(F.lit(length).alias("length"), "h1", "h2", "doc_id", "pos"))
        out = out.unionByName(now)
    return out
