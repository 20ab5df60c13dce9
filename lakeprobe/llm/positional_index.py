"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table with a row for each shard, a run of documents of about a megabyte: its terms,
and for each of them the increasing positions of its tokens (postings), beside the documents'
bounds.  A phrase is answered from its rarest term over all shards: that term's list, shifted by the term's offset, gives
the candidate starts, and the lists of the other terms, shifted by theirs and rarest first, are
intersected with them.  Only phrases whose rarest term a shard has cost anything there.
Terms are compared as texts, so nothing can collide.

The test items are a stated query set.  They are read in blocks of bounded size, one after the other:
each is sent to the executors, answered from the index, and given up before the next.

`matches` and `keep_clean` answer exact phrases; `near_matches` finds words in order with gaps, from the same index.

Defined cases: null texts and items have no words; repeated item rows count once
by id; an item id that several texts share occurs if a window of any of them does; repeated documents and
rows without doc_id are judged one by one; very long texts are a shard alone; other columns don't get in;
without documents or items nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, map_batches, shuffles_removed, without
from .kernels import ALNUM, LOWER, Slice, Words, gathered, slices, word_codes, word_hashes, words

#: Bytes of item texts in a block: what is sent to the executors at once.
BLOCK_BYTES = 8 << 20
#: Candidate starts that are looked at together.
CANDIDATES = 1 << 20


def folded(part: Slice) -> Slice:
    return Slice(part.first, part.last, LOWER[part.data], part.offsets)


def tokens(part: Slice) -> tuple[Words, np.ndarray]:
    """Words of the lower-cased texts of a slice, and their hashes."""
    low = folded(part)
    w = words(low, ALNUM)
    return w, word_hashes(low, w)


def token_texts(text: str) -> list[bytes]:
    low = folded(next(slices(pa.array([text], pa.large_string()))))
    w = words(low, ALNUM)
    return [low.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]


INDEX = "shard long, ids array<long>, keys1 array<long>, keys2 array<long>, bounds binary, terms array<binary>, first binary, postings binary"


def build_index(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The stored index.  A shard has its documents' ids and two hashes of their texts, their token bounds, its terms, where each one's
    list begins (one more than terms), and all lists as differences."""
    text = F.col("text").cast("string")
    keyed = documents(docs, F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(1), text).alias("key2"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch.column(1)):
            low = folded(part)
            w = words(low, ALNUM)
            code, lead = word_codes(low.data, w.starts, w.ends)
            raw, cut = gathered(low.data, w.starts[lead], w.ends[lead])
            terms = pa.Array.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            positions = np.argsort(code, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(lead)))])
            one = np.array([0, part.last - part.first], np.int32)
            lists = [pa.ListArray.from_arrays(one, batch.column(k)[part.first : part.last].cast(pa.int64())) for k in (0, 2, 3)]
            blobs = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (w.bounds, first, np.diff(positions, prepend=0))]
            yield pa.RecordBatch.from_arrays([*lists, blobs[0], pa.ListArray.from_arrays(np.array([0, len(lead)], np.int32), terms), blobs[1], blobs[2]], names=["ids", "keys1", "keys2", "bounds", "terms", "first", "postings"])

    made = map_batches(keyed, run, INDEX.removeprefix("shard long, "))
    return scratch.keep(made.select(F.monotonically_increasing_id().alias("shard"), "*"))


@dataclass
class Shard:
    """The lists of those terms of a shard that have a number: `numbers` in order, positions of the k-th are positions[first[k]:first[k+1]]."""

    numbers: np.ndarray
    first: np.ndarray
    positions: np.ndarray
    bounds: np.ndarray

    @classmethod
    def read(cls, row: dict, vocabulary: dict[bytes, int]) -> Shard:
        number = np.array([vocabulary.get(t, -1) for t in row["terms"]], np.int64)
        first = np.frombuffer(row["first"], np.int32).astype(np.int64)
        known = np.flatnonzero(number >= 0)
        known = known[np.argsort(number[known])]
        sizes = first[known + 1] - first[known]
        start = np.concatenate([[0], np.cumsum(sizes)])
        every = np.cumsum(np.frombuffer(row["postings"], np.int32), dtype=np.int64)
        return cls(number[known], start, every[np.arange(start[-1]) + np.repeat(first[known] - start[:-1], sizes)], np.frombuffer(row["bounds"], np.int32).astype(np.int64))

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, side="right") - 1

    def phrases(self, terms: np.ndarray, order: np.ndarray, by_rarest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """terms: a row for each phrase, all of one length; order: its offsets, rarest term first; by_rarest: phrases from the first of each rarest term
        to the next, phrases being sorted by it.  Numbers of phrases and starts of their occurrences, some at a time."""
        begin, count = by_rarest[self.numbers], by_rarest[self.numbers + 1] - by_rarest[self.numbers]
        phrase = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        own = np.repeat(np.arange(len(self.numbers)), count)
        sizes = (self.first[1:] - self.first[:-1])[own]
        done = np.cumsum(sizes)
        lists = self.numbers.repeat(self.first[1:] - self.first[:-1]) << 32 | self.positions
        at = 0
        while at < len(phrase):
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CANDIDATES, side="right")))
            some = sizes[at:end]
            which = np.repeat(phrase[at:end], some)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some)
            start = self.positions[np.repeat(self.first[own[at:end]], some) + inside] - order[which, 0]
            ok = (start >= 0) & (start + terms.shape[1] <= self.bounds[-1])
            ok[ok] = self.document(start[ok]) == self.document(start[ok] + terms.shape[1] - 1)
            which, start = which[ok], start[ok]
            for k in range(1, terms.shape[1]):
                offset = order[which, k]
                wanted = terms[which, offset] << 32 | (start + offset)
                place = np.searchsorted(lists, wanted)
                place[place == len(lists)] = 0
                ok = lists[place] == wanted
                which, start = which[ok], start[ok]
            yield which, start
            at = end

    def near(self, terms: list[int], gap: int) -> list[tuple[int, int]]:
        """Starts and ends (inclusive) of the terms in order in one document, at most `gap` other tokens between neighbours; for each first position the nearest chain."""
        place = np.searchsorted(self.numbers, terms)
        if not terms or (place >= len(self.numbers)).any() or (self.numbers[place] != terms).any():
            return []
        lists = [self.positions[self.first[k] : self.first[k + 1]] for k in place]
        reach = {int(p): int(p) for p in lists[-1]}
        for here, after in zip(lists[-2::-1], lists[:0:-1], strict=True):
            after = np.array([p for p in after.tolist() if p in reach], np.int64)
            now: dict[int, int] = {}
            for p in here.tolist():
                a, b = np.searchsorted(after, [p + 1, p + 2 + gap])
                last = self.bounds[self.document(p) + 1]
                ends = [reach[int(q)] for q in after[a:b] if q < last]
                if ends:
                    now[p] = min(ends)
            reach = now
        return sorted(reach.items())


class Queries:
    """Windows of the items of one block: `vocabulary` numbers their terms; by length, windows sorted by their rarest term."""

    def __init__(self, rows: list[tuple[str, str]], size: int):
        found: dict[tuple, dict[str, None]] = {}
        self.vocabulary: dict[bytes, int] = {}
        for item, text in rows:
            own = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in token_texts(text)]
            n = min(size, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                found.setdefault(tuple(own[i : i + n]), {})[item] = None
        self.windows = {n: np.array([w for w in found if len(w) == n], np.int64) for n in {len(w) for w in found}}
        self.items = {n: [list(found[tuple(w)]) for w in terms.tolist()] for n, terms in self.windows.items()}

    def arrange(self, often: np.ndarray) -> None:
        """often: occurrences of each term over all shards."""
        self.order, self.by_rarest = {}, {}
        for n, terms in self.windows.items():
            order = np.argsort(often[terms], axis=1, kind="stable")
            rarest = terms[np.arange(len(terms)), order[:, 0]]
            by = np.argsort(rarest, kind="stable")
            self.windows[n], self.order[n], self.items[n] = terms[by], order[by], [self.items[n][k] for k in by]
            self.by_rarest[n] = np.searchsorted(rarest[by], np.arange(len(self.vocabulary) + 1))


def _blocks(benchmark: DataFrame, size: int, most: int) -> Iterator[Queries]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield Queries(sorted(map(tuple, block.collect())), size)


def _frequency(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Occurrences of the vocabulary's terms over all shards: one number a term comes to the driver."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        often = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = np.array([shared.value.get(t, -1) for t in terms], np.int64)
                known = number >= 0
                often[number[known]] += np.diff(np.frombuffer(first, np.int32))[known]
        some = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(often[some])], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    with shuffles_removed(index.sparkSession):
        for term, n in index.select("terms", "first").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
            out[term] = n
    shared.unpersist()
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ITEMS = pa.list_(pa.string())
HITS = "shard long, place int, spans array<struct<start:long,end:long>>, items array<string>"


def _search(q: Queries, row: dict) -> Iterator[tuple[int, list[dict], list[str]]]:
    """Place, spans and items of each document of a shard that has any."""
    shard = Shard.read(row, q.vocabulary)
    covered = np.zeros(int(shard.bounds[-1]) + 1, np.int32)
    found: dict[int, set[str]] = {}
    for n, terms in q.windows.items():
        for phrase, start in shard.phrases(terms, q.order[n], q.by_rarest[n]):
            np.add.at(covered, start, 1)
            np.add.at(covered, start + n, -1)
            for p, d in set(zip(phrase.tolist(), shard.document(start).tolist(), strict=True)):
                found.setdefault(d, set()).update(q.items[n][p])
    hit = np.cumsum(covered[:-1]) > 0
    for d in sorted(found):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[shard.bounds[d] : shard.bounds[d + 1]].astype(np.int8), [0]])))
        yield d, [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()], sorted(found[d])


def find(index: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written table of HITS: for each document (by shard and place there) that holds windows the merged runs of words inside them, and the items' ids."""
    context = index.sparkSession.sparkContext
    tables = []
    for queries in _blocks(benchmark, window, block_bytes):
        queries.arrange(_frequency(index, queries.vocabulary))
        shared = context.broadcast(queries)

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            for row in batch.to_pylist():
                found = list(_search(shared.value, row))
                if found:
                    place, spans, items = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(place), pa.int64()), pa.array(place, pa.int32()), pa.array(spans, _SPANS), pa.array(items, _ITEMS)], names=["shard", "place", "spans", "items"])

        tables.append(scratch.keep(map_batches(index.select("shard", "bounds", "terms", "first", "postings"), run, HITS)))
        shared.unpersist()
    if not tables:
        return index.sparkSession.createDataFrame([], HITS)
    if len(tables) == 1:
        return tables[0]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    # a document has at most one row a block
    together = every.groupBy("shard", "place").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def united(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_union(s) for s in batch.column(2).to_pylist()], _SPANS), batch.column(3)], names=["shard", "place", "spans", "items"])

    return scratch.keep(map_batches(together, united, HITS))


def _union(spans: list[dict]) -> list[dict]:
    """spans: by start."""
    out: list[dict] = []
    for s in spans:
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged runs of words inside an occurrence of a window; end exclusive), items (ids whose windows occur, sorted).

    An item shorter than the window, but not empty, is one window.
    """
    scratch = Scratch(docs.sparkSession, "postings")
    index = build_index(docs, scratch)
    hits = find(index, benchmark, scratch, window, block_bytes)

    def listed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for shard, ids, bounds in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            n = np.diff(np.frombuffer(bounds, np.int32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(n), pa.int64()), pa.array(np.arange(len(n), dtype=np.int32)), ids.values, pa.array(n)], names=["shard", "place", "doc_id", "n_words"])

    rows = map_batches(index.select("shard", "ids", "bounds"), listed, "shard long, place int, doc_id long, n_words long")
    none = {"spans": F.array().cast("array<struct<start:long,end:long>>"), "items": F.array().cast("array<string>")}
    return rows.join(hits, ["shard", "place"], "left").select("doc_id", "n_words", *(F.coalesce(c, empty).alias(c) for c, empty in none.items()))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose text has no occurrence of any window; columns stay as they are.  Rows are told apart by 128 bits of their texts' hashes."""
    scratch = Scratch(docs.sparkSession, "postings")
    index = build_index(docs, scratch)
    hits = find(index, benchmark, scratch, window, block_bytes)
    text = F.col("text").cast("string")
    names = ["__key1", "__key2"]
    places = index.select("shard", F.posexplode(F.arrays_zip("keys1", "keys2")).alias("place", "k")).join(hits.select("shard", "place"), ["shard", "place"], "left_semi")
    keys = scratch.keep(places.select(F.col("k.keys1").alias(names[0]), F.col("k.keys2").alias(names[1])).distinct())
    scratch.drop(index)
    rows = docs.select("*", F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1]))
    return without(rows, keys, *names).select(docs.columns)


def near_matches(index: DataFrame, phrases: list[str], gap: int = 2) -> DataFrame:
    """doc_id, phrase, start, end (exclusive): the phrase's words in order with at most `gap` words between neighbours.

    index: build_index(); phrases: a query set, which is sent to the executors whole.
    """
    vocabulary: dict[bytes, int] = {}
    terms = [(p, [vocabulary.setdefault(t, len(vocabulary)) for t in token_texts(p)]) for p in phrases]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for row in batch.to_pylist():
            shard = Shard.read(row, vocabulary)
            for p, t in terms:
                for a, b in shard.near(t, gap):
                    d = int(shard.document(a))
                    rows.append((row["ids"][d], p, int(a - shard.bounds[d]), int(b - shard.bounds[d]) + 1))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "phrase", "start", "end"])

    return map_batches(index.select("ids", "bounds", "terms", "first", "postings"), run, "doc_id long, phrase string, start long, end long")
