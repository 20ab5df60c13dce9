"""Exact substring deduplication with a Burrows-Wheeler transform and threshold-bounded interval expansion.

A byte string of `window` bytes that also starts in a document with a smaller
doc_id is removed.  The work is dealt so that equal windows meet in one task:

1.  Each window chooses the least-hashed anchor (28 bytes) inside it, so equal
    windows choose equal anchors.  A fixed-size filter tells which anchors occur twice;
    successive windows whose anchors do are a region.  Equal regions, such as those of
    exact copies, become one with the least and greatest document they occur in.
2.  In distinct regions, successive windows that chose the same (shorter) anchor are a
    fragment.  Equal fragments are one text for each run of regions, and are dealt by anchor; a text
    takes its places along if they are few, more are joined with its decisions later.
    Fragments of an anchor that is in very many different ones are dealt by their single windows, which are to
    fragments what fragments are to regions.
3.  Each task sorts the suffixes of the distinct fragments of an anchor as deep as the window needs,
    and takes the transform.  Starting at the empty string, intervals of suffixes are
    extended backwards by one byte, breadth first: the right end of an interval of
    strings of length l+1 that nothing has marked is a common prefix of l bytes, so
    prefixes come by increasing value, and the expansion stops at the window's length.
    Suffixes between two marks then have a whole window in common; the least document of
    such a class decides.  An anchor with one distinct fragment needs no expansion:
    the least document of that fragment has all its windows.
4.  The decisions go back to fragments, regions, their occurrences, and the documents.

Fragments are the same if their bytes are; regions, and places that a text does not take along, are joined by 128-bit hashes.

Defined cases: a null text is empty; texts shorter than the window keep everything;
rows without doc_id keep everything; rows that repeat a doc_id are one document's, so none of
them loses what only they share, and each keeps its own place of spans, whatever its text; equal texts of
different ids go but for the least id; very long texts are cut nowhere; other columns don't get in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, Scratch, blob_batch, bucket_count, build_filter, documents, in_filter, map_batches, split_by_filter, with_key
from .kernels import byte_gram_hashes, gathered, leftmost_minima, mix, range_hashes, slices, text_buffers

#: Bytes of an anchor in a window of 50 (in other windows, in proportion): to find regions, and to deal fragments.
ANCHOR, SHORT_ANCHOR = 28, 16
#: Bytes of fragments whose suffixes are sorted at once.
CHUNK_BYTES = 64 << 10
#: Bytes of an anchor's fragments (one for each run of regions) beyond which they are dealt by their windows.
GROUP_BYTES = 4 << 20
#: Parts in which fragments are written, dealt by anchor, and joined with their decisions, one after the other, so that only one part is in shuffle files at a time.
PASSES = 4
#: Places of a fragment in a run of regions at most for them to go where its text goes: they are then no longer than a few texts.
PLACES = 8
#: Cells of anchors whose bytes are added up to find those that may be in very many fragments.
CELLS = 1 << 16
#: Runs of windows that are put in order at once.
RUN_ROWS = 1 << 16
_NONE = np.iinfo(np.int64).max


def _anchors(part, window: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows that fit, the anchor each has chosen, and the hashes of all anchors."""
    size = max(1, anchor * window // 50)
    g = byte_gram_hashes(part.data, size)
    low = leftmost_minima(g, window - size + 1)
    n = np.maximum(np.diff(part.offsets) - window + 1, 0)
    starts = np.arange(n.sum()) + np.repeat(part.offsets[:-1] - (np.cumsum(n) - n), n)
    return starts, low[starts], g


def _anchor_blobs(docs: DataFrame, window: int) -> DataFrame:
    buckets = bucket_count(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for part in slices(batch.column(1)):
            _, low, g = _anchors(part, window)
            if len(low):
                parts.append(g[low[np.flatnonzero(np.diff(low, prepend=-1))]])
        return blob_batch(parts, buckets)

    return map_batches(documents(docs), run, BLOBS)


def _leads(data: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Two hashes of each byte range, the number of its text, and for each text a range that has it and the least and most over all of them."""
    c1, c2 = (range_hashes(data, a, b, seed) for seed in (1, 2))
    _, back = np.unique(c1, return_inverse=True)
    n = int(back.max()) + 1 if len(back) else 0
    low, high, once = np.full(n, _NONE), np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int64)
    np.minimum.at(low, back, least)
    np.maximum.at(high, back, most)
    once[back] = np.arange(len(back))
    if (c2 != c2[once][back]).any():  # different ranges with one hash: each is a text of its own
        back = once = np.arange(len(a))
        low, high = least, most
    return c1.view(np.int64), c2.view(np.int64), back, once, low, high


def _held_by_leads(part, a: np.ndarray, b: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Hashes of the byte ranges, and for the first of equal ones their bytes with the least and most over all of them; null for others."""
    c1, c2, back, once, low, high = _leads(part.data, a, b, least, most)
    lead = np.zeros(len(a), bool)
    lead[once] = True
    raw, bounds = gathered(part.data, a, np.where(lead, b, a))
    held = pa.py_buffer(np.packbits(lead, bitorder="little").tobytes())
    text = pa.Array.from_buffers(pa.binary(), len(a), [held, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
    only = lambda x: pa.array(x, pa.int64(), mask=~lead)
    return pa.array(c1), pa.array(c2), only(low[back]), only(high[back]), text


_REGIONS = "c1 long, c2 long, doc_id long, key long, pos long, least long, most long, bytes binary"


def regions(docs: DataFrame, window: int) -> DataFrame:
    """Every run of successive windows whose anchors may occur twice: its 128-bit hash, document, hash of the document's text, and place.

    The first of equal regions in a run of documents also has the bytes, and the
    least and greatest document of that run.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_filter(_anchor_blobs(docs, window), repeated=True))

    def run(batch: pa.RecordBatch):
        ids, keys = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
        for part in slices(batch.column(1)):
            starts, low, g = _anchors(part, window)
            if not len(starts):
                continue
            first = np.flatnonzero(np.diff(low, prepend=-1))
            n = np.diff(np.concatenate([first, [len(low)]]))
            at = starts[np.repeat(in_filter(shared.value, g[low[first]]), n)]
            if not len(at):
                continue
            begin = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            a, b = at[begin], at[np.concatenate([begin[1:], [len(at)]]) - 1] + window
            place = np.searchsorted(part.offsets, a, side="right") - 1
            doc = ids[part.first + place]
            c1, c2, least, most, text = _held_by_leads(part, a, b, doc, doc)
            yield pa.RecordBatch.from_arrays([c1, c2, pa.array(doc), pa.array(keys[part.first + place]), pa.array(a - part.offsets[place]), least, most, text], names=["c1", "c2", "doc_id", "key", "pos", "least", "most", "bytes"])

    return map_batches(with_key(docs.where(F.col("doc_id").isNotNull())), run, _REGIONS)


_FRAGMENTS = "c1 long, c2 long, anchor long, least long, most long, bytes binary, places binary, part int"
#: A fragment's place: its region's hash and where it begins there.
_PLACE = np.dtype([("r1", "<i8"), ("r2", "<i8"), ("at", "<i4")])


def _binary(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of all rows, one row after the other, and their number in each."""
    raw, bounds = text_buffers(column)
    return np.frombuffer(raw[bounds[0] : bounds[-1]].tobytes(), _PLACE), np.diff(bounds) // _PLACE.itemsize


def _with_places(c1, c2, back, once, anchor, least, most, text: pa.Array, places: np.ndarray, dealt: np.ndarray, most_places: int) -> Iterator[pa.RecordBatch]:
    """Rows of texts with their places; back is the text of each place and once a place of each text."""
    count = np.bincount(back, minlength=len(once))
    many = count > most_places
    order = np.argsort(back, kind="stable")
    apart = many[back[order]]
    bounds = lambda k: np.concatenate([[0], np.cumsum(k)]) * _PLACE.itemsize
    names = ["c1", "c2", "anchor", "least", "most", "bytes", "places", "part"]
    hashes = [pa.array(x[once], mask=~many) for x in (c1, c2)]
    along = _binary(places[order[~apart]], bounds(np.where(many, 0, count)))
    yield pa.RecordBatch.from_arrays([*hashes, *map(pa.array, (anchor, least, most)), text, along, pa.array(dealt)], names=names)
    if apart.any():
        of = once[many]
        none = [pa.nulls(len(of), kind) for kind in (*[pa.int64()] * 3, pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(c1[of]), pa.array(c2[of]), *none, _binary(places[order[apart]], bounds(count[many])), pa.array(dealt[many])], names=names)


def fragments(distinct: DataFrame, window: int, most_places: int = PLACES) -> DataFrame:
    """Fragments of distinct regions, one row for equal ones in a run of regions: bytes, anchor, least and greatest document, and places.

    Where there are more places than most_places, they have a row of their own, without bytes; both have a hash then.
    """
    passes = PASSES

    def run(batch: pa.RecordBatch):
        r1, r2, least, most = (batch.column(k).to_numpy() for k in range(4))
        for part in slices(batch.column(4)):
            starts, low, g = _anchors(part, window, SHORT_ANCHOR)
            first = np.flatnonzero(np.diff(low, prepend=-1))
            if not len(first):
                continue
            n = np.diff(np.concatenate([first, [len(low)]]))
            a = starts[first]
            b = a + n + window - 1
            region = np.searchsorted(part.offsets, a, side="right") - 1
            row = part.first + region
            c1, c2, back, once, lowest, highest = _leads(part.data, a, b, least[row], most[row])
            anchor = g[low[first]]
            dealt = (mix(anchor ^ np.uint64(window)) % np.uint64(passes)).astype(np.int32)
            places = np.empty(len(a), _PLACE)
            places["r1"], places["r2"], places["at"] = r1[row], r2[row], a - part.offsets[region]
            text = _binary(*gathered(part.data, a[once], b[once]))
            yield from _with_places(c1, c2, back, once, anchor[once].view(np.int64), lowest, highest, text, places, dealt[once], most_places)

    return map_batches(distinct.select("c1", "c2", "least", "most", "bytes"), run, _FRAGMENTS)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols at least, by doubling; a symbol is under 512 and 0 follows the end."""
    n = len(symbols)
    wide = np.concatenate([symbols, np.zeros(8, np.uint64)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | wide[j : j + n]
    size = 7
    while True:
        order = np.argsort(key)
        if size >= depth:
            return order
        sorted_ = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], sorted_[1:] != sorted_[:-1]])).astype(np.uint64)
        if int(rank[order[-1]]) == n:
            return order
        after = np.zeros(n, np.uint64)
        after[: max(0, n - size)] = rank[size:]
        key = (rank << np.uint64(32)) | after
        size *= 2


def common_prefix_marks(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Length of the common prefix at each boundary between neighbours in order, where it is under `least`; else -1.

    Separators (symbol 0) are not extended over: only strings without one can be shared.
    """
    n = len(symbols)
    before = symbols[order - 1].astype(np.uint16)  # the transform; the text is taken as a circle
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix that is one symbol longer stands
    step[by_symbol] = np.arange(n)
    first = np.concatenate([symbols[order].astype(np.int32), [-1]])
    marks = np.full(n + 1, -1, np.int16)
    marks[0] = marks[n] = 0
    owner = np.full(n + 1, -1, np.int64)
    low, high = np.array([0]), np.array([n])
    for length in range(least):
        sizes = high - low
        which = np.repeat(np.arange(len(low)), sizes)
        rows = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        some = before[rows] != 0
        which, to = which[some], step[rows[some]]
        owner[to] = which
        ends = (owner[to + 1] != which) | (first[to + 1] != first[to])
        begins = (owner[to - 1] != which) | (first[to - 1] != first[to])
        low, high = np.sort(to[begins]), np.sort(to[ends]) + 1
        owner[to] = -1
        new = marks[high] < 0
        low, high = low[new], high[new]
        marks[high] = length
        if not len(low):
            break
    return marks


def window_classes(texts: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of the texts, one text after the other: the number of its text, and the least of docs over the texts that hold an equal window."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(lengths + 1) - 1
    raw[ends] = 0
    order = suffix_order(raw, window + 1)
    marks = common_prefix_marks(raw, order, window)
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    valid = (ends[text] - np.arange(len(raw))) >= window
    value = np.where(valid, docs[text], _NONE)[order]
    begin = np.flatnonzero(marks[:-1] >= 0)
    low = np.minimum.reduceat(value, begin)
    out = np.empty(len(raw), np.int64)
    out[order] = np.repeat(low, np.diff(np.concatenate([begin, [len(raw)]])))
    return text[valid], out[valid]


_DECIDED = "r1 long, r2 long, a int, b int, least long, placed boolean"


def _batch(r1: np.ndarray, r2: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, placed: bool) -> pa.RecordBatch:
    columns = [pa.array(r1, pa.int64()), pa.array(r2, pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(least, pa.int64()), pa.array(np.full(len(r1), placed))]
    return pa.RecordBatch.from_arrays(columns, names=["r1", "r2", "a", "b", "least", "placed"])


def _runs(texts: pa.Array, anchor: np.ndarray, least: np.ndarray, most: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Number of the text, first window, window after the last, and least document of runs of windows, where that is smaller than the greatest of the text."""
    _, group, sizes = np.unique(anchor, return_inverse=True, return_counts=True)
    alone = sizes[group] == 1
    some = np.flatnonzero(alone & (least < most))
    lengths = pc.binary_length(texts).to_numpy()[some].astype(np.int64)
    out = [(some, np.zeros(len(some), np.int64), lengths - window + 1, least[some])]
    many = np.flatnonzero(~alone)
    if len(many):
        text, low = window_classes(texts.take(pa.array(many)).to_pylist(), least[many], window)
        cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (low[1:] != low[:-1])]))
        start = np.searchsorted(text, text[cut])
        end = np.concatenate([cut[1:], [len(text)]])
        of = many[text[cut]]
        keep = low[cut] < most[of]
        out.append((of[keep], (cut - start)[keep], (end - start)[keep], low[cut][keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _decide(rows: list[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Decisions of some anchors' fragments, which are here altogether: at their places, or for those that are not along by hash."""
    table = pa.Table.from_batches(rows).combine_chunks()
    texts = table["bytes"].combine_chunks().dictionary_encode()
    back, n = texts.indices.to_numpy(), len(texts.dictionary)
    once, least, most = np.zeros(n, np.int64), np.full(n, _NONE), np.full(n, np.iinfo(np.int64).min)
    once[back] = np.arange(len(back))
    np.minimum.at(least, back, table["least"].to_numpy())
    np.maximum.at(most, back, table["most"].to_numpy())
    of, a, b, low = _runs(texts.dictionary, table["anchor"].to_numpy()[once], least, most, window)
    order = np.argsort(of, kind="stable")
    a, b, low, count = a[order], b[order], low[order], np.bincount(of, minlength=n)
    begin = np.cumsum(count) - count

    def at_each(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For some texts, one after the other, the index of the text among them and of the run, for all runs."""
        k = count[text]
        which = np.repeat(np.arange(len(text)), k)
        return which, np.arange(len(which)) + np.repeat(begin[text] - (np.cumsum(k) - k), k)

    places, counts = _places(table["places"])
    which, run = at_each(np.repeat(back, counts))
    if len(which):
        at = places["at"][which]
        yield _batch(places["r1"][which], places["r2"][which], at + a[run], at + b[run], low[run], True)
    named = np.flatnonzero(table["c1"].is_valid().to_numpy())
    if len(named):
        text, first = np.unique(back[named], return_index=True)
        which, run = at_each(text)
        c1, c2 = (table[k].combine_chunks().fill_null(0).to_numpy()[named[first]][which] for k in ("c1", "c2"))
        yield _batch(c1, c2, a[run], b[run], low[run], False)


def _chunks(batches: Iterable[pa.RecordBatch], key: str, chunk_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows that come sorted by `key`, in chunks that end with the key that goes beyond chunk_bytes."""
    held, size = [], 0
    for batch in batches:
        keys = batch.column(key).to_numpy()
        sizes = np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())
        at = 0
        if held and size >= chunk_bytes and batch.num_rows and keys[0] != held[-1].column(key)[-1].as_py():
            yield held
            held, size = [], 0
        while at < batch.num_rows:
            k = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + max(0, chunk_bytes - size)))
            end = batch.num_rows if k >= batch.num_rows else int(np.searchsorted(keys, keys[k], side="right"))
            held.append(batch.slice(at, end - at))
            size += int(sizes[end - 1] - (sizes[at - 1] if at else 0))
            at = end
            if size >= chunk_bytes and at < batch.num_rows:
                yield held
                held, size = [], 0
    if held:
        yield held


def decisions(found: DataFrame, window: int, scratch: Scratch, chunk_bytes: int = CHUNK_BYTES, group_bytes: int = GROUP_BYTES) -> list[DataFrame]:
    """Written tables, some for each part of the anchors: per region (r1, r2) and fragment there, runs of windows [a, b) with the least document that has them, where it is smaller than some document of the fragment.

    Fragments come here once for each run of regions that has them, so even one that a third of all documents share is few rows.
    """
    leads = found.where("bytes is not null")

    def run(batches):
        for held in _chunks(batches, "anchor", chunk_bytes):
            yield from _decide(held, window)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.select("c1", "c2", "anchor", "least", "most", "bytes", "places").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _DECIDED)

    cell, size = F.col("anchor").bitwiseAND(CELLS - 1), F.sum(F.octet_length("bytes")).alias("size")
    full = [c for c, _ in leads.groupBy(cell.alias("cell")).agg(size).where(F.col("size") > group_bytes).collect()]
    hot = scratch.keep(leads.where(cell.isin(full)).groupBy("anchor").agg(size).where(F.col("size") > group_bytes).select("anchor")) if full else None
    if hot is not None and hot.isEmpty():
        hot = None

    def single(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The windows of fragments like fragments of regions: one row for equal ones, with their places in fragments."""
        for part in slices(batch.column("bytes")):
            own = slice(part.first, part.last)
            sizes = np.diff(part.offsets) - window + 1
            row = np.repeat(np.arange(len(sizes)), sizes)
            places = np.empty(len(row), _PLACE)
            places["at"] = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            places["r1"], places["r2"] = (range_hashes(part.data, part.offsets[:-1], part.offsets[1:], seed).view(np.int64)[row] for seed in (1, 2))
            begin = part.offsets[row] + places["at"]
            c1, c2, back, once, least, most = _leads(part.data, begin, begin + window, *(batch.column(k).to_numpy()[own][row] for k in ("least", "most")))
            text = _binary(*gathered(part.data, begin[once], begin[once] + window))
            yield from _with_places(c1, c2, back, once, c1[once], least, most, text, places, np.zeros(len(once), np.int32), PLACES)

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = text_buffers(batch.column("bytes"))
        hashes = [pa.array(range_hashes(data, bounds[:-1], bounds[1:], seed).view(np.int64)) for seed in (1, 2)]
        return pa.RecordBatch.from_arrays([*hashes, batch.column("places")], names=["c1", "c2", "places"])

    def at_places(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, counts = _places(batch.column("places"))
        a, b, least = (np.repeat(batch.column(k).to_numpy(), counts) for k in ("a", "b", "least"))
        return _batch(places["r1"], places["r2"], places["at"] + a, places["at"] + b, least, True)

    def by_hash(decided: DataFrame, rest: DataFrame) -> DataFrame:
        """Decisions at the places that did not go along."""
        apart = decided.where("not placed").select(F.col("r1").alias("c1"), F.col("r2").alias("c2"), "a", "b", "least").distinct()
        return scratch.keep(map_batches(rest.join(apart, ["c1", "c2"]).select("places", "a", "b", "least"), at_places, _DECIDED))

    out = []
    for k in range(PASSES):
        some = leads.where(F.col("part") == k)
        rest = found.where((F.col("part") == k) & F.col("bytes").isNull()).select("c1", "c2", "places")
        if hot is None:
            decided = scratch.keep(dealt(some))
        else:
            many = some.join(hot, "anchor", "left_semi").select("least", "most", "bytes", "places")
            windows = scratch.keep(map_batches(many.select("least", "most", "bytes"), single, _FRAGMENTS))
            at = scratch.keep(dealt(windows.where("bytes is not null")))
            at = at.where("placed").unionByName(by_hash(at, windows.where("bytes is null").select("c1", "c2", "places")))
            decided = scratch.keep(dealt(some.join(hot, "anchor", "left_anti")).unionByName(at.withColumn("placed", F.lit(False))))
            rest = rest.unionByName(map_batches(many.where("length(places) > 0").select("bytes", "places"), named, "c1 long, c2 long, places binary"))
        out += [decided, by_hash(decided, rest)]
    return out


_JUDGED = "c1 long, c2 long, runs array<struct<from:long,to:long,least:long>>"


def _joined_runs(table: pa.Table) -> pa.RecordBatch:
    """The runs of regions that are here altogether, in order, neighbours with one least document put together."""
    r1, r2, a, b, least = (table[k].to_numpy() for k in ("r1", "r2", "a", "b", "least"))
    order = np.lexsort((a, r2, r1))
    r1, r2, a, b, least = (x[order] for x in (r1, r2, a, b, least))
    other = np.concatenate([[True], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])])
    begin = np.flatnonzero(other | np.concatenate([[True], (least[1:] != least[:-1]) | (a[1:] != b[:-1])]))
    last = np.concatenate([begin[1:], [len(a)]]) - 1
    runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (a[begin], b[last], least[begin])], names=["from", "to", "least"])
    first = np.flatnonzero(other)
    bounds = np.concatenate([np.searchsorted(begin, first), [len(begin)]])
    return pa.RecordBatch.from_arrays([pa.array(r1[first]), pa.array(r2[first]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)], names=["c1", "c2", "runs"])


def _by_region(batches: Iterable[pa.RecordBatch], most: int = RUN_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by region, put together in chunks that end with a region."""
    held, n, limit = [], 0, most
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        r1, r2 = table["r1"].to_numpy(), table["r2"].to_numpy()
        end = int(np.argmax((r1 == r1[-1]) & (r2 == r2[-1])))
        if end:
            yield _joined_runs(table.slice(0, end))
        held, n = table.slice(end).to_batches(), n - end
        limit = most + 2 * n
    if n:
        yield _joined_runs(pa.Table.from_batches(held).combine_chunks())


def removed_spans(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Written table: doc_id, key (the hash of a row's text), spans (start, end in bytes; they may overlap)."""
    places = scratch.keep(regions(docs, window))
    texts = scratch.keep(places.where("bytes is not null").groupBy("c1", "c2").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.first("bytes").alias("bytes")))
    found = scratch.keep(fragments(texts, window), "part", PASSES)
    scratch.drop(texts)
    tables = decisions(found, window, scratch)
    scratch.drop(found)
    runs = reduce(DataFrame.unionByName, tables).where("placed").select("r1", "r2", "a", "b", "least")
    judged = scratch.keep(runs.repartition("r1", "r2").sortWithinPartitions("r1", "r2").mapInArrow(_by_region, _JUDGED))
    scratch.drop(*tables)
    hit = places.select("c1", "c2", "doc_id", "key", "pos").join(judged, ["c1", "c2"])
    spans = F.transform(F.filter("runs", lambda r: r["least"] < F.col("doc_id")), lambda r: F.struct((F.col("pos") + r["from"]).alias("a"), (F.col("pos") + r["to"] - 1 + window).alias("b")))
    out = scratch.keep(hit.select("doc_id", "key", spans.alias("s")).where(F.size("s") > 0).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("s")).alias("spans")))
    scratch.drop(places, judged)
    return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept {}"


def merged(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [a, b) of some rows as the maximal runs they cover, in order."""
    order = np.lexsort((a, row))
    base = row[order] << 32
    a, b = base + a[order], np.maximum.accumulate(base + b[order])
    begin = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]) if len(a) else a)
    last = np.concatenate([begin[1:], [len(a)]])[: len(begin)] - 1
    return base[begin] >> 32, a[begin] - base[begin], b[last] - base[begin]


def _kept(batch: pa.RecordBatch, digest: bool) -> pa.RecordBatch:
    total = np.zeros(batch.num_rows, np.int64)
    gone, count, kept = total.copy(), total.copy(), []
    row = a = b = np.zeros(0, np.int64)
    if batch.num_columns > 2:
        spans = batch.column(2)
        items = spans.flatten()
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
        row, a, b = merged(row, items.field("a").to_numpy().astype(np.int64), items.field("b").to_numpy().astype(np.int64))
    for part in slices(batch.column(1)):
        lengths = np.diff(part.offsets)
        data, bounds = part.data, part.offsets
        own = slice(*np.searchsorted(row, [part.first, part.last]))
        if own.start < own.stop:
            doc = row[own] - part.first
            begin, end = np.minimum(a[own], lengths[doc]), np.minimum(b[own], lengths[doc])
            some = begin < end
            doc, begin, end = doc[some], begin[some] + bounds[doc[some]], end[some] + bounds[doc[some]]
            step = np.zeros(len(data) + 1, np.int8)
            step[begin] += 1
            np.add.at(step, end, -1)
            data = data[np.cumsum(step[:-1], dtype=np.int8) == 0]
            np.add.at(gone[part.first : part.last], doc, end - begin)
            count[part.first : part.last] = np.bincount(doc, minlength=len(lengths))
            bounds = np.concatenate([[0], np.cumsum(lengths - gone[part.first : part.last])])
        total[part.first : part.last] = lengths
        raw = memoryview(np.ascontiguousarray(data))
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            kept.append(hashlib.sha256(raw[x:y]).hexdigest() if digest else bytes(raw[x:y]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(gone), pa.array(count), pa.array(kept, pa.string() if digest else pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicate(docs: DataFrame, window: int = 50, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left, or with digest their SHA-256 in hex)."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    removed = removed_spans(docs, window, scratch)
    some, others = split_by_filter(with_key(docs), removed)
    joined = some.join(removed, ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    schema = SCHEMA.format("string" if digest else "binary")
    return map_batches(joined, lambda b: _kept(b, digest), schema).unionByName(map_batches(others.select("doc_id", "text"), lambda b: _kept(b, digest), schema))
