"""Concatenate and cut: documents into sequences of a fixed number of tokens.

Pass one tokenizes each document once, writes its ids to the shared folder and
counts the ids before it in its partition.  The totals of the partitions, summed up
on the driver (one number a partition), give every document its place in the
one stream of all ids.  Pass two cuts the stream at fixed windows and writes a record for each
piece of a document in a window.  The ids after the last full window go to
windows whose lengths are the powers of two of their number, so none is padded.

Tokens of a text are those of its words between ASCII blanks, one after the other: the
vocabulary's normalizer and splitter never look across a blank.  Each distinct word
is so encoded once a worker; remembered words are compared byte by byte.

Defined cases: a null or empty text has its end id alone; a null doc_id is packed like others; repeated rows
are packed as often as they occur; very long texts are cut like others; other columns don't get in;
an empty table has no pieces.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents
from .kernels import Slice, gathered, loads, same_bytes, slices, word_hashes, words

#: Words, and bytes of them, that a worker remembers; beyond that it starts anew.
MEMO_WORDS, MEMO_BYTES = 1_000_000, 32 << 20


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        """Known words: their hashes in order and places; by place their bytes in `raw` and their ids."""
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw, self.at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, self.dtype)
        self.loads = loads(self.raw)

    def _learn(self, part: Slice, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """keys: sorted, none of them known."""
        raw, bounds = gathered(part.data, starts, ends)
        texts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)).to_pylist()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        place = np.arange(len(found)) + len(self.first) - 1
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), self.dtype, int(counts.sum()))])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.at = np.concatenate([self.at, self.at[-1] + bounds[1:]])
        self.raw = np.concatenate([self.raw, raw])
        self.loads = loads(self.raw)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, place)

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice and each document's first (one more than documents)."""
        w = words(part)
        if not len(w.starts):
            return np.zeros(0, self.dtype), np.zeros(len(w.bounds), np.int64)
        once, back = np.unique(word_hashes(part, w), return_inverse=True)
        index = np.zeros(len(once), np.int64)
        index[back] = np.arange(len(back))
        if len(self.keys) > MEMO_WORDS or len(self.raw) > MEMO_BYTES:
            self._clear()
        at = np.searchsorted(self.keys, once)
        new = np.ones(len(once), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != once[inside]
        if new.any():
            k = index[new]
            self._learn(part, w.starts[k], w.ends[k], once[new])
            at = np.searchsorted(self.keys, once)
        place = self.place[at][back]
        lengths = w.ends - w.starts
        if (self.at[place + 1] - self.at[place] != lengths).any() or not same_bytes(loads(part.data), w.starts, self.loads, self.at[place], lengths):  # two words with one hash: encode the texts as they are
            found = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast([part.bytes_of(d).decode() for d in range(part.last - part.first)], add_special_tokens=False)]
            return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        counts = self.first[place + 1] - self.first[place]
        total = np.concatenate([[0], np.cumsum(counts)])
        flat = np.arange(total[-1]) + np.repeat(self.first[place] - total[:-1], counts)
        return self.ids[flat], total[w.bounds]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Written table: doc_id, part, before (ids before it in its part), n_ids, ids (little-endian, of 2 bytes or 4), wide."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches):
        part_id, before = TaskContext.get().partitionId(), 0
        encoder = _encoder(SparkFiles.get(name))
        for batch in batches:
            for part in slices(batch.column(1)):
                ids, bounds = encoder.encode(part)
                n = part.last - part.first
                ids = np.insert(ids, bounds[1:], np.array(end_id, encoder.dtype))
                bounds = bounds + np.arange(n + 1)
                size = encoder.dtype().itemsize
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((bounds * size).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                columns = [batch.column(0)[part.first : part.last], pa.array(np.full(n, part_id, np.int32)), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), blob, pa.array(np.full(n, size == 4))]
                before += int(bounds[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "before", "n_ids", "ids", "wide"])

    return scratch.keep(documents(docs).mapInArrow(run, "doc_id long, part int, before long, n_ids long, ids binary, wide boolean"))


def cuts(total: int, window: int) -> list[int]:
    """Ends of the windows after the last full one: the remaining ids by powers of two, the largest first."""
    at, rest, out = total - total % window, total % window, []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        at, rest = at + size, rest - size
        out.append(at)
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """A row for each piece: its document, place there, place in a sequence, checksum, and (with_ids) the ids."""
    spark = docs.sparkSession
    table = tokenized(docs, tokenizer, end_id)
    totals = table.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n")).collect()
    base, total = {}, 0
    for part, n in sorted(map(tuple, totals)):
        base[part] = total
        total += n
    full = total // window
    ends = cuts(total, window)
    shared = spark.sparkContext.broadcast(base)

    def run(batches):
        bounds = np.array([full * window, *ends], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, blobs = [], []
            for doc, part, before, n, raw, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, np.uint32 if wide else np.uint16).astype("<u4")
                at = shared.value[part] + before
                done = 0
                while done < n:
                    here = at + done
                    if here < bounds[0]:
                        sequence, offset = divmod(here, window)
                        size = window - offset
                    else:
                        k = int(np.searchsorted(bounds, here, side="right"))
                        sequence, offset, size = full + k - 1, here - int(bounds[k - 1]), int(bounds[k]) - here
                    size = min(size, n - done)
                    piece = ids[done : done + size]
                    rows.append((doc, done, size, zlib.crc32(piece.tobytes()), n, sequence, offset))
                    blobs.append(piece.astype(np.int32) if with_ids else None)
                    done += size
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.list_(pa.int32()))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return table.mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids in order; a sequence has at most as many pieces as ids, so a group is bounded by the window."""
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
