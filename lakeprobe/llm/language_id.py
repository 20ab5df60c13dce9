"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text is built.  A document is
cut greedily into phrases: each the longest run that occurs in the language's
text.  Phrases times log2 of that text's length, over the document's length, estimate
the cross entropy in bits a byte; the language with the least wins.

Texts are compared as lower-cased UTF-8 bytes in which ASCII blanks, digits and
punctuation marks are one symbol each.  Phrases are longest matches over the whole text; that long
texts are parsed in blocks of BLOCK bytes side by side changes no phrase.

The training text is a bounded sample: at most `documents_per_language` documents
of every language, the first of each bucket of a hash, and `bytes_each` bytes of each.
Where all languages would have more than `most_bytes` together, each has an equal share
of them: fewer documents, and fewer bytes of one only when it has a single document left.
The bytes of a longer text are PIECES pieces from hashed places, one in each equal part of it,
so an opening that many texts share is not all that is learned.  Predictions read whole texts.

Defined cases: `und` with score 0 for a null text, one without a letter, or when
there is no training text; equal languages go to the first by name; a byte that a language's text
lacks is a phrase alone; repeated rows come back as often; columns of other names don't get in.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches
from .kernels import slices

BLOCK = 1024
#: Pieces that a document's training bytes are taken in.
PIECES = 4
_BLANK, _DIGIT, _MARK = 0x20, 0x30, 0x2E


def _symbols() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = b if c.isalpha() else _BLANK if c.isspace() or b < 0x20 else _DIGIT if c.isdigit() else _MARK
    return table


SYMBOLS = _symbols()


def suffix_automaton(text: bytes) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of each state (state 0 is the root) and the suffix links, built online."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves, link


class CrossParser:
    """Counts the phrases of many texts in several languages at once.

    One table holds all automata.  An entry is the next state's row, or its bitwise complement where a
    new phrase begins with this byte.  Row 0 of an automaton stands for "no phrase is open": every move from
    it begins one.  It comes before the first byte and after a byte that the language's text lacks, which is a phrase alone.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        used = np.unique(np.frombuffer(b"".join(texts.values()), np.uint8))
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.classes = self.classes[SYMBOLS]
        width = len(used) + 1
        number = {int(b): k + 1 for k, b in enumerate(used)}
        tables, roots, base = [], [], 0
        for name in self.languages:
            moves, _ = suffix_automaton(texts[name])
            table = np.full((len(moves), width), ~(base * width), np.int64)
            for c, to in moves[0].items():
                table[:, number[c]] = ~((base + to) * width)
            for state, out in enumerate(moves[1:], 1):
                for c, to in out.items():
                    table[state, number[c]] = (base + to) * width
            tables.append(table.ravel())
            roots.append(base * width)
            base += len(moves)
        whole = np.concatenate(tables)
        self.table = whole.astype(np.int32 if base * width < 2**31 else np.int64)
        self.shift = self.table.dtype.type(self.table.dtype.itemsize * 8 - 1)
        self.roots = np.array(roots, self.table.dtype)
        self.weights = np.array([np.log2(max(2, len(texts[x]))) for x in self.languages])

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and -1 where a phrase has begun."""
        now = np.take(self.table, state + symbol)
        begun = now >> self.shift
        return now ^ begun, begun

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns): longest matches one after the other over the whole text.

        Blocks of all texts are parsed side by side as if a phrase began with each.  Then the parse that comes in from the block
        before is followed beside the block's own until both are in one state, from where on they are the same;
        what they differ in until then is made good.  Where they don't meet, the block's end changes and the next block follows.
        """
        classes = self.classes[data].astype(self.table.dtype)
        lengths = np.diff(offsets)
        blocks = -(-lengths // BLOCK)
        doc = np.repeat(np.arange(len(lengths)), blocks)
        inside = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[doc] + inside * BLOCK
        size = np.minimum(lengths[doc] - inside * BLOCK, BLOCK)
        out = np.zeros((len(lengths), len(self.languages)), np.int64)
        if not len(start):
            return out
        order = np.argsort(-size, kind="stable")
        begin, sizes = start[order], size[order]
        state = np.repeat(self.roots[:, None], len(begin), 1)
        count = np.zeros((len(self.languages), len(begin)), np.int64)
        # so many blocks still run at each step
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        for t in range(int(sizes[0])):
            n = int(active[t])
            state[:, :n], begun = self._step(state[:, :n], classes[begin[:n] + t])
            count[:, :n] -= begun
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        count, ends = count[:, back], state[:, back]
        self._mend(classes, start, size, inside, count, ends)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(doc, weights=count[k], minlength=len(lengths))
        return out

    def _mend(self, classes: np.ndarray, start: np.ndarray, size: np.ndarray, inside: np.ndarray, count: np.ndarray, ends: np.ndarray) -> None:
        """Corrects the counts and end states of blocks whose text goes on from the block before."""
        own, more = ends.copy(), np.zeros_like(count)
        lang, block = (x.ravel() for x in np.broadcast_arrays(np.arange(len(ends))[:, None], np.flatnonzero(inside > 0)[None, :]))
        while len(block):
            more[lang, block], last = self._entered(classes, start[block], size[block], ends[lang, block - 1], self.roots[lang], own[lang, block])
            changed = last != ends[lang, block]
            ends[lang, block] = last
            lang, block = lang[changed], block[changed] + 1
            on = np.append(inside, 0)[block] > 0
            lang, block = lang[on], block[on]
        count += more

    def _entered(self, classes: np.ndarray, start: np.ndarray, size: np.ndarray, true: np.ndarray, alone: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that blocks entered in the states `true` have more than they have alone, and their end states (`own`: alone)."""
        more, last = np.zeros(len(start), np.int64), own.copy()
        at, t = np.flatnonzero(true != alone), 0
        true, alone, start, size = true[at], alone[at], start[at], size[at]
        while len(at):
            symbol = classes[start + t]
            (true, a), (alone, b) = self._step(true, symbol), self._step(alone, symbol)
            more[at] += b - a
            t += 1
            differ, over = true != alone, size <= t
            last[at[differ & over]] = true[differ & over]
            on = differ & ~over
            if not on.all():
                at, true, alone, start, size = at[on], true[on], alone[on], start[on], size[on]
        return more, last


@lru_cache(maxsize=2)
def _parser(texts: tuple[tuple[str, bytes], ...]) -> CrossParser:
    return CrossParser(dict(texts))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sample_texts(docs: DataFrame, documents_per_language: int = 64, bytes_each: int = 384, most_bytes: int = 64 * 64 * 384) -> tuple[tuple[str, bytes], ...]:
    """Training text of each language; its size depends on the three parameters alone (and is a byte a language at least)."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    share = most_bytes // max(1, labelled.agg(F.count_distinct("lang")).first()[0])
    documents_per_language = max(1, min(documents_per_language, share // bytes_each))
    bytes_each = max(1, min(bytes_each, share))
    place = F.xxhash64("doc_id")
    chosen = labelled.groupBy("lang", F.pmod(place, F.lit(documents_per_language)).alias("bucket")).agg(F.min(F.struct(place.alias("h"), "doc_id")).alias("first")).select("first.doc_id").collect()
    ids = sorted({r[0] for r in chosen})
    pieces = PIECES if bytes_each >= 16 * PIECES else 1
    size = bytes_each // pieces

    def piece(k: int) -> Column:
        start, end = (F.floor(F.length("text") * n / pieces).cast("int") for n in (k, k + 1))
        return F.substring("text", start + 1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), end - start - size + 1)).cast("int"), F.least(F.lit(size), end - start))

    taken = F.when(F.octet_length("text") <= bytes_each, F.array("text")).otherwise(F.array(*map(piece, range(pieces))))
    rows = labelled.where(F.col("doc_id").isin(ids)).select("lang", "doc_id", taken.alias("taken")).collect() if ids else []
    out: dict[str, list[bytes]] = {}
    for lang, _, texts in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        for text in texts:
            raw = text.lower().encode()[: bytes_each if len(texts) == 1 else size]
            out.setdefault(lang, []).append(SYMBOLS[np.frombuffer(raw, np.uint8)].tobytes())
    return tuple((k, b" ".join(v)) for k, v in sorted(out.items()) if len(v) or k)


SCHEMA = "doc_id long, lang_pred string, score double, bits_per_byte double"


def _languages(column: pa.Array, texts: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and bits of each text, and whether it has a letter."""
    n = len(column)
    names, score, bits = np.full(n, "und", object), np.zeros(n), np.zeros(n)
    text = pc.fill_null(column, "")
    letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    if texts:
        parser = _parser(texts)
        for part in slices(pc.utf8_lower(text)):
            size = np.maximum(1, np.diff(part.offsets))
            cost = parser.phrases(part.data, part.offsets) * parser.weights / size[:, None]
            best = cost.argmin(1)
            here = slice(part.first, part.last)
            names[here] = np.array(parser.languages, object)[best]
            bits[here] = cost.min(1)
            if len(parser.languages) > 1:
                two = np.partition(cost, 1, axis=1)[:, :2]
                score[here] = two[:, 1] / np.maximum(two.sum(1), 1e-300)
            else:
                score[here] = 1.0
        names[~letters], score[~letters], bits[~letters] = "und", 0.0, 0.0
    return names, score, bits, letters


def identify(docs: DataFrame, texts: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """doc_id, lang_pred, score (the runner-up's bits over those of both), bits_per_byte of the winner."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, bits, _ = _languages(batch.column(1), texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(bits)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return map_batches(documents(docs), run, SCHEMA)


def keep_identified(docs: DataFrame, texts: tuple[tuple[str, bytes], ...], languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows whose text identify() gives a language (one of `languages`, if named), with that in the column lang, if there is one.

    Where there is no training text, rows whose text has a letter stay as they are.  Other columns stay as they are.
    """
    schema = docs.schema
    at = schema.names.index("text")
    to = schema.names.index("lang") if "lang" in schema.names and schema["lang"].dataType.simpleString() == "string" else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, _, _, letters = _languages(batch.column(at), texts)
        if not texts:
            return batch.filter(pa.array(letters))
        if to is not None:
            columns = list(batch.columns)
            columns[to] = pa.array(names.tolist(), columns[to].type)
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        return batch.filter(pa.array(np.isin(names, languages) if languages is not None else names != "und"))

    return map_batches(docs, run, schema)
