"""Secret scan by a trigram inverted index.

Each rule's regular expression gives a Boolean query over the trigrams every
match must contain.  Documents are indexed shard by shard (a shard is a run of
documents inside one partition): trigram -> documents.  A query's postings are
intersected and united, and only documents that are left are verified with the
expression itself.  A rule without a mandatory trigram scans every document.

Defined cases: a null text is an empty one; a rule with several groups may name
one whose length counts; extra input columns don't get in; repeated rows give
repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_batches
from .kernels import LOWER, Slice, distinct, slices

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # Python 3.10
    import sre_constants as sre
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and don't overlap; those whose `group` is shorter than `least` are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


#: The three base rules, in the order that breaks ties, then further well-known token formats.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, True),
    Rule("hex", r"[0-9a-f]{16,}", 16, 0, True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("login", r"://[^\s/:@]{1,256}:[^\s/@]{1,256}@"),
)

#: A query is True (no condition), a trigram's number, or ("and" | "or", queries).
Query = bool | int | tuple
_MOST_STRINGS = 64


def trigram(text: bytes) -> int:
    return text[0] << 16 | text[1] << 8 | text[2]


def _all(queries: Iterable[Query]) -> Query:
    left = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not left else left[0] if len(left) == 1 else ("and", tuple(left))


def _any(queries: Iterable[Query]) -> Query:
    left = list(dict.fromkeys(queries))
    return True if True in left or not left else left[0] if len(left) == 1 else ("or", tuple(left))


def _of_strings(strings: set[str]) -> Query:
    """What a text must contain if it contains one of the strings."""
    return _any(_all(trigram(b[i : i + 3]) for i in range(len(b) - 2)) for b in (s.encode() for s in sorted(strings)))


def _fold(code: int) -> str:
    return chr(code + 32 if 0x41 <= code <= 0x5A else code)


def _class_strings(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(_fold(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {_fold(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _derive(nodes: Iterable) -> tuple[set[str] | None, Query]:
    """Strings that the nodes match exactly (None: unknown or too many), and the query of what they match."""
    exact: set[str] | None = {""}
    run: set[str] = {""}
    parts: list[Query] = []

    def end_run() -> None:
        nonlocal run, exact
        parts.append(_of_strings(run))
        run, exact = {""}, None

    for op, arg in nodes:
        strings: set[str] | None = None
        query: Query = True
        if op is sre.LITERAL:
            strings = {_fold(arg)}
        elif op is sre.IN:
            strings = _class_strings(arg)
        elif op is sre.SUBPATTERN:
            strings, query = _derive(arg[-1])
        elif op is sre.BRANCH:
            found = [_derive(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
            query = _any(q for _, q in found)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, item = arg
            once, inner = _derive(item)
            if low == 0 and high == 1 and once is not None:
                strings = once | {""}
            elif low == high == 1:
                strings, query = once, inner
            elif low >= 1:
                query = inner if once is None else _of_strings(once)
        elif op is sre.AT:
            strings = {""}
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        end_run()
        if strings is not None:
            run = strings
        else:
            parts.append(query)
    whole = run if exact is not None else None
    parts.append(_of_strings(run))
    return whole, _all(parts)


def trigram_query(pattern: str) -> Query:
    """Boolean query over trigrams of the text with A-Z lower-cased."""
    return _derive(parser.parse(pattern))[1]


def _mentioned(query: Query) -> set[int]:
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(_mentioned, query[1]))


class ShardIndex:
    """trigram -> increasing document numbers, of the documents of one slice.

    Postings are kept for the trigrams in `wanted` (a table over all 2**24), or for all.
    """

    def __init__(self, part: Slice, wanted: np.ndarray | None = None):
        low = LOWER[part.data].astype(np.int32)
        n = len(low)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if n > 2 else np.zeros(0, np.int32)
        at = np.flatnonzero(wanted[codes]) if wanted is not None else np.arange(len(codes))
        doc = np.searchsorted(part.offsets, at, side="right") - 1
        fits = at + 3 <= part.offsets[doc + 1] if len(at) else np.zeros(0, bool)
        pairs = distinct(codes[at[fits]].astype(np.int64) << 32 | doc[fits])
        self.documents = part.last - part.first
        self._codes, self._docs = pairs >> 32, pairs & 0xFFFFFFFF

    def postings(self, code: int) -> np.ndarray:
        a, b = np.searchsorted(self._codes, [code, code + 1])
        return self._docs[a:b]

    def answer(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.documents)
        if isinstance(query, int):
            return self.postings(query)
        kind, parts = query
        found = sorted((self.answer(q) for q in parts), key=len)
        out = found[0]
        for x in found[1:]:
            if kind == "and" and not len(out):
                break
            out = np.intersect1d(out, x, assume_unique=True) if kind == "and" else np.union1d(out, x)
        return out


def scanner(rules: tuple[Rule, ...] = RULES) -> Callable[[pa.Array], list[list[tuple[int, int, int]]]]:
    """Function from a column of texts to each text's spans (start, rule's number, end), in order."""
    queries = [trigram_query(r.pattern) for r in rules]
    state: dict = {}

    def scan(column: pa.Array) -> list[list[tuple[int, int, int]]]:
        if not state:
            state["wanted"] = np.zeros(1 << 24, bool)
            state["wanted"][sorted(set().union(*map(_mentioned, queries)))] = True
            state["compiled"] = [re.compile(r.pattern) for r in rules]
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        for part in slices(column):
            index = ShardIndex(part, state["wanted"])
            texts: dict[int, str] = {}
            for k, (rule, query, expression) in enumerate(zip(rules, queries, state["compiled"], strict=True)):
                for d in index.answer(query).tolist():
                    text = texts.get(d)
                    if text is None:
                        text = texts[d] = part.bytes_of(d).decode()
                    for m in expression.finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[part.first + d].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found

    return scan


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the spans found in its text (code points, end exclusive) by start, then by the order of rules."""
    scan = scanner(rules)
    kinds = [r.kind for r in rules]
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in s] for s in scan(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind_of)], names=["doc_id", "spans"])

    return map_batches(documents(docs), run, SCHEMA)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, with each span's text (overlapping ones together) replaced by `mark`; n_chars, if there, follows."""
    from pyspark.sql import functions as F

    scan = scanner(rules)
    schema = docs.schema
    at = schema.names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(at)
        out = column.to_pylist()
        for k, spans in enumerate(scan(column)):
            if spans:
                text, parts, done, last = out[k], [], 0, -1
                for a, _, b in spans:
                    if a >= last:
                        parts += [text[done:a], mark]
                    done = last = max(last, b)
                out[k] = "".join([*parts, text[done:]])
        columns = list(batch.columns)
        columns[at] = pa.array(out, column.type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    done = map_batches(docs, run, schema)
    return done.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else done
