"""Quality rules: a decision list learned by sequential covering.

Statistics of each whole text are computed once; words and lines are compared byte by byte.  On labelled rows rules are
grown one after the other: thresholds are added to a conjunction while they raise
its information gain, its last conditions are pruned while that does not lower its worth
on rows kept aside, and the rows it covers leave.  A rule says "keep" or "drop", whichever is surer, so
their order matters.  The list becomes one ordered conditional expression of Spark columns.

Fitting takes a bounded sample: at most `sample_rows` labelled rows, those
with the least hashes of their ids.  Applying covers every row.

Defined cases: a null text has no words; without labels, or with one class
only, the list is empty and keeps everything; a null label counts as none, as does one without a
document; a document that several labels name counts once for each; repeated rows come back as often; very long texts are
read whole; other columns don't get in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches
from .kernels import BLANK_SEPARATED, byte_class, distinct, fitting, slices, word_codes, words

SYMBOL = byte_class(inside=b"#*$%&|<>")
#: Fixed values of the base rule.
LEAST_WORDS, MOST_REPEATED = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bare_words", "n_distinct_words")
#: Features of the rules, from the counts.
FEATURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "bare_word_share": ("n_bare_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
}


def _line_table(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line starts, ends and the first line of each document."""
    n = len(part.data)
    breaks = np.flatnonzero(part.data == 0x0A)
    filled = np.diff(part.offsets) > 0
    starts = np.unique(np.concatenate([part.offsets[:-1][filled], breaks + 1]))
    starts = starts[starts < n]
    ends = np.concatenate([starts[1:], [n]]) if len(starts) else starts
    # a line ends before its break
    ends = ends - ((ends > starts) & (part.data[ends - 1] == 0x0A)) if len(starts) else ends
    return starts, ends, np.searchsorted(starts, part.offsets)


def count_slice(part) -> dict[str, np.ndarray]:
    """The COUNTS of each document of a slice."""
    docs = part.last - part.first
    out = {k: np.zeros(docs, np.int64) for k in COUNTS}
    n = len(part.data)
    if not n:
        return out
    w = words(part)
    out["n_words"] = w.counts

    filled = np.flatnonzero(np.diff(part.offsets) > 0)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(docs, np.int64)
        sums[filled] = np.add.reduceat(flags, part.offsets[filled], dtype=np.int64)
        return sums

    out["word_chars"] = total(BLANK_SEPARATED[part.data] & ((part.data & 0xC0) != 0x80))
    out["n_symbols"] = total(SYMBOL[part.data])
    upper = (part.data >= 0x41) & (part.data <= 0x5A)
    letter = upper | ((part.data >= 0x61) & (part.data <= 0x7A)) | (part.data >= 0xC0)
    out["n_upper"], out["n_letters"] = total(upper), total(letter)
    alpha = np.concatenate([[0], np.cumsum(letter | ((part.data >= 0x30) & (part.data <= 0x39)), dtype=np.int32)])
    bare = alpha[w.ends] == alpha[w.starts]
    sums = np.concatenate([[0], np.cumsum(bare)])
    out["n_bare_words"] = sums[w.bounds[1:]] - sums[w.bounds[:-1]]

    doc = w.docs
    if len(doc):
        code, lead = word_codes(part.data, w.starts, w.ends)
        kinds = len(lead)
        out["n_distinct_words"] = np.bincount(distinct(doc * kinds + code) // kinds, minlength=docs)
        ok = np.flatnonzero(fitting(w.bounds, 3, max(0, len(code) - 2)))
        if len(ok):
            three = _numbered(_numbered(code[:-1] * kinds + code[1:])[ok] * kinds + code[ok + 2])
            order = np.argsort(three * docs + doc[ok])
            same = np.zeros(len(ok), bool)
            same[1:] = (three[order[1:]] == three[order[:-1]]) & (doc[ok[order[1:]]] == doc[ok[order[:-1]]])
            same[:-1] |= same[1:].copy()
            repeated = ok[order[same]]
            mark = np.zeros(len(code) + 3, bool)
            for k in range(3):
                mark[repeated + k] = True
            sums = np.concatenate([[0], np.cumsum(mark[: len(code)])])
            out["n_repeat_words"] = sums[w.bounds[1:]] - sums[w.bounds[:-1]]
        starts, ends, _ = _line_table(part)
        line_words = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
        with_word = np.flatnonzero(line_words > 0)
        of = np.searchsorted(part.offsets, starts[with_word], side="right") - 1
        out["n_lines"] = np.bincount(of, minlength=docs)
        line, lead = word_codes(part.data, starts[with_word], ends[with_word])
        out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct(of * len(lead) + line) // max(1, len(lead)), minlength=docs)
    return out


def _numbered(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal where x is, so that they can be put together further without overflow."""
    return np.unique(x, return_inverse=True)[1]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS of its whole text."""

    def run(batch: pa.RecordBatch):
        for part in slices(batch.column(1)):
            found = count_slice(part)
            yield pa.RecordBatch.from_arrays([batch.column(0)[part.first : part.last], *(pa.array(found[k].astype(np.int64)) for k in COUNTS)], names=["doc_id", *COUNTS])

    return map_batches(documents(docs), run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def feature_columns() -> dict[str, Column]:
    return {k: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)) for k, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, ">" or "<=", threshold), all of which must hold; `keep` is what it says of the rows it covers."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int
    keep: bool = False

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, op, t in self.conditions:
            v = x[:, names.index(name)]
            out &= v > t if op == ">" else v <= t
        return out

    def column(self, features: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, t in self.conditions:
            out = out & ((features[name] > F.lit(t)) if op == ">" else (features[name] <= F.lit(t)))
        return out


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        out = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, out, -np.inf)


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str]):
    p0, n0 = float(y.sum()), float((~y).sum())
    best = (1e-9, None)
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, pos = x[order, j], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p_low, total = pos[cut].astype(float), cut + 1.0
        for op, p, n in (("<=", p_low, total - p_low), (">", p0 - p_low, n0 - (total - p_low))):
            gain = _gain(p0, n0, p, n)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (name, op, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    return best[1]


def _grown(x: np.ndarray, y: np.ndarray, aside: np.ndarray, names: list[str], most_conditions: int) -> tuple[tuple, int, int]:
    """Conditions grown for the rows of y and pruned on those kept aside; how many of y and of others they cover there."""
    gx, gy, conditions = x[~aside], y[~aside], []
    while len(conditions) < most_conditions and gy.any() and (~gy).any():
        found = _best_condition(gx, gy, names)
        if found is None:
            break
        conditions.append(found)
        hold = Rule((found,), 0, 0).holds(gx, names)
        gx, gy = gx[hold], gy[hold]
    px, py, best = x[aside], y[aside], (-2.0, (), 0, 0)
    for k in range(1, len(conditions) + 1):
        hold = Rule(tuple(conditions[:k]), 0, 0).holds(px, names)
        p, n = int((hold & py).sum()), int((hold & ~py).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, tuple(conditions[:k]), p, n)
    return best[1:]


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], most_rules: int = 12, most_conditions: int = 3, least_precision: float = 0.7, least_covered: int = 12, seed: int = 7) -> list[Rule]:
    """A decision list: the first rule that holds decides, and rules for either class may follow each other.

    Each time a rule for the bad rows and one for the good ones are grown.  The one with the greater gain over its
    class's share, weighted by what it covers of the rows kept aside, is taken if it is right there
    at least `least_precision` of the time; the rows it covers leave.  If most of the rows that are left are bad, a
    last rule without conditions says so; else what no rule covers is kept.
    """
    rng = np.random.default_rng(seed)
    x, bad, rules = np.asarray(x, float), np.asarray(bad, bool), []
    while len(rules) < most_rules and bad.any() and (~bad).any():
        aside = np.zeros(len(x), bool)
        for of in (bad, ~bad):
            k = np.flatnonzero(of)
            aside[rng.permutation(k)[: len(k) // 3]] = True
        best = (1e-9, None)
        for keep, y in ((False, bad), (True, ~bad)):
            conditions, p, n = _grown(x, y, aside, names, most_conditions) if y.sum() >= least_covered else ((), 0, 0)
            if not conditions or p + n == 0 or p / (p + n) < least_precision:
                continue
            hold = Rule(conditions, 0, 0).holds(x, names)
            gain = (p + n) / aside.sum() * (p / (p + n) - y[aside].mean())
            if hold.sum() >= least_covered and gain > best[0] + 1e-9:
                best = (gain, Rule(conditions, float(y[hold].mean()), int(hold.sum()), keep))
        if best[1] is None:
            break
        rules.append(best[1])
        hold = best[1].holds(x, names)
        x, bad = x[~hold], bad[~hold]
    if len(bad) >= least_covered and bad.mean() >= least_precision:
        rules.append(Rule((), float(bad.mean()), len(bad)))
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, **limits) -> list[Rule]:
    """labels: doc_id, quality (0 is bad).  At most `sample_rows` labels, and as many documents, are looked at."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    chosen = F.broadcast(wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows))
    features = feature_columns()
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id", "left_semi")
    found = statistics(here).join(chosen, "doc_id").where(~base_failed()).select("doc_id", "quality", *(c.alias(k) for k, c in features.items()))
    rows = found.orderBy(F.xxhash64("doc_id"), *found.columns).limit(sample_rows).collect()
    if not rows:
        return []
    return learn(np.array([r[2:] for r in rows], float), np.array([r[1] == 0 for r in rows]), list(features), **limits)


def verdict(rules: list[Rule]) -> Column:
    """What the first rule that holds says; rows that none covers are kept: the ordered conditional expression."""
    features = feature_columns()
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(features), rules[0].keep)
    for rule in rules[1:]:
        out = out.when(rule.column(features), rule.keep)
    return out.otherwise(True)


def fired(rules: list[Rule]) -> Column:
    """Number of the rule that decided, from 1; 0 if none."""
    features = feature_columns()
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(features), k).otherwise(out)
    return out


def apply(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """doc_id, the COUNTS, base_failed, rule (the one that decided, 0 if none) and kept of every document."""
    rules = fit(docs, labels, **limits)
    return statistics(docs).select("*", base_failed().alias("base_failed"), fired(rules).alias("rule"), (~base_failed() & verdict(rules)).alias("kept"))
