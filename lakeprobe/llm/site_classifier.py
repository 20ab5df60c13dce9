"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document: logistic models of its words, their beginnings and its shape (shares of
symbols, capitals, repeats and the like), one for quality and one for toxicity.
Evidence of its site: the mean of all documents' probabilities by host, and by path
below the host.  A host's mean is shrunk towards the global one and a path's towards
its host's, the more the fewer documents it has; how much is estimated from the
spread between hosts and between paths (the method of moments).  A document's own
share is taken out of its site's evidence before the two are added up as log odds.

The models are fitted on at most `sample_rows` labelled documents, those with the
least hashes of their ids; site evidence covers every document, by grouped sums.

Defined cases: a null text has no words; a null host or path is a site of its own; with
labels of one class only, the model gives that class's share; without labels, one half; of rows that repeat a labelled
doc_id one stands for it in fitting; repeated rows come back as often; very long texts are read whole; columns
named host, path, q or t in the input don't get in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, map_batches
from .kernels import LOWER, first_bytes, mix, slices
from .positional_index import tokens
from .quality_rules import COUNTS, FEATURES, count_slice

#: Word beginnings of so many bytes are features beside whole words.
PREFIXES = (5, 7)
#: Sites that are sent to all executors, and numbers by which documents of one site are dealt where there are more.
MOST_SENT, SALTS = 100_000, 32
_SHAPE = np.uint64(0x5348415045000000)


def features(part) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features (hashes) of each document of a slice, and the document of each."""
    w, h = tokens(part)
    counts = count_slice(part)
    n_docs = part.last - part.first
    shape = [np.floor(2 * np.log2(1 + counts["n_words"])).astype(np.uint64)]
    for a, b in FEATURES.values():
        shape.append(np.minimum(63, np.floor(24 * np.sqrt(counts[a] / np.maximum(1, counts[b])))).astype(np.uint64))
    docs = np.arange(n_docs)
    low = LOWER[part.data]
    heads = []
    for size in PREFIXES:
        long = np.flatnonzero(w.ends - w.starts > size)
        heads.append((mix(first_bytes(low, w.starts[long], w.starts[long] + size) + np.uint64(size)), w.docs[long]))
    h, of = np.concatenate([h, *(x for x, _ in heads)]), np.concatenate([w.docs, *(x for _, x in heads)])
    all_h = np.concatenate([h, *(mix(_SHAPE + np.uint64(64 * k) + s) for k, s in enumerate(shape))])
    all_d = np.concatenate([of, *([docs] * len(shape))])
    order = np.argsort(all_h)
    all_h, all_d = all_h[order], all_d[order]
    order = np.argsort(all_d.astype(np.uint16) if n_docs < 65536 else all_d, kind="stable")
    all_h, all_d = all_h[order], all_d[order]
    new = np.ones(len(all_h), bool)
    new[1:] = (all_h[1:] != all_h[:-1]) | (all_d[1:] != all_d[:-1])
    return all_h[new], all_d[new]


def sample_features(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        for part in slices(batch.column(1)):
            h, d = features(part)
            bounds = np.searchsorted(d, np.arange(part.last - part.first + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0)[part.first : part.last], pa.array([h[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], names=["doc_id", "features"])

    return map_batches(documents(docs), run, "doc_id long, features binary")


class Model:
    """Log odds of the positive class: a bias and a weight for each of the features that tell the classes apart."""

    def __init__(self, bias: float, keys: np.ndarray, weights: np.ndarray):
        self.bias, self.keys, self.weights = bias, keys, weights

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, least_gain: float = 12.0, least_documents: int = 4, steps: int = 500, decay: float = 1e-4) -> Model:
        none = np.zeros(0, np.uint64)
        if not len(y):
            return cls(0.0, none, np.zeros(0))
        share = (y.sum() + 1) / (len(y) + 2)
        bias = float(np.log(share / (1 - share)))
        if y.all() or not y.any():
            return cls(bias, none, np.zeros(0))
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        keys, index = np.unique(np.concatenate(rows), return_inverse=True)
        doc = np.repeat(np.arange(len(rows)), sizes)
        n = np.bincount(index, minlength=len(keys)).astype(float)
        p = np.bincount(index, weights=y[doc], minlength=len(keys))
        total, pos = len(y), y.sum()

        def part(x, e):
            return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0)

        gain = 2 * (part(p, n * pos / total) + part(n - p, n * (total - pos) / total) + part(pos - p, (total - n) * pos / total) + part(total - n - pos + p, (total - n) * (total - pos) / total))
        chosen = np.flatnonzero((gain >= least_gain) & (n >= least_documents))
        if not len(chosen):
            return cls(bias, none, np.zeros(0))
        place = np.full(len(keys), -1)
        place[chosen] = np.arange(len(chosen))
        at = place[index]
        doc, at = doc[at >= 0], at[at >= 0]
        w, b, speed = np.zeros(len(chosen)), bias, np.full(len(chosen) + 1, 1e-6)
        for _ in range(steps):
            z = b + np.bincount(doc, weights=w[at], minlength=total)
            r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g = np.append(np.bincount(at, weights=r[doc], minlength=len(chosen)) / total + decay * w, r.mean())
            speed += g * g
            step = 0.3 * g / np.sqrt(speed)
            w, b = w - step[:-1], b - step[-1]
        return cls(float(b), keys[chosen], w)

    def log_odds(self, h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        if not len(self.keys):
            return np.full(n_docs, self.bias)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        same = self.keys[at] == h
        return self.bias + np.bincount(doc[same], weights=self.weights[at[same]], minlength=n_docs)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> tuple[Model, Model]:
    """(quality, toxicity)"""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).where("doc_id is not null")
    chosen = [tuple(r) for r in wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "q", "t").limit(sample_rows).collect()]
    here = F.broadcast(docs.sparkSession.createDataFrame([(r[0],) for r in chosen], "doc_id long").distinct())
    rows = sample_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(here, "doc_id", "left_semi")).groupBy("doc_id").agg(F.min("features").alias("features")).collect()
    by_id = {r[0]: np.frombuffer(r[1], np.uint64) for r in rows}
    out = []
    for k in (1, 2):
        have = [r for r in chosen if r[0] in by_id and r[k] is not None]
        out.append(Model.fit([by_id[r[0]] for r in have], np.array([float(r[k] == 1) for r in have])))
    return out[0], out[1]


def evidence(docs: DataFrame, models: tuple[Model, Model], host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, q and t: the document's own log odds of good quality and of toxicity."""
    own = documents(docs, F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch):
        for part in slices(batch.column(1)):
            h, d = features(part)
            odds = [pa.array(m.log_odds(h, d, part.last - part.first)) for m in shared.value]
            here = slice(part.first, part.last)
            yield pa.RecordBatch.from_arrays([batch.column(0)[here], batch.column(2)[here], batch.column(3)[here], *odds], names=["doc_id", "host", "path", "q", "t"])

    return map_batches(own, run, "doc_id long, host string, path string, q double, t double")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(mean: float, spread: float | None) -> float:
    """Documents that the prior counts for, from the variance between sites beyond what their sizes explain."""
    if not spread or spread <= 0:
        return 10_000.0
    return float(min(10_000.0, max(2.0, mean * (1 - mean) / spread - 1)))


def _spread(groups: DataFrame, mean: Column, name: str) -> Column:
    """Variance between groups of `name`'s mean around `mean`, weighted by size, less the expected sampling variance."""
    m = F.col(f"s{name}") / F.col("n")
    return (F.sum(F.col("n") * (m - mean) * (m - mean) - m * (1 - m)) / F.sum("n")).alias(name)


def posteriors(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Written table host, path, n, sq, st, hq, ht (the host's posterior means); and for q and t (global mean, prior strength of a path)."""
    p = {k: 1 / (1 + F.exp(-F.col(k))) for k in ("q", "t")}
    paths = scratch.keep(found.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p["q"]).alias("sq"), F.sum(p["t"]).alias("st")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum("st").alias("st"))
    n, sq, st = hosts.agg(F.sum("n"), F.sum("sq"), F.sum("st")).first()
    mean = {"q": (sq or 0) / (n or 1), "t": (st or 0) / (n or 1)}
    between = hosts.agg(*(_spread(hosts, F.lit(mean[k]), k) for k in ("q", "t"))).first()
    strength = {k: _strength(mean[k], between[k]) for k in ("q", "t")}
    shrunk = hosts.select("host", *(((F.col(f"s{k}") + strength[k] * mean[k]) / (F.col("n") + strength[k])).alias(f"h{k}") for k in ("q", "t")))
    out = scratch.keep(paths.join(shrunk, "host"))
    inside = out.agg(*(_spread(out, F.col(f"h{k}"), k) for k in ("q", "t"))).first()
    return out, {k: (mean[k], _strength(mean[k], inside[k])) for k in ("q", "t")}


def _with_sites(found: DataFrame, sites: DataFrame) -> DataFrame:
    """The documents with their site's sums: sites are sent to all executors if they are few, else both sides are dealt by site and one of SALTS numbers."""
    if sites.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return found.join(F.broadcast(sites), ["host", "path"])
    salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "q", "t"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"]).drop("salt")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample_rows: int = 6000) -> DataFrame:
    """doc_id, p_quality, p_toxic, site_quality (its path's shrunk mean without itself), kept (good and not toxic).

    host and path default to the columns source and lang.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    scratch = Scratch(docs.sparkSession, "sites")
    found = scratch.keep(evidence(docs, fit(docs, labels, sample_rows), host, path))
    sites, prior = posteriors(found, scratch)
    joined = _with_sites(found, sites)
    site, odds = {}, {}
    for k in ("q", "t"):
        mean, strength = prior[k]
        own = 1 / (1 + F.exp(-F.col(k)))
        site[k] = (F.col(f"s{k}") - own + F.lit(strength) * F.col(f"h{k}")) / (F.col("n") - 1 + F.lit(strength))
        odds[k] = F.col(k) + _logit(site[k]) - _logit(F.lit(float(mean)))
    good, toxic = (1 / (1 + F.exp(-odds[k])) for k in ("q", "t"))
    return joined.select("doc_id", good.alias("p_quality"), toxic.alias("p_toxic"), site["q"].alias("site_quality"), ((good >= 0.5) & (toxic < 0.5)).alias("kept"))
