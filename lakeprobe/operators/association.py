"""Association of columns: each statistic is one small aggregate; probabilities are added on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import finite
from ..functions.tails import chi2_tail, f_tail, pearson_p, t_tail_both

# What an association needs to be computed or reported.
LEAST_PAIRS = 20
LEAST_EXPECTED = 5
MOST_CATEGORIES = 50
LEAST_GROUP = 20
STRONG_CORRELATION = 0.8
#: Columns up to which all pairs go into one aggregate; wider tables use sums of products.
PAIRS_IN_ONE_AGGREGATE = 12


class Effect(NamedTuple):
    kind: str
    effect: float
    p: float


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of the rows that have both; null if either does not vary there."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))  # the deviation of equal values need not come out as exactly 0
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlation_matrix(df: DataFrame, columns: Sequence[str], least: int = LEAST_PAIRS) -> list[tuple[str, str, int, float | None]]:
    """(a, b, rows with both, r) of every pair in order; r is None below `least` rows or without variation."""
    if len(columns) < 2:
        return []
    if len(columns) > PAIRS_IN_ONE_AGGREGATE:
        return _by_products(df, columns, least)
    values = df.select(*(finite(F.col(c)).alias(c) for c in columns))
    pairs = list(combinations(columns, 2))
    row = values.agg(*(F.struct(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), correlation(F.col(a), F.col(b)).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).first()
    return [(a, b, row[i]["n"], _bounded(row[i]["r"]) if row[i]["n"] >= least else None) for i, (a, b) in enumerate(pairs)]


def _bounded(r: float | None) -> float | None:
    return None if r is None or not math.isfinite(r) else max(-1.0, min(1.0, r))


def _by_products(df: DataFrame, columns: Sequence[str], least: int) -> list[tuple[str, str, int, float | None]]:
    """All pairs from sums of products of centred values: one matrix a task, added up by one row each."""
    k = len(columns)
    values = df.select(*(finite(F.col(c)).alias(c) for c in columns))
    means = [m if m is not None else 0.0 for m in values.agg(*(F.avg(c) for c in columns)).first()]

    def gather(batches):
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - means
            here = ~np.isnan(x)
            x = np.where(here, x, 0.0)
            m = here.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = values.mapInArrow(gather, "sums binary").collect()
    n, s, q, xy = sum(np.frombuffer(r[0]).reshape(4, k, k) for r in parts)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = xy - s * s.T / n
        var = q - s * s / n
        r = cov / np.sqrt(var * var.T)
    r[(var <= 1e-12 * np.maximum(q, 1e-300)) | (var.T <= 1e-12 * np.maximum(q.T, 1e-300))] = np.nan
    return [(columns[i], columns[j], int(n[i, j]), _bounded(float(r[i, j])) if n[i, j] >= least else None) for i in range(k) for j in range(i + 1, k)]


def pearson(df: DataFrame, a: Column, b: Column) -> Effect | None:
    row = df.select(a.alias("a"), b.alias("b")).agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n"), correlation(F.col("a"), F.col("b")).alias("r")).first()
    r = _bounded(row["r"])
    if row["n"] < LEAST_PAIRS or r is None:
        return None
    return Effect("pearson", r, pearson_p(r, row["n"]))


def eta_table(df: DataFrame, value: Column, group: Column) -> DataFrame:
    """k groups of two or more values, n values, eta2, f: one row; eta2 and f are null where undefined."""
    groups = df.select(value.alias("v"), group.alias("g")).where("v is not null and g is not null").groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("w"), F.min("v").alias("low"), F.max("v").alias("high")).where("n >= 2")
    sums = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("w").alias("within"), (F.min("low") < F.max("high")).alias("varies"), F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("grand"))
    between = groups.crossJoin(sums.select("grand")).agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("between"))
    both = sums.crossJoin(between)
    usable = (F.col("k") >= 2) & F.col("varies")
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    return both.select("k", F.coalesce("n", F.lit(0)).alias("n"), F.when(usable, F.try_divide(F.col("between"), F.col("between") + F.col("within"))).alias("eta2"), F.when(usable, f).alias("f"))


def eta(df: DataFrame, value: Column, group: Column) -> Effect | None:
    """The correlation ratio (the root of eta squared) and the probability of its F."""
    row = eta_table(df, value, group).first()
    if row["eta2"] is None:
        return None
    d1, d2 = row["k"] - 1, row["n"] - row["k"]
    p = 0.0 if row["f"] is None else f_tail(row["f"], d1, d2) if d2 > 0 else 1.0
    return Effect("eta_squared", math.sqrt(max(0.0, row["eta2"])), p)


def contingency(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """x, y, n, expected for every pair of values, also those that never meet."""
    cells = df.select(a.alias("x"), b.alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
    # margins of columns that are known to have few values
    grid = rows.crossJoin(cols).crossJoin(cells.agg(F.sum("n").alias("total")))
    return grid.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"), (F.col("nx") * F.col("ny") / F.col("total")).alias("expected"))


def cramers_table(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """rows, cols, n, chi2, least_expected: one row.

    Only pairs of values that meet have a row; those that never do add what is expected of them, which is
    the total less what is expected of the others.
    """
    cells = df.select(a.alias("x"), b.alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
    sides = rows.agg(F.count("*").alias("rows"), F.min("nx").alias("ax"), F.coalesce(F.sum("nx"), F.lit(0)).alias("total")).crossJoin(cols.agg(F.count("*").alias("cols"), F.min("ny").alias("ay")))  # one row each
    met = cells.join(rows, "x").join(cols, "y").crossJoin(F.broadcast(sides))
    expected = F.col("nx") * F.col("ny") / F.col("total")
    sums = met.agg(F.sum((F.col("n") - expected) * (F.col("n") - expected) / expected).alias("differ"), F.sum(expected).alias("met"))
    return sides.crossJoin(sums).select("rows", "cols", F.col("total").alias("n"), (F.col("differ") + F.greatest(F.lit(0.0), F.col("total") - F.col("met"))).alias("chi2"), (F.col("ax") * F.col("ay") / F.col("total")).alias("least_expected"))


def cramers_v(df: DataFrame, a: Column, b: Column) -> Effect | None:
    row = cramers_table(df, a, b).first()
    if row["rows"] < 2 or row["cols"] < 2 or row["least_expected"] < LEAST_EXPECTED:
        return None
    small = min(row["rows"], row["cols"]) - 1
    return Effect("cramers_v", math.sqrt(row["chi2"] / (row["n"] * small)), chi2_tail(row["chi2"], (row["rows"] - 1) * (row["cols"] - 1)))


def welch_table(df: DataFrame, indicators: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """For each indicator and value: counts, means and variances of the values where the indicator holds (1) and not (0); a row for each pair."""
    parts = []
    for j, flag in indicators.items():
        for c, v in values.items():
            one = []
            for side, test in (("1", flag), ("0", ~flag)):
                x = F.when(test, v)
                one += [F.count(x).alias(f"n{side}"), F.avg(x).alias(f"m{side}"), F.when(F.min(x) < F.max(x), F.var_samp(x)).otherwise(0.0).alias(f"v{side}")]
            parts.append(F.struct(F.lit(j).alias("indicator"), F.lit(c).alias("value"), *one))
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def welch(row) -> tuple[str | None, Effect | None]:
    """(reason why not, effect): Cohen's d with the pooled deviation and Welch's probability."""
    n1, n0 = row["n1"], row["n0"]
    if n1 < LEAST_GROUP or n0 < LEAST_GROUP:
        return "small_group", None
    e1, e0 = row["v1"] / n1, row["v0"] / n0
    if not e1 + e0 > 0:
        return "no_variation", None
    t = (row["m1"] - row["m0"]) / math.sqrt(e1 + e0)
    dof = (e1 + e0) ** 2 / (e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1))
    pooled = ((n1 - 1) * row["v1"] + (n0 - 1) * row["v0"]) / (n1 + n0 - 2)
    return None, Effect("numeric", (row["m1"] - row["m0"]) / math.sqrt(pooled), t_tail_both(t, dof))


def flags_by_category(df: DataFrame, indicators: dict[str, Column], category: Column) -> DataFrame:
    """value, n and for each indicator the rows where it holds, by category."""
    return df.where(category.isNotNull()).groupBy(category.alias("value")).agg(F.count("*").alias("n"), *(F.count_if(f).alias(f"m_{j}") for j, f in indicators.items()))


def chi2_of_flag(counts: list[tuple[int, int]]) -> tuple[str | None, Effect | None]:
    """counts: (rows, rows where the indicator holds) for each category."""
    total, held = sum(n for n, _ in counts), sum(m for _, m in counts)
    if len(counts) < 2:
        return "no_variation", None
    if len(counts) > MOST_CATEGORIES:
        return "too_many_categories", None
    cells = [(m, n * held / total) for n, m in counts] + [(n - m, n * (total - held) / total) for n, m in counts]
    if min(e for _, e in cells) < LEAST_EXPECTED:
        return "small_expected", None
    chi2 = sum((o - e) ** 2 / e for o, e in cells)
    return None, Effect("categorical", math.sqrt(chi2 / total), chi2_tail(chi2, len(counts) - 1))


def flag_pairs(df: DataFrame, indicators: dict[str, Column]) -> tuple[int, dict[str, int], dict[tuple[str, str], int]]:
    """Rows, rows where each indicator holds, and where each two do."""
    names = list(indicators)
    pairs = list(combinations(names, 2))
    sums = [F.count("*").alias("n"), *(F.count_if(indicators[a]).alias(f"o{i}") for i, a in enumerate(names))]
    row = df.agg(*sums, F.array(*(F.count_if(indicators[a] & indicators[b]) for a, b in pairs)).alias("both") if pairs else F.lit(None).alias("both")).first()
    return row["n"], {a: row[f"o{i}"] for i, a in enumerate(names)}, dict(zip(pairs, row["both"] or [], strict=False))


def phi(n: int, a: int, b: int, both: int) -> float | None:
    """Phi of two indicators, or None where an expected count is under the least one."""
    if min(x * y / n for x in (a, n - a) for y in (b, n - b)) < LEAST_EXPECTED:
        return None
    return (n * both - a * b) / math.sqrt(a * (n - a) * b * (n - b))
