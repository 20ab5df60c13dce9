"""Aggregations over one or more columns: frequencies, counts, moments, quantiles, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import finite

#: Rows up to which Spark's own exact percentile (whose memory grows with distinct values) is used.
SMALL_ROWS = 2_000_000
#: Parts that a bracket is cut into: so many rows a bracket come to the driver in a round.
BRACKET_PARTS = 4096


def frequency(df: DataFrame, column: str) -> DataFrame:
    """value, n: how often each value that is not missing occurs."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def distinct_and_top(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_distinct, top: one row a column, by a union of grouped counts that keep each column's own type.

    Partial counts are made before the shuffle; no row is copied for each column as with several distinct counts in one aggregate.
    """
    out = None
    for c in columns:
        one = frequency(df, c).agg(F.count("*").alias("n_distinct"), F.coalesce(F.max("n"), F.lit(0)).alias("top")).select(F.lit(c).alias("column"), "n_distinct", "top")
        out = one if out is None else out.unionByName(one)
    return out


def null_overview(df: DataFrame) -> DataFrame:
    """cells, missing_cells, rows_with_missing."""
    nulls = [F.col(c).isNull() for c in df.columns]
    any_null = nulls[0]
    for x in nulls[1:]:
        any_null = any_null | x
    missing = sum((F.count_if(x) for x in nulls[1:]), F.count_if(nulls[0]))
    return df.agg((F.count("*") * len(nulls)).alias("cells"), missing.alias("missing_cells"), F.count_if(any_null).alias("rows_with_missing"))


def bias_free_skew(value: Column) -> Column:
    """Adjusted skewness; null for fewer than three values or no spread."""
    n = F.count(value)
    return F.when((n > 2) & (F.min(value) < F.max(value)), F.try_divide(F.skewness(value) * F.sqrt(n * (n - 1)), (n - 2).cast("double")))


def moments(value: Column, prefix: str = "") -> list[Column]:
    """count, mean, std, min, max and skew of the finite values."""
    x = finite(value)
    named = {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "skew": bias_free_skew(x)}
    return [c.alias(prefix + k) for k, c in named.items()]


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], n_rows: int | None = None) -> dict[str, list[float] | None]:
    """Quantiles with linear interpolation of each column's finite values.

    Small tables use the built-in percentile.  For larger ones, with the same results, the wanted ranks are
    bracketed and the brackets narrowed by exact counts, so that memory does not grow with the table.
    """
    if not columns:
        return {}
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows <= SMALL_ROWS:
        row = df.agg(*(F.percentile(finite(F.col(c)), list(probabilities)).alias(c) for c in columns)).first()
        return {c: None if row[c] is None else list(row[c]) for c in columns}
    return {c: _by_brackets(df.select(finite(F.col(c)).alias("x")).where("x is not null"), probabilities) for c in columns}


def _by_brackets(values: DataFrame, probabilities: Sequence[float]) -> list[float] | None:
    """Brackets of the wanted ranks are cut into equal parts until a part has one value only; each round is one job for all of them."""
    n, low, high = values.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    ranks = sorted({r for p in probabilities for r in (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))})
    found: dict[int, float] = {}
    brackets = [(low, high, 0, ranks)]  # least and greatest value, rows below, ranks inside
    while brackets:
        parts, x = [], F.col("x")
        for j, (a, b, _, _) in enumerate(brackets):
            place = F.lit(0) if a == b else F.floor((x / 2 - a / 2) / (b / 2 - a / 2) * BRACKET_PARTS)
            parts.append(F.when((x >= a) & (x <= b), F.struct(F.lit(j).alias("j"), F.least(place, F.lit(BRACKET_PARTS - 1)).cast("int").alias("part"))))
        cells = values.select("x", F.explode(F.array_compact(F.array(*parts))).alias("at")).groupBy("at.j", "at.part").agg(F.count("*"), F.min("x"), F.max("x"))
        later, below = [], {j: b[2] for j, b in enumerate(brackets)}
        for j, _, size, a, b in sorted(map(tuple, cells.collect())):
            inside = [r for r in brackets[j][3] if below[j] <= r < below[j] + size]
            if a == b:
                found |= dict.fromkeys(inside, a)
            elif inside:
                later.append((a, b, below[j], inside))
            below[j] += size
        brackets = later
    out = []
    for p in probabilities:
        k = p * (n - 1)
        a, b = found[int(k)], found[min(n - 1, int(k) + 1)]
        out.append(a + (b - a) * (k - int(k)))
    return out


def ranked_top(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """rank, label, n: the commonest values (equal counts by label), and as rank most + 1 the rest pooled, with its number of values in `pooled`."""
    counts = frequency(df, column).select(F.col("value").cast("string").alias("label"), "n")
    top = counts.orderBy(F.desc("n"), "label").limit(most)
    order = Window.orderBy(F.desc("n"), "label")  # over `most` rows only
    top = top.withColumn("rank", F.row_number().over(order)).withColumn("pooled", F.lit(None).cast("long"))
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    part = top.agg(F.sum("n").alias("m"), F.count("*").alias("j"))
    rest = whole.crossJoin(part).where("k > j").select(F.lit("(other)").alias("label"), (F.col("n") - F.col("m")).alias("n"), F.lit(most + 1).alias("rank"), (F.col("k") - F.col("j")).alias("pooled"))
    return top.unionByName(rest).select("rank", "label", "n", "pooled")


def duplicate_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """duplicate_rows (beyond the first of each group), duplicate_groups, largest_group."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    many = F.col("__n") > 1
    return groups.agg(F.coalesce(F.sum(F.when(many, F.col("__n") - 1)), F.lit(0)).alias("duplicate_rows"), F.count_if(many).alias("duplicate_groups"), F.coalesce(F.max("__n"), F.lit(0)).alias("largest_group"))


def repeat_positions(df: DataFrame, columns: Sequence[str], position: str, most: int = 5) -> DataFrame:
    """The first positions that repeat an earlier row.

    Only groups with repeats come back to the rows, and the least `most` positions are kept at once on every task.
    """
    first = df.groupBy(*columns).agg(F.min(position).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    same = None
    for c in columns:
        test = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = test if same is None else same & test
    hits = df.alias("a").join(first.alias("b"), same).where(F.col(f"a.{position}") > F.col("b.__first"))
    return hits.select(F.col(f"a.{position}").alias("position")).orderBy("position").limit(most)


def repeated_identifiers(df: DataFrame, identifier: str, compared: Sequence[str]) -> DataFrame:
    """repeated (values), conflicting (values whose rows differ), exact (values whose rows are equal), rows (extra rows)."""
    groups = df.where(F.col(identifier).isNotNull()).groupBy(*[identifier], *[c for c in compared if c != identifier]).agg(F.count("*").alias("__n"))
    each = groups.groupBy(identifier).agg(F.sum("__n").alias("n"), F.count("*").alias("k")).where("n > 1")
    return each.agg(F.count("*").alias("repeated"), F.count_if(F.col("k") > 1).alias("conflicting"), F.count_if(F.col("k") == 1).alias("exact"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows"))
