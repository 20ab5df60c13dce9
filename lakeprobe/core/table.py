"""The examined table: a lazy DataFrame with row positions, and what was already worked out about it."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import TableError
from .results import Finding, Settings, Severity, count_of

POSITION = "__pos"
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _scans_files(df: DataFrame) -> bool:
    """Whether rows come from one scan of files, with nothing but columns and conditions on top, so that Spark can tell a row's file."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def with_positions(df: DataFrame) -> DataFrame:
    """Adds gap-free positions from 0: files in the order of their paths, rows as they stand there, whatever the order in which Spark deals out files and their parts.

    Rows that do not come straight from files count in the order of their partitions.  A few values
    for each part of a file come to the driver and go back as a broadcast; no row is moved.
    """
    spark = df.sparkSession
    from_files = _scans_files(df)
    part = {"__f": F.input_file_name() if from_files else F.lit(""), "__b": F.input_file_block_start() if from_files else F.lit(0).cast("long"), "__m": F.monotonically_increasing_id()}
    marked = df.withColumns(part).withColumn("__p", F.shiftright("__m", 33))
    found = marked.groupBy("__f", "__b", "__p").agg(F.min("__m"), F.count("*")).collect()
    rows, total = [], 0
    for f, b, p, least, n in sorted(found, key=lambda r: (unquote(r[0]), *r[1:4])):
        rows.append((f, b, p, total - least))
        total += n
    starts = spark.createDataFrame(rows, "__f string, __b long, __p long, __s long")
    placed = marked.join(F.broadcast(starts), ["__f", "__b", "__p"], "left")
    return placed.withColumn(POSITION, F.col("__m") + F.col("__s")).drop("__f", "__b", "__p", "__m", "__s")


@dataclass(frozen=True)
class ColumnInfo:
    """id: the column's name inside; name: its label; kind: how its values behave."""

    id: str
    name: str
    dtype: str
    kind: str


def kind_of(field: T.StructField) -> str:
    t = field.dataType
    if field.metadata.get("categorical"):
        return "category"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, NUMBERS):
        return "integer" if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "floating"
    if isinstance(t, MOMENTS):
        return "date" if isinstance(t, T.DateType) else "moment"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.VariantType):
        return "variant"
    return "nested" if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else "other"


class Table:
    """Immutable.  Columns are addressed by ids c0, c1, ... so that labels may repeat; NaN is missing, like null."""

    def __init__(self, df: DataFrame, name: str = "table", *, source: str | None = None, target: str | None = None, provenance=None, positions: bool = True):
        if not isinstance(df, DataFrame):
            raise TypeError("a table needs a Spark DataFrame")
        fields = df.schema.fields
        labels = [f.name for f in fields if f.name != POSITION]
        if target is not None and target not in labels:
            raise TableError(f"there is no column named {target!r} to be the target")
        self.name, self.source, self.target, self.provenance = name, source, target, provenance
        self.columns = [ColumnInfo(f"c{i}", f.name, f.dataType.simpleString(), kind_of(f)) for i, f in enumerate(f for f in fields if f.name != POSITION)]
        has_position = any(f.name == POSITION for f in fields)
        inner = df.toDF(*[f.name if f.name == POSITION else f"c{labels_i}" for f, labels_i in zip(fields, _counting(fields), strict=True)])
        clean = [F.nanvl(F.col(c.id), F.lit(None).cast(c.dtype)).alias(c.id) if c.dtype in ("float", "double") else F.col(c.id) for c in self.columns]
        self._plain = inner.select(*clean, *([POSITION] if has_position else []))
        self._positions = positions
        self._memo: dict = {}

    @property
    def df(self) -> DataFrame:
        """Columns by id, floats without NaN."""
        return self._plain.drop(POSITION)

    @property
    def positioned(self) -> DataFrame:
        def make():
            return self._plain if POSITION in self._plain.columns else with_positions(self._plain)

        return self.remember("positioned", make)

    def remember(self, key, make):
        if key not in self._memo:
            self._memo[key] = make()
        return self._memo[key]

    @property
    def n_rows(self) -> int:
        return self.remember("n_rows", self.df.count)

    @property
    def target_column(self) -> ColumnInfo | None:
        return next((c for c in self.columns if c.name == self.target), None) if self.target is not None else None

    def need_rows(self, purpose: str) -> int:
        if self.n_rows == 0:
            raise TableError(f"a table without rows can't be examined for {purpose}")
        return self.n_rows

    def of_kind(self, *kinds: str) -> list[ColumnInfo]:
        return [c for c in self.columns if c.kind in kinds]


def _counting(fields):
    n = -1
    for f in fields:
        if f.name != POSITION:
            n += 1
        yield n


@dataclass(frozen=True)
class Guard:
    """What the limits leave: the rows to use (all or a sample), whether pairs of columns are looked at, and the notices."""

    rows: DataFrame
    n: int
    sampled: bool
    pairwise: bool
    findings: tuple[Finding, ...]


def sample_positions(n: int, k: int, seed: int) -> np.ndarray:
    """k distinct positions of n, increasing, the same for the same seed everywhere (a frozen generator)."""
    return np.sort(np.random.RandomState(seed).choice(n, k, replace=False))


def guarded(table: Table, settings: Settings) -> Guard:
    """Applies the limits: an exact-size sample above the row threshold, no pairs above the column threshold."""

    def make() -> Guard:
        notices = []
        n, rows, used = table.n_rows, table.df, table.n_rows
        if n > settings.row_threshold:
            chosen = sample_positions(n, settings.row_threshold, settings.random_seed)
            spark = table.df.sparkSession
            wanted = spark.createDataFrame([(int(p),) for p in chosen] if len(chosen) < 1000 else _frame(chosen), f"{POSITION} long")
            # the sample's size is a setting, so the broadcast is bounded by it
            rows = table.positioned.join(F.broadcast(wanted), POSITION, "left_semi").orderBy(POSITION).drop(POSITION)
            rows, used = rows.persist(), settings.row_threshold
            notices.append(
                Finding(
                    category="guardrail", severity=Severity.INFO, confidence=1.0, title="A sample of rows was used",
                    evidence=f"The table has {count_of(n, 'row')}; the limit is {settings.row_threshold:,}.",
                    interpretation="Comparisons of columns ran on an exact-size random sample, the same at every run.",
                    limitations="Rare patterns may be absent from the sample.", recommendation="Raise row_threshold to use more rows.",
                )
            )
        pairwise = len(table.columns) <= settings.column_threshold
        if not pairwise:
            notices.append(
                Finding(
                    category="guardrail", severity=Severity.INFO, confidence=1.0, title="Pairs of columns were left out",
                    evidence=f"The table has {count_of(len(table.columns), 'column')}; the limit is {settings.column_threshold:,}.",
                    interpretation="The number of pairs grows with the square of the number of columns.",
                    limitations="Relations between columns are not covered.", recommendation="Raise column_threshold or choose fewer columns.",
                )
            )
        return Guard(rows, used, n > settings.row_threshold, pairwise, tuple(notices))

    return table.remember(("guard", settings), make)


def _frame(positions: np.ndarray):
    import pandas as pd

    return pd.DataFrame({POSITION: positions.astype("int64")})
