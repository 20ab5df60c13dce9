"""Loads one file as a Table; the format comes from the name or is given, and is never guessed from the content."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.errors import LoadError
from ..core.provenance import Provenance
from ..core.results import Settings
from ..core.table import Table
from .delimited import read_delimited
from .xlsx import read_xlsx

FORMATS = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".xlsx": "excel", ".json": "json"}
#: Options that each format takes.
OPTIONS = {"csv": {"separator", "encoding", "text_columns"}, "tsv": {"separator", "encoding", "text_columns"}, "json": {"encoding"}, "parquet": set(), "excel": {"sheet", "text_columns"}}


def load(path: str, spark: SparkSession | None = None, *, file_format: str | None = None, target: str | None = None, separator: str | None = None, encoding: str | None = None, sheet: str | int | None = None, text_columns: Iterable[str] = (), settings: Settings | None = None) -> Table:
    """Reads a csv, tsv, json, parquet or xlsx file; nothing is dropped or filled."""
    spark = spark or SparkSession.builder.getOrCreate()
    settings = settings or Settings()
    path = os.fspath(path)
    remote = "://" in path
    if not remote and not os.path.exists(path):
        raise LoadError(f"{path} does not exist")
    kind = file_format or FORMATS.get(os.path.splitext(path)[1].lower())
    if kind not in OPTIONS:
        raise LoadError(f"the format of {path} is unknown; give one of {', '.join(OPTIONS)}")
    if not remote and os.path.isdir(path) and kind != "parquet":
        raise LoadError(f"{path} is a folder")
    wanted = {text_columns} if isinstance(text_columns, str) else set(text_columns)
    given = {"separator": separator, "encoding": encoding, "sheet": sheet, "text_columns": wanted or None}
    useless = sorted(k for k, v in given.items() if v is not None and k not in OPTIONS[kind])
    if useless:
        raise LoadError(f"{kind} files take no {', '.join(useless)}")
    try:
        if kind in ("csv", "tsv"):
            df, notes = read_delimited(spark, path, separator or ("," if kind == "csv" else "\t"), encoding or "utf-8-sig", wanted)
        elif kind == "json":
            df, notes = read_json(spark, path, encoding or "utf-8"), {}
        elif kind == "parquet":
            df, notes = read_parquet(spark, path)
        else:
            df, notes = read_xlsx(spark, path, sheet, wanted)
        n = df.count()
    except PySparkException as e:
        raise LoadError(f"{path} can't be read as {kind}: {str(e).splitlines()[0]}") from e
    if not n or not df.columns:
        raise LoadError(f"{path} has no rows")
    provenance = Provenance.capture(spark, path, settings, n, len(df.columns), **notes)
    name = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    return Table(df, name, source=path, target=target, provenance=provenance)


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Stored columns; a stored row index that is not just 0, 1, 2 ... becomes columns in front."""
    df = spark.read.parquet(path)
    promoted: list[str] = []
    if os.path.isfile(path):
        import pyarrow.parquet as pq

        stored = json.loads((pq.read_schema(path).metadata or {}).get(b"pandas", b"{}"))
        for k, c in enumerate(c for c in stored.get("index_columns", []) if isinstance(c, str)):
            name = c if not c.startswith("__index_level_") else "index" if k == 0 else f"index_{k}"
            if name != c and name in df.columns:
                raise LoadError(f"the stored index would take the name {name!r} of a column")
            df = df.withColumnRenamed(c, name)
            promoted.append(name)
    df = df.select(*promoted, *(c for c in df.columns if c not in promoted))
    return df, {"promoted_index": promoted}


def read_json(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """An array of objects; values keep their JSON types, and a key with several types stays a variant."""
    whole = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("t"))
    rows = whole.select(F.parse_json("t").alias("v"))
    shape = rows.select(F.schema_of_variant("v").alias("s")).first()
    if shape is None or not shape[0].startswith("ARRAY"):
        raise LoadError(f"{path} is not an array of objects")
    items = spark.sql("SELECT value AS v, pos FROM {rows}, LATERAL variant_explode(v)", rows=rows)
    if items.where(~F.schema_of_variant("v").startswith("OBJECT")).limit(1).count():
        raise LoadError(f"{path} has elements that are not objects")
    types: dict[str, set[str]] = {}
    for key, kind in _fields(items):
        types.setdefault(key, set()).add(kind)
    columns = []
    for key, kinds in types.items():
        kinds = kinds - {"VOID"}
        at = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
        numbers = all(k in ("BIGINT", "DOUBLE") or k.startswith("DECIMAL") for k in kinds)
        target = "bigint" if kinds == {"BIGINT"} else "double" if kinds and numbers else "boolean" if kinds == {"BOOLEAN"} else "string" if kinds in ({"STRING"}, set()) else None
        columns.append((F.variant_get("v", at, target) if target else F.variant_get("v", at, "variant")).alias(key))
    return items.orderBy("pos").select(*columns)


def _fields(items: DataFrame) -> list[tuple[str, str]]:
    """(key, type) by the first row that has the key, then by name: a parsed object keeps its keys sorted."""
    inner = items.select("pos", "v").withColumnRenamed("pos", "row")
    exploded = inner.sparkSession.sql("SELECT row, e.pos AS place, e.key AS key, schema_of_variant(e.value) AS type FROM {inner} AS i, LATERAL variant_explode(i.v) AS e", inner=inner)
    rows = exploded.groupBy("key", "type").agg(F.min(F.struct("row", "place")).alias("first")).orderBy("first").collect()
    return [(r["key"], r["type"]) for r in rows]
