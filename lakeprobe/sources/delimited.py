"""Delimited text: one scan with every column as text, then types from one aggregate.

The raw text stays at hand, so what reading would lose (tokens turned missing,
leading zeros) is counted from the same columns.
"""

from __future__ import annotations

import codecs
import csv
import io
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.errors import LoadError
from ..core.table import POSITION, with_positions
from ..functions import predicates as P

# Texts that are read as missing.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")
ZERO_ROWS = 100_000
_CORRUPT, _ROW = "__corrupt", "__row"


def header_of(spark: SparkSession, path: str, separator: str, encoding: str) -> list[str]:
    if os.path.isfile(path):
        try:
            with open(path, encoding=encoding, newline="") as f:
                row = next(csv.reader(f, delimiter=separator), None)
        except UnicodeDecodeError as e:
            raise LoadError(f"{path}: byte {e.start} is not {encoding}") from e
        except LookupError as e:
            raise LoadError(f"there is no encoding {encoding!r}") from e
    else:
        first = spark.read.text(path).head()
        row = next(csv.reader(io.StringIO(first[0].lstrip("﻿")), delimiter=separator), None) if first else None
    if not row:
        raise LoadError(f"{path} has no header")
    if len(row) == 1 and (hint := next((s for s in ",;\t|" if s != separator and s in row[0]), None)):
        raise LoadError(f"{path} has a single column {row[0]!r}; is the separator {hint!r}?")
    return row


def charset(encoding: str) -> str:
    """Spark's name of a Python encoding."""
    name = codecs.lookup(encoding).name
    # Names that differ.
    return {"ascii": "us-ascii", "iso8859-1": "iso-8859-1", "utf-8-sig": "utf-8"}.get(name, name)


def labels_of(row: list[str]) -> tuple[list[str], list[str]]:
    """(labels, those given to columns without a name)"""
    labels = [name if name else f"Unnamed: {i}" for i, name in enumerate(row)]
    repeated = sorted({x for x in labels if labels.count(x) > 1})
    if repeated:
        raise LoadError(f"column names occur more than once: {', '.join(repeated)}")
    return labels, [x for x, name in zip(labels, row, strict=True) if not name]


def missing_or(raw: Column) -> Column:
    return F.when(~raw.isin(*MISSING_TOKENS), raw)


def _is_integer(v: Column) -> Column:
    return P.whole(v, r"\s*[+-]?[0-9]+\s*") & F.trim(v).try_cast("bigint").isNotNull()


def _is_double(v: Column) -> Column:
    return P.whole(v, rf"\s*(?:{P.NUMBER}|[+-]?(?i:inf|infinity))\s*")


def typed(raw: DataFrame, ids: list[str], keep_text: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """Columns with the narrowest type that all their values have: whole number, number, yes or no, text."""
    aggs = []
    for c in ids:
        v = missing_or(F.col(c))
        aggs += [F.count(v).alias(f"{c}_n"), F.count_if(_is_integer(v)).alias(f"{c}_i"), F.count_if(_is_double(v)).alias(f"{c}_d"), F.count_if(v.isin(*TRUE, *FALSE)).alias(f"{c}_b")]
    row = raw.agg(*aggs).first()
    kinds, out = {}, []
    for c in ids:
        v, n = missing_or(F.col(c)), row[f"{c}_n"]
        if c in keep_text:
            kind, value = "string", v
        elif n == 0 or row[f"{c}_d"] == n:
            kind = "bigint" if n and row[f"{c}_i"] == n else "double"
            value = F.trim(v).try_cast(kind)
        elif row[f"{c}_b"] == n:
            kind, value = "boolean", F.when(v.isNotNull(), v.isin(*TRUE))
        else:
            kind, value = "string", v
        kinds[c] = kind
        out.append(value.alias(c))
    return raw.select(*out), kinds


def converted_tokens(raw: DataFrame, labels: dict[str, str]) -> dict[str, dict[str, int]]:
    """By label, how often each text (but the empty one) was read as missing."""
    cells = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(c).alias("token")) for c, name in labels.items()))).alias("cell")
    rows = raw.select(cells).select("cell.*").where(F.col("token").isin(*MISSING_TOKENS[1:])).groupBy("name", "token").count().collect()
    out: dict[str, dict[str, int]] = {}
    for name, token, n in sorted(map(tuple, rows)):
        out.setdefault(name, {})[token] = n
    return out


def leading_zeros(raw: DataFrame, ids: list[str], labels: dict[str, str]) -> dict[str, dict[str, int]]:
    """By label of a whole-number column, how many of the first rows' texts begin with a zero before a digit."""
    if not ids:
        return {}
    aggs = []
    for c in ids:
        v = missing_or(F.col(c))
        aggs += [F.count(v).alias(f"{c}_n"), F.count_if(v.rlike(r"\A0[0-9]")).alias(f"{c}_z"), F.min(F.length(v)).alias(f"{c}_a"), F.max(F.length(v)).alias(f"{c}_b"), F.count_if(v.startswith("-")).alias(f"{c}_m")]
    row = with_positions(raw).where(F.col(POSITION) < ZERO_ROWS).agg(*aggs).first()
    out = {}
    for c in ids:
        if row[f"{c}_z"] and not row[f"{c}_m"]:
            out[labels[c]] = {"values": row[f"{c}_z"], "checked": row[f"{c}_n"]} | ({"width": row[f"{c}_a"]} if row[f"{c}_a"] == row[f"{c}_b"] else {})
    return out


def read_delimited(spark: SparkSession, path: str, separator: str, encoding: str, text_columns: set[str]) -> tuple[DataFrame, dict]:
    """(DataFrame, notes)"""
    if len(separator) != 1:
        raise LoadError("the separator must be one character")
    labels, unnamed = labels_of(header_of(spark, path, separator, encoding))
    absent = sorted(text_columns - set(labels))
    if absent:
        raise LoadError(f"there are no columns {', '.join(absent[:20])} to keep as text")
    ids = [f"c{i}" for i in range(len(labels))]
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in ids), T.StructField(_CORRUPT, T.StringType())])
    options = {"header": True, "sep": separator, "encoding": charset(encoding), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "multiLine": _breaks_in_fields(spark, path, encoding), "escape": '"', "enforceSchema": True, "nullValue": "\x00never\x00", "emptyValue": ""}
    read = spark.read.schema(schema).options(**options).csv(path)
    _refuse_long_rows(read, len(ids), separator)
    raw = read.drop(_CORRUPT).na.fill("")
    if raw.where(F.exists(F.array(*ids), lambda v: v.contains("�"))).limit(1).count() and os.path.isfile(path):
        _strict_decode(path, encoding)
    names = dict(zip(ids, labels, strict=True))
    df, kinds = typed(raw, ids, {c for c in ids if names[c] in text_columns})
    notes = {
        "converted_tokens": converted_tokens(raw, names),
        "unnamed_columns": unnamed,
        "leading_zeros": leading_zeros(raw, [c for c in ids if kinds[c] == "bigint"], names),
        "text_columns": sorted(text_columns),
    }
    return df.toDF(*labels), notes


def _breaks_in_fields(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a field may hold a line break, whatever the file's size: some line has an odd number of quotes, or lines can't be told by bytes.

    Only files that have such a line are read as a whole; all others are split at line ends.
    """
    if "\"\n".encode(encoding) != b'"\n':
        return True
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).head(1))


def _refuse_long_rows(read: DataFrame, n: int, separator: str) -> None:
    """Spark marks short and long rows alike; the marked ones alone are parsed again."""

    def count(batches):
        for batch in batches:
            sizes = [len(next(csv.reader(io.StringIO(x), delimiter=separator), [])) for x in batch[_CORRUPT]]
            yield pd.DataFrame({"n": pd.Series(sizes, dtype="int64")})

    marked = read.where(F.col(_CORRUPT).isNotNull()).select("c0", _CORRUPT).mapInPandas(count, "n long")
    most = marked.agg(F.max("n"), F.count_if(F.col("n") > n)).first()
    if most[1]:
        raise LoadError(f"{most[1]:,} rows have more fields than the {n} of the header (up to {most[0]})")


def _strict_decode(path: str, encoding: str) -> None:
    try:
        with open(path, encoding=encoding) as f:
            while f.read(1 << 20):
                pass
    except UnicodeDecodeError as e:
        raise LoadError(f"{path}: byte {e.start} is not {encoding}") from e
