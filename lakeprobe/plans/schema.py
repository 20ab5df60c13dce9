"""Schema profile: what each column appears to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.results import Finding, Result, Severity
from ..core.table import Table
from ..functions import predicates as P
from ..functions.names import is_identifier_name
from ..operators.aggregates import distinct_and_top

# Rules of the profile.
LEAST_UNIQUE_ROWS, UNIQUE_SHARE = 20, 0.95
CATEGORY_DISTINCT, CATEGORY_SHARE = 20, 0.5
NAMED_AND_UNIQUE, UNIQUE_ONLY, NAMED_ONLY, PROMOTED_FROM = 0.95, 0.6, 0.4, 0.6
PROFILE_SCHEMA = "name string, dtype string, semantic_type string, cardinality long, null_count long, identifier_confidence double, identifier_named boolean"


def _measures(c) -> dict:
    col = F.col(c.id)
    out = {"n": F.count(col)}
    if c.kind in ("integer", "floating"):
        value = P.finite(col)
        out |= {"low": F.min(value), "high": F.max(value), "inf": F.count(col) - F.count(value), "whole": F.bool_and(F.try_mod(value, F.lit(1.0)) == 0)}
    elif c.kind == "string":
        out |= {"iso": F.bool_and(P.is_iso_moment(col)), "blank": F.bool_or(P.has_blank(col))}
    return out


def facts(table: Table) -> dict[str, dict]:
    """By column id: n (not missing), n_distinct, top and the measures of its kind; two jobs for the whole table, kept."""

    def make():
        wanted = {c.id: _measures(c) for c in table.columns}
        row = table.df.agg(F.count("*").alias("rows"), *(v.alias(f"{i}_{k}") for i, m in wanted.items() for k, v in m.items())).first()
        table._memo.setdefault("n_rows", row["rows"])
        out = {i: {k: row[f"{i}_{k}"] for k in m} | {"n_distinct": None, "top": None} for i, m in wanted.items()}
        countable = [c.id for c in table.columns if c.kind not in ("nested", "variant")]
        if countable:
            for r in distinct_and_top(table.df, countable).collect():
                out[r["column"]] |= {"n_distinct": r["n_distinct"], "top": r["top"]}
        return out

    return table.remember("facts", make)


def _identifier(c, f: dict) -> tuple[float, bool, bool] | None:
    """(confidence, named, sequential) of a column that may identify rows."""
    n, distinct = f["n"], f["n_distinct"]
    unique = n >= LEAST_UNIQUE_ROWS and distinct / n >= UNIQUE_SHARE
    sequential = False
    if c.kind == "string":
        alone = unique and not f["blank"]
    else:
        if not f["whole"] or f["inf"]:
            return None
        sequential = alone = unique and distinct == n and int(f["high"]) - int(f["low"]) + 1 == n
    named = is_identifier_name(c.name)
    if not (named or alone):
        return None
    return (NAMED_AND_UNIQUE if unique else NAMED_ONLY) if named else UNIQUE_ONLY, named, sequential


def classify(c, f: dict, is_target: bool) -> tuple[str, tuple | None]:
    if f["n"] == 0 or c.kind in ("nested", "variant", "other"):
        return "unknown", None
    simple = {"boolean": "boolean", "date": "datetime", "moment": "datetime", "category": "categorical"}
    if c.kind in simple:
        return simple[c.kind], None
    if c.kind == "string":
        if f["iso"]:
            return "datetime", None
        few = f["n_distinct"] <= CATEGORY_DISTINCT or f["n_distinct"] / f["n"] <= CATEGORY_SHARE
        base = "categorical" if few else "text"
    else:
        base = "numeric"
    found = None if is_target else _identifier(c, f)
    return ("identifier" if found and found[0] >= PROMOTED_FROM else base), found


def profile(table: Table) -> Result:
    """Metrics of every column and a finding for each that may identify rows."""

    def make():
        known = facts(table)
        rows, findings = [], []
        for c in table.columns:
            f = known[c.id]
            kind, found = classify(c, f, table.target is not None and c.name == table.target)
            cardinality = 0 if f["n"] == 0 else f["n_distinct"]
            rows.append({"name": c.name, "dtype": c.dtype, "semantic_type": kind, "cardinality": cardinality, "null_count": table.n_rows - f["n"], "identifier_confidence": found[0] if found else None, "identifier_named": found[1] if found else None})
            if found:
                why = [f"{cardinality:,} distinct among {f['n']:,} values", *(["its name ends like an identifier's"] if found[1] else []), *(["the values are consecutive whole numbers"] if found[2] else [])]
                findings.append(
                    Finding(
                        category="schema", severity=Severity.LOW, confidence=found[0], title="A column may identify rows", affected_columns=(c.name,),
                        evidence=f"'{c.name}': {'; '.join(why)}.", interpretation="Such a column tells rows apart and carries no signal of its own.",
                        limitations="Judged from the name and the number of distinct values only.", recommendation="Leave it out of the features; keep it for joins and grouping.",
                    )
                )
        return Result(findings=findings, metrics={"n_rows": table.n_rows, "n_columns": len(rows), "columns": rows})

    return table.remember("profile", make)


def semantic_types(table: Table) -> dict[str, str]:
    return {c.id: m["semantic_type"] for c, m in zip(table.columns, profile(table).metrics["columns"], strict=True)}


def profile_frame(table: Table) -> DataFrame:
    """The profile as a DataFrame of one row a column."""
    rows = [tuple(m.values()) for m in profile(table).metrics["columns"]]
    return table.df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)
