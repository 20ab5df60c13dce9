"""Whole runs: quality, exploration, diagnostics and the report."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession

from ..core.results import Finding, Result, Settings, Severity, by_severity, without_repeats
from ..core.table import Table
from . import diagnostics as D
from . import quality as Q
from .eda import explore
from .privacy import pii
from .schema import profile

CHECKS = ("missingness", "duplicates", "constants", "outliers", "dtypes", "impossible_values", "privacy")


def quality_checks(table: Table, settings: Settings, as_of: dt.date | None = None) -> Result:
    table.need_rows("quality")
    runs = (Q.missingness(table, settings), Q.duplicates(table, settings), Q.constants(table, settings), Q.outliers(table, settings), Q.dtypes(table, settings), Q.impossible(table, settings, as_of), pii(table, settings))
    found = by_severity(without_repeats(f for r in runs for f in r.findings))
    counts = {s.value: sum(f.severity is s for f in found) for s in Severity}
    return Result(findings=found, metrics={"checks_run": list(CHECKS), "findings_by_severity": counts} | {k: r.metrics for k, r in zip(CHECKS, runs, strict=True)}, settings=settings)


def diagnose(table: Table, settings: Settings, quality: Result | None = None, eda: Result | None = None, write: bool = True) -> Result:
    quality, eda = quality or quality_checks(table, settings), eda or explore(table, settings, write)
    splits, leaks = D.split_strategy(table, settings), D.leakage(table, settings)
    ready = D.readiness(table, settings, splits, leaks)
    kept = [r for r in D.recommendations((quality, eda, splits, leaks, ready)) if any(f.category in ("split_strategy", "leakage", "readiness") for f in r.findings)]
    headline = [f for f in ready.findings if f.title not in {g.title for r in kept for g in r.findings}]
    metrics = {"recommendations": [r.to_dict() for r in kept], "split_strategy": splits.metrics, "leakage": leaks.metrics, "readiness": ready.metrics}
    return Result(findings=[*headline, *(r.to_finding() for r in kept)], metrics=metrics, settings=settings)


def build_report(table: Table, settings: Settings, as_of: dt.date | None = None, write: bool = True) -> Result:
    from ..report.render import report_markdown

    shape, quality, eda = profile(table), quality_checks(table, settings, as_of), explore(table, settings, write)
    told = diagnose(table, settings, quality, eda, write)
    found = by_severity(D.without_superseded(without_repeats(f for r in (shape, quality, eda, told) for f in r.findings)))
    metrics = {"profile": shape.metrics, "quality": quality.metrics, "explore": eda.metrics, "diagnose": told.metrics}
    text = report_markdown(table, found, metrics, settings)
    artifacts = dict(eda.artifacts)
    if write:
        os.makedirs(settings.output_dir, exist_ok=True)
        artifacts["report"] = os.path.join(settings.output_dir, "report.md")
        with open(artifacts["report"], "w", encoding="utf-8") as f:
            f.write(text)
    return Result(findings=found, metrics=metrics | {"markdown": text}, artifacts=artifacts, settings=settings)


def findings_frame(spark: SparkSession, findings: list[Finding]) -> DataFrame:
    rows = [(i, f.category, f.severity.value, f.severity.rank, float(f.confidence), f.title, f.evidence, list(f.affected_columns)) for i, f in enumerate(findings)]
    return spark.createDataFrame(rows, "place int, category string, severity string, rank int, confidence double, title string, evidence string, affected_columns array<string>")
