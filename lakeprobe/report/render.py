"""Plain text, Markdown and HTML of results; every text from the data is escaped."""

from __future__ import annotations

import os
from html import escape

from ..core.results import Finding, Result, Settings, Severity
from ..core.table import Table

BADGES = {Severity.CRITICAL: "#a50026", Severity.HIGH: "#d73027", Severity.MEDIUM: "#b35806", Severity.LOW: "#4575b4", Severity.INFO: "#666666"}


def text_table(header: list[str], rows: list[list]) -> str:
    cells = [[("-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)) for v in r] for r in [header, *rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(header))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def profile_text(table: Table, result: Result) -> str:
    rows = [[m["name"], m["dtype"], m["semantic_type"], m["cardinality"], m["null_count"], m["identifier_confidence"]] for m in result.metrics["columns"]]
    return f"{table.name}: {result.metrics['n_rows']:,} rows, {result.metrics['n_columns']} columns\n{provenance_text(table)}\n" + text_table(["column", "type", "holds", "distinct", "missing", "identifier"], rows)


def provenance_text(table: Table) -> str:
    p = table.provenance
    return "" if p is None else "\n".join(f"{k}: {v}" for k, v in p.to_dict().items() if v not in (None, {}, []))


def findings_text(findings: list[Finding]) -> str:
    blocks = []
    for f in findings:
        lines = [f"[{f.severity.value}] {f.title} ({f.confidence:.0%} sure)", f"  {f.evidence}", f"  Means: {f.interpretation}", f"  But: {f.limitations}"]
        if f.recommendation:
            lines.append(f"  Do: {f.recommendation}")
        if f.affected_columns:
            lines.append(f"  Columns: {', '.join(f.affected_columns)}")
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks) or "No findings."


def _md(text) -> str:
    out = str(text).replace("\n", " ")
    for c in "\\`*_{}[]<>|#":
        out = out.replace(c, "\\" + c)
    return out


def report_markdown(table: Table, findings: list[Finding], metrics: dict, settings: Settings) -> str:
    out = [f"# Report on {_md(table.name)}", "", f"{metrics['profile']['n_rows']:,} rows, {metrics['profile']['n_columns']} columns" + (f", target {_md(table.target)}" if table.target else "") + ".", ""]
    if table.provenance is not None:
        out += ["## Source", "", *(f"- {_md(k)}: {_md(v)}" for k, v in table.provenance.to_dict().items() if v not in (None, {}, [])), ""]
    out += ["## Findings", ""]
    for f in findings:
        out += [f"### {f.severity.value.upper()}: {_md(f.title)}", "", _md(f.evidence), "", f"*{_md(f.interpretation)}* Limits: {_md(f.limitations)}" + (f" **{_md(f.recommendation)}**" if f.recommendation else ""), ""]
        if f.affected_columns:
            out += [f"Columns: {', '.join(map(_md, f.affected_columns))}", ""]
    out += ["## Columns", "", "| column | type | holds | distinct | missing |", "| --- | --- | --- | --- | --- |"]
    out += [f"| {_md(m['name'])} | {_md(m['dtype'])} | {m['semantic_type']} | {'' if m['cardinality'] is None else m['cardinality']} | {m['null_count']} |" for m in metrics["profile"]["columns"]]
    return "\n".join([*out, "", f"Seed {settings.random_seed}, row limit {settings.row_threshold}, column limit {settings.column_threshold}.", ""])


def report_html(table: Table, result: Result) -> str:
    parts = [f"<h1>Report on {escape(table.name)}</h1>"]
    for f in result.findings:
        columns = f"<p>Columns: {escape(', '.join(f.affected_columns))}</p>" if f.affected_columns else ""
        advice = f"<p><b>{escape(f.recommendation)}</b></p>" if f.recommendation else ""
        parts.append(f'<section><h2><span style="background:{BADGES[f.severity]};color:#fff;padding:2px 6px">{f.severity.value}</span> {escape(f.title)}</h2><p>{escape(f.evidence)}</p><p>{escape(f.interpretation)} {escape(f.limitations)}</p>{advice}{columns}</section>')
    rows = "".join(f"<tr><td>{escape(m['name'])}</td><td>{escape(m['dtype'])}</td><td>{m['semantic_type']}</td><td>{m['cardinality'] if m['cardinality'] is not None else ''}</td><td>{m['null_count']}</td></tr>" for m in result.metrics["profile"]["columns"])
    parts.append(f"<table><tr><th>column</th><th>type</th><th>holds</th><th>distinct</th><th>missing</th></tr>{rows}</table>")
    parts += [f'<img src="{escape(os.path.basename(p))}" alt="{escape(k)}">' for k, p in sorted(result.artifacts.items()) if p.endswith(".svg")]
    return '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Report</title></head><body>' + "\n".join(parts) + "</body></html>\n"
