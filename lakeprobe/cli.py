"""Command line: profile, quality, explore, diagnose, report."""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

from . import __version__
from .core.errors import ProbeError
from .core.results import Settings, strict_dumps
from .core.table import Table
from .plans.eda import explore
from .plans.runs import build_report, diagnose, quality_checks
from .plans.schema import profile
from .report.render import findings_text, profile_text, provenance_text, report_html
from .sources.load import load


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakeprobe", description="Diagnostics of a tabular dataset on Spark.")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command")
    for name, help_ in (("profile", "what each column holds"), ("quality", "defects of the data"), ("explore", "distributions and relations"), ("diagnose", "splits, leakage and readiness"), ("report", "everything, as Markdown and HTML")):
        p = commands.add_parser(name, help=help_)
        p.add_argument("path")
        p.add_argument("--target")
        p.add_argument("--format", dest="file_format")
        p.add_argument("--separator")
        p.add_argument("--encoding")
        p.add_argument("--sheet")
        p.add_argument("--text-column", dest="text_columns", action="append", default=[])
        p.add_argument("--output-dir", default=Settings.output_dir)
        p.add_argument("--json", dest="json_path", help="write the result as JSON to this file")
        if name in ("quality", "report"):
            p.add_argument("--as-of", type=dt.date.fromisoformat, help="reference day of date checks, YYYY-MM-DD")
    return top


def _write_json(path: str, table: Table, key: str, result) -> None:
    provenance = None if table.provenance is None else table.provenance.to_dict()
    with open(path, "w", encoding="utf-8") as f:
        f.write(strict_dumps({"dataset": {"name": table.name, "source": table.source, "target": table.target}, "provenance": provenance, key: result.to_dict()}, indent=2) + "\n")


def main(args: list[str] | None = None) -> int:
    parser = _parser()
    options = parser.parse_args(args)
    if options.command is None:
        parser.print_help()
        return 0
    try:
        settings = Settings(output_dir=options.output_dir)
        sheet = int(options.sheet) if options.sheet and options.sheet.isdigit() else options.sheet
        table = load(options.path, file_format=options.file_format, target=options.target, separator=options.separator, encoding=options.encoding, sheet=sheet, text_columns=options.text_columns, settings=settings)
        if options.command == "profile":
            result = profile(table)
            print(profile_text(table, result))
        elif options.command == "quality":
            result = quality_checks(table, settings, options.as_of)
            print(provenance_text(table), findings_text(list(result.findings)), sep="\n\n")
        elif options.command == "explore":
            result = explore(table, settings)
            print(findings_text(list(result.findings)), *sorted(result.artifacts.values()), sep="\n")
        elif options.command == "diagnose":
            result = diagnose(table, settings)
            print(findings_text(list(result.findings)))
        else:
            result = build_report(table, settings, options.as_of)
            page = os.path.join(settings.output_dir, "report.html")
            with open(page, "w", encoding="utf-8") as f:
                f.write(report_html(table, result))
            print(result.artifacts["report"], page, sep="\n")
        if options.json_path:
            _write_json(options.json_path, table, options.command, result)
    except (ProbeError, OSError) as e:
        print(f"error: {e}".splitlines()[0], file=sys.stderr)
        return 1
    return 0
