"""Diagnostics of tabular datasets, and operators for training corpora, on Spark."""

__version__ = "0.1.0"

#: Public names and the modules that define them; loaded when first used, so that workers import only what they need.
_PUBLIC = {
    "load": "sources.load",
    "Table": "core.table",
    "Settings": "core.results",
    "Finding": "core.results",
    "Result": "core.results",
    "Severity": "core.results",
    "profile": "plans.schema",
    "quality_checks": "plans.runs",
    "explore": "plans.eda",
    "diagnose": "plans.runs",
    "build_report": "plans.runs",
}
__all__ = ["__version__", *_PUBLIC]


def __getattr__(name: str):
    from importlib import import_module

    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)
