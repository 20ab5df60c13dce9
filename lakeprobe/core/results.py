"""Settings, severities, findings and results; plain values, no Spark."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, fields
from enum import Enum

from .errors import SettingsError, StrictJsonError


def strict_dumps(value, **options) -> str:
    """JSON without NaN or infinities, which must read back as it was."""
    try:
        text = json.dumps(value, allow_nan=False, **options)
    except (TypeError, ValueError) as e:
        raise StrictJsonError(str(e)) from e
    if json.loads(text) != value:
        raise StrictJsonError("the value does not read back as it was (tuples, keys that are not text, or special numbers)")
    return text


def strict_loads(text: str):
    def refuse(name: str):
        raise StrictJsonError(f"{name} is not strict JSON")

    return json.loads(text, parse_constant=refuse)


@dataclass(frozen=True, kw_only=True)
class Settings:
    """Limits an examination runs under.

    Above `row_threshold` rows, pairwise work uses an exact-size seeded
    sample; above `column_threshold` columns, pairwise work is left out.
    """

    random_seed: int = 42
    row_threshold: int = 100_000
    column_threshold: int = 100
    output_dir: str = "outputs"

    def __post_init__(self):
        for name, least in (("random_seed", 0), ("row_threshold", 1), ("column_threshold", 1)):
            value = getattr(self, name)
            if type(value) is not int or value < least:
                raise SettingsError(f"{name} must be a whole number of {least} or more, not {value!r}")
        if not isinstance(self.output_dir, str) or not self.output_dir.strip():
            raise SettingsError("output_dir must be a path")


class Severity(str, Enum):
    """Impact if the finding is real; how sure it is, is the confidence."""

    CRITICAL = "critical"
    HIGH = "high"
    MEDIUM = "medium"
    LOW = "low"
    INFO = "info"

    @property
    def rank(self) -> int:
        return 4 - list(Severity).index(self)


def _from_dict(cls, data: dict):
    names = [f.name for f in fields(cls)]
    if set(data) != set(names):
        raise StrictJsonError(f"{cls.__name__} needs exactly the keys {', '.join(names)}")
    return data


@dataclass(frozen=True, kw_only=True)
class Finding:
    category: str
    severity: Severity
    confidence: float
    title: str
    evidence: str
    interpretation: str
    limitations: str
    affected_columns: tuple[str, ...] = ()
    recommendation: str | None = None

    def __post_init__(self):
        if not isinstance(self.severity, Severity):
            raise TypeError("severity must be a Severity")
        if isinstance(self.confidence, bool) or not 0 <= self.confidence <= 1:
            raise ValueError("confidence must be from 0 to 1")
        object.__setattr__(self, "affected_columns", tuple(self.affected_columns))

    def to_dict(self) -> dict:
        return asdict(self) | {"severity": self.severity.value, "affected_columns": list(self.affected_columns)}

    @classmethod
    def from_dict(cls, data: dict) -> Finding:
        data = _from_dict(cls, data)
        return cls(**data | {"severity": Severity(data["severity"]), "affected_columns": tuple(data["affected_columns"])})


@dataclass(frozen=True, kw_only=True)
class Result:
    """Findings, strict-JSON metrics, paths of files written, and the settings in force."""

    findings: tuple[Finding, ...] = ()
    metrics: dict = field(default_factory=dict)
    artifacts: dict = field(default_factory=dict)
    settings: Settings | None = None

    def __post_init__(self):
        object.__setattr__(self, "findings", tuple(self.findings))
        for key, value in self.metrics.items():
            try:
                strict_dumps(value)
            except StrictJsonError as e:
                raise StrictJsonError(f"metric {key}: {e}") from e

    def to_dict(self) -> dict:
        return {"findings": [f.to_dict() for f in self.findings], "metrics": self.metrics, "artifacts": self.artifacts, "settings": None if self.settings is None else asdict(self.settings)}

    def to_json(self) -> str:
        return strict_dumps(self.to_dict())

    @classmethod
    def from_json(cls, text: str) -> Result:
        data = _from_dict(cls, strict_loads(text))
        settings = data["settings"]
        return cls(findings=tuple(map(Finding.from_dict, data["findings"])), metrics=data["metrics"], artifacts=data["artifacts"], settings=None if settings is None else Settings(**settings))


def by_severity(findings: Iterable[Finding]) -> list[Finding]:
    """Most severe first; findings of one severity keep their order."""
    return sorted(findings, key=lambda f: -f.severity.rank)


def without_repeats(findings: Iterable[Finding]) -> list[Finding]:
    return list(dict.fromkeys(findings))


def number(value) -> float | int | None:
    """A finite number as plain Python, else None."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def listed(names: Iterable[str], most: int = 5) -> str:
    """The first names, and how many more there are."""
    names = list(names)
    text = ", ".join(f"'{n}'" for n in names[:most])
    return text + (f" and {len(names) - most} more" if len(names) > most else "")


def count_of(n: int, noun: str) -> str:
    return f"{n:,} {noun}{'' if n == 1 else 's'}"
