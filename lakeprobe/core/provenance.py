"""Where a table came from and what reading it changed."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import platform
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .results import Settings


def file_digest(spark: SparkSession, path: str) -> tuple[str | None, int | None]:
    """SHA-256 and size of one file: in pieces here if it is local, by Spark if it is elsewhere."""
    if os.path.isfile(path):
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
        return digest.hexdigest(), os.path.getsize(path)
    rows = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256), "length").limit(2).collect()
    return tuple(rows[0]) if len(rows) == 1 else (None, None)


@dataclass(frozen=True)
class Provenance:
    source: str | None
    sha256: str | None = None
    size: int | None = None
    n_rows: int | None = None
    n_columns: int | None = None
    loaded_at: str | None = None
    python_version: str = field(default_factory=platform.python_version)
    spark_version: str | None = None
    settings: dict | None = None
    converted_tokens: dict = field(default_factory=dict)
    unnamed_columns: list = field(default_factory=list)
    promoted_index: list = field(default_factory=list)
    leading_zeros: dict = field(default_factory=dict)
    text_columns: list = field(default_factory=list)

    @classmethod
    def capture(cls, spark: SparkSession, source: str, settings: Settings, n_rows: int, n_columns: int, **notes) -> Provenance:
        digest, size = file_digest(spark, source)
        now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        return cls(source, digest, size, n_rows, n_columns, now, spark_version=spark.version, settings=asdict(settings), **notes)

    def to_dict(self) -> dict:
        return asdict(self)
