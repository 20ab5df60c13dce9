"""Running quality counters of a stream: each micro-batch adds its own, which merge by sums, least and greatest values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "batch long, name string, rows long, missing long, low double, high double, total double, squares double"


def batch_counters(df: DataFrame, batch: int) -> DataFrame:
    """One row a column; numbers also get their range and sums."""
    numbers = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")}
    parts = []
    for c in df.columns:
        x = F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(batch).cast("long").alias("batch"), F.lit(c).alias("name"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("missing"), F.min(x).alias("low"), F.max(x).alias("high"), F.sum(x).alias("total"), F.sum(x * x).alias("squares")))
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def merged(counters: DataFrame) -> DataFrame:
    """Counters of all batches so far; a batch that was written twice, after a restart, counts once."""
    once = counters.dropDuplicates(["batch", "name"])
    n = F.sum("rows") - F.sum("missing")
    mean = F.try_divide(F.sum("total"), n)
    return once.groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.min("low").alias("low"), F.max("high").alias("high"), mean.alias("mean"), F.try_divide(F.sum("squares"), n).alias("mean_square"))


def watch(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends each micro-batch's counters to a Parquet table at `path`."""

    def write(df: DataFrame, batch: int) -> None:
        batch_counters(df, batch).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
