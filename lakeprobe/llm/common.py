"""What the operators of this subpackage share: tables in the shared folder, fixed-size filters, defined inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import send_package
from .kernels import mix

#: Rows of one Arrow batch; documents of 20 kB then make batches of about 40 MB.
BATCH_ROWS = 2000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one under the warehouse only where that is unset (single-machine tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


#: Whether jobs remove their shuffle files at their end; files a task writes to side by side, without which rows are sorted for one after the other.
CLEANUP, WRITERS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """Jobs inside remove their shuffle files at their end: what they made is a written table or on the driver by then."""
    return setting(spark, CLEANUP, "true")


class Scratch:
    """Written tables of one query in the shared folder.

    A written table cuts the lineage: an executor that is lost later costs only
    the tasks that were on it.  `drop` removes a table nothing reads any more; what results
    are read from goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path, files = self._files(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, by: str = "", values: int = 1) -> DataFrame:
        """The table as written; `by` names its last column, of which each of the few values gets a folder, so that one is read without the others."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with setting(self.spark, CLEANUP, "true"), setting(self.spark, WRITERS, str(values)):
            df.write.option("compression", "zstd").partitionBy(*[by] * bool(by)).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, files = self._files(t._scratch_path)
            files.delete(path, True)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, with further columns by name; others and clashing names don't get in."""
    spark = docs.sparkSession
    send_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for functions of one batch; batches without rows are skipped."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    send_package(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Bits of a filter at most, and of the planes in which a first occurrence is noted (of all buckets together), unless the session says otherwise.
FILTER_BITS, PLANE_BITS = 30, 33
#: Bits of a bucket's plane at least, where the session says nothing; share of a filter's bits that may be set for it to be halved, and bits it keeps.
BUCKET_PLANE_BITS, FULLEST, LEAST_BITS = 27, 0.15, 20
FILTER_SETTING, PLANE_SETTING = "spark.lakeprobe.filterBits", "spark.lakeprobe.planeBits"
BLOBS = "bucket int, hashes binary"
_ROUND = np.uint64(0x5851F42D4C957F2D)


def spread(h: np.ndarray) -> np.ndarray:
    """Another hash of each: those chosen as the least of several would crowd the low buckets and lines of a filter."""
    return mix(h ^ _ROUND)


def hash_blobs(parts: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Hashes, spread, each at most twice, dealt by their top bits to `buckets` (a power of two) blobs; a blob holds the 40 bits that follow."""
    h = spread(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    h.sort()
    if len(h) > 2:
        h = np.concatenate([h[:2], h[2:][h[2:] != h[:-2]]])
    top = buckets.bit_length() - 1
    cuts = np.searchsorted(h >> np.uint64(64 - top), np.arange(buckets + 1, dtype=np.uint64))
    kept = ((h << np.uint64(top)) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, kept[cuts[b] : cuts[b + 1]].tobytes()


def blob_hashes(bucket: int, blob: bytes, buckets: int) -> np.ndarray:
    """The hashes of a blob in order, without the bits that it does not hold."""
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    top = buckets.bit_length() - 1
    return (wide.view("<u8").ravel() << np.uint64(24 - top)) | np.uint64(bucket << (64 - top))


def blob_batch(parts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    rows = list(hash_blobs(parts, buckets))
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "hashes"])


def bucket_count(spark: SparkSession) -> int:
    """Blobs a batch is dealt to: the next power of two from the number of shuffle partitions, so it grows with the cluster's setting."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << min(12, max(4, (n - 1).bit_length()))


def _positions(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three positions of each spread hash in a filter of 2**bits bits, all in the line of 2**12 bits that its top bits name; other bits say where, the same for all sizes."""
    line = (h >> np.uint64(64 - bits + 12)) << np.uint64(12)
    low = np.uint64(4095)
    one, two = (h >> np.uint64(32)) & low, (h >> np.uint64(20)) & low
    for p in (one, two, (one * np.uint64(5) + two * np.uint64(3) + np.uint64(1)) & low):
        yield line | p


def _halved(filter_: np.ndarray) -> np.ndarray:
    """The filter of half the bits: neighbouring lines become one."""
    lines = filter_.reshape(-1, 2, 512)
    return (lines[:, 0] | lines[:, 1]).ravel()


def _bits_at(plane: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (plane[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _set_bits(plane: np.ndarray, p: np.ndarray) -> None:
    np.bitwise_or.at(plane, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))


def in_filter(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may have been put in; never false for one that was."""
    bits = (8 * len(filter_)).bit_length() - 1
    out = np.ones(len(h), bool)
    for p in _positions(spread(h), bits):
        out &= _bits_at(filter_, p)
    return out


def build_filter(blobs: DataFrame, repeated: bool, bits: int | None = None) -> np.ndarray:
    """Filter over the hashes in blobs (bucket int, hashes binary, as hash_blobs deals them), of 2**bits bits at most, by default as the session sets it.

    It is halved as long as few of its bits are set, so its size follows the number of hashes in it.

    With `repeated`, only hashes that occur twice go in.  Each bucket has a task of its own, which
    keeps no hash: a first occurrence sets a bit in the bucket's plane, and one whose bit
    is set goes into the bucket's lines of the filter.  A full plane or filter lets more pass, so it costs
    time but no result.  The driver gets at most the filter and only puts its lines in place.
    """
    spark = blobs.sparkSession
    bits = bits or int(spark.conf.get(FILTER_SETTING, str(FILTER_BITS)))
    buckets = bucket_count(spark)
    per, top = (1 << bits - 12) // buckets, buckets.bit_length() - 1
    set_ = spark.conf.get(PLANE_SETTING, None)
    plane_bits = max(PLANE_BITS - top, BUCKET_PLANE_BITS) if set_ is None else min(40, max(16, int(set_) - top))

    def fill(batches):
        planes: dict[int, np.ndarray] = {}
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = blob_hashes(b, blob.as_py(), buckets)
                part = found.setdefault(b, np.zeros(per * 512, np.uint8))
                if repeated:
                    plane = planes.setdefault(b, np.zeros((1 << plane_bits) // 8, np.uint8))
                    cell = (h << np.uint64(top)) >> np.uint64(64 - plane_bits)
                    again = _bits_at(plane, cell)
                    again[1:] |= h[1:] == h[:-1]
                    _set_bits(plane, cell)
                    h = h[again]
                for p in _positions(h, bits):
                    _set_bits(part, p - np.uint64(b * per * 4096))
        for b, part in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["bucket", "lines"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    with shuffles_removed(spark):
        for b, lines in blobs.repartitionById(buckets, "bucket").mapInArrow(fill, "bucket int, lines binary").collect():
            out[b * per * 512 : (b + 1) * per * 512] = np.frombuffer(pa.decompress(bytes(lines), per * 512, "zstd"), np.uint8)
    n_set = int(np.bitwise_count(out.view(np.uint64)).sum(dtype=np.int64))
    while bits > LEAST_BITS and n_set <= FULLEST / 2 * (1 << bits):
        out, bits = _halved(out), bits - 1
    return out


def with_key(docs: DataFrame, *more: str) -> DataFrame:
    """documents() with `key`, a hash of the text: doc_id and key tell rows with one doc_id and different texts apart."""
    text = F.col("text").cast("string")
    return documents(docs, F.xxhash64(text).alias("key"), *more)


def _id_hashes(columns: list[pa.Array]) -> np.ndarray:
    """A hash of each row's ids; nulls count as 0."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix(out ^ c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    return out


def id_filter(ids: DataFrame, *columns: str) -> np.ndarray:
    """Filter over the values of the (long) columns; its size does not depend on their number."""
    buckets = bucket_count(ids.sparkSession)
    return build_filter(map_batches(ids.select(*columns), lambda batch: blob_batch([_id_hashes(batch.columns)], buckets), BLOBS), repeated=False)


def may_be_in(filter_: np.ndarray, *columns: pa.Array) -> np.ndarray:
    return in_filter(filter_, _id_hashes(list(columns)))


def split_by_filter(rows: DataFrame, ids: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose values in the columns may be in ids, rows whose are not), so that only the former need be shuffled; those with a null are not."""
    columns = columns or ("doc_id", "key")
    shared = rows.sparkSession.sparkContext.broadcast(id_filter(ids, *columns))
    places = [rows.columns.index(c) for c in columns]

    def part(inside: bool) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [batch.column(k) for k in places]
            ok = may_be_in(shared.value, *found)
            for c in found:
                ok &= c.is_valid().to_numpy(zero_copy_only=False)
            return batch.filter(pa.array(ok if inside else ~ok))

        return map_batches(rows, run, rows.schema)

    return part(True), part(False)


def without(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """The rows whose values in the columns are not in ids; only those that a filter can't clear are shuffled."""
    some, others = split_by_filter(rows, ids, *columns)
    return some.join(ids.select(*columns), list(columns), "left_anti").select(rows.columns).unionByName(others)
