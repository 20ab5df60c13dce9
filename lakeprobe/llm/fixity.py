"""Merkle fixity audit of web-archive records.

Records are hashed one by one.  A tree over their keys hashes runs of FAN nodes
in order, level by level, and each node also knows the range of offsets its records
take in their archive.  An audit compares the roots of two replicas and goes down
only where hashes differ, so it reads as many nodes as there are faults, times
the height, times FAN.

With `placement`, a leaf also has a digest of its records' archives, offsets and lengths, and nodes
hash both, so a record that lies elsewhere is found too.  Without it, replicas may be packed
differently: a record that is missing moves all those after it in its archive.

All of it is DataFrame functions.  A node has at most FAN children.  A leaf's digests are sums over its records, so
a key that very many records share is added up before it is shuffled, and offsets inside such a key are sums over
parts of it by digest.  The trees are written tables that several audits can use.

Defined cases: rows without a key are left out; a null url or html is empty; rows that repeat a key and its content are one
record with a number of copies; a key with several contents is one leaf; very long pages are hashed whole; other columns
don't get in; empty replicas have no root, and against one every record is missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FAN = 16
#: Keys of one archive file; its records' offsets are sums over them.
ARCHIVE_KEYS = 4096


def record_bytes(key, url, html, date: str):
    """A record as the archive holds it; its id is made from key and address."""
    body = F.encode(F.coalesce(html, F.lit("")), "utf-8")
    address = F.coalesce(url, F.lit(""))
    name = F.md5(F.concat(key.cast("string"), F.lit(" "), address).cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), address, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "utf-8"), body, F.lit(b"\r\n\r\n"))


def records(pages: DataFrame, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """key, archive, offset, length, digest and copies of every page's record; `date` (20 characters) is that of the capture.

    An archive has the records of ARCHIVE_KEYS keys in order of key and digest, copies once.
    """
    data = record_bytes(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), date)
    one = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("key"), F.octet_length(data).cast("long").alias("length"), F.sha2(data, 256).alias("digest"))
    one = Scratch(pages.sparkSession, "records").keep(one.groupBy("key", "digest").agg(F.min("length").alias("length"), F.count("*").alias("copies")))
    one = one.withColumns({"archive": F.floor(F.col("key") / ARCHIVE_KEYS).cast("long"), "part": F.substring("digest", 1, 3)})
    # sums over keys of an archive, over a key's 4096 parts, and over the records of a part: none of these groups grows with a key's records but by its share
    parts = one.groupBy("archive", "key", "part").agg(F.sum("length").alias("n"))
    keys = parts.groupBy("archive", "key").agg(F.sum("n").alias("n"))

    def before(n: str, order: str, *within: str):
        return F.coalesce(F.sum(n).over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    keys = keys.select("key", before("n", "key", "archive").alias("base"))
    parts = parts.join(keys, "key").select("key", "part", (F.col("base") + before("n", "part", "key")).alias("base"))
    placed = one.join(parts, ["key", "part"])
    return placed.select("key", "archive", (F.col("base") + before("length", "digest", "key", "part")).cast("long").alias("offset"), "length", "digest", "copies")


@dataclass
class Tree:
    """nodes: level, node, digest, start, end, archive (start and end are offsets, of leaves and nodes inside one archive)."""

    nodes: DataFrame
    height: int

    def level(self, n: int) -> DataFrame:
        return self.nodes.where(F.col("level") == n).drop("level")

    def root(self) -> str | None:
        top = self.level(self.height).select(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", F.format_string("%020d", F.col("node")), "digest")))), 256)).first()
        return top[0] if not self.level(self.height).isEmpty() else None


def _height(*tables: DataFrame) -> int:
    """Levels until nodes -1 and 0 are all that is left, whichever table is the larger."""
    most = 0
    for t in tables:
        low, high = t.agg(F.min("key"), F.max("key")).first()
        if low is not None:
            most = max(most, abs(low), abs(high) + 1)
    n = 0
    while FAN**n < most:
        n += 1
    return n


def tree(found: DataFrame, height: int, scratch: Scratch, placement: bool = False) -> Tree:
    """Written Merkle tree over the keys of records(); with `placement`, a leaf's digest is two, of what its records hold and of where each lies."""
    copies = F.col("copies") if "copies" in found.columns else F.lit(1)

    def of_all(digest):
        """A digest of a leaf's records' digests, in whatever order they come."""
        sums = (F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") * copies).cast("string") for k in range(4))
        return F.sha2(F.concat_ws(":", F.sum(copies).cast("string"), *sums), 256)

    digest = of_all(F.sha2(F.col("digest"), 256))
    if placement:
        where = F.concat_ws(":", "digest", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("archive", "offset", "length")))
        digest = F.concat_ws(":", digest, of_all(F.sha2(where, 256)))
    level = scratch.keep(
        found.groupBy(F.col("key").alias("node")).agg(digest.alias("digest"), F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("archive").alias("archive"))
    )
    nodes = level.withColumn("level", F.lit(0))
    for n in range(1, height + 1):
        parent = F.floor(F.col("node") / FAN).cast("long").alias("node")
        child = F.concat_ws(":", F.pmod("node", F.lit(FAN)).cast("string"), "digest")
        one = F.min("archive") == F.max("archive")
        up = level.groupBy(parent).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(child))), 256).alias("digest"), F.when(one, F.min("start")).alias("start"), F.when(one, F.max("end")).alias("end"), F.when(one, F.min("archive")).alias("archive"))
        level = scratch.keep(up)
        nodes = nodes.unionByName(level.withColumn("level", F.lit(n)))
    return Tree(nodes, height)


def mismatches(a: Tree, b: Tree, level: int, within: DataFrame | None) -> DataFrame:
    """Nodes of a level whose hashes differ, below the parents in `within` (None: all)."""

    def side(t: Tree, name: str) -> DataFrame:
        here = t.level(level).select("node", F.col("digest").alias(name))
        if within is None:
            return here
        return here.withColumn("parent", F.floor(F.col("node") / FAN).cast("long")).join(within.select(F.col("node").alias("parent")), "parent", "left_semi").drop("parent")

    both = side(a, "x").join(side(b, "y"), "node", "full")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("node", "x", "y")


def audit(left: DataFrame, right: DataFrame, placement: bool = False) -> DataFrame:
    """page_id, status (changed, missing, extra; with `placement` also moved: the same bytes elsewhere), archive, offset, length: the records of the left replica that the right one does not hold as they are, and its extra ones (with its own offsets)."""
    scratch = Scratch(left.sparkSession, "fixity")
    left, right = scratch.keep(left), scratch.keep(right)
    height = _height(left, right)
    a, b = tree(left, height, scratch, placement), tree(right, height, scratch, placement)
    within = None
    if a.root() == b.root():
        within = a.level(0).select("node").limit(0)
    else:
        for level in range(height, 0, -1):
            within = scratch.keep(mismatches(a, b, level, within))
    leaves = mismatches(a, b, 0, within)
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra")
    if placement:
        status = status.when(F.substring_index("x", ":", 1) == F.substring_index("y", ":", 1), "moved")
    status = status.otherwise("changed")
    place = a.level(0).withColumn("own", F.lit(True)).unionByName(b.level(0).withColumn("own", F.lit(False)))
    found = leaves.select("node", status.alias("status"), F.col("x").isNotNull().alias("own"))
    return found.join(place.select("node", "own", "archive", "start", "end"), ["node", "own"]).select(F.col("node").alias("page_id"), "status", "archive", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"))


def damaged(found: DataFrame) -> DataFrame:
    """Records of a second replica with known faults, by key: every 97th (rest 13) has another digest, every 101st (rest 17) is gone, every 89th (rest 5) lies 64 bytes on."""
    key = F.col("key")
    altered = F.when(F.pmod(key, F.lit(97)) == 13, F.sha2(F.concat("digest", F.lit("~")), 256)).otherwise(F.col("digest"))
    moved = F.col("offset") + F.when(F.pmod(key, F.lit(89)) == 5, F.lit(64)).otherwise(F.lit(0))
    return found.where(F.pmod(key, F.lit(101)) != 17).withColumns({"digest": altered, "offset": moved})
