"""Fixity audit of WARC archives with Merkle trees.

A record's digest and length are taken where it is read; its bytes never move. Leaves are ordered ranges of
an archive's offsets, each with the hash of its records' offsets, lengths and digests; a node is the hash of
its ``fan`` children. Of two replicas the roots are compared first, then level by level the children of
the nodes that differ, and at last the records in the ranges that differ.

A group is never larger than ``fan`` children or the records that begin in one range. Offsets are running sums
within an archive, over narrow rows.

Defined results: null fields are empty in a record. Pages without an id form archives by their content.
Records that repeat are stored as often as they occur. An archive that only one replica has is reported
record by record. Replicas that agree, empty ones too, give no row. Other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import stage

RECORDS, RANGE, FAN = 1000, 64 << 10, 16


def warc_record(url: Column, payload: Column) -> Column:
    """The text of a WARC/1.0 response record."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(payload, 256),
                    F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def archive_index(records: DataFrame) -> DataFrame:
    """(archive, place, offset, length, digest) of (archive, place, record): records lie one after another by place."""
    read = records.select("archive", "place", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    before = Window.partitionBy("archive").orderBy("place", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return read.select("archive", "place", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")).alias("offset"), "length", "digest")


def page_records(pages: DataFrame, records: int = RECORDS) -> DataFrame:
    """Pages as records of archives with about ``records`` of them."""
    archive = F.coalesce(F.floor(F.col("page_id") / records), -1 - F.pmod(F.xxhash64("html"), F.lit(1 << 20)))
    return pages.select(archive.cast("long").alias("archive"), F.col("page_id").cast("long").alias("place"), warc_record(F.col("url"), F.col("html")).alias("record"))


def _above(level: DataFrame, fan: int) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return (level.groupBy("archive", F.floor(F.col("node") / fan).alias("parent")).agg(children.alias("c"))
            .select("archive", F.col("parent").alias("node"), F.sha2(F.concat_ws("|", F.transform("c", lambda x: F.concat_ws(":", x["node"], x["hash"]))), 256).alias("hash")))


def merkle_levels(index: DataFrame, depth: int, range_bytes: int = RANGE, fan: int = FAN) -> list[DataFrame]:
    """Levels of (archive, node, hash), ranges of offsets first, roots last."""
    entry = F.concat_ws(":", "offset", "length", "digest")
    # Offsets order the records; at most RANGE bytes of them begin in a range.
    leaf = (index.groupBy("archive", F.floor(F.col("offset") / range_bytes).alias("node"))
            .agg(F.array_sort(F.collect_list(F.struct("offset", entry.alias("e")))).alias("r"))
            .select("archive", "node", F.sha2(F.concat_ws("|", F.col("r.e")), 256).alias("hash")))
    levels = [stage(leaf, "merkle")]
    for _ in range(depth):
        levels.append(stage(_above(levels[-1], fan), "merkle"))
    return levels


def _differing(left: DataFrame, right: DataFrame, fan: int, above: DataFrame | None) -> DataFrame:
    """(archive, node) where two levels differ, among the children of the nodes above that do."""
    sides = [left, right]
    if above is not None:
        wanted = above.select("archive", F.col("node").alias("parent"))
        sides = [s.withColumn("parent", F.floor(F.col("node") / fan)).join(wanted, ["archive", "parent"], "left_semi").drop("parent") for s in sides]
    a, b = sides[0].withColumnRenamed("hash", "hash_a"), sides[1].withColumnRenamed("hash", "hash_b")
    return a.join(b, ["archive", "node"], "full_outer").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("archive", "node")


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE, fan: int = FAN) -> DataFrame:
    """Records that differ between two indexes: archive, offset, lengths and digests on both sides, and status.

    status: ``changed``, ``missing`` (on the right) or ``extra``.
    """
    left, right = stage(left, "index"), stage(right, "index")
    last = left.select("offset").union(right.select("offset")).agg(F.max("offset")).first()[0] or 0
    depth, reach = 0, range_bytes
    while reach <= last:
        depth, reach = depth + 1, reach * fan
    trees = [merkle_levels(side, depth, range_bytes, fan) for side in (left, right)]
    nodes = None
    for a, b in zip(*map(reversed, trees), strict=True):
        nodes = stage(_differing(a, b, fan, nodes), "differing")
    sides = [side.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(nodes, ["archive", "node"], "left_semi")
             .select("archive", "offset", F.col("length").alias(f"length_{s}"), F.col("digest").alias(f"digest_{s}")) for side, s in ((left, "a"), (right, "b"))]
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return (sides[0].join(sides[1], ["archive", "offset"], "full_outer")
            .filter(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).withColumn("status", status))
