"""Exact duplicates against an immutable snapshot, screened by static binary fuse filters.

A snapshot is a table of exact buckets, one row per digest with the smallest doc_id and the number of
rows, and one filter per shard of the digests. Incoming rows are grouped by digest first, which also
finds the duplicates within the new batch. Each shard's digests are then screened with that shard's
filter; only what the filter reports is joined with the buckets. Rows of groups with more than one
row are compared by their bytes with the row that stays; a row that differs (digests that collide)
goes to a group of rows with its own bytes.

A digest that holds a third of all rows is one row after the map-side aggregation; joins of rows with
their group have one row per digest on the other side, a written table, so Spark can split a hot one.

Defined results: null text counts as empty. Rows with a null id are new ones; they stay only in a group
without any id (keep_id is then null). Rows that repeat a doc_id with the same text are
all kept or all dropped. Other columns are not used; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm import fuse_filter
from marquee.llm.common import documents, stage

#: Digests of a shard, about; a filter of so many keys takes some 300 KB.
SHARD = 250_000


class Snapshot(NamedTuple):
    buckets: DataFrame  #: shard, key, digest, keep_id, n
    filters: DataFrame  #: shard, blob
    shards: int


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest. Its last 15 hex digits are the key of filters and shards."""
    key = F.conv(F.right(F.hex("digest"), F.lit(15)), 16, 10).cast("long")
    return (rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
            .select((key % shards).cast("int").alias("shard"), key.alias("key"), "digest", "keep_id", "n"))


def _filter_of(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [group["shard"].iloc[0]], "blob": [fuse_filter.build(group["key"].to_numpy(np.int64))]})


def snapshot(rows: DataFrame, shards: int) -> Snapshot:
    """Build a snapshot of (doc_id, digest). It is written once and never changed."""
    buckets = stage(_grouped(rows, shards), "buckets")
    return Snapshot(buckets, stage(buckets.select("shard", "key").groupBy("shard").applyInPandas(_filter_of, "shard int, blob binary"), "filters"), shards)


def screen(incoming: DataFrame, snap: Snapshot) -> DataFrame:
    """Incoming groups with a column ``reported``: false if the digest is surely not in the snapshot."""

    def look(keys: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        found = fuse_filter.contains(blobs["blob"].iloc[0], keys["key"].to_numpy(np.int64)) if len(blobs) else np.zeros(len(keys), bool)
        return keys.assign(reported=found)

    return (incoming.groupBy("shard").cogroup(snap.filters.groupBy("shard"))
            .applyInPandas(look, "shard int, key long, digest binary, keep_id long, n long, reported boolean"))


def group_batch(rows: DataFrame, snap: Snapshot) -> DataFrame:
    """(digest, keep_id, n) of everything in the snapshot or the new rows."""
    screened = stage(screen(_grouped(rows, snap.shards), snap), "screened")
    old = snap.buckets.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
    positives = screened.filter("reported").select("digest", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
    # Reported digests meet their exact buckets; those the filter reported wrongly come out as new ones.
    met = old.join(positives, "digest", "full_outer").select(
        "digest", F.least("old_id", "new_id").alias("keep_id"),
        (F.coalesce("old_n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n"))
    return met.union(screened.filter("not reported").select("digest", "keep_id", "n"))


def exact_duplicates(docs: DataFrame, known: Column | None = None, digest=sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``known`` says which rows form the snapshot (by default those in the lower half of the range of
    ids); ``digest`` makes the digest of a normalised text.
    """
    texts = documents(docs).select("doc_id", normalised(F.col("text")).alias("text"))
    size = documents(docs).agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    shards = max(1, -(-size["n"] // SHARD))
    if known is None:
        known = F.col("doc_id") <= ((size["low"] or 0) + (size["high"] or 0)) // 2
    rows = stage(texts.select("doc_id", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256"),
                              F.coalesce(known, F.lit(False)).alias("known")), "digests")
    snap = snapshot(rows.filter("known"), shards)
    groups = stage(group_batch(rows.filter("not known"), snap), "groups")
    odd = stage(different(texts.withColumn("digest", digest(F.col("text"))), groups.filter("n > 1")), "collisions")
    own = odd.groupBy("digest", "text").agg(F.min("doc_id").alias("own_id"), F.count("*").alias("own_n"))
    apart = odd.groupBy("digest").agg(F.count("*").alias("apart"))
    # Written tables on the side of the groups: only between plain shuffles can Spark split a hot digest.
    moved = stage(odd.join(own, ["digest", "text"]).select("digest", F.sha2("text", 256).alias("text_sha256"), "own_id", "own_n").distinct(), "moved")
    counted = stage(groups.join(apart, "digest", "left").select("digest", "keep_id", (F.col("n") - F.coalesce("apart", F.lit(0))).alias("n")), "counted")
    return (rows.join(counted, "digest").join(moved, ["digest", "text_sha256"], "left")
            .select("doc_id", F.when(F.col("own_n").isNull(), F.col("keep_id")).otherwise(F.col("own_id")).alias("keep_id"),
                    F.coalesce("own_n", "n").alias("group_size"), "text_sha256")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def different(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (doc_id, digest, text) whose bytes are not those of the row that stays in their group."""
    members = stage(texts.join(groups.select("digest", "keep_id"), "digest"), "members")
    stays = stage(members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("stays")), "stays")
    return members.join(stays, "digest").filter("text <> stays").select("doc_id", "digest", "text")
