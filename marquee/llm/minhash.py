"""Near duplicates by circulant MinHash.

Signatures (Li & Li, 2022): a permutation s of the 32-bit numbers scatters the shingles, and coordinate k is
the least p(s(x) + k mod 2^32) over the set: one more permutation p, shifted circularly, serves all
coordinates. Bands of the signature are the buckets.

1. Texts with the same shingle set are one class, named by its smallest doc_id. What follows is on classes.
2. In each bucket every class is paired with the bucket's smallest class. Each class first verifies the
   partner it meets most often, then, where those links have left both in different components, the others.
3. Where a bucket still spans several components, a link inside it may have been missed: the classes in
   such buckets go through an exact join on prefixes (Bayardo et al. 2007; Xiao et al. 2008). Their shingles are ordered
   by frequency; of two sets with the similarity, the rarest quarter of the larger one holds one of the rarest
   seventh of the smaller one, and what follows the first shared one must be large enough. Only pairs in
   different components are kept.
Pairs are verified on full sets. A bucket is never expanded into all its pairs, and has no cap.

With 40 bands of 4 a link of similarity 0.75 shares no bucket at all with probability 3e-7.

Defined results: a null or empty text has no shingle, its own id as component and is kept. A null id is
replaced by a number from 2^62 on that is made from the text, so it never is the smallest beside a real id; it is
given back as null, and the number shows only as a component without any real id. Rows that repeat a doc_id are one document: their links are pooled,
and they are kept or dropped alike. Other columns are not used. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import key_of, keyed_documents, numbered, stage
from marquee.llm.components import components
from marquee.llm.textarrays import U64, gram_hashes, shingle_sets, slices

K, PERCENT, BANDS, ROWS = 5, 75, 40, 4
U32 = np.uint32
#: Shingles of one document that are permuted at a time.
BLOCK = 4096


def permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection on 32 bits, in place."""
    x ^= x >> U32(16)
    x *= U32(first)
    x ^= x >> U32(13)
    x *= U32(second)
    x ^= x >> U32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` coordinates of a set of 64-bit shingles (not empty)."""
    scattered = permute(shingles.astype(U32), 0x85EBCA6B, 0xC2B2AE35)
    shifts = np.arange(size, dtype=U32)[:, None]
    low = np.full(size, 0xFFFFFFFF, U32)
    for i in range(0, len(scattered), BLOCK):
        np.minimum(low, permute(scattered[None, i:i + BLOCK] + shifts, 0x7FEB352D, 0x846CA68B).min(axis=1), out=low)
    return low


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """One bucket key per band."""
    rows = len(coordinates) // bands
    numbered = np.concatenate([coordinates.reshape(bands, rows).astype(U64), np.arange(1, bands + 1, dtype=U64)[:, None]], axis=1)
    return gram_hashes(numbered.ravel(), rows + 1)[::rows + 1]


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = K) -> DataFrame:
    """(doc_id, unnamed, n_shingles, set_key, buckets) of (doc_id, text, unnamed); the last two are null without a shingle."""

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for first, last, data, offsets in slices(batch.column(1)):
                sizes, keys, buckets = [], [], []
                for shingles in shingle_sets(data, offsets, k):
                    sizes.append(len(shingles))
                    keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                    buckets.append(band_keys(signature(shingles, bands * rows), bands).view(np.int64) if len(shingles) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "unnamed", "n_shingles", "set_key", "buckets"])

    return docs.mapInArrow(sign, "doc_id long, unnamed boolean, n_shingles long, set_key binary, buckets array<long>")


def similar(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """The (a, b) whose full sets have the similarity. texts: (cid, text); the pairs carry no text until here."""
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for batch in parts:
            keep = []
            for i in range(batch.num_rows):
                raw = batch.column(3)[i].as_buffer()
                if last is None or not last.equals(raw):  # the rows come sorted by b as a rule
                    last, y = raw, one_set(batch.column(3).slice(i, 1), k)
                x = one_set(batch.column(2).slice(i, 1), k)
                both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def one_set(column: pa.Array, k: int) -> np.ndarray:
    return next(shingle_sets(*next(slices(column))[2:], k))


def prefix_pairs(labelled: DataFrame, texts: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """Pairs that may be similar and lie in different components, by an exact join on prefixes.

    labelled: (cid, component) of the classes to compare. Every shingle of theirs is counted to put the rare ones first.
    """

    def explode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(batch.num_rows):
                shingles = one_set(batch.column(2).slice(i, 1), k).view(np.int64)
                n = len(shingles)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(j)[i].as_py(), np.int64)) for j in (0, 1)] + [pa.array(np.full(n, n, np.int64)), pa.array(shingles)],
                    ["cid", "component", "n", "shingle"])

    # Written, because it is counted and joined: otherwise the texts would be shingled twice.
    rows = stage(labelled.join(texts, "cid").select("cid", "component", "text").mapInArrow(explode, "cid long, component long, n long, shingle long"), "shingles")
    counted = rows.join(rows.groupBy("shingle").agg(F.count("*").alias("df")), "shingle").filter("df > 1")
    # Shingles of one set alone meet nothing, yet take places in the prefix: df = 1 comes first in the order.
    singles = counted.groupBy("cid").agg(F.count("*").alias("shared"))
    # array_sort is within one set, as large as its text.
    ordered = (counted.groupBy("cid", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
               .join(singles, "cid").select("cid", "component", "n", F.posexplode("s").alias("i", "x"), "shared")
               .select("cid", "component", "n", (F.col("i") + F.col("n") - F.col("shared")).alias("place"), F.col("x.shingle").alias("shingle")))
    # n sets places 0 .. n - ceil(p n / 100) for the larger set, n - ceil(2 p n / (100 + p)), which are fewer, for the smaller one.
    larger = stage(ordered.filter(F.col("place") <= F.col("n") - F.expr(f"({percent} * n + 99) div 100")), "prefixes")
    smaller = larger.filter(F.col("place") <= F.col("n") - F.expr(f"(2 * {percent} * n + {99 + percent}) div {100 + percent}"))
    # A shingle within one component has nothing to add; it is left out before the join.
    across = larger.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("shingle")
    big, small = larger.join(across, "shingle", "left_semi"), smaller.join(across, "shingle", "left_semi")
    x, y = (side.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("cid", "component", "n", "place")]) for side, s in ((big, "x"), (small, "y")))
    # At the first shingle that two sets share, all they share lies in what follows it in either of them.
    enough = f"{100 + percent} * least(n_x - place_x, n_y - place_y) >= {percent} * (n_x + n_y)"
    return (x.join(y, "shingle").filter(f"component_x <> component_y and n_y <= n_x and 100 * n_y >= {percent} * n_x and {enough}")
            .select(F.greatest("cid_x", "cid_y").alias("a"), F.least("cid_x", "cid_y").alias("b")).distinct())


def with_component(nodes: DataFrame, found: DataFrame | None, name: str = "cid", out: str = "component") -> DataFrame:
    """Adds the component of the node in column ``name``; a node without links is its own."""
    if found is None:
        return nodes.withColumn(out, F.col(name))
    named = found.select(F.col("node").alias(name), F.col("component").alias(out))
    return nodes.join(named, name, "left").withColumn(out, F.coalesce(out, name))


def grouped(docs: DataFrame, percent: int, bands: int, rows: int, k: int) -> DataFrame:
    """(doc_id, unnamed, n_shingles, component, kept) with stand-ins for null ids."""
    texts = keyed_documents(docs)
    each = stage(signed(texts, bands, rows, k), "signatures")
    # buckets follow from the set, so as a grouping key they change nothing
    classes = stage(each.filter("set_key is not null").groupBy("set_key", "buckets").agg(F.min("doc_id").alias("cid")), "classes")
    members = classes.select("cid", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("cid").alias("b"), F.max("cid").alias("top")).filter("b < top").select("bucket", "b")
    met = stage(members.join(shared, "bucket").select("bucket", F.col("cid").alias("a"), "b"), "met")
    stars = met.filter("a > b").groupBy("a", "b").agg(F.count("*").alias("times"))
    active = met.select(F.col("a").alias("cid")).distinct()
    class_texts = stage(texts.select(F.col("doc_id").alias("cid"), "text").join(active, "cid", "left_semi"), "texts")

    best = stars.groupBy("a").agg(F.max_by("b", F.struct("times", -F.col("b"))).alias("b"))
    links = stage(similar(best, class_texts, percent, k), "links-best")
    found = components(links)
    rest = with_component(with_component(stars.join(best, ["a", "b"], "left_anti"), found, "a", "ca"), found, "b", "cb")
    links = links.union(stage(similar(rest.filter("ca <> cb").select("a", "b"), class_texts, percent, k), "links-rest"))
    found = components(links)

    labelled = with_component(met.select("bucket", F.col("a").alias("cid")), found)
    spanning = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket")
    open_classes = stage(labelled.join(spanning, "bucket", "left_semi").select("cid", "component").distinct(), "open")
    links = links.union(stage(similar(prefix_pairs(open_classes, class_texts, percent, k), class_texts, percent, k), "links-prefix"))
    found = components(links)

    placed = with_component(classes.select("set_key", "cid"), found).select("set_key", "component")
    return (each.select("doc_id", "unnamed", "n_shingles", "set_key").join(placed, "set_key", "left")
            .select("doc_id", "unnamed", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    return grouped(docs, percent, bands, rows, k).select(F.expr("if(unnamed, null, doc_id)").alias("doc_id"), "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, k: int = K) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names."""
    # Written first, so that Spark knows its size: where it is small enough to be broadcast, no text is shuffled.
    dropped = stage(grouped(docs, percent, bands, rows, k).filter("not kept").select(F.col("doc_id").alias("key")).distinct(), "dropped")
    key = key_of(*[F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text")])
    return numbered(docs).withColumn("key", key).join(dropped, "key", "left_anti").drop("key").toDF(*docs.columns)
