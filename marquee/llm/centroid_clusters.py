"""Exact centroid clustering on whole numbers, with heaps of bound gaps as sorted runs.

A vector's upper bound is its distance to its centroid and its lower bound that to the next one, when last scanned. When centroids move,
the gap between the two shrinks by at most the centroid's own drift and the greatest drift of another one. Instead of touching
every vector, each cluster adds up that drift (its offset); a vector is kept under the key gap + offset of the day it was
scanned, and its gap has expired when the offset reaches the key. A cluster's heap is a set of runs: each round writes the
vectors that it scanned, sorted by cluster and key, and a heap's top is the range of keys that the offset has passed since
the last round. Popping is a filter on that range, which the sorted files answer from their statistics; whatever lies
beyond is not read. A popped vector is scanned against all centroids and written to the new run under its new
cluster and key, so an entry is alive as long as its key lies above its cluster's offset, and nothing is ever deleted.

Centroids come from sums that change only by the vectors that change cluster. All sums, distances and centroids are whole numbers; bounds are
floating-point numbers with a slack far above their error, so ties and near ties are always scanned. The driver holds the centroids
and one row per cluster.

Kept are vectors of the wanted number of components without null, NaN or infinite ones, whose scaled components lie within 2^27 (so that squared
distances fit a long; a sum of distances that does not is null). Fewer kept vectors than clusters: each is a centroid. A null id is clustered, but begins no cluster.
Rows that repeat an id are vectors of their own. Equal distances: the smaller cluster number. No kept vector: no row. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import stage

CLUSTERS, ROUNDS, DIMENSION, SCALE, SEED = 16, 3, 64, 64, 1
LIMIT = 1 << 27
#: Added to offsets in every round, and half of it to keys: far more than the rounding error of the bounds.
SLACK = 1e-3
ENTRY = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("was", pa.int32()), ("cluster", pa.int32()), ("key", pa.float64())])
ENTRY_DDL = "vec_id long, x array<int>, was int, cluster int, key double"
#: Bytes of a row group of a run, the unit that a key range can skip.
ROW_GROUP = 8 << 20


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the kept vectors with every component turned into floor(scale * component)."""
    scaled = F.transform(F.col(vector_col), lambda v: scale * v.cast("double"))
    right = (F.size(vector_col) == dimension) & F.forall(scaled, lambda v: F.coalesce((v >= -LIMIT) & (v <= LIMIT) & ~F.isnan(v), F.lit(False)))
    return df.filter(right).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(scaled, lambda v: F.floor(v).cast("int")).alias("x"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest digests of 'seed:id', in their order; equal ids by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.filter(F.col("vec_id").isNotNull()).orderBy(digest, "x").limit(clusters)
    return [list(r.x) for r in first.select("x").collect()]


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Whole squared distances, as one product of matrices where floating-point numbers hold them exactly."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 21:
        f, c = x.astype("f8"), centroids.astype("f8")
        return ((f * f).sum(1)[:, None] + (c * c).sum(1) - 2 * f @ c.T).astype("i8")
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def vectors_of(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy().astype("i8").reshape(-1, dimension)


def scan(entries: DataFrame, centroids: list[list[int]], offsets: list[float], dimension: int) -> DataFrame:
    """Entries (vec_id, x, was) with their nearest centroid and the key under which its heap keeps them."""
    wanted, offset = np.array(centroids, "i8"), np.array(offsets, "f8")

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            d = squared_distances(vectors_of(batch.column(1), dimension), wanted)
            cluster = d.argmin(1)  # the first of equal ones
            best = d[np.arange(len(d)), cluster]
            if len(wanted) > 1:
                d[np.arange(len(d)), cluster] = np.iinfo("i8").max
                gap = np.sqrt(d.min(1).astype("f8")) - np.sqrt(best.astype("f8"))
            else:
                gap = np.full(len(d), np.inf)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(cluster, pa.int32()), pa.array(gap + offset[cluster] + SLACK / 2, pa.float64())], schema=ENTRY)

    return entries.select("vec_id", "x", "was").mapInArrow(nearest, ENTRY_DDL)


def write_run(entries: DataFrame, name: str) -> DataFrame:
    """A run of the heaps: sorted by cluster and key in every file, in small row groups; written and read back."""
    with_groups = entries.sortWithinPartitions("cluster", "key")
    return stage(with_groups, name, {"parquet.block.size": str(ROW_GROUP)})


def in_range(bounds: list[tuple[float, float]]) -> Column:
    """Whether an entry's key lies in its cluster's range (low, high]: parts of Parquet files outside are skipped."""
    found = F.lit(False)
    for number, (low, high) in enumerate(bounds):
        if high > low:
            found = found | ((F.col("cluster") == number) & (F.col("key") > low) & (F.col("key") <= high))
    return found


def changed_sums(run: DataFrame, dimension: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, count, sums): what the run adds to the clusters, its vectors, less those that were in another cluster before."""
    moved = run.filter((F.col("was") < 0) | (F.col("was") != F.col("cluster"))).select(
        "x", F.explode(F.array(F.struct(F.col("cluster").alias("number"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("number"), F.lit(-1).alias("sign")))).alias("m"))
    sums = (moved.filter("m.number >= 0").groupBy("m.number")
            .agg(F.sum("m.sign").alias("n"), *[F.sum(F.col("x")[i].cast("long") * F.col("m.sign")).alias(f"s{i}") for i in range(dimension)]).collect())
    return [(r["number"], r["n"], [r[f"s{i}"] for i in range(dimension)]) for r in sums]


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION,
            scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    vectors = whole_vectors(df, id_col, vector_col, dimension, scale)
    centroids = first_centroids(vectors, clusters, seed) or [[0] * dimension]
    k = len(centroids)
    offsets, before = [0.0] * k, [-math.inf] * k
    sums, counts = [[0] * dimension for _ in range(k)], [0] * k
    runs = [write_run(scan(vectors.withColumn("was", F.lit(-1)), centroids, offsets, dimension), "clusters-run0")]
    for number in range(rounds):
        for j, n, added in changed_sums(runs[-1], dimension):
            counts[j] += n
            sums[j] = [s + m for s, m in zip(sums[j], added, strict=True)]
        moved = [[s // counts[j] for s in sums[j]] if counts[j] else centroids[j] for j in range(k)]
        drift = [math.sqrt(sum((a - b) ** 2 for a, b in zip(centroids[j], moved[j], strict=True))) for j in range(k)]
        centroids, before = moved, offsets
        offsets = [offsets[j] + drift[j] + max([d for i, d in enumerate(drift) if i != j], default=0.0) + SLACK for j in range(k)]
        # what has expired since the last round is popped from every heap, scanned, and written as a new run
        expired = in_range(list(zip(before, offsets, strict=True)))
        popped = union([run.filter(expired) for run in runs]).select("vec_id", "x", F.col("cluster").alias("was"))
        runs.append(write_run(scan(popped, centroids, offsets, dimension), f"clusters-run{number + 1}"))
    alive = in_range([(offset, math.inf) for offset in offsets])
    return described(union([run.filter(alive) for run in runs]), centroids, dimension)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def described(entries: DataFrame, centroids: list[list[int]], dimension: int) -> DataFrame:
    """Entries with their distance, the sums of the distances, and their centroid's digest."""
    wanted = np.array(centroids, "i8")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            number = batch.column(2).to_numpy()
            distance = ((vectors_of(batch.column(1), dimension) - wanted[number]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    measured = stage(entries.select("vec_id", "x", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long"), "clusters-distances")
    inertia = {r["cluster"]: int(r["s"]) for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    number = F.col("cluster") + 1

    def long(value: int) -> Column:
        return F.lit(value if value < 1 << 63 else None).cast("long")

    of_cluster = F.array(*[long(inertia.get(j, 0)) for j in range(len(centroids))])
    return measured.select("vec_id", "cluster", "distance", F.element_at(of_cluster, number).alias("cluster_inertia"),
                           long(sum(inertia.values())).alias("inertia"),
                           F.element_at(F.array(*map(F.lit, names)), number).alias("centroid_sha256"))
