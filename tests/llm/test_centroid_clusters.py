import hashlib
import math
import random

import pytest

from marquee.llm import centroid_clusters as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, `a.b` int"


def plain(rows, clusters=16, rounds=3, dimension=64, scale=64):
    """Every vector against every centroid in every round."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((k for k in kept if k[0] is not None), key=lambda k: (hashlib.sha256(f"1:{k[0]}".encode()).hexdigest(), k[1]))[:clusters]
    centroids = [x for _, x in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x), (_, k) in zip(kept, found) if k == j]
            if mine:
                centroids[j] = [sum(column) // len(mine) for column in zip(*mine)]
    found = assign()
    total = sum(d for d, _ in found)
    return [(i, j, d, sum(e for e, k in found if k == j), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
            for (i, _), (d, j) in zip(kept, found)]


def check(spark, rows, partitions=3, **options):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(partitions)
    got = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in C.cluster(df, **options).collect()]
    as_floats = [(i, None if v is None else [None if x is None else __import__("numpy").float32(x).item() for x in v]) for i, v in rows]
    assert sorted(got, key=repr) == sorted(plain(as_floats, **options), key=repr)


def test_agrees_with_plain_rounds(spark):
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [rng.gauss(m, 0.4) for m in rng.choice(centres)]) for i in range(400)]
    check(spark, rows)


def test_ties_repeats_nulls_and_bad_vectors(spark):
    rng = random.Random(4)
    grid = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(64)]) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [float("nan")] + [1.0] * 63), (106, [float("inf")] * 64)]
    check(spark, grid + grid[:20] + bad + [(None, [0.5] * 64)] + [(200, [0.0] * 64)] * 30)


def test_few_equal_and_no_vectors(spark):
    check(spark, [(1, [0.25] * 64), (2, [-0.25] * 64)])
    check(spark, [(i, [0.1] * 64) for i in range(40)])
    check(spark, [])
    check(spark, [(1, None)])


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    check(spark, [(i, [rng.uniform(-4e5, 4e5) for _ in range(64)]) for i in range(50)])


def test_sums_beyond_a_long_are_null(spark):
    rows = [(i, [2e6 * (-1) ** i] * 64) for i in range(40)] + [(99, [3e6] * 64)]
    got = C.cluster(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA), clusters=1).collect()
    assert len(got) == 40 and {(r.cluster, r.cluster_inertia, r.inertia) for r in got} == {(0, None, None)}


@pytest.mark.parametrize("options", [dict(clusters=1), dict(rounds=0), dict(clusters=3, rounds=9)])
def test_other_options(spark, options):
    rng = random.Random(6)
    check(spark, [(i, [rng.gauss(0, 0.3) for _ in range(64)]) for i in range(60)], **options)


def test_only_expired_gaps_are_popped(spark, monkeypatch):
    """Well separated clusters: after the first scan almost nothing is scanned again, and every entry lives in one run."""
    rng = random.Random(7)
    centres = [[rng.choice([-3.0, 3.0]) for _ in range(64)] for _ in range(4)]
    rows = [(i, [m + rng.uniform(-0.05, 0.05) for m in centres[i % 4]]) for i in range(200)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    sizes = []
    write = C.write_run
    monkeypatch.setattr(C, "write_run", lambda entries, name: sizes.append((run := write(entries, name)).count()) or run)
    assert C.cluster(df, clusters=4).count() == 200
    assert sizes[0] == 200 and sum(sizes[1:]) < 800 and sizes[-1] < 200
