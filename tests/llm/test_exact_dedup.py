import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import exact_dedup, fuse_filter

ROWS = [(1, "a  b"), (2, "a b"), (3, "A b"), (4, None), (5, ""), (6, " "), (7, "a\t\nb"), (8, "\xa0"), (None, "a b"), (None, "lone"), (None, "lone"),
        (9, "again"), (9, "again"), (10, "long " * 50_000), (11, "long " * 50_000), (12, "a b ")]


def expected(rows):
    texts = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in texts:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in texts:
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("known", [None, "false", "true", "doc_id % 2 = 0"])
def test_any_snapshot_gives_the_same_groups(documents, known):
    assert got(exact_dedup.exact_duplicates(documents(ROWS), known and F.expr(known))) == expected(ROWS)


def test_digests_that_collide_are_told_apart_by_bytes(documents):
    weak = lambda text: F.substring(F.encode(text, "utf-8"), 1, 1)
    assert got(exact_dedup.exact_duplicates(documents(ROWS), F.col("doc_id") < 6, weak)) == expected(ROWS)


def test_empty_table(documents):
    assert exact_dedup.exact_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50_000])
def test_filter_misses_nothing_and_reports_little_else(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 60, n, dtype=np.int64)
    blob = fuse_filter.build(np.concatenate([keys, keys[:5]]))
    assert fuse_filter.contains(blob, keys).all()
    others = rng.integers(0, 1 << 60, 100_000, dtype=np.int64)
    assert fuse_filter.contains(blob, others).mean() < 0.01
    assert n < 50_000 or len(blob) < 1.3 * n


def test_screen_joins_few_digests_beyond_the_known_ones(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), exact_dedup.sha256(F.col("id").cast("string")).alias("digest"))
    snap = exact_dedup.snapshot(rows.filter("doc_id < 2000"), 4)
    seen = exact_dedup.screen(exact_dedup._grouped(rows.filter("doc_id >= 1000"), 4), snap).groupBy((F.col("keep_id") < 2000).alias("old")).agg(
        F.sum(F.col("reported").cast("int")).alias("n")).collect()
    counts = {r.old: r.n for r in seen}
    assert counts[True] == 1000 and counts[False] < 40
