import hashlib

import pytest
from pyspark.sql import functions as F

from marquee.llm import warc_fixity as w

PAGES = "page_id long, url string, html string, archive int, digest string"


def pages(spark, n=300):
    rows = [(i, f"http://e.example/{i}", "x" * (i * 37 % 900)) for i in range(n)]
    rows += [(n, None, None), (None, "http://no.example", "id"), (7, "http://e.example/7", "x" * 259), (n + 1, "u", "long " * 40_000)]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], PAGES).repartition(4)


@pytest.mark.parametrize(("range_bytes", "fan"), [(w.RANGE, w.FAN), (512, 2), (2048, 3)])
def test_only_what_differs_is_reported(spark, range_bytes, fan):
    good = w.archive_index(w.page_records(pages(spark), 50))
    broken = F.col("place").isin(3, 49, 50, 222)
    bad = good.withColumn("digest", F.when(broken, F.lit("0" * 64)).otherwise(F.col("digest"))).filter(F.coalesce(F.col("place") != 120, F.lit(True)))
    bad = bad.union(spark.createDataFrame([(99, 1, 0, 5, "f" * 64)], bad.schema)).filter("archive <> 4")
    found = {(r.archive, r.offset): r.status for r in w.audit(good, bad, range_bytes, fan).collect()}
    at = {(r.archive, r.offset): r.place for r in good.collect()}
    expected = {k: "changed" for k, p in at.items() if p in (3, 49, 50)} | {k: "missing" for k, p in at.items() if p == 120 or k[0] == 4} | {(99, 0): "extra"}
    assert found == expected


def test_equal_and_empty_replicas(spark):
    index = w.archive_index(w.page_records(pages(spark, 40), 10))
    assert w.audit(index, index).count() == 0
    assert w.audit(index.limit(0), index.limit(0)).count() == 0
    assert w.audit(index.limit(0), index).count() == index.count() == 44


def test_records_and_offsets(spark):
    one = spark.createDataFrame([(1, "http://a", "é")], "page_id long, url string, html string")
    record = w.page_records(one).first().record
    assert record == ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a\r\nWARC-Payload-Digest: sha256:"
                      + hashlib.sha256("é".encode()).hexdigest() + "\r\nContent-Length: 2\r\n\r\né\r\n\r\n")
    index = sorted((r.archive, r.offset, r.length) for r in w.archive_index(w.page_records(pages(spark), 50)).collect())
    for (a, offset, length), (b, following, _) in zip(index, index[1:], strict=False):
        assert following == (offset + length if a == b else 0)
