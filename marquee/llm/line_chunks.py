"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines ends a chunk where it is divisible by ``divisor``,
two lines at the earliest, so chunks depend on their own lines only and inserted text moves no later border
for long. A line of ``long_words`` words or more is a chunk by itself. A short line that would be left alone at the end
of a text or before a long line belongs to the chunk before it, unless that one is a long line; a short line beside long ones
is part of their runs (see ``passages``), so with these, copies of a text of several lines are emptied whole. Chunks of several lines, and such long
lines, are counted over all documents; of those that repeat, the first one stays (in the document with the
smallest id, there the first place) and every other one is removed.

With ``passages``, repeats count beyond the borders of chunks as well: for each line the shortest run of several
whole lines from it on, and the shortest one up to it, that has ``long_words`` words. Every passage of so many words is
covered by such runs inside it, wherever it stands. The first place of a repeated run stays, every other
one that doesn't overlap it is removed, together with the chunks. The first place of a line in order of id and place
is never removed on account of a later one.

Bytes are compared by grouping on them together with their digest, which aggregates before the shuffle: a
chunk that a third of all documents hold is one row per task. Of runs, 64-bit hashes are counted first; only
those that repeat are compared by their bytes. The removal joins each document with its own list of digests and hashes.

Defined results: null text counts as empty and stays as it is; blank lines belong to the chunk before them; a text of
nothing but blank lines has no chunk. Documents without an id are told apart by their text and come after
all others. Rows that repeat a doc_id are one document: what only they share stays. An empty table gives no
row. Other columns are kept by ``dedup_lines`` and may have any name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import key_of, keyed_documents, numbered, stage, unused, with_fields
from marquee.llm.textarrays import U64, WHITE, gram_hashes, slices, span_hashes, spans

DIVISOR, LEAST_LINES, LONG_WORDS = 2, 2, 50
#: Bytes of chunk texts in one output batch, about.
BATCH_BYTES = 4 << 20


def digest_of(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def chunk_spans(column: pa.Array, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> Iterator[tuple[bytes, list[tuple[int, int, int, bool]]]]:
    """(text, chunks) of each row; a chunk: (start, end of its last line, start of the next chunk, whether it counts)."""
    for _, _, data, offsets in slices(column):
        newline = data == 0x0A
        starts, ends, first = spans(newline, offsets)
        hashes = span_hashes(data, starts, ends)
        pairs = gram_hashes(np.concatenate([np.zeros(1, U64), hashes]), 2)  # the hash up to each line
        cut = (pairs % U64(divisor) == 0).tolist()
        words = spans(WHITE[data], offsets)[0]
        long = (np.searchsorted(words, ends) - np.searchsorted(words, starts) >= long_words).tolist()
        starts, ends, first, raw = starts.tolist(), ends.tolist(), first.tolist(), data.tobytes()
        for row in range(len(offsets) - 1):
            low, high = int(offsets[row]), int(offsets[row + 1])
            chunks, begin = [], first[row]
            for line in range(first[row], first[row + 1]):
                last = line + 1 == first[row + 1]
                # The first line of a text has no neighbour before it; LEAST_LINES keeps its hash from being asked for.
                # No border leaves a short line alone at the end of a text or before a long line.
                if last or long[line] or long[line + 1] or (cut[line] and line - begin + 1 >= LEAST_LINES
                                                            and line + 2 < first[row + 1] and not long[line + 2]):
                    counts = line > begin or long[line]
                    chunks.append((starts[begin] - low, ends[line] - low, (high if last else starts[line + 1]) - low, counts))
                    begin = line + 1
            yield raw[low:high], chunks


def runs(data: np.ndarray, offsets: np.ndarray, long_words: int = LONG_WORDS) -> tuple[np.ndarray, ...]:
    """(row, start, end of the last line, start of what follows, hash) of the runs of several lines, by row and place."""
    starts, ends, first = spans(data == 0x0A, offsets)
    words = spans(WHITE[data], offsets)[0]
    before, upto = np.searchsorted(words, starts), np.searchsorted(words, ends)
    n, row = len(starts), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    from_it, up_to_it = np.searchsorted(upto, before + long_words), np.searchsorted(before, upto - long_words, "right") - 1
    i, j = np.concatenate([np.arange(n), up_to_it]), np.concatenate([from_it, np.arange(n)])
    inside = (i >= 0) & (j < n) & (i < j)
    i, j = i[inside], j[inside]
    # Lines of white space begin and end no run, so a line is in few runs.
    i, j = np.divmod(np.unique((i * n + j)[(row[i] == row[j]) & (before[i] < upto[i]) & (before[j] < upto[j])]), max(n, 1))
    row = row[i]
    following = np.where(j + 1 < first[row + 1], np.append(starts, 0)[j + 1], offsets[row + 1])
    return row, starts[i], ends[j], following, span_hashes(data, starts[i], ends[j]).view(np.int64)


def run_spans(column: pa.Array, long_words: int = LONG_WORDS) -> Iterator[list[tuple[int, int, int, int]]]:
    """The runs of each row: (start, end, start of what follows, hash)."""
    for _, _, data, offsets in slices(column):
        row, start, end, following, hashes = runs(data, offsets, long_words)
        low = offsets[row]
        found = list(zip((start - low).tolist(), (end - low).tolist(), (following - low).tolist(), hashes.tolist(), strict=True))
        edges = np.searchsorted(row, np.arange(len(offsets))).tolist()
        yield from (found[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))


def run_rows(texts: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, hash, times) of each different run of a document."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids = batch.column(0).to_numpy()
            for first_row, _, data, offsets in slices(batch.column(1)):
                row, _, _, _, hashes = runs(data, offsets, long_words)
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                heads = np.flatnonzero(np.concatenate([np.ones(min(len(row), 1), bool), (np.diff(row) != 0) | (np.diff(hashes) != 0)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (
                    ids[first_row + row[heads]], hashes[heads], np.diff(np.append(heads, len(row))))], ["doc_id", "hash", "times"])

    return texts.select("doc_id", "text").mapInArrow(cut, "doc_id long, hash long, times long")


def run_contents(asked: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(hash, content) of the runs asked for; asked: (text, hashes)."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def as_rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([c for _, c in found], pa.binary())], ["hash", "content"])

        for batch in parts:
            found, weight = [], 0
            for text, wanted, here in zip(batch.column(0), batch.column(1), run_spans(batch.column(0), long_words), strict=True):
                raw, wanted = text.as_py().encode(), set(wanted.as_py())
                for a, b, _, value in here:
                    if value in wanted:
                        found.append((value, raw[a:b]))
                        weight += b - a + 40
                        if weight >= BATCH_BYTES:
                            yield as_rows(found)
                            found, weight = [], 0
            if found:
                yield as_rows(found)

    return asked.select("text", "hashes").mapInArrow(cut, "hash long, content binary")


def repeated_runs(texts: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(hash, doc_id, times, first_id): the runs that occur more than once, by their bytes, in each document that has them."""
    rows = stage(run_rows(texts, long_words), "runs")
    again = stage(rows.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.sum("times").alias("n")).filter("n > 1").drop("n"), "again")
    hits = stage(rows.join(again, "hash"), "hits")
    asked = texts.select("doc_id", "text").join(hits.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes")), "doc_id")
    collided = stage(run_contents(asked, long_words).distinct().groupBy("hash").count().filter("count > 1").select("hash"), "collided")
    return hits.join(collided, "hash", "left_anti")


def chunk_rows(texts: DataFrame, contents: bool, **rules) -> DataFrame:
    """(doc_id, digest, times) of each different chunk of a document that counts, with its bytes if asked for."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "times"] + ["content"] * contents
        for batch in parts:
            rows: list[tuple] = []
            weight = 0
            for doc_id, (text, chunks) in zip(batch.column(0).to_pylist(), chunk_spans(batch.column(1), **rules), strict=True):
                for content, times in Counter(text[a:b] for a, b, _, counts in chunks if counts).items():
                    rows.append((doc_id, digest_of(content), times) + (content,) * contents)
                    weight += len(content) * contents + 40
                if weight >= BATCH_BYTES:
                    yield as_batch(rows, names)
                    rows, weight = [], 0
            if rows:
                yield as_batch(rows, names)

    return texts.select("doc_id", "text").mapInArrow(cut, "doc_id long, digest binary, times long" + ", content binary" * contents)


def as_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)


def repeated_chunks(texts: DataFrame, **rules) -> DataFrame:
    """(digest, first_id, n): chunks that occur more than once, by their bytes.

    Digests that stand for chunks with different bytes are left out, so nothing is removed on account of a collision.
    """
    same = (chunk_rows(texts, True, **rules).groupBy("digest", "content")
            .agg(F.min("doc_id").alias("first_id"), F.sum("times").alias("n")).select("digest", "first_id", "n"))
    return (same.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"), F.count("*").alias("variants"))
            .filter("variants = 1 and n > 1").drop("variants"))


def marks(texts: DataFrame, **rules) -> DataFrame:
    """(doc_id, elsewhere, here): the repeated chunks of each document that first occur elsewhere, and those that do here."""
    repeated = stage(repeated_chunks(texts, **rules), "repeated")
    found = chunk_rows(texts, False, **rules).join(repeated.drop("n"), "digest").filter("doc_id <> first_id or times > 1")
    own = F.col("doc_id") == F.col("first_id")
    return found.groupBy("doc_id").agg(F.collect_set(F.when(~own, F.col("digest"))).alias("elsewhere"),
                                       F.collect_set(F.when(own, F.col("digest"))).alias("here"))


def run_marks(texts: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, runs_elsewhere, runs_here): as ``marks``, of repeated runs by their hashes."""
    found, own = repeated_runs(texts, long_words).filter("doc_id <> first_id or times > 1"), F.col("doc_id") == F.col("first_id")
    return found.groupBy("doc_id").agg(F.collect_set(F.when(~own, F.col("hash"))).alias("runs_elsewhere"),
                                       F.collect_set(F.when(own, F.col("hash"))).alias("runs_here"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False, **rules) -> DataFrame:
    """All columns of docs with the text deduplicated, then three more: n_chunks, removed_chunks, removed_bytes (``_`` added if taken).

    With ``passages``, repeated runs of lines across the borders of chunks go too; removed_chunks counts the chunks that are gone whole.
    """
    texts = keyed_documents(docs, id_col, text_col)
    noted, run_rules = stage(marks(texts, **rules), "marks"), {k: v for k, v in rules.items() if k == "long_words"}
    if passages:
        noted = noted.join(stage(run_marks(texts, **run_rules), "run-marks"), "doc_id", "full")
    else:
        noted = noted.withColumns({n: F.expr("cast(null as array<bigint>)") for n in ("runs_elsewhere", "runs_here")})
    counts = [unused(docs, n) for n in ("n_chunks", "removed_chunks", "removed_bytes")]
    at, plain = docs.columns.index(text_col), numbered(docs)
    key = key_of(F.col(f"c{docs.columns.index(id_col)}"), F.col(f"c{at}"))
    joined = plain.withColumn("key", key).join(noted.withColumnRenamed("doc_id", "key"), "key", "left").drop("key")

    def ranges(text: bytes, chunks: list, here: list, marked: tuple) -> list[tuple[int, int]]:
        """What goes: (start, start of what follows), in order and without overlaps."""
        other, own, runs_other, runs_own = (set(m or ()) for m in marked)
        gone, seen, ends = [], set(), {}
        for a, b, following, counts_here in chunks if other or own else ():
            if counts_here:
                digest = digest_of(text[a:b])
                if digest in other or digest in seen:
                    gone.append((a, following))
                elif digest in own:
                    seen.add(digest)
        for a, b, following, value in here:
            if value in runs_other or (value in runs_own and a >= ends.setdefault(value, b)):
                gone.append((a, following))
        merged: list[tuple[int, int]] = []
        for a, following in sorted(gone):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(following, merged[-1][1]))
            else:
                merged.append((a, following))
        return merged

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            # Rows without marks keep their text; it is cut only to be counted.
            marked = zip(*(batch.column(batch.num_columns - k).to_pylist() for k in (4, 3, 2, 1)), strict=True)
            found = run_spans(batch.column(at), **run_rules) if passages else repeat([], batch.num_rows)
            texts, chunked, removed, lost = [], [], [], []
            for noted_here, here, (text, chunks) in zip(marked, found, chunk_spans(batch.column(at), **rules), strict=True):
                gone = ranges(text, chunks, here, noted_here) if any(noted_here) else []
                left = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)], strict=True))
                begins = [a for a, _ in gone]
                texts.append(left.decode() if gone else None)
                chunked.append(len(chunks))
                removed.append(sum((k := bisect_right(begins, a)) > 0 and b <= gone[k - 1][1] for a, b, *_ in chunks) if gone else 0)
                lost.append(len(text) - len(left))
            columns = list(batch.columns[:-4])
            texts = pa.array(texts, columns[at].type)
            columns[at] = pc.coalesce(texts, columns[at])
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in (chunked, removed, lost))], [*batch.schema.names[:-4], "n_chunks", "removed_chunks", "removed_bytes"])

    return joined.mapInArrow(remove, with_fields(plain, n_chunks="long", removed_chunks="long", removed_bytes="long")).toDF(*docs.columns, *counts)
