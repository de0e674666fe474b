"""Concatenate and cut: documents become one stream of token ids, cut into windows of a fixed length.

First pass: tokenise, and write each document's ids with the number of the task and the place in that
task's stream. The written table is what fixes the order, so a retried task can't change it. The totals
of the tasks give, by a prefix sum over one small row per task, where each task's stream begins. Second
pass: every document finds its global place by itself and is cut at the window borders. Nothing is
shuffled but one row per task, and no window is ever gathered to be filled.

Null and empty texts are documents of one token, the end token. Null ids are kept as null; rows that
repeat an id are packed as often as they occur. Other columns are not used. An empty table gives no
piece. A text of any length is cut into as many pieces as it takes.
"""

from __future__ import annotations

import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import documents, stage
from marquee.llm.pretokens import LONG, REMEMBERED, PreTokenizer

#: Rows of one output batch: so many ids at most, or one document.
BATCH_IDS = 1 << 20
END_ID = 2
WINDOW = 4096
WIDE = np.dtype("<u4")


class WordIds(PreTokenizer):
    """Ids of whole texts by a tokenizer that drops white space: what stands between white space is encoded once."""

    def __init__(self, path: str):
        super().__init__(path, words=True)
        self.chunks: dict[str, bytes] = {}

    def chunk(self, chunk: str) -> bytes:
        encode = self.library.model.tokenize
        ids = array.array("I")
        for piece in self.cut(chunk):
            ids.extend([t.id for t in encode(piece.encode().decode("latin-1").translate(self.alphabet))])
        found = ids.tobytes()
        if len(chunk) <= LONG:
            if len(self.chunks) >= REMEMBERED:
                self.chunks = {}
            self.chunks[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit ids."""
        if not self.plain(text):
            return array.array("I", self.whole(text)).tobytes()
        chunks = text.split()
        found = list(map(self.chunks.get, chunks))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    value = self.chunks.get(chunks[i])
                    found[i] = self.chunk(chunks[i]) if value is None else value
        return b"".join(found)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per Python worker, so that later tasks find what earlier ones have encoded."""
    return WordIds(path)


STREAM = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.int64()), ("ids", pa.binary())])
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                   ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = BATCH_IDS * 4) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is bytes, in batches of about ``size`` bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[-1]) + 64
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def narrow(ids: bytes) -> bytes:
    """Half the width where every id allows it; the count of the tokens tells which it is."""
    wide = np.frombuffer(ids, WIDE)
    return wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else ids


def widen(ids: bytes, tokens: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype(WIDE).tobytes() if len(ids) == 2 * tokens else ids


def token_stream(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """First pass: one row per document with its ids and its place in the stream of its task; written and read back."""
    end = array.array("I", [end_id]).tobytes()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_ids(tokenizer), TaskContext.get().partitionId()

        def rows():
            place = 0
            for batch in parts:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = encoder.ids(text.as_py()) + end
                    yield part, place, doc_id.as_py(), len(ids) // 4, narrow(ids)
                    place += len(ids) // 4

        yield from batches(rows(), STREAM)

    schema = "part int, place long, doc_id long, tokens long, ids binary"
    return stage(documents(docs).mapInArrow(encode, schema), "token-stream")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and the ids (unsigned 32-bit, little-endian).

    Every sequence is full but the last one, which is left as long as it is if that is a power of two and
    is to be padded otherwise (see ``padding``).
    """
    stream = token_stream(docs, tokenizer, end_id)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the first pass: what the scheduler holds anyway bounds this broadcast.
    offsets = (stream.groupBy("part").agg(F.sum("tokens").alias("total"))
               .select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("begin")))
    placed = stream.join(F.broadcast(offsets), "part").select("doc_id", "tokens", (F.col("begin") + F.col("place")).alias("at"), "ids")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in parts:
                for doc_id, tokens, at, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids, start = memoryview(widen(ids, tokens)), 0
                    while start < tokens:
                        sequence, offset = divmod(at + start, window)
                        length = min(window - offset, tokens - start)
                        yield doc_id, start, length, tokens, sequence, offset, bytes(ids[4 * start:4 * (start + length)])
                        start += length

        yield from batches(rows(), PIECE)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed windows: sequence_id, n_tokens, ids, and the boundary records of what lies in it (at most one window per group)."""
    members = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return (pieces.groupBy("sequence_id").agg(members.alias("m"))
            .select("sequence_id", F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"),
                    F.aggregate("m", F.unhex(F.lit("")), lambda b, x: F.concat(b, x["ids"])).alias("ids"),
                    F.transform("m", lambda x: F.struct(x["offset"], x["doc_id"], x["start"], x["length"])).alias("boundaries")))


def padding(n_tokens: Column, window: int = WINDOW) -> Column:
    """Tokens of padding that a sequence of this length needs: none at a power of two."""
    return F.when(F.bit_count(n_tokens) == 1, F.lit(0).cast("long")).otherwise(F.lit(window) - n_tokens)
